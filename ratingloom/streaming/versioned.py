"""A store of game versions that streams write to: deltas per batch, compacted bases, and conflicts that stay open until decided.

A folder a season: ``versions/season=<s>/part=delta-<n>`` has the versions that batch n brought and the season didn't have yet, and
``part=base-<n>`` all that is worth keeping of the batches up to n. A reader takes the newest finished base and the deltas after
it, of the seasons it asks for and no others, so a batch costs what it touches whatever the store holds. ``decisions`` is laid out
alike. Every folder is written whole: a batch or a compaction that is repeated after a failure writes the same folders again, and
readers see a base only when it is finished.

A game's state comes from its versions in order of batches: one distinct completed record stands, or one distinct upcoming record
while none is completed; what makes them two opens a conflict, and the record that stood before goes on standing (none, if the
first batch disagrees with itself). A decision names the record that holds (by its digest): of the versions up to the decision's
batch the others are ruled out, and don't come back if they are sent again. A later, different record opens a new conflict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import cut, record_digest

STAMPS = ("run_id", "captured_at")


class VersionStore:
    """Versions of games (``columns``: a schema with game_id, completed and the partition column) under ``root``."""

    def __init__(self, spark: SparkSession, root: str, columns: T.StructType, part: str = "season"):
        self.spark, self.root, self.part, self.names = spark, root.rstrip("/"), part, columns.names
        self.schema = T.StructType([*(f for f in columns if f.name != part), T.StructField("run_id", T.StringType()), T.StructField("captured_at", T.TimestampType()), T.StructField("digest", T.StringType()),
                                    T.StructField("ruled_out", T.BooleanType()), T.StructField("batch", T.LongType()), columns[part], T.StructField("part", T.StringType())])
        self.decided = T.StructType([T.StructField("game_id", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("batch", T.LongType()), T.StructField("number", T.LongType()), columns[part], T.StructField("part", T.StringType())])

    # --- folders

    def _folders(self, table: str, below: str = "") -> list[str]:
        """Names of the folders in a folder of the store."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}{below}")
        fs = path.getFileSystem(conf)
        return [x.getPath().getName() for x in fs.listStatus(path) if x.isDirectory()] if fs.exists(path) else []

    def _finished(self, table: str, below: str) -> bool:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}{below}/_SUCCESS")
        return path.getFileSystem(conf).exists(path)

    def parts(self, season, table: str = "versions") -> list[str]:
        """The newest finished base of a season and the deltas after it, oldest first."""
        below = f"/{self.part}={season}"
        names = sorted(n.removeprefix("part=") for n in self._folders(table, below) if n.startswith("part="))
        bases = [n for n in names if n.startswith("base-") and self._finished(table, f"{below}/part={n}")]
        first = bases[-1:] if bases else []
        since = first[0].removeprefix("base-") if first else ""
        return first + [n for n in names if n.startswith("delta-") and n.removeprefix("delta-") > since]

    def seasons(self) -> list[str]:
        return sorted(n.split("=", 1)[1] for n in self._folders("versions") if n.startswith(f"{self.part}="))

    def _read(self, table: str, schema: T.StructType, seasons, before: int | None) -> DataFrame:
        seasons = self.seasons() if seasons is None else seasons
        paths = [f"{self.root}/{table}/{self.part}={s}/part={n}" for s in seasons for n in self.parts(s, table)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths)
        return rows if before is None else rows.where(F.col("batch") < before)

    def versions(self, seasons=None, before: int | None = None) -> DataFrame:
        return self._read("versions", self.schema, seasons, before)

    def decisions(self, seasons=None, before: int | None = None) -> DataFrame:
        return self._read("decisions", self.decided, seasons, before)

    def _write(self, rows: DataFrame, table: str, batch: int) -> None:
        named = rows.withColumn("part", F.lit(f"delta-{batch:012d}"))
        named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.part, "part").parquet(f"{self.root}/{table}")

    # --- writing

    def append(self, new: DataFrame, batch: int) -> list:
        """Add a batch of versions (the record's columns, run_id, captured_at); returns the seasons that it touches."""
        rows = new.select(*self.names, *STAMPS).withColumn("digest", record_digest(sorted(self.names)))
        touched = sorted(r[0] for r in rows.select(self.part).distinct().collect())  # seasons of a batch: few
        if not touched:
            return []
        known = self.versions(touched, batch).select("game_id", "digest")
        once = Window.partitionBy("game_id", "digest").orderBy("captured_at", "run_id")
        fresh = rows.join(known, ["game_id", "digest"], "left_anti").withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
        self._write(fresh.withColumns({"ruled_out": F.lit(False), "batch": F.lit(batch).cast("long")}), "versions", batch)
        return touched

    def decide(self, decisions: DataFrame, batch: int, number: int | None = None) -> DataFrame:
        """Add decisions (game_id, digest) on conflicts that are open after ``batch``; returns (game_id, digest, rule) of those that
        don't fit. ``number`` counts the calls (by default it is the batch); a call that is repeated has the same. If the decisions
        name their seasons, only these are read."""
        number = batch if number is None else number
        seasons = sorted(r[0] for r in decisions.select(self.part).distinct().collect()) if self.part in decisions.columns else None
        open_ = self._conflicts(seasons, batch + 1, number)
        asked = decisions.select("game_id", "digest").distinct().withColumn("_n", F.count("*").over(Window.partitionBy("game_id")))
        found = asked.join(open_.select("game_id", "digest", self.part), ["game_id", "digest"], "left").join(open_.select("game_id", F.lit(True).alias("_open")).distinct(), "game_id", "left")
        rule = F.when(F.col("_n") > 1, "decided_twice").when(F.col("_open").isNull(), "no_such_conflict").when(F.col(self.part).isNull(), "no_such_candidate")
        checked = cut(found.withColumn("rule", rule))
        self._write(checked.where("rule IS NULL").select("game_id", "digest", F.lit(batch).cast("long").alias("batch"), F.lit(number).cast("long").alias("number"), self.part), "decisions", number)
        return checked.where("rule IS NOT NULL").select("game_id", "digest", "rule")

    # --- reading

    def _ruled(self, seasons, before: int | None, number: int | None = None) -> DataFrame:
        """Versions with ``ruled_out`` as the newest decision on their game has it (of those before ``number``)."""
        given = self.decisions(seasons, before)
        given = given if number is None else given.where(F.col("number") < number)
        last = given.groupBy("game_id").agg(F.max_by(F.struct("digest", "batch"), F.struct("batch", "number")).alias("d"))
        rows = self.versions(seasons, before).drop("part").join(last, "game_id", "left")
        return rows.withColumn("ruled_out", F.col("ruled_out") | F.coalesce((F.col("batch") <= F.col("d.batch")) & (F.col("digest") != F.col("d.digest")), F.lit(False))).drop("d")

    def _states(self, seasons, before: int | None, number: int | None = None) -> DataFrame:
        """Versions that count, with what their game's state is after each batch: completed and all records so far, and both at the end."""
        so_far = Window.partitionBy("game_id").orderBy("batch").rangeBetween(Window.unboundedPreceding, 0)
        game = Window.partitionBy("game_id")
        rows = self._ruled(seasons, before, number).where("NOT ruled_out")
        done = F.col("completed").cast("int")
        return rows.withColumns({"_done": F.sum(done).over(so_far), "_any": F.count("*").over(so_far), "_all_done": F.sum(done).over(game), "_all": F.count("*").over(game)})

    def current(self, seasons=None, before: int | None = None) -> DataFrame:
        """The record that stands of each game, of the seasons asked for (by default all) and of the batches before one."""
        agreed = (F.col("_done") == 1) | (F.col("_done") == 0) & (F.col("_any") == 1)
        rows = self._states(seasons, before).withColumn("_agreed", agreed)
        # the state of a batch is on all its rows; the newest agreed batch tells which record stands
        newest = rows.where("_agreed").groupBy("game_id").agg(F.max("batch").alias("_batch"), F.max_by("_done", "batch").alias("_k"))
        stands = rows.join(newest, "game_id").where((F.col("batch") <= F.col("_batch")) & ((F.col("_k") == 0) | F.col("completed")))
        return stands.select(*self.names)

    def conflicts(self, seasons=None, before: int | None = None) -> DataFrame:
        """(game_id, digest, run_id, batch, season) of the records between which an open conflict is."""
        return self._conflicts(seasons, before)

    def _conflicts(self, seasons, before: int | None, number: int | None = None) -> DataFrame:
        rows = self._states(seasons, before, number)
        split = (F.col("_all_done") > 1) & F.col("completed") | (F.col("_all_done") == 0) & (F.col("_all") > 1)
        return rows.where(split).select("game_id", "digest", "run_id", "batch", self.part)

    # --- compaction

    def compact(self, season, upto: int) -> str:
        """Write a season's base of the batches up to ``upto``: upcoming records that a single completed one has replaced go, what
        was ruled out stays as such. Repeating it changes nothing; what the base replaces is left for ``vacuum``."""
        name = f"base-{upto:012d}"
        if name in self.parts(season):
            return name
        game = Window.partitionBy("game_id")
        counts = F.sum((F.col("completed") & ~F.col("ruled_out")).cast("int")).over(game)
        rows = self._ruled([season], upto + 1).withColumn("_k", counts).where("_k <> 1 OR completed OR ruled_out")
        kept = [c for c in self.schema.names if c not in (self.part, "part")]
        rows.select(*kept).write.mode("overwrite").parquet(f"{self.root}/versions/{self.part}={season}/part={name}")
        return name

    def vacuum(self, season) -> list[str]:
        """Delete the parts of a season that its newest finished base replaces. Call it when no reader uses them any more."""
        live = self.parts(season)
        base = next((n for n in live if n.startswith("base-")), None)
        if base is None:
            return []
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        gone = []
        for name in self._folders("versions", f"/{self.part}={season}"):
            part = name.removeprefix("part=")
            if part not in live and part.split("-")[1] <= base.split("-")[1]:
                path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions/{self.part}={season}/{name}")
                path.getFileSystem(conf).delete(path, True)
                gone.append(part)
        return sorted(gone)
