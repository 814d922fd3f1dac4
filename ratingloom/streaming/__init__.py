"""Incremental snapshots: landed schedule files stream in, and each micro-batch is merged into the current games."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import GAMES, conform
from ..sources.raw_json import read_schedule
from .versioned import VersionStore


def stream_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (file, payload) of JSON files as they land."""
    raw = spark.readStream.schema("value string").option("wholetext", True).format("text").load(folder)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("payload"))


RECORD = T.StructType([*GAMES.fields, T.StructField("season_type", T.StringType())])


def game_store(spark: SparkSession, root: str) -> VersionStore:
    return VersionStore(spark, root, RECORD)


def current_games(spark: SparkSession, root: str, seasons=None, before: int | None = None) -> DataFrame:
    """The games as of the last batch (or of the one before ``before``), of all seasons or of some."""
    return game_store(spark, root).current(seasons, before)


def merge_batch(root: str, compact_every: int = 20):
    """A ``foreachBatch`` function: the batch's records become versions in the store under ``root``.

    A file may hold a game once, and several files of a batch may hold versions of it. Records that break a rule go to
    ``quarantine/batch=<id>``. A season with ``compact_every`` deltas is compacted. A replayed batch writes the same folders again, so
    a restart neither loses nor doubles a record.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        new, rejected = read_schedule(batch, source="file")
        version = {"run_id": F.concat_ws("/", F.lit(f"batch-{batch_id:08d}"), "file"), "captured_at": F.lit(batch_id).cast("timestamp")}
        rejected.write.mode("overwrite").parquet(f"{root}/quarantine/batch={batch_id}")
        store = game_store(batch.sparkSession, root)
        rows = conform(new.withColumns(version), GAMES)
        rows = rows if "season_type" in rows.columns else rows.withColumn("season_type", F.lit(None).cast("string"))
        for season in store.append(rows, batch_id):
            if len(store.parts(season)) > compact_every:
                store.compact(season, batch_id)

    return write


def decision_batch(root: str):
    """A ``foreachBatch`` function for decisions (game_id, digest): those that fit settle their games, the others go to ``refused/batch=<id>``.
    Its batches are numbered on their own, so a decision counts for all versions that the store has when it comes."""

    def write(batch: DataFrame, batch_id: int) -> None:
        store = game_store(batch.sparkSession, root)
        newest = store.versions().agg(F.max("batch")).first()[0]
        refused = store.decide(batch, -1 if newest is None else newest, batch_id)
        refused.write.mode("overwrite").parquet(f"{root}/refused/batch={batch_id}")

    return write


def run_available(spark: SparkSession, folder: str, root: str) -> None:
    """Merge all files that have landed, then stop; state is kept in ``root``."""
    query = stream_snapshots(spark, folder).writeStream.foreachBatch(merge_batch(root)).option("checkpointLocation", f"{root}/_state").trigger(availableNow=True).start()
    query.awaitTermination()
