"""Versioned tables: runs as partitions of parquet tables, one row a run in ``runs``, written last; fingerprints; sinks."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import neutralise

RUNS = "run_id string, kind string, status string, schema_version int, created_at timestamp, as_of timestamp, dataset_id string, model string, counts map<string,bigint>, warnings array<string>, owners map<string,string>"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a fresh local one where that is unset and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a table of summaries is broadcast.
FEW = 10_000


def join_summary(rows: DataFrame, summary: DataFrame, key: str | list[str], most: int = FEW) -> DataFrame:
    """``rows`` joined with one summary row a key: by broadcast if there are no more than ``most`` of these, so that no key's rows meet in a task."""
    few = summary.limit(most + 1).collect()
    if len(few) > most:
        return rows.join(summary, key)
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(few, summary.schema)), key)


LIMBS = 4
WRAP = 1 << 32


#: Columns up to which a row's text is one expression; of more, each value is made text once and the parts are an array, as one expression of them all is too long to be compiled well.
NARROW = 24


def row_text(columns: list[str]) -> Column:
    """A row as one text that no other row has: per column the length and text of its value, or ``n`` for null."""
    part = lambda t: F.when(t.isNull(), "n").otherwise(F.concat(F.length(t).cast("string"), F.lit(":"), t))
    texts = [F.col(f"`{c}`").cast("string") for c in columns]
    return F.concat_ws("|", *map(part, texts)) if len(texts) <= NARROW else F.concat_ws("|", F.transform(F.array(*texts), part))


def fingerprint(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """(rows, digest), for each value of ``by`` if given: a count and a digest of the rows in any order.

    The digest is a multiset hash: the first 128 bits of each row's SHA-256 are four whole numbers, which are summed modulo 2^32. So
    repeated rows count, digests of parts add up to that of the whole (``add_fingerprints``), any engine with SHA-256 can compute
    it, and each task sends no more than its sums.
    """
    h = F.sha2(row_text(sorted(columns or df.columns)).cast("binary"), 256)
    limbs = df.select(*(by or []), *(F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)").alias(f"_{i}") for i in range(LIMBS)))
    sums = limbs.groupBy(*(by or [])).agg(F.count("*").alias("rows"), *(F.coalesce(F.sum(f"_{i}"), F.lit(0)).alias(f"_{i}") for i in range(LIMBS)))
    shown = F.concat(*(F.lpad(F.hex((F.col(f"_{i}") % WRAP).cast("bigint")), 8, "0") for i in range(LIMBS)))
    return sums.select(*(by or []), "rows", F.lower(shown).alias("digest"))


def add_fingerprints(parts: list[tuple[int, str]]) -> tuple[int, str]:
    """(rows, digest) of the rows of all parts together."""
    limbs = [sum(int(d[8 * i : 8 * i + 8], 16) for _, d in parts) % WRAP for i in range(LIMBS)]
    return sum(n for n, _ in parts), "".join(f"{v:08x}" for v in limbs)


def fingerprint_sql(table: str, columns: list[str]) -> str:
    """DuckDB SQL of ``fingerprint``'s row for a table."""
    one = lambda c: f"CASE WHEN {c} IS NULL THEN 'n' ELSE concat(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR), ':', CAST({c} AS VARCHAR)) END"
    sums = ", ".join(f"lpad(lower(to_hex(CAST(coalesce(SUM(CAST(concat('0x', substr(h, {8 * i + 1}, 8)) AS HUGEINT)), 0) % {WRAP} AS BIGINT))), 8, '0')" for i in range(LIMBS))
    return f"SELECT COUNT(*) AS rows, concat({sums}) AS digest FROM (SELECT sha256(concat_ws('|', {', '.join(map(one, sorted(columns)))})) AS h FROM {table}) t"


def record_digest(columns: list[str]):
    """SHA-256 of a record's canonical JSON (nulls kept)."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


class Store:
    """Tables of a folder, partitioned by run. A run exists once its row stands in ``runs``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def publish(self, run_id: str, kind: str, tables: dict[str, DataFrame], as_of: str | None = None, dataset_id: str | None = None, model: str | None = None,
                warnings: list[str] | None = None, sort: dict[str, list[str]] | None = None, partition: dict[str, str] | None = None,
                base: str | None = None, replaces: dict[str, list] | None = None) -> None:
        """Write the tables of a run, check them by fingerprint, then its row.

        ``sort`` gives a table's order, over all its files; ``partition`` a column by whose values its files lie in folders of their
        own, each with its own fingerprint, so that a reader of some of them verifies no others.

        With ``base``, an earlier run, its partitions stand for those that this run doesn't write: they are neither read nor copied.
        ``replaces`` gives for a table the partitions that this run decides on, written or not (a season whose rows are all gone); its
        rows must lie in these.
        """
        counts, owners = {}, {}
        before = self._run(base) if base else None
        for name, df in tables.items():
            order, column = (sort or {}).get(name), (partition or {}).get(name)
            path = f"{self.root}/{name}/run_id={run_id}"
            writer = (df.orderBy(*([column] if column else []), *order) if order else df).write.mode("errorifexists")
            (writer.partitionBy(column) if column else writer).parquet(path)
            back = self._read(path, df.schema)
            if column:
                parts = {str(r[column]): (r["rows"], r["digest"]) for r in fingerprint(back, by=[column]).collect()}  # partitions of one table
                mine = {str(v) for v in (replaces or {}).get(name, parts)}
                if not set(parts) <= mine:
                    raise ValueError(f"run {run_id}, table {name}: rows outside the partitions that it replaces")
                owners |= {f"{name}/{v}": run_id for v in parts}
                if before is not None:
                    if f"{name}:by:{column}" not in before["counts"]:
                        raise ValueError(f"run {base} has no table {name} partitioned by {column}")
                    kept = {v: found for v, found in self.partitions(name, base).items() if v not in mine}
                    owners |= {f"{name}/{v}": before["owners"][f"{name}/{v}"] for v in kept}
                    parts |= kept
                counts[f"{name}:by:{column}"] = len(parts)
                for value, found in parts.items():
                    self._note(counts, f"{name}/{value}", found)
                whole = add_fingerprints(list(parts.values()))
            elif before is not None:
                raise ValueError(f"run {run_id}, table {name}: a table on a base needs partitions")
            else:
                whole = fingerprint(back).first()
            self._note(counts, name, whole)
        row = self.spark.createDataFrame([(run_id, kind, "complete", 1, None, None, dataset_id, model, counts, warnings or [], owners)], RUNS)
        row = row.withColumns({"created_at": F.current_timestamp(), "as_of": F.lit(as_of).cast("timestamp")})
        row.write.mode("append").parquet(f"{self.root}/runs")

    @staticmethod
    def _note(counts: dict, name: str, found: tuple[int, str]) -> None:
        counts[name] = found[0]
        counts |= {f"{name}:{i}": int(found[1][8 * i : 8 * i + 8], 16) for i in range(LIMBS)}

    def _read(self, path: str, schema: T.StructType | None = None) -> DataFrame:
        reader = self.spark.read.option("basePath", path)
        return (reader.schema(schema) if schema else reader).parquet(path)

    def _run(self, run_id: str):
        run = self.runs().where(F.col("run_id") == run_id).first()
        if run is None:
            raise ValueError(f"no complete run {run_id}")
        return run

    def partitions(self, name: str, run_id: str) -> dict[str, tuple[int, str]]:
        """(rows, digest) of each partition of a run's table, as its row in ``runs`` has them; no data are read."""
        counts = self._run(run_id)["counts"]
        keys = [k for k in counts if k.startswith(f"{name}/") and not re.search(r":\d$", k)]
        return {k.removeprefix(f"{name}/"): (counts[k], "".join(f"{counts[f'{k}:{i}']:08x}" for i in range(LIMBS))) for k in keys}

    def changed(self, name: str, old: str, new: str) -> list[str]:
        """The partitions, as text, in which two runs' tables differ: by their digests alone."""
        a, b = self.partitions(name, old), self.partitions(name, new)
        return sorted(v for v in a.keys() | b.keys() if a.get(v) != b.get(v))

    def _rows(self, name: str, run) -> DataFrame:
        """A run's table: the files that it wrote, and those of the runs that its other partitions come from."""
        column = next((k.split(":by:")[1] for k in run["counts"] if k.startswith(f"{name}:by:")), None)
        owners: dict[str, list[str]] = {}
        for key, owner in (run["owners"] or {}).items():
            if key.startswith(f"{name}/"):
                owners.setdefault(owner, []).append(key.removeprefix(f"{name}/"))
        path = lambda owner: f"{self.root}/{name}/run_id={owner}"
        if column is None or set(owners) <= {run["run_id"]}:
            return self._read(path(run["run_id"]))
        return union_all([self._read(path(o)).where(F.col(column).cast("string").isin(values)) for o, values in sorted(owners.items())])

    def runs(self, kind: str | None = None) -> DataFrame:
        df = self.spark.read.schema(RUNS).parquet(f"{self.root}/runs").where("status = 'complete'")
        return (df.where(F.col("kind") == kind) if kind else df).orderBy("created_at", "run_id")

    def newest(self, kind: str) -> str | None:
        return newest(self.runs(kind))

    def load(self, name: str, run_id: str, required: list[str] | None = None, only: list | None = None) -> DataFrame:
        """A table of a run, verified: status, columns, row count and digest; with ``only``, the partitions of these values, which alone are read."""
        run = self._run(run_id)
        df, counts = self._rows(name, run), run["counts"]
        missing = set(required or []) - set(df.columns)
        if missing:
            raise ValueError(f"run {run_id}, table {name}: missing columns {sorted(missing)}")
        if only is None:
            found = {name: tuple(fingerprint(df).first())}
        else:
            column = next((k.split(":by:")[1] for k in counts if k.startswith(f"{name}:by:")), None)
            if column is None:
                raise ValueError(f"run {run_id}, table {name}: it was published without partitions")
            df = df.where(F.col(column).isin(list(only)))
            there = {str(r[column]): (r["rows"], r["digest"]) for r in fingerprint(df, by=[column]).collect()}
            found = {f"{name}/{v}": there.get(str(v), (0, "0" * 8 * LIMBS)) for v in only if f"{name}/{v}" in counts or str(v) in there}
        for key, what in found.items():
            said: dict = {}
            self._note(said, key, what)
            if any(counts.get(k) != v for k, v in said.items()):
                raise ValueError(f"run {run_id}, table {key}: content differs from what was published")
        return df

    def written(self, name: str, run_id: str) -> DataFrame:
        """A table that ``publish`` has just written: its digest was taken from the files then, so it isn't read for that again."""
        return self._rows(name, self._run(run_id))

    def all_runs(self, name: str, kind: str, columns: list[str] | None = None) -> DataFrame:
        """A table over all complete runs of a kind, with lineage columns source_run, run_created and run_as_of."""
        runs = self.runs(kind).select(F.col("run_id").alias("source_run"), F.col("created_at").alias("run_created"), F.col("as_of").alias("run_as_of"))
        df = self.spark.read.option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}").withColumnRenamed("run_id", "source_run")
        return join_summary(df.select("source_run", *columns) if columns else df, runs, "source_run")

    def activate(self, run_id: str, names: list[str]) -> None:
        """Point the current tables, temp views, at a run."""
        for name in names:
            self.load(name, run_id).createOrReplaceTempView(f"current_{name}")


def newest(runs: DataFrame) -> str | None:
    return runs.agg(F.max_by("run_id", F.struct("created_at", "run_id"))).first()[0]


def safe_export(df: DataFrame) -> DataFrame:
    """Text columns neutralised for spreadsheets, timestamps without zone."""
    kinds = dict(df.dtypes)
    out = {c: neutralise(c) for c in df.columns if kinds[c] == "string"} | {c: F.col(c).cast("timestamp_ntz") for c in df.columns if kinds[c] == "timestamp"}
    return df.withColumns(out) if out else df


def write_csv(df: DataFrame, path: str) -> None:
    safe_export(df).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_table(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    """CSV or parquet under an explicit schema."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
