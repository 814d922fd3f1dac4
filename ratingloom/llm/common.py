"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java/Python regex class of the white space that separates words; ``bytes.split()`` splits on the same six bytes.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a fresh local one where that is unset and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in an Arrow batch than by default: texts may be long, and a worker holds a batch several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


#: A key is hot if it holds more than one row in so many; so there are fewer hot keys than this, whatever the data.
HOT_SHARE = 1000


def hot_keys(rows: DataFrame, key: str, weight: str | None = None) -> list:
    """The values of ``key`` with more than a ``HOT_SHARE``-th of all rows (of the sum of ``weight``, where a row stands for several)."""
    n = F.count("*") if weight is None else F.sum(weight)
    whole = rows.agg(n).first()[0] or 0
    return [r[0] for r in rows.where(F.col(key).isNotNull()).groupBy(key).agg(n.alias("_n")).where(F.col("_n") * HOT_SHARE > whole).collect()]


#: Slices into which the rows of a hot key are dealt.
SALTS = 64


def join_unique(rows: DataFrame, unique: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """``rows`` joined with a table of at most one row a key. The rows of ``hot`` keys are dealt to ``SALTS`` slices in turn (equal rows
    too), and their partners go to each slice, so that no task gets all rows of a key. Columns of any type may be there."""
    if not hot:
        return rows.join(unique, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    dealt = rows.withColumn("_salt", F.when(is_hot, (F.monotonically_increasing_id() % SALTS).cast("int")).otherwise(0))
    partners = unique.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(partners, [key, "_salt"], how).drop("_salt")
