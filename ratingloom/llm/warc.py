"""WARC archives: written as text records by Spark, read back by boundary-chain verification.

Writing: of the pages with equal payloads of at least ``MIN_DEDUP`` bytes, the one with the largest id becomes a response record
and the others revisit it. A record is one value of Spark's text writer, and the record terminator is its line separator. A
file holds a bounded number of records.

Reading: Spark's text reader cuts the files at every occurrence of the magic line, in splits, so a file needn't fit a task.
Each segment is a candidate record: its header says where its successor must start. Per file, pointer jumping over these
offsets from the file's start marks the reachable candidates; a magic line inside a payload is never reached, and its segment
is part of the record before it. Only offsets and header fields are shuffled. Payloads that hold a magic line are pieced
together from the segments of their file in a second pass over such files alone. A file's offsets and header fields (some 300
bytes a record) go to one task, so archives are meant to be cut into files of a million records at most, as they usually are.

Edge cases: a null payload is empty; null ids and URLs are empty header fields and come back as null; line breaks in URLs are
percent-encoded; in text ids they and blanks are too, and decoded when read; rows that repeat the largest id of a payload are all responses; an empty table gives no records; what follows
a broken record in a file isn't reachable and is left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, cut, join_unique, scratch

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
MIN_DEDUP = 1000
RECORDS_PER_FILE = 2000
#: Repeated payloads up to this many are broadcast as (digest, id) rows of about 60 bytes; beyond it the join is shuffled.
MAX_BROADCAST_ROWS = 100_000
DATE = "2024-01-01T00:00:00Z"


def header(fields: list[tuple[str, Column]]) -> Column:
    return F.concat(F.lit(MAGIC), *(F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("")), F.lit("\r\n")) for name, value in fields))


#: What can't stand in a header field as it is, and how it is written there; the percent sign goes first, and last when read.
ESCAPES = (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), (" ", "%20"), ("\t", "%09"))


def escaped(value: Column) -> Column:
    for a, b in ESCAPES:
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def unescaped(value: Column) -> Column:
    for a, b in reversed(ESCAPES):
        value = F.replace(value, F.lit(b), F.lit(a))
    return value


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """One column, ``value``: the text of each page's record without its terminator."""
    text = F.coalesce(F.col(payload_col), F.lit(""))
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text.alias("payload"))
    base = base.withColumns({"bytes": F.octet_length("payload"), "digest": F.sha1(F.col("payload").cast("binary"))})
    large = base.where(F.col("bytes") >= MIN_DEDUP).select("digest", "id")
    twins = cut(large.groupBy(F.col("digest").alias("twin")).agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    size = twins.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("pages")).first()
    few = size["rows"] <= MAX_BROADCAST_ROWS
    hot = [] if few else [r["twin"] for r in twins.where(F.col("n") * HOT_SHARE > size["pages"]).select("twin").collect()]
    twins = twins.select("twin", "first")
    # small payloads have no twin: each has a key of its own, so that equal ones don't meet
    keyed = base.withColumn("twin", F.when(F.col("bytes") >= MIN_DEDUP, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    joined = join_unique(keyed, F.broadcast(twins) if few else twins, "twin", hot, "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    key = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    uuid = F.concat_ws("-", *(F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    common = [("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", url), ("X-Page-ID", escaped(F.col("id").cast("string"))),
              ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), ("X-Payload-Length", F.col("bytes"))]
    block = F.concat(F.lit(HTTP + END), "payload")
    full = F.concat(header([("WARC-Type", F.lit("response")), *common, ("Content-Type", F.lit("application/http;msgtype=response")), ("Content-Length", F.octet_length(block))]), F.lit("\r\n"), block)
    again = F.concat(header([("WARC-Type", F.lit("revisit")), *common, ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")), ("X-Refers-To-Page", escaped(F.col("first").cast("string"))), ("Content-Length", F.lit(0))]), F.lit("\r\n"))
    return joined.select(F.when(revisit, again).otherwise(full).alias("value"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", per_file: int = RECORDS_PER_FILE) -> None:
    records(pages, id_col, url_col, payload_col).write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(path)


def _field(name: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}:([^\r\n]*)", 1)), F.lit(""))


def segments(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magic lines, with the place of each in its file's order and the header fields of a record that may start there."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    out = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), "value")
    out = out.withColumn("head", F.substring_index("value", END, 1))
    return out.withColumns({"size": F.octet_length("value").cast("long"), "head_size": F.octet_length("head").cast("long"), "content": _field("Content-Length").try_cast("long")})


def payload_of(value: Column, head: Column) -> Column:
    """The payload of a response record's text: after the record's and the HTTP header, before the terminator."""
    block = F.substr(value, F.length(head) + 5)
    http = F.substring_index(block, END, 1)
    return F.substr(block, F.length(http) + 5, F.length(block) - F.length(http) - 8)


def chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Offsets of a file's segments, and the reachable record to which each belongs (-1: none)."""
    pdf = pdf.sort_values(["block", "nth"], kind="stable").reset_index(drop=True)
    size = pdf["size"].to_numpy(np.int64)
    n, magic = len(pdf), len(MAGIC)
    offset = np.cumsum(size + magic) - size - 2 * magic  # of the magic line before the segment; negative for what stands before the first
    total = int(size.sum()) + magic * (n - 1)
    content = pdf["content"].fillna(-1).to_numpy(np.int64)
    after = offset + magic + pdf["head_size"].to_numpy(np.int64) + 8 + content
    known = (content >= 0) & (offset >= 0)
    jump = np.full(n + 1, n)
    at = np.minimum(np.searchsorted(offset, after), n - 1)
    jump[:n] = np.where(known & (offset[at] == after), at, n)
    ends = known & ((jump[:n] < n) | (after == total))  # a record's end must be a boundary too
    reach = np.zeros(n + 1, bool)
    first = np.flatnonzero(offset == 0)
    reach[first] = ends[first]
    for _ in range(max(1, n).bit_length()):
        reach[jump[reach]] = True
        jump = jump[jump]
    reach = reach[:n] & ends
    record = np.maximum.accumulate(np.where(reach, offset, -1))
    return pdf.assign(offset=offset, record=record, starts=reach)


FIELDS = {"warc_type": "WARC-Type", "page": "X-Page-ID", "url": "WARC-Target-URI", "digest": "WARC-Payload-Digest", "length": "X-Payload-Length", "refers": "X-Refers-To-Page"}


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each reachable record: file, offset, the header fields, and size and SHA-1 of the payload as read."""
    seg = segments(spark, path)
    body = payload_of(F.col("value"), F.col("head"))
    narrow = seg.select("file", "block", "nth", "size", "head_size", "content", *(_field(v).alias(k) for k, v in FIELDS.items()), F.sha1(body.cast("binary")).alias("read_digest"), F.octet_length(body).cast("long").alias("read_bytes"))
    kind = "file string, block long, nth long, size long, head_size long, content long, " + ", ".join(f"{k} string" for k in FIELDS) + ", read_digest string, read_bytes long, offset long, record long, starts boolean"
    chained = narrow.groupBy("file").applyInPandas(chain, kind).where("record >= 0")
    parts = cut(chained.groupBy("file", "record").agg(F.count("*").alias("n"), *(F.max(F.when(F.col("starts"), F.col(c))).alias(c) for c in (*FIELDS, "read_digest", "read_bytes"))))
    split = parts.where("n > 1").select("file").distinct()
    found = parts.select("file", F.col("record").alias("offset"), *FIELDS, "n", "read_digest", "read_bytes")
    if split.isEmpty():
        return found.drop("n")
    # payloads with magic lines inside: the segments of their files once more, with their text
    texts = seg.join(split, "file", "left_semi").select("file", "block", "nth", "size", "head_size", "content", "head", "value")
    kind = "file string, block long, nth long, size long, head_size long, content long, head string, value string, offset long, record long, starts boolean"
    whole = texts.groupBy("file").applyInPandas(chain, kind).where("record >= 0").groupBy("file", "record").agg(
        F.count("*").alias("n"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"]), MAGIC).alias("value"),
        F.max(F.when(F.col("starts"), F.col("head"))).alias("head"),
    ).where("n > 1")
    body = payload_of(F.col("value"), F.col("head"))
    fixed = whole.select("file", F.col("record").alias("offset"), F.sha1(body.cast("binary")).alias("whole_digest"), F.octet_length(body).cast("long").alias("whole_bytes"))
    joined = found.join(fixed, ["file", "offset"], "left")
    return joined.select("file", "offset", *FIELDS, F.coalesce("whole_digest", "read_digest").alias("read_digest"), F.coalesce("whole_bytes", "read_bytes").alias("read_bytes"))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of each page, from archives written to the shared folder and read back."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write(pages, path, id_col, url_col, payload_col)
    kind = dict(pages.dtypes)[id_col]
    response = F.col("warc_type") == "response"
    return read(spark, path).select(
        unescaped(F.col("page")).cast(kind).alias(id_col),
        F.when(response, F.col("read_bytes")).otherwise(F.col("length").cast("long")).alias("payload_bytes"),
        F.when(response, F.col("read_digest")).otherwise(F.regexp_replace("digest", "^sha1:", "")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        unescaped(F.col("refers")).cast(kind).alias("refers_to"),
    )


def roundtrip_sql() -> str:
    """DuckDB SQL of the round trip's rows."""
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= {MIN_DEDUP} THEN MAX(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM m"""
