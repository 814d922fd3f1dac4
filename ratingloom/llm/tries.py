"""Prefix trie of conversations by burst tries.

Every turn becomes an id of 16 bytes (the MD5 of its role and text), every conversation the string of its turns' ids. Equal
strings are one row, with the smallest conversation, their number and a digest of all their ids. All rows start in one container
under the trie's root. A container that holds more rows than ``BURST`` (or more turns than ``BURST_TURNS``, unless it holds one
row) bursts: the path that all its rows share becomes a chain of heads, and the rows go on to a container for each next turn id
(the row that ends at the last head stays there). So each burst divides its container, however long the shared path is. Rounds go on until no container is oversized. Then
the containers are sorted by Spark and swept in one pass, each into the nodes of its subtree; a worker holds the nodes of one
container at a time. Heads last: their counts come up from their containers, round by round, by aggregates with a partial step.

No step gathers the rows of a hot container, a hot path or its copies in one task: sizes and shared paths are minima, maxima and
counts; the join that tells rows of a burst salts hot containers; the sorted ids of a path's conversations are joined per range
of ``ID_RANGE`` ids and only these strings are put through the path's digest one after the other.

Edge cases: rows with a null conversation id take no part; a null role or text is empty; turns that tie are ordered by their id
in the trie, and a repeated row is a turn of its own; a conversation without turns belongs to the root alone; an empty table has
no nodes; other columns are left out. A conversation's turn ids (16 bytes and a count each, no texts) are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, cut, join_unique

ID = 16
BURST, BURST_TURNS = 256, 4096
ID_RANGE = 64
WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes that tell turns apart: the role's length is part of what is hashed."""
    return F.unhex(F.md5(F.concat_ws(":", F.octet_length(role).cast("string"), F.concat(role, text)).cast("binary")))


def paths(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: Column | None = None) -> DataFrame:
    """(conv, turns) of each conversation: its turns in order as (id, words). ``block``, a function of the conversation's id, deals
    the result: all conversations of a block are in one partition."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    turns = rows.where(F.col(conv).isNotNull()).select(F.col(conv).alias("conv"), F.struct(F.col(turn).alias("turn"), turn_id(r, t).alias("id"), F.coalesce(F.regexp_count(t, F.lit(WORD)), F.lit(0)).alias("words")).alias("t"))
    keys = ["conv"]
    if block is not None:
        keys = ["block", "conv"]
        turns = turns.withColumn("block", block)
        turns = turns.repartition(F.col("block"))
    kept = F.transform(F.sort_array(F.collect_list("t")), lambda x: F.struct(x["id"].alias("id"), x["words"].alias("words")))
    return turns.groupBy(*keys).agg(kept.alias("turns"))


def rebuilt(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", size: int = 20, heads: int = 4) -> DataFrame:
    """(conv, turns) with the head of each conversation taken from the first of its block of ``size`` ids: as many turns as the CRC-32
    of the id modulo ``heads`` says. A block is at most ``2 * size`` conversations, so its first one's head joins in place."""
    c = F.col("conv")
    base = c - c % size
    own = paths(rows, conv, turn, role, text, base)
    h = (F.crc32(c.cast("string").cast("binary")) % heads).cast("int")
    first = F.max(F.when(c == F.col("block"), F.slice("turns", 1, heads - 1)))
    blocks = own.groupBy("block").agg(F.collect_list(F.struct("conv", "turns")).alias("all"), first.alias("first"))
    lent = F.slice(F.coalesce("first", F.array().cast("array<struct<id:binary,words:int>>")), F.lit(1), h)
    tail = F.when(F.size("turns") > h, F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(1)))).otherwise(F.array().cast("array<struct<id:binary,words:int>>"))
    return blocks.select("first", F.inline("all")).select("conv", F.concat(lent, tail).alias("turns"))


def _digest(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (path, words, part, ids, n, conv) rows to a row a path: the digest of its parts, joined by commas, goes on over batches."""
    path, row, sha = None, None, None
    for pdf in batches:
        out = []
        for p, words, ids, n, conv in zip(pdf["path"], pdf["words"], pdf["ids"], pdf["n"], pdf["conv"]):
            if row is not None and p == path:
                sha.update(b",")
                sha.update(ids.encode())
                row[2] += n
                row[3] = min(row[3], conv)
                continue
            if row is not None:
                out.append((*row, sha.hexdigest()))
            path, row, sha = p, [p, words, n, conv], hashlib.sha256(ids.encode())
        yield pd.DataFrame(out, columns=["path", "words", "n", "conv", "ends"])
    if row is not None:
        yield pd.DataFrame([(*row, sha.hexdigest())], columns=["path", "words", "n", "conv", "ends"])


def distinct_paths(conversations: DataFrame) -> DataFrame:
    """(path, words, n, conv, ends) of each distinct sequence of turns: how many conversations have it, the smallest of them, and the
    SHA-256 of their ids in decimal, ascending, comma-joined."""
    one = conversations.select(F.col("conv").cast("long").alias("conv"), F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), "")).alias("path"), F.transform("turns", lambda t: t["words"]).alias("words"))
    parts = one.groupBy("path", F.floor(F.col("conv") / ID_RANGE).alias("part")).agg(
        F.first("words").alias("words"), F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("ids"), F.count("*").alias("n"), F.min("conv").alias("conv"),
    )
    dealt = parts.repartition(F.col("path")).sortWithinPartitions("path", "part").select("path", "words", "ids", "n", "conv")
    return dealt.mapInPandas(_digest, "path binary, words array<int>, n long, conv long, ends string")


def _depth(path: str | Column) -> Column:
    return (F.octet_length(path) / ID).cast("int")


def shared_depth(a: Column, b: Column) -> Column:
    """Number of leading turn ids that two paths share."""
    n = F.least(_depth(a), _depth(b))
    same = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substr(a, i * ID + 1, F.lit(ID)) == F.substr(b, i * ID + 1, F.lit(ID)))
    at = F.array_position(same, False).cast("int")
    return F.when(n == 0, 0).when(at == 0, n).otherwise(at - 1)


def _container(path: Column, depth: Column) -> Column:
    """Name of the container under a head: its depth and a digest of its path."""
    return F.concat_ws("/", depth.cast("string"), F.md5(F.substr(path, F.lit(1), depth * ID)))


def burst(rows: DataFrame, limit: int, turns: int) -> tuple[DataFrame, list[DataFrame]]:
    """Rows in containers that are within the limits, and the heads of each round's bursts, the root's first. A round reads and
    writes the rows of containers that the round before has made, no others."""
    state = rows.select("*", F.lit("root").alias("container"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("long").alias("parent_conv"))
    state = cut(state)
    settled, heads = [], []
    while True:
        sizes = state.groupBy("container", "depth", "parent", "parent_conv").agg(
            F.count("*").alias("rows"), F.sum("n").alias("n"), F.min("conv").alias("conv"), F.sum(_depth("path")).alias("turns"),
            F.min(F.struct("path", "words", "ends")).alias("low"), F.max("path").alias("high"),
        )
        over = sizes.where((F.col("rows") > limit) | (F.col("turns") > turns) & (F.col("rows") > 1))
        over = cut(over.withColumn("shared", shared_depth(F.col("low.path"), F.col("high"))))
        top = over.agg(F.count("*").alias("n"), F.sum("rows").alias("rows")).first()
        if not top["n"]:
            return reduce(DataFrame.unionByName, settled, state), heads
        heads.append(over)
        hot = [r[0] for r in over.where(F.col("rows") * HOT_SHARE > top["rows"]).select("container").collect()]
        told = cut(join_unique(state, over.select("container", "shared", F.col("conv").alias("head_conv")), "container", hot, "left"))
        settled.append(told.where("shared is null").select(*state.columns))
        next_depth = F.col("shared") + 1
        state = told.where(_depth("path") > F.col("shared")).select(*rows.columns, _container(F.col("path"), next_depth).alias("container"), next_depth.alias("depth"), F.col("container").alias("parent"), F.col("head_conv").alias("parent_conv"))


NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


class _Node:
    __slots__ = ("depth", "up", "words", "n", "conv", "children", "leaves", "saved", "ends")

    def __init__(self, depth: int, up: _Node | None, words: int):
        self.depth, self.up, self.words = depth, up, words
        self.n = self.children = self.leaves = self.saved = 0
        self.conv, self.ends = None, EMPTY


def _sweep(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by container and path to the nodes from each container's top down; the top's row names the head above it."""
    nodes: list[_Node] = []
    chain: list[_Node] = []
    now = last = parent = parent_conv = None

    def close(depth: int) -> None:
        """Nodes below ``depth`` have all their members: add them to the one above."""
        while chain and chain[-1].depth > depth:
            x = chain.pop()
            x.leaves = x.leaves or 1
            x.saved += (x.n - 1) * x.words
            if x.up is not None:
                x.up.n += x.n
                x.up.conv = x.conv if x.up.conv is None else min(x.up.conv, x.conv)
                x.up.children += 1
                x.up.leaves += x.leaves
                x.up.saved += x.saved

    def flush() -> list[tuple]:
        close(-1)
        out = [(x.conv, x.depth, x.up.conv if x.up else parent_conv, x.n, x.children, x.leaves, x.saved, x.ends, None if x.up else parent) for x in nodes]
        nodes.clear()
        return out

    columns = [c.split()[0] for c in NODE.split(", ")] + ["parent"]
    for pdf in batches:
        out = []
        for container, top, above, above_conv, path, words, n, conv, ends in zip(*(pdf[c] for c in ("container", "depth", "parent", "parent_conv", "path", "words", "n", "conv", "ends"))):
            if container != now:
                out += flush()
                now, parent, parent_conv = container, above, None if above_conv is None else int(above_conv)
                chain.append(_Node(top, None, int(words[top - 1]) if top else 0))
                nodes.append(chain[0])
            else:
                close(max(top, _common(path, last, top)))
            for d in range(chain[-1].depth + 1, len(path) // ID + 1):
                chain.append(_Node(d, chain[-1], int(words[d - 1])))
                nodes.append(chain[-1])
            x = chain[-1]
            x.n += n
            x.conv = conv if x.conv is None else min(x.conv, conv)
            x.ends = ends
            last = path
        yield pd.DataFrame(out, columns=columns).astype({"parent_conv_id": "Int64"})
    yield pd.DataFrame(flush(), columns=columns).astype({"parent_conv_id": "Int64"})


def _common(a: bytes, b: bytes, depth: int) -> int:
    """Leading turn ids that two paths share, which share ``depth`` for certain."""
    n = min(len(a), len(b)) // ID
    while depth < n and a[depth * ID : depth * ID + ID] == b[depth * ID : depth * ID + ID]:
        depth += 1
    return depth


def head_nodes(over: DataFrame, below: DataFrame) -> DataFrame:
    """Nodes of a round's heads, from the tops of the containers and heads below them; ``parent`` is set for each chain's first."""
    sums = below.groupBy(F.col("parent").alias("container")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    x = over.join(sums, "container")
    words = F.col("low.words")
    at = F.sequence(F.col("depth"), F.col("shared"))

    def node(d: Column) -> Column:
        from_here = F.slice(words, F.greatest(d, F.lit(1)), F.greatest(F.col("shared") - F.greatest(d, F.lit(1)) + 1, F.lit(0)))
        last = d == F.col("shared")
        first = d == F.col("depth")
        return F.struct(
            F.col("conv").alias("conv_id"), d.alias("depth"), F.when(first, F.col("parent_conv")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(last, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
            F.col("leaves").alias("n_leaves"), (F.col("saved") + (F.col("n") - 1) * F.aggregate(from_here, F.lit(0).cast("long"), lambda a, w: a + w)).alias("saved_tokens"),
            F.when(last & (_depth(F.col("low.path")) == F.col("shared")), F.col("low.ends")).otherwise(EMPTY).alias("ends_sha256"), F.when(first, F.col("parent")).alias("parent"), first.alias("_top"),
        )

    return x.select(F.inline(F.transform(at, node)))


def nodes(conversations: DataFrame, limit: int = BURST, turns: int = BURST_TURNS) -> DataFrame:
    """Nodes of the trie over (conv, turns) rows: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    kept, heads = burst(distinct_paths(conversations), limit, turns)
    dealt = kept.repartition(F.col("container")).sortWithinPartitions("container", "path")
    swept = dealt.select("container", "depth", "parent", F.col("parent_conv").cast("string"), "path", "words", "n", "conv", "ends").mapInPandas(_sweep, NODE + ", parent string")
    if not heads:
        return swept.drop("parent")
    swept = cut(swept)
    parts, tops = [swept.drop("parent")], swept.where("parent is not null")
    for over in reversed(heads):
        found = cut(head_nodes(over, tops))
        parts.append(found.drop("parent", "_top"))
        tops = tops.unionByName(found.where("_top").drop("_top"))
    return reduce(DataFrame.unionByName, parts)


def trie_sql(source: str = "conversations", size: int = 20, heads: int = 4) -> str:
    """DuckDB SQL of the rebuilt conversations' nodes."""
    bits = "CASE WHEN i % 8 = 0 THEN xor(a, ascii(s[i // 8 + 1])) ELSE a END"
    crc = f"list_reduce(list_prepend(4294967295, range(8 * length(s))), lambda a, i: xor(({bits}) >> 1, ({bits}) % 2 * 3988292384))"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {source} WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST) AS l, CAST(conv_id AS VARCHAR) AS s FROM t GROUP BY conv_id),
cut AS (SELECT *, xor({crc}, 4294967295) % {heads} AS h FROM own),
r AS MATERIALIZED (SELECT c.conv_id, list_concat(coalesce(b.l, [])[1:c.h], c.l[c.h + 1:]) AS l FROM cut c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % {size}),
m AS (SELECT conv_id, len(l) AS n, l[1:d] AS p, d FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM r)),
node AS MATERIALIZED (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256,
  (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].text, '[^\\x20\\x09-\\x0D]+')) END AS own FROM m GROUP BY p, d),
kids AS MATERIALIZED (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
under AS (SELECT n.p[1:e] AS p, e AS d, SUM(n.own) AS saved, count(*) FILTER (leaf) AS leaves FROM (SELECT node.p, node.d, own, k.n IS NULL AS leaf, unnest(range(0, node.d + 1)) AS e FROM node LEFT JOIN kids k ON k.p = node.p AND k.d = node.d) n GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM node n JOIN under u ON u.p = n.p AND u.d = n.d LEFT JOIN kids k ON k.p = n.p AND k.d = n.d LEFT JOIN node up ON up.d = n.d - 1 AND up.p = n.p[1:n.d - 1]"""
