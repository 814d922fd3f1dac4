"""Near-duplicates by SimHash and tiled exact comparison.

A text's fingerprint has a bit for each of 64 positions: 1 if more than half of the XXH64 hashes of its word shingles have it.
Equal fingerprints are one row. The distinct fingerprints are laid out in tiles by the population counts of their four
16-bit quarters. Two fingerprints within ``radius`` bits have counts that differ by no more than ``radius`` in total, so only
such tile pairs are compared, each exactly and whole, by numpy exclusive-or and bit counts; all other pairs are skipped
without loss. A tile pair answers with a spanning forest of its links, never with all linked pairs, so that large groups of
near copies stay linear. Components of the links are found by Spark.

Scale: a tile row is at most ``TILE`` packed fingerprints, so a task holds two tiles at a time. A fingerprint is shuffled to
the tiles that may hold its neighbours, as 8 bytes each. The number of comparisons falls with the quarters' selectivity (about
a twentieth of all pairs) but still grows with the square of the number of distinct fingerprints.

Edge cases: a null text or one without words has fingerprint zero, which links like any other; texts with fewer words than a
shingle hash the whole sequence; null ids take part, and a component of nothing but null ids has a null id; repeated rows keep
a row each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_keys, join_unique, small_batches
from .components import components

TILE = 2048
#: Tiles of a cell that meet in one task: larger cells are compared block by block, in as many tasks as there are block pairs.
BLOCK = 32
#: Of a wide fingerprint: its 64-bit lanes, the bits of the first two lanes and of all lanes within which two texts are compared
#: shingle by shingle. At a Jaccard similarity of 0.8, 128 bits differ in 19 places on average (standard deviation 4) and 512 bits
#: in 77 (standard deviation 8; four of five shingles: 24 and 96), unrelated texts in 64 and 256.
LANES, FIRST_RADIUS, WIDE_RADIUS = 8, 44, 128
#: Shingle hashes that a tile of similar-text candidates holds at most, one row at least.
HELD_HASHES = 4_000_000
QUARTERS = 4


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words, lower-cased (A-Z) and joined by spaces; of the whole sequence if it is shorter."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    n = len(tokens) - words + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    lengths = [len(t) + 1 for t in tokens]
    ends = np.cumsum(lengths)
    starts, stops = (ends - lengths).tolist(), (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n], stops[words - 1 :])), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    return majority(shingle_hashes(text, words))


def wide_fingerprint(text: str | None, words: int = 5) -> tuple[int, int, list[int]]:
    """(hash of the set of shingles, its size, ``LANES`` fingerprints of it); each lane mixes the hashes anew."""
    hashes = np.unique(shingle_hashes(text, words))
    lanes = []
    for lane in range(LANES):
        x = hashes + np.uint64((lane * 0x9E3779B97F4A7C15) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        lanes.append(majority(x ^ (x >> np.uint64(31))))
    return xxhash.xxh64_intdigest(hashes.tobytes(), 42), len(hashes), lanes


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of 0.8 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * both >= 4 * (len(a) + len(b))


def with_fingerprint(docs: DataFrame, text_col: str = "text", words: int = 3, name: str = "_fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).astype(np.int64))

    return docs.withColumn(name, of.asNondeterministic()(F.col(text_col)))


def quarter_counts(fp: str) -> list[Column]:
    return [F.bit_count(F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))).cast("int") for i in range(QUARTERS)]


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Differences of quarter counts within the radius, one of each pair of opposites, and none at all."""
    side = range(-radius, radius + 1)
    all_ = [(a, b, c, d) for a in side for b in side for c in side for d in side if abs(a) + abs(b) + abs(c) + abs(d) <= radius]
    return [o for o in all_ if o >= (0, 0, 0, 0)]


def close(a: np.ndarray, b: np.ndarray, radius: int, wide_a=None, wide_b=None, wide_radius: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, matrix) of the pairs of ``a`` and ``b`` (the same array: each pair once) within ``radius`` bits, by runs of rows.

    With further lanes (arrays of a column each), the first of them counts for ``radius`` as well, and a pair must also be
    within ``wide_radius`` over all.
    """
    for at in range(0, len(a), 256):
        bits = np.bitwise_count(a[at : at + 256, None] ^ b[None, :])
        if wide_a is not None:
            bits += np.bitwise_count(wide_a[0][at : at + 256, None] ^ wide_b[0][None, :])
        near = bits <= radius
        if a is b:
            near &= np.arange(len(b))[None, :] > np.arange(at, at + len(near))[:, None]
        if wide_a is not None:
            i, j = np.nonzero(near)
            bits = np.bitwise_count(a[at + i] ^ b[j]).astype(int)
            for x, y in zip(wide_a, wide_b):
                bits += np.bitwise_count(x[at + i] ^ y[j])
            near[i, j] = bits <= wide_radius
        yield at, near


def forest(a: np.ndarray, b: np.ndarray, radius: int, wide_a=None, wide_b=None, wide_radius: int = 0, linked=None) -> list[tuple[int, int]]:
    """A spanning forest of the links between the rows of ``a`` and ``b`` (the same array: within it).

    Links are the pairs that ``close`` finds and, if it is given, ``linked`` confirms; pairs that are connected already aren't asked.
    """
    same = a is b
    parent = np.arange(len(a) + (0 if same else len(b)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return int(x)

    out = []
    base = 0 if same else len(a)
    for at, near in close(a, b, radius, wide_a, wide_b, wide_radius):
        for i in np.flatnonzero(near.any(axis=1)):
            row, js = find(at + int(i)), np.flatnonzero(near[i])
            roots = parent[js + base]
            for j in js[roots != row].tolist():  # those already under this root need no further look
                other = find(j + base)
                row = find(row)
                if other != row and (linked is None or linked(at + int(i), j)):
                    parent[other] = row
                    parent[j + base] = row
                    out.append((at + int(i), j))
    return out


def packed_tiles(cells: DataFrame, key: str, columns: list[str], tile: int | Column) -> tuple[DataFrame, DataFrame]:
    """(tiles, sizes): rows of each cell dealt by hash of ``key`` to tiles of about ``tile`` rows, with ``columns`` as arrays.

    Cells are small tuples of counts (17 ** 4 at most, or 300 of wide fingerprints), so ``sizes`` is broadcast.
    """
    sizes = cut(cells.groupBy("cell").agg(F.ceil(F.count("*") / (0.75 * tile)).cast("int").alias("parts")))
    dealt = cells.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")).cast("int"))
    packed = dealt.groupBy("cell", "part").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    return packed.select("cell", "part", *(F.col(f"rows.{c}").alias(c) for c in columns)), F.broadcast(sizes)


def tile_pairs(tiles: DataFrame, sizes: DataFrame, columns: list[str], offsets: list[tuple[int, ...]]) -> DataFrame:
    """Each pair of tiles of neighbouring cells once, side by side (``c`` and ``c_b``); ``same``: a tile with itself.

    A pair of cells is a grid of blocks, ``BLOCK`` tiles a side, and each block of the grid is a join key of its own: a cell of
    any size is compared by many tasks. A tile goes to the blocks of its row or column.
    """
    steps = F.array(*(F.array(*(F.lit(x) for x in o)) for o in offsets))
    last = lambda c: F.floor((F.col(c) - 1) / BLOCK).cast("int")
    own = F.floor(F.col("part") / BLOCK).cast("int")
    near = lambda sign: F.transform("cell", lambda x, i: x + sign * F.get("o", i))
    left = tiles.withColumn("o", F.explode(steps)).withColumn("cell_b", near(1)).join(sizes.select(F.col("cell").alias("cell_b"), "parts"), "cell_b")
    left = left.withColumns({"row": own, "column": F.explode(F.sequence(F.lit(0), last("parts")))}).drop("o", "parts")
    right = tiles.select(F.col("cell"), F.col("part").alias("part_b"), *(F.col(c).alias(f"{c}_b") for c in columns)).withColumn("o", F.explode(steps)).withColumn("cell_a", near(-1))
    right = right.join(sizes.select(F.col("cell").alias("cell_a"), "parts"), "cell_a")
    right = right.withColumns({"column": F.floor(F.col("part_b") / BLOCK).cast("int"), "row": F.explode(F.sequence(F.lit(0), last("parts")))})
    right = right.select(F.col("cell_a").alias("cell"), F.col("cell").alias("cell_b"), "row", "column", "part_b", *(f"{c}_b" for c in columns))
    pairs = left.join(right, ["cell", "cell_b", "row", "column"]).where((F.col("cell") != F.col("cell_b")) | (F.col("part") <= F.col("part_b")))
    return pairs.withColumn("same", (F.col("cell") == F.col("cell_b")) & (F.col("part") == F.col("part_b")))


def links(prints: DataFrame, fp: str = "fp", radius: int = 3, tile: int = TILE) -> DataFrame:
    """(a, b): links between distinct fingerprints whose components are those of all pairs within ``radius`` bits."""
    cells = prints.select(F.col(fp).alias("fp")).select("fp", F.array(*quarter_counts("fp")).alias("cell"))
    tiles, sizes = packed_tiles(cells, "fp", ["fp"], tile)
    pairs = tile_pairs(tiles, sizes, ["fp"], _offsets(radius))
    rows = pairs.select("fp", F.when(~F.col("same"), F.col("fp_b")).alias("fp_b"))

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b = [], []
            for x, y in zip(pdf["fp"], pdf["fp_b"]):
                p = np.asarray(x, np.int64)
                q = p if y is None else np.asarray(y, np.int64)
                for i, j in forest(p.view(np.uint64), p.view(np.uint64) if y is None else q.view(np.uint64), radius):
                    a.append(p[i])
                    b.append(q[j])
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return rows.mapInPandas(compared, "a long, b long")


def named(prints: DataFrame, found_links: DataFrame) -> DataFrame:
    """(node, component_id: the least ``first`` of its component) for each node of ``prints`` (node, first)."""
    linked = cut(prints.select("node", "first").join(components(found_links), "node"))
    least = cut(linked.groupBy("label").agg(F.min("first").alias("component_id")))
    own = join_unique(linked.select("node", "label"), least, "label", hot_keys(linked, "label")).select("node", "component_id")
    return prints.select("node", "first").join(own, "node", "left").select("node", F.coalesce("component_id", "first").alias("component_id"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id: the smallest id reachable over links)."""
    marked = cut(with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", words).select("id", F.col("_fp").alias("node")))
    prints = cut(marked.groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    joined = join_unique(marked, cut(named(prints, links(prints, "node", radius))), "node", hot_keys(prints, "node", "n"))
    return joined.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def similar_candidates(prints: DataFrame, tile: int = TILE) -> DataFrame:
    """(pair, right, node): the nodes of each pair of tiles that have a close fingerprint in the other tile (``right``: the second
    tile). ``prints`` has node, size and the lanes f0, f1, ...

    Shingle sets of similarity 0.8 or more have sizes within a factor of 1.25, and lanes within ``FIRST_RADIUS`` bits have
    population counts that differ no more than that: tiles are cells of both, and only neighbouring cells are compared.
    """
    level = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / F.lit(float(np.log(1.25)))).cast("int")
    band = F.floor((F.bit_count("f0") + F.bit_count("f1")) / (FIRST_RADIUS + 1)).cast("int")
    names = [f"f{i}" for i in range(LANES)]
    cells = prints.select("node", *names, F.array(level, band).alias("cell"))
    columns = ["node", *names]
    rows = F.least(F.lit(tile), F.greatest(F.lit(1), F.floor(HELD_HASHES / F.pow(F.lit(1.25), F.col("cell")[0] + 1))))
    tiles, sizes = packed_tiles(cells, "node", columns, rows)
    id_ = F.xxhash64("cell", "cell_b", "part", "part_b").alias("pair")
    pairs = tile_pairs(tiles, sizes, columns, [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]).select(id_, *columns, *(f"{c}_b" for c in columns), "same")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                p = [np.asarray(getattr(r, x), np.int64) for x in ("node", *names)]
                q = p if r.same else [np.asarray(getattr(r, f"{x}_b"), np.int64) for x in ("node", *names)]
                a, b = [x.view(np.uint64) for x in p[1:]], [x.view(np.uint64) for x in q[1:]]
                if q is p:
                    b = a
                left, right = np.zeros(len(a[0]), bool), np.zeros(len(b[0]), bool)
                for at, near in close(a[0], b[0], FIRST_RADIUS, a[1:], b[1:], WIDE_RADIUS):
                    left[at : at + len(near)] |= near.any(axis=1)
                    right |= near.any(axis=0)
                if q is p:
                    left, right = left | right, np.zeros_like(right)
                nodes = np.concatenate([p[0][left], q[0][right]])
                yield pd.DataFrame({"pair": r.pair, "right": np.arange(len(nodes)) >= left.sum(), "node": nodes})

    return pairs.mapInPandas(compared, "pair long, right boolean, node long")


def similar_links(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of nodes: links between candidates whose shingle sets have a Jaccard similarity of 0.8 or more. ``sets`` has node,
    the lanes and ``hashes``, the sorted shingle hashes as bytes."""
    names = [f"f{i}" for i in range(LANES)]

    def verified(pdf: pd.DataFrame) -> pd.DataFrame:
        right = pdf["right"].to_numpy()
        sides = [pdf[~right]] if not right.any() else [pdf[~right], pdf[right]]
        nodes = [x["node"].to_numpy() for x in sides]
        lanes = [[np.ascontiguousarray(x[c].to_numpy(np.int64)).view(np.uint64) for c in names] for x in sides]
        hashes = [[np.frombuffer(h, np.uint64) for h in x["hashes"]] for x in sides]
        a, b = lanes[0], lanes[-1]
        found = forest(a[0], b[0], FIRST_RADIUS, a[1:], b[1:], WIDE_RADIUS, lambda i, j: similar(hashes[0][i], hashes[-1][j]))
        return pd.DataFrame([(nodes[0][i], nodes[-1][j]) for i, j in found], columns=["a", "b"]).astype("int64")

    return candidates.join(sets, "node").groupBy("pair").applyInPandas(verified, "a long, b long")


def _similar(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, component_id, _key, _first_key): the smallest id of each row's group, and hashes that tell rows of one id apart.

    Wide fingerprints choose the candidates. Only their texts are read again, and their shingle sets decide.
    """
    small_batches(docs.sparkSession)
    kind = "node long, size int, " + ", ".join(f"f{i} long" for i in range(LANES))

    @F.pandas_udf(kind)
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = [wide_fingerprint(t, words) for t in texts]
        lanes = np.array([r[2] for r in rows], np.uint64).reshape(-1, LANES).view(np.int64)
        nodes = np.array([r[0] for r in rows], np.uint64).view(np.int64)
        return pd.DataFrame({"node": nodes, "size": [r[1] for r in rows], **{f"f{i}": lanes[:, i] for i in range(LANES)}})

    @F.pandas_udf("binary")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, words)).tobytes() for t in texts], dtype=object)

    names = [f"f{i}" for i in range(LANES)]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("key", _row_key("id", "text"))
    marked = cut(texts.select("id", "key", of.asNondeterministic()("text").alias("w")).select("id", "key", "w.*"))
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "key")))
    prints = cut(marked.groupBy("node").agg(first.alias("first"), F.min("key").alias("key"), F.count("*").alias("n"), *(F.first(x).alias(x) for x in ("size", *names))))
    candidates = cut(similar_candidates(prints))
    wanted = prints.join(candidates.select("node").distinct(), "node", "left_semi").select("node", "key", *names)
    sets = cut(texts.select("key", "text").join(wanted, "key").dropDuplicates(["key"]).select("node", *names, shingles("text").alias("hashes")))
    found = cut(named(prints, cut(similar_links(candidates, sets))))
    joined = join_unique(marked.select("id", "key", "node"), found, "node", hot_keys(prints, "node", "n"))
    return joined.select(F.col("id").alias(id_col), F.col("component_id.id").alias("component_id"), F.col("key").alias("_key"), F.col("component_id.key").alias("_first_key"))


def _row_key(*columns: str) -> Column:
    return F.xxhash64(*columns)


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """(id, component_id) over texts whose ``words``-word shingle sets have a Jaccard similarity of 0.8 or more."""
    return _similar(docs, id_col, text_col, words).select(id_col, "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """``docs`` with one row of each group of similar texts: that of the smallest id, and of the smallest hash of its text where an
    id stands with several texts. Rows that agree in id and text are one, the one whose other columns, of whatever types, are least
    as text. Rows with a null id are all kept, and stand for no group."""
    classed = _similar(docs, id_col, text_col, words)
    kept = classed.where((F.col(id_col) == F.col("component_id")) & (F.col("_key") == F.col("_first_key"))).select(F.col(id_col).alias("_id"), "_key").distinct()
    keyed = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), _row_key(id_col, text_col).alias("_key"), F.col(text_col).alias("_text"), F.struct(*(c for c in docs.columns if c not in (id_col, text_col)), F.lit(0).alias("_")).alias("_rest"))
    once = keyed.join(kept, ["_id", "_key"], "left_semi").groupBy("_id", "_key").agg(F.first("_text").alias("_text"), F.min_by("_rest", F.col("_rest").cast("string")).alias("_rest"))
    named_ = {id_col: F.col("_id"), text_col: F.col("_text")}
    first = once.select(*(named_.get(c, F.col(f"_rest.`{c}`")).alias(c) for c in docs.columns))
    return first.unionByName(docs.where(F.col(id_col).isNull()))
