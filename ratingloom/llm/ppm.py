"""Language-model scores by prediction by partial matching (PPM) over bytes.

The model is a context trie of up to ``ORDER`` bytes that is pretrained on the training documents: Spark counts every
(context, next byte) pair of the corpus. The probability of a byte is looked up in its longest known context; if the byte
was never seen there, an escape is paid (method C: distinct followers over followers plus distinct) and the next shorter
context is asked, with the symbols of the longer one excluded. After all contexts the rest of the alphabet is equally
likely. The text is lower-cased (A-Z) and scored with an end symbol, so that the probabilities of all texts sum to one at most
(the byte that stands before a text keeps its share of an unknown symbol).

Beside it stands a unigram base score over words, exact for every word: counts of the most common words are broadcast (their
number is bounded), counts of all the others are joined.

Scale: the pair counts are combined per task before they are shuffled, and all of them stay in written tables. Contexts of up
to 2 bytes are at most 2**24 pairs and are broadcast. Of longer contexts the commonest are broadcast, each with all its
followers, up to ``MAX_NODES`` pairs an order; as a context is no more common than its endings, a broadcast context has its
endings beside it. A pair whose longest context was not broadcast is scored by joins with the written tables. So the scores
are those of the whole model at every size, and what is broadcast is bounded.

Edge cases: null text is empty (one end symbol is scored); without training text every byte has probability 1/256 and the base
probability of a token is 1; null ids are held out; repeated rows are scored one by one; very long texts are read in slices.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket, cut, small_batches

ORDER = 5
#: Neither byte occurs in UTF-8: the first stands before a text, the second ends it.
START, END = b"\xfe", b"\xff"
#: Contexts of so many bytes are always broadcast whole; of longer ones, ``MAX_NODES`` pairs an order.
WHOLE = 2
MAX_NODES = 1 << 20
MAX_COMMON = 1 << 16
SLICE = 1 << 20
#: What a counting task holds before it passes its counts on, and the rows of a batch that it passes on.
HELD_TOKENS, HELD_CODES, FLUSHED_ROWS = 250_000, 1_000_000, 50_000
EMPTY = np.uint64(2**64 - 1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def groups(texts: list[bytes], size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about ``size`` bytes."""
    at = total = 0
    for i, t in enumerate(texts):
        total += len(t) + ORDER + 1
        if total >= size:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def slices(texts: list[bytes], order: int = ORDER, size: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, index of the text) of all symbols: the code holds ``order`` context bytes and the symbol, high bytes first."""
    stream = np.frombuffer(b"".join(START * order + t + END for t in texts), np.uint8)
    done = 0
    for at in range(order, len(stream), size):
        part = stream[at - order : at + size]
        n = len(part) - order
        codes = np.zeros(n, np.uint64)
        for k in range(order + 1):
            codes = (codes << np.uint64(8)) | part[k : k + n]
        symbols = part[order:]
        ends = symbols == END[0]
        owner = done + np.cumsum(ends) - ends
        done += int(ends.sum())
        keep = symbols != START[0]
        yield codes[keep], owner[keep]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    unique, inverse = np.unique(codes, return_inverse=True)
    return unique, np.bincount(inverse, weights=counts).astype(np.int64)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of the tokens and of the byte pairs that this task has read. Both are flushed when they outgrow a bound."""

    def flush() -> Iterator[pd.DataFrame]:
        rows = iter(tokens.items())
        while part := list(islice(rows, FLUSHED_ROWS)):
            yield pd.DataFrame({"code": None, "token": [t for t, _ in part], "n": [n for _, n in part]}).astype({"code": "Int64"})
        if parts:
            codes, counts = _merge(parts)
            for at in range(0, len(codes), FLUSHED_ROWS):
                yield pd.DataFrame({"code": codes[at : at + FLUSHED_ROWS].astype(np.int64), "token": None, "n": counts[at : at + FLUSHED_ROWS]})

    tokens, parts = Counter(), []
    for pdf in batches:
        texts = [(t or "").encode().lower() for t in pdf["text"]]
        for a, b in groups(texts):
            parts += [np.unique(c, return_counts=True) for c, _ in slices(texts[a:b])]
            for t in texts[a:b]:
                tokens.update(t.split())
            tokens[b""] += b - a
            if len(parts) >= 8:
                parts = [_merge(parts)]
            if len(tokens) > HELD_TOKENS or parts and len(parts[0][0]) > HELD_CODES:
                yield from flush()
                tokens, parts = Counter(), []
    yield from flush()


@dataclass
class Trie:
    """Sorted (context, symbol) codes and counts of each order, and, built where it is used, a hash table from the longest codes
    to log10 probabilities. A trie that isn't ``whole`` lacks the rarer contexts."""

    codes: list[np.ndarray]
    counts: list[np.ndarray]
    whole: bool = True

    def build(self) -> None:
        top, n = self.codes[-1], self.counts[-1].astype(float)
        self.contexts, at, size = np.unique(top >> np.uint64(8), return_index=True, return_counts=True)
        if len(top):
            total = np.add.reduceat(n, at)
            logs = np.log10(n) - np.repeat(np.log10(total + size), size)
        else:
            logs = n
        self.bits = max(4, int(2 * len(top)).bit_length())
        self.table = np.full(1 << self.bits, EMPTY)
        self.logs = np.zeros(1 << self.bits, np.float32)
        slot, left = self._slots(top), np.arange(len(top))
        while len(left):
            free = left[self.table[slot[left]] == EMPTY]
            self.table[slot[free]] = top[free]
            placed = self.table[slot[left]] == top[left]
            self.logs[slot[left[placed]]] = logs[left[placed]]
            left = left[~placed]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        self.rare: dict[int, float] = {}

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def log10p(self, codes: np.ndarray) -> np.ndarray:
        """log10 probabilities; NaN for pairs whose longest context a trie that isn't whole doesn't hold."""
        if not hasattr(self, "table"):
            self.build()
        slot = self._slots(codes)
        key = self.table[slot]
        out = self.logs[slot].astype(float)
        look = np.flatnonzero((key != codes) & (key != EMPTY))
        missed = [np.flatnonzero((key != codes) & (key == EMPTY))]
        while len(look):
            slot[look] = (slot[look] + 1) & ((1 << self.bits) - 1)
            key = self.table[slot[look]]
            found = key == codes[look]
            out[look[found]] = self.logs[slot[look[found]]]
            missed.append(look[~found & (key == EMPTY)])
            look = look[~found & (key != EMPTY)]
        where = np.concatenate(missed)
        if not self.whole:
            asked = codes[where] >> np.uint64(8)
            at = np.searchsorted(self.contexts, asked)
            held = at < len(self.contexts)
            held[held] = self.contexts[at[held]] == asked[held]
            out[where[~held]] = np.nan
            where = where[held]
        unique, inverse = np.unique(codes[where], return_inverse=True)
        out[where] = np.array([self._escaped(int(c)) for c in unique])[inverse] if len(unique) else 0.0
        return out

    def _escaped(self, code: int) -> float:
        """log10 probability of a pair that its longest context doesn't hold."""
        if code in self.rare:
            return self.rare[code]
        if len(self.rare) > 500_000:
            self.rare.clear()
        symbol, total = code & 255, 0.0
        excluded = np.zeros(256, bool)
        for k in range(len(self.codes) - 1, -1, -1):
            base = code & ((1 << 8 * (k + 1)) - 1) & ~255
            lo, hi = np.searchsorted(self.codes[k], np.array([base, base + 256], np.uint64))
            symbols = (self.codes[k][lo:hi] & np.uint64(255)).astype(np.int64)
            open_ = ~excluded[symbols]
            symbols, n = symbols[open_], self.counts[k][lo:hi][open_]
            if not len(symbols):
                continue
            whole = int(n.sum()) + len(symbols)
            hit = np.flatnonzero(symbols == symbol)
            if len(hit):
                total += math.log10(int(n[hit[0]]) / whole)
                break
            total += math.log10(len(symbols) / whole)
            excluded[symbols] = True
        else:
            total -= math.log10(256 - int(excluded.sum()))
        self.rare[code] = total
        return total


def _least(counts: DataFrame, bound: int) -> int:
    """The smallest count so that no more than ``bound`` rows have it or more."""
    sizes = counts.groupBy("n").agg(F.count("*").alias("rows")).orderBy(F.desc("n"))
    total, least = 0, None
    for r in sizes.toLocalIterator():
        total += r["rows"]
        if total > bound:
            return least if least is not None else r["n"] + 1
        least = r["n"]
    return 1


def _context(k: int) -> Column:
    """The ``k`` bytes before the symbol of a code."""
    return F.shiftrightunsigned(F.col("code"), 8) % (1 << 8 * k)


def _shared(followers: DataFrame, max_nodes: int) -> int:
    """The smallest total so that the contexts with it or more have no more than ``max_nodes`` pairs."""
    sizes = followers.groupBy("total").agg(F.sum(F.size("rows")).alias("rows")).orderBy(F.desc("total"))
    pairs, least = 0, None
    for r in sizes.toLocalIterator():
        pairs += r["rows"]
        if pairs > max_nodes:
            return least if least is not None else r["total"] + 1
        least = r["total"]
    return 0


@dataclass
class Model:
    trie: Trie
    followers: dict[int, DataFrame]  # of each longer order: context, and (code, n) of all its pairs; empty if the trie is whole
    common: dict[bytes, int]
    tokens: DataFrame
    least_common: int
    n: int
    v: int


def fit(train: DataFrame, text_col: str = "text", max_nodes: int = MAX_NODES, max_common: int = MAX_COMMON) -> Model:
    """Counts of all tokens and all byte pairs of ``train``."""
    raw = train.select(F.col(text_col).alias("text")).mapInPandas(_counted, "code long, token binary, n long")
    counts = cut(raw.groupBy("code", "token").agg(F.sum("n").alias("n")))
    tokens = counts.where("token IS NOT NULL").select("token", "n")
    size = tokens.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    pairs = counts.where("code IS NOT NULL").select("code", "n")
    levels = [pairs if k == ORDER else pairs.groupBy((F.col("code") % (1 << 8 * (k + 1))).alias("code")).agg(F.sum("n").alias("n")) for k in range(ORDER + 1)]
    followers: dict[int, DataFrame] = {}
    if any(levels[k].count() > max_nodes for k in range(ORDER, WHOLE, -1)):
        for k in range(WHOLE + 1, ORDER + 1):
            rows = levels[k].groupBy(_context(k).alias("context")).agg(F.sum("n").alias("total"), F.collect_list(F.struct("code", "n")).alias("rows"))
            followers[k] = cut(rows)
        total = max(_shared(f, max_nodes) for f in followers.values())
        levels[WHOLE + 1 :] = [f.where(F.col("total") >= total).selectExpr("inline(rows)") for f in followers.values()]
    codes, numbers = [], []
    for k, level in enumerate(levels):
        rows = level.toArrow().combine_chunks().sort_by("code")
        codes.append(rows["code"].to_numpy().astype(np.uint64))
        numbers.append(rows["n"].to_numpy().astype(np.int64))
    least = _least(tokens, max_common)
    common = {bytes(r["token"]): r["n"] for r in tokens.where(F.col("n") >= least).toLocalIterator()}
    return Model(Trie(codes, numbers, not followers), followers, common, tokens, least, size["n"] or 0, size["v"] or 0)


def score_texts(texts: list[bytes], trie: Trie) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(scores without the pairs that the trie can't tell, these pairs' codes and how often they occur) of each text."""
    out = np.zeros(len(texts))
    missed: list[list[np.ndarray]] = [[] for _ in texts]
    for a, b in groups(texts):
        for codes, owner in slices(texts[a:b]):
            logs = trie.log10p(codes)
            if not trie.whole:
                at = np.flatnonzero(np.isnan(logs))
                logs[at] = 0.0
                starts = np.flatnonzero(np.diff(owner[at], prepend=-1))
                for i, part in zip(owner[at][starts], np.split(codes[at], starts[1:])):
                    missed[a + i].append(part)
            out[a:b] += np.bincount(owner, weights=logs, minlength=b - a)
    found = [np.unique(np.concatenate(m), return_counts=True) if m else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for m in missed]
    return out, [f[0].astype(np.int64) for f in found], [f[1].astype(np.int32) for f in found]


def resolved(missed: DataFrame, model: Model) -> DataFrame:
    """(code, log) of the distinct codes of ``missed``, by the written followers of their contexts."""
    asked = missed.select("code").distinct()
    for k, f in model.followers.items():
        asked = asked.withColumn("context", _context(k)).join(f.select("context", F.col("rows.code").alias(f"codes{k}"), F.col("rows.n").alias(f"counts{k}")), "context", "left").drop("context")
    low = Trie(model.trie.codes[: WHOLE + 1], model.trie.counts[: WHOLE + 1])
    shared = missed.sparkSession.sparkContext.broadcast(low)

    def looked_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low = shared.value
        for pdf in batches:
            codes, counts = list(low.codes), list(low.counts)
            for k in range(WHOLE + 1, ORDER + 1):
                known = pdf[pdf[f"codes{k}"].notna()]
                rows = np.concatenate([np.zeros(0, np.int64), *known[f"codes{k}"]]).astype(np.uint64)
                n = np.concatenate([np.zeros(0, np.int64), *known[f"counts{k}"]]).astype(np.int64)
                unique, at = np.unique(rows, return_index=True)
                codes.append(unique)
                counts.append(n[at])
            trie = Trie(codes, counts)
            trie.rare = {}
            yield pd.DataFrame({"code": pdf["code"], "log": [trie._escaped(int(c)) for c in pdf["code"]]})

    return asked.mapInPandas(looked_up, "code long, log double")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score), a row for each row of ``docs``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.trie, {t: math.log10(n + 0.1) for t, n in model.common.items()}))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, common = shared.value
        row = TaskContext.get().partitionId() << 34
        for pdf in batches:
            texts = [(t or "").encode().lower() for t in pdf["text"]]
            out = []
            for t in texts:
                words = [*t.split(), b""]
                logs = list(map(common.get, words))
                rest = Counter([w for w, x in zip(words, logs) if x is None]) if None in logs else {}
                known = [x for x in logs if x is not None]
                out.append((len(words), len(known), sum(known), list(rest), list(rest.values())))
            res = pd.DataFrame(out, columns=["n_tokens", "known", "logs", "rest", "times"])
            res.insert(0, "row", np.arange(row, row + len(res)))
            res.insert(1, "id", pdf["id"].to_numpy() if pdf["id"].notna().all() else pdf["id"])
            res["score"], res["missed"], res["missed_times"] = score_texts(texts, trie)
            yield res
            row += len(res)

    kind = dict(docs.dtypes)[id_col]
    part = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    first = cut(part.mapInPandas(scored, f"row long, id {kind}, n_tokens long, known long, logs double, rest array<binary>, times array<int>, score double, missed array<long>, missed_times array<int>"))
    rest = first.select("row", F.explode(F.arrays_zip("rest", "times")).alias("r")).select("row", F.col("r.rest").alias("token"), F.col("r.times").alias("times"))
    rare = model.tokens.where(F.col("n") < model.least_common)
    found = (
        rest.join(rare, "token", "left")
        .groupBy("row")
        .agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("more"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1)) * F.col("times")).alias("more_logs"))
    )
    score = F.col("score")
    if not model.trie.whole:
        missed = first.select("row", F.explode(F.arrays_zip("missed", "missed_times")).alias("m")).select("row", F.col("m.missed").alias("code"), F.col("m.missed_times").alias("times"))
        logs = missed.join(resolved(missed, model), "code").groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("missed_logs"))
        first, score = first.join(logs, "row", "left"), F.col("score") + F.coalesce("missed_logs", F.lit(0.0))
    each = math.log10(model.n + 0.1 * (model.v + 1))
    return first.join(found, "row", "left").select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(each)).alias("base_score"),
        score.alias("score"),
    )


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """Scores of all documents by a model of those outside the held-out fold."""
    small_batches(docs.sparkSession)
    held = bucket(id_col, folds) == 0
    out = score(docs, fit(docs.where(~held), text_col), id_col, text_col)
    return out.select(id_col, (bucket(id_col, folds) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
