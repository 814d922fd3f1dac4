"""Byte-level BPE by corpus-level merge replay.

The distinct pre-tokens of a batch form one long sequence of symbols. An inverted index leads from each merge (by rank) to the
positions where it applies; the ranks are replayed in order, all positions of a rank at once, and only the neighbours of a
merged position are looked up anew and entered in the index. Every pre-token of the batch is then spelled out once, and texts
are put together from a bounded cache of spelled pre-tokens.

The ranks are read on the driver (their path is a parameter) and broadcast: a vocabulary file is of fixed size.

Edge cases: null and empty texts have no ids; a text of any length is one sequence of pre-tokens; special tokens are ordinary
text; extra columns are kept, ``n_tokens`` and ``ids`` replaced; repeated rows are encoded alike.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

#: Bounds of a worker's cache of spelled pre-tokens: their number, and the length of those it takes in.
CACHE, CACHED_CHARS = 150_000, 64
#: Characters of the texts, and pre-tokens, that are replayed together.
CHUNK_CHARS, REPLAYED = 8_000_000, 75_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Replay:
    """Merges of a vocabulary, replayed over many pre-tokens at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        left, right, whole = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    whole.append(rank)
        key = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(key)
        self.key, self.whole = np.append(key[order], 1 << 62), np.append(np.array(whole, np.int64)[order], -1)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, or -1."""
        key = a << 32 | b
        at = np.searchsorted(self.key, key)
        return np.where(self.key[at] == key, self.whole[at], -1)

    def spell(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each pre-token."""
        if not words:
            return []
        size = np.array([len(w) for w in words])
        sym = self.single[np.frombuffer(b"".join(words), np.uint8)]
        n = len(sym)
        stop = np.cumsum(size)
        word_of = np.repeat(np.arange(len(words)), size)
        nxt = np.arange(1, n + 1)
        nxt[stop[size > 0] - 1] = -1
        prv = np.arange(-1, n - 1)
        prv[(stop - size)[size > 0]] = -1
        alive = np.ones(n, bool)
        rank_at = np.full(n, -1, np.int64)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray) -> np.ndarray:
            """Look up the pairs at these positions and put them into the index."""
            found = self._rank(sym[at], sym[nxt[at]])
            rank_at[at] = found
            keep = found >= 0
            found, at = found[keep], at[keep]
            if not len(at):
                return found
            order = np.argsort(found, kind="stable")
            found, at = found[order], at[order]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            for rank, part in zip(found[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts) if len(cuts) else [at]):
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    heapq.heappush(heap, rank)
            return found

        enter(np.flatnonzero(nxt >= 0))
        again: set[int] = set()
        while heap:
            rank = heapq.heappop(heap)
            parts = index.pop(rank)
            pos = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            pos = pos[rank_at[pos] == rank]
            if not len(pos):
                continue
            if len(parts) == 1 and len(pos) > 1:
                pos = np.unique(pos)
            if len(pos) > 1 and (clash := nxt[pos[:-1]] == pos[1:]).any():  # of overlapping pairs the leftmost goes first
                take = np.ones(len(pos), bool)
                for i in np.flatnonzero(clash).tolist():
                    take[i + 1] = not take[i]
                pos = pos[take]
            right = nxt[pos]
            after = nxt[right]
            sym[pos] = rank
            nxt[pos] = after
            alive[right] = False
            rank_at[right] = -1
            rank_at[pos] = -1
            inner = after >= 0
            prv[after[inner]] = pos[inner]
            before = prv[pos]
            touched = np.unique(np.concatenate([before[before >= 0], pos[inner]]))
            if len(touched) and (new := enter(touched)).size and int(new[0]) < rank:
                # a merge of lower rank arose: where this rank stood twice in a word, their order matters
                again |= set(word_of[touched].tolist())
        starts = np.searchsorted(word_of[alive], np.arange(len(words) + 1))
        ids = sym[alive].astype("<u4")
        out = [ids[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
        for w in again:
            out[w] = self.spell_one(words[w])
        return out

    def spell_one(self, word: bytes) -> np.ndarray:
        """Ids of one pre-token, merge by merge: the pairs wait in a heap by rank and place, so long words take n log n steps."""
        ranks, n = self.ranks, len(word)
        part: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = nxt[i]
            if part[i] is None or j >= n or ranks.get(part[i] + part[j]) != rank:
                continue  # one of the two has changed since
            part[i], part[j] = part[i] + part[j], None
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for k in (prv[i], i):
                if k >= 0 and nxt[k] < n and (r := ranks.get(part[k] + part[nxt[k]])) is not None:
                    heapq.heappush(heap, (r, k))
        return np.array([ranks[p] for p in part if p is not None], "<u4")


class Encoder:
    """Texts to ids, through the replay of each chunk's new pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.replay, self.find, self.cache = Replay(ranks), regex.compile(pattern).findall, {}

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        chunk: list[str] = []
        size = 0
        for t in texts:
            chunk.append(t or "")
            size += len(chunk[-1])
            if size >= CHUNK_CHARS:
                yield from self._chunk(chunk)
                chunk, size = [], 0
        yield from self._chunk(chunk)

    def _chunk(self, texts: list[str]) -> Iterator[bytes]:
        # a text is kept as numbers of its pre-tokens: as objects they would take many times the text's size
        number: dict[str, int] = {}
        found = []
        for t in texts:
            words = self.find(t)
            found.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
        cached = self.cache.get
        spelled = [cached(w) for w in number]
        new = [w for w, ids in zip(number, spelled) if ids is None]
        if len(self.cache) > CACHE:
            self.cache.clear()
        for at in range(0, len(new), REPLAYED):
            part = new[at : at + REPLAYED]
            for w, ids in zip(part, self.replay.spell([w.encode() for w in part])):
                spelled[number[w]] = ids.tobytes()
                if len(w) <= CACHED_CHARS:
                    self.cache[w] = spelled[number[w]]
        of = spelled.__getitem__
        for numbers in found:
            yield b"".join(map(of, numbers.tolist()))


_WORKER: dict[str, Encoder] = {}


def vocabulary_key(ranks: dict[bytes, int], pattern: str) -> str:
    """A digest of all ranks and the pattern."""
    digest = hashlib.sha256(pattern.encode())
    for token, rank in sorted(ranks.items()):
        digest.update(b"%d %d " % (rank, len(token)) + token)
    return digest.hexdigest()


def _encoder(key: str, ranks: dict[bytes, int], pattern: str) -> Encoder:
    """One encoder for each worker process and vocabulary, so that its cache lasts over tasks."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Encoder(ranks, pattern)
    return _WORKER[key]


def encoded(spark: SparkSession, text: str | Column, ranks: dict[bytes, int], pattern: str) -> Column:
    """Ids of a text column, as binary of little-endian unsigned 32-bit integers."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast((vocabulary_key(ranks, pattern), ranks, pattern))

    @F.pandas_udf("binary")
    def spelled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _encoder(*shared.value)
        held: list[pd.Series] = []

        def done() -> Iterator[pd.Series]:
            ids = coder.encode(t for texts in held for t in texts)
            for texts in held:
                yield pd.Series(list(islice(ids, len(texts))), dtype=object)

        size = 0
        for texts in batches:  # small batches are replayed together
            held.append(texts)
            size += int(texts.str.len().sum())
            if size >= CHUNK_CHARS:
                yield from done()
                held, size = [], 0
        yield from done()

    return spelled.asNondeterministic()(F.col(text) if isinstance(text, str) else text)


def decoded(spark: SparkSession, ids: str | Column, ranks: dict[bytes, int]) -> Column:
    """The bytes that a column of ids spells."""
    shared = spark.sparkContext.broadcast(ranks)

    @F.pandas_udf("binary")
    def spelled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = {r: t for t, r in shared.value.items()}.__getitem__
        for column in batches:
            yield pd.Series([_bytes(x, of) for x in column], dtype=object)

    return spelled.asNondeterministic()(F.col(ids) if isinstance(ids, str) else ids)


def _bytes(ids: bytes, of) -> bytes:
    return b"".join(map(of, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and ``ids``."""
    kept = [c for c in docs.columns if c not in ("n_tokens", "ids")]
    out = docs.withColumn("_ids", encoded(docs.sparkSession, text_col, ranks, pattern))
    return out.select(*kept, (F.octet_length("_ids") / 4).cast("long").alias("n_tokens"), F.col("_ids").alias("ids"))


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): texts are encoded, the ids decoded again, and both digested where they are made."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digested(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = {r: t for t, r in shared.value.items()}.__getitem__
        for column in batches:
            rows = [(len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(_bytes(x, of)).hexdigest()) for x in column]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    ids = encoded(docs.sparkSession, text_col, ranks, pattern)
    return docs.select(F.col(id_col), digested.asNondeterministic()(ids).alias("_d")).select(id_col, "_d.*")
