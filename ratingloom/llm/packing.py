"""Harmonic packing of documents into training sequences.

Lengths are partitioned into reciprocal-capacity classes: class k holds lengths above capacity/(k+1) and up to capacity/k, and a
bin of class k takes k pieces, no more and no fewer. A worker fills its classes' bins on its own, as its documents come, and
holds no more than the open bins; no document waits for another worker and nothing is shuffled.

Harmonic bins waste most where a length lies well below its class's upper end. As documents may be cut, no such length is ever
packed: whole multiples of the capacity become sequences of their own, and the tail is cut into the fewest lengths of which k
fill a bin but for ``SLACK`` tokens. What is left in open bins at a worker's end (fewer than k pieces a class) is laid end to
end, cut at the capacity, and its last stretch is cut at powers of two, which need no padding. So a full bin is padded by at
most ``SLACK`` tokens and no other sequence is padded.

Ids are those of the ``tokenizers`` library for a byte-level tokenizer file. They are computed by the ``tiktoken`` encoder from
the file's own vocabulary, which gives the same ids where merges stand in the order of their ids (checked when the file is
read) at a quarter of the time. Names of special tokens in a text are ordinary text.

Edge cases: a null text is empty and has the end id alone; a text of any length is tokenized whole; null and repeated ids are
packed row by row; other columns are left out; an empty table gives no sequences. Which pieces share a sequence depends on how
rows are dealt to partitions; ``pack`` runs on its input as it is read, so a task that is repeated gives the same sequences.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, END_ID, SLACK = 1024, 0, 16
#: Splits text before the merges: the pre-tokenizer that a byte-level tokenizer file names without spelling it out.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ids in an Arrow batch of finished sequences.
BATCH_IDS = 4_000_000


def byte_letters() -> dict[str, int]:
    """The letter of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the others for U+0100 onwards."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level tokenizer file, special tokens left out."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"]:
        raise ValueError(f"{path} isn't a plain byte-level tokenizer")
    vocabulary, letters = model["vocab"], byte_letters()
    merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if merged != sorted(merged):
        raise ValueError(f"merges of {path} aren't in the order of their ids")
    special = {t["content"] for t in spec["added_tokens"]}
    return {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in special}


def class_of(length: int, capacity: int = CAPACITY) -> int:
    """The k for which capacity/(k+1) < length <= capacity/k."""
    return capacity // length


@lru_cache(maxsize=8)
def tail_cuts(capacity: int = CAPACITY, slack: int = SLACK) -> tuple[tuple[int, ...], ...]:
    """For each tail length below the capacity, the fewest lengths that fill their classes' bins and add up to it, longest first."""
    fit = [n for n in range(capacity - 1, 0, -1) if capacity - class_of(n, capacity) * n <= slack]
    best: list[tuple[int, ...]] = [()]
    for tail in range(1, capacity):
        first = min((n for n in fit if n <= tail), key=lambda n: len(best[tail - n]))  # the longest of the best ones
        best.append(tuple(sorted((first, *best[tail - first]), reverse=True)))
    return tuple(best)


#: (document's number, start in it, ids) of a piece.
Piece = tuple[int, int, np.ndarray]


class Bins:
    """The open bins of a worker; methods yield the sequences that are full."""

    def __init__(self, capacity: int = CAPACITY, slack: int = SLACK):
        self.capacity, self.cuts = capacity, tail_cuts(capacity, slack)
        self.open: dict[int, list[Piece]] = {}

    def add(self, doc: int, ids: np.ndarray) -> Iterator[list[Piece]]:
        at, whole = 0, len(ids) - len(ids) % self.capacity
        while at < whole:
            yield [(doc, at, ids[at : at + self.capacity])]
            at += self.capacity
        for n in self.cuts[len(ids) - whole]:
            k = class_of(n, self.capacity)
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc, at, ids[at : at + n].copy()))  # a view would keep the whole document
            at += n
            if len(bin_) == k:
                yield self.open.pop(k)

    def rest(self) -> Iterator[list[Piece]]:
        """What open bins hold, end to end: whole sequences first, then stretches of falling powers of two."""
        pieces = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        left = sum(len(p[2]) for p in pieces)
        room = self._stretch(left)
        now: list[Piece] = []
        for doc, start, ids in pieces:
            while len(ids):
                head, ids = ids[:room], ids[room:]
                now.append((doc, start, head))
                start, room, left = start + len(head), room - len(head), left - len(head)
                if not room:
                    yield now
                    now, room = [], self._stretch(left)

    def _stretch(self, left: int) -> int:
        return self.capacity if left >= self.capacity else 1 << max(left.bit_length() - 1, 0)


def _batch(done: list[tuple[int, list[Piece]]], keys: list, tokens: list[int], key_type: pa.DataType) -> pa.RecordBatch:
    flat = [p for _, pieces in done for p in pieces]
    sizes = [len(pieces) for _, pieces in done]
    lengths = np.array([len(p[2]) for p in flat], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    before = np.concatenate([[0], np.cumsum(lengths)])
    totals = before[bounds[1:]] - before[bounds[:-1]]
    ids = [b"".join(p[2].tobytes() for p in pieces) for _, pieces in done]
    fields = {
        "key": pa.array([keys[p[0]] for p in flat], key_type), "start": pa.array([p[1] for p in flat], pa.int64()), "length": pa.array(lengths),
        "doc_tokens": pa.array([tokens[p[0]] for p in flat], pa.int64()), "offset": pa.array(before[:-1] - np.repeat(before[bounds[:-1]], sizes)),
    }
    pieces = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(list(fields.values()), list(fields)))
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in done], pa.int64()), pa.array(totals), pa.array(ids, pa.binary()), pieces], ["sequence_id", "n_tokens", "ids", "pieces"])


def pack(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, slack: int = SLACK) -> DataFrame:
    """Sequences (sequence_id, n_tokens, ids, pieces): ``ids`` as little-endian unsigned 32-bit integers without padding, ``pieces``
    in their order, each (key, start, length, doc_tokens, offset); ``key`` is the document's id."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a vocabulary file is of fixed size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=shared.value, special_tokens={})
        bins, keys, tokens, done, held = Bins(capacity, slack), [], [], [], 0
        first = TaskContext.get().partitionId() << 32
        key_type = None

        def flush() -> pa.RecordBatch:
            nonlocal keys, tokens, done, first, held
            out = _batch(done, keys, tokens, key_type)
            first, done, held = first + len(done), [], 0
            # only documents with a piece in an open bin are asked for again
            new = {d: i for i, d in enumerate(sorted({p[0] for b in bins.open.values() for p in b}))}
            keys, tokens = [keys[d] for d in new], [tokens[d] for d in new]
            bins.open = {k: [(new[d], s, ids) for d, s, ids in b] for k, b in bins.open.items()}
            return out

        def take(sequences: Iterable[list[Piece]]) -> None:
            nonlocal held
            for pieces in sequences:
                done.append((first + len(done), pieces))
                held += sum(len(p[2]) for p in pieces)

        for batch in batches:
            key_type = batch.column(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encoder.encode_ordinary(text.as_py() or ""), end_id], "<u4")
                keys.append(key)
                tokens.append(len(ids))
                take(bins.add(len(keys) - 1, ids))
                if held >= BATCH_IDS:
                    yield flush()
        take(bins.rest())
        if done:
            yield flush()

    key_type = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    kind = f"sequence_id long, n_tokens long, ids binary, pieces array<struct<key: {key_type}, start: long, length: long, doc_tokens: long, offset: long>>"
    return docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, kind)


def piece_rows(sequences: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Checksums are taken before rows are made, so that no row repeats its sequence's ids."""
    def digest(p):
        return F.struct(p["key"].alias(id_col), p["start"].alias("start"), p["length"].alias("length"), F.crc32(F.substring("ids", (p["offset"] * 4 + 1).cast("int"), (p["length"] * 4).cast("int"))).alias("ids_crc32"), p["doc_tokens"].alias("doc_tokens"), F.col("sequence_id"), p["offset"].alias("offset"))

    return sequences.select(F.inline(F.transform("pieces", digest)))
