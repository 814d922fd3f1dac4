"""Packing, prefix tries and hard negatives against plain computations, and their odd cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ratingloom.llm import entries, negatives, packing, tries
from ratingloom.llm.common import table

FILE = public_tokenizers.path("byte_bpe_50k.json")


# --- packing


@pytest.fixture(scope="module")
def vocabulary():
    return packing.read_vocabulary(FILE)


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return t


def check_pieces(pieces, want, capacity=1024):
    """Every id of every document lies in exactly one piece, sequences are gapless; returns the padded share."""
    of_doc, of_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        of_doc[p["doc_id"]].append(p)
        of_seq[p["sequence_id"]].append(p)
    assert set(of_doc) == set(want)
    for d, ps in of_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(want[d]))
            assert p["ids_crc32"] == zlib.crc32(np.array(want[d][at : at + p["length"]], "<u4").tobytes())
            assert p["length"] > 0
            at += p["length"]
        assert at == len(want[d])
    padding = 0
    for ps in of_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / sum(map(len, want.values()))


def test_packing_equals_the_tokenizer_library_with_little_padding(spark, data, tokenizer):
    docs = table(spark, data, "documents")
    rows = docs.collect()
    want = {r["doc_id"]: [*e.ids, 0] for r, e in zip(rows, tokenizer.encode_batch([r["text"] or "" for r in rows], add_special_tokens=False))}
    assert check_pieces(entries.op11_packing(spark, data).collect(), want) < 0.005


def test_full_bins_hold_their_class_fixed_count(vocabulary, spark, data):
    full = [r for r in packing.pack(table(spark, data, "documents"), vocabulary).collect() if len({packing.class_of(p["length"]) for p in r["pieces"]}) == 1 and r["n_tokens"] > 1024 - packing.SLACK]
    assert full
    for r in full:
        assert len(r["pieces"]) == packing.class_of(r["pieces"][0]["length"]) and len(r["ids"]) == 4 * r["n_tokens"]


@pytest.mark.parametrize("capacity, slack", [(1024, 16), (1024, 0), (64, 4), (8, 0), (1, 0)])
def test_bins_keep_every_id_whatever_the_capacity(capacity, slack):
    rng = random.Random(capacity)
    lengths = [rng.randrange(0, 3 * capacity + 2) for _ in range(200)]
    docs = {i: np.arange(n, dtype="<u4") + 10_000 * i for i, n in enumerate(lengths)}
    bins = packing.Bins(capacity, slack)
    out = [s for i, ids in docs.items() for s in bins.add(i, ids)] + list(bins.rest())
    for i, ids in docs.items():
        mine = sorted((p for s in out for p in s if p[0] == i), key=lambda p: p[1])
        assert (np.concatenate([p[2] for p in mine]) if mine else np.array([])).tolist() == ids.tolist()
    sizes = [sum(len(p[2]) for p in s) for s in out]
    assert all(0 < n <= capacity and (n >= capacity - slack or n & (n - 1) == 0) for n in sizes)


def test_tail_cuts_are_the_fewest(capacity=48, slack=3):
    fit = [n for n in range(1, capacity) if capacity - capacity // n * n <= slack]
    fewest = [0] + [capacity] * (capacity - 1)
    for n in range(1, capacity):
        fewest[n] = 1 + min(fewest[n - f] for f in fit if f <= n)
    assert [len(c) for c in packing.tail_cuts(capacity, slack)] == fewest
    assert all(sum(c) == n for n, c in enumerate(packing.tail_cuts(capacity, slack)))


def test_packing_odd_rows(spark, vocabulary, tokenizer):
    texts = ["", "a b c", "<|endoftext|> is text", "word " * 60_000, "x" * 30_000, "same", "same", "漢字 \U0001f600 \u0000 é"]
    rows = [(i, t, "own", "own", "own") for i, t in enumerate(texts)] + [(None, None, "own", "own", "own")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, sequence_id string, pieces string, key string")
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t, *_ in rows}
    check_pieces(packing.piece_rows(packing.pack(docs.repartition(3), vocabulary)).collect(), want)
    repeated = docs.where("doc_id = 1")
    assert packing.piece_rows(packing.pack(repeated.union(repeated), vocabulary)).count() >= 2
    assert packing.pack(docs.where("false"), vocabulary).count() == 0


def test_packing_batches_hand_over_open_bins(spark, vocabulary, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "BATCH_IDS", 1500)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gam ma"]) for _ in range(rng.randrange(900)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in rows}
    assert check_pieces(packing.piece_rows(packing.pack(docs, vocabulary)).collect(), want) < 0.02


def test_only_plain_byte_level_files_are_taken():
    with pytest.raises(ValueError):
        packing.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))


# --- tries


def brute_nodes(conversations):
    """Nodes from {conv: [(role, text)]}, straight from the definition."""
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = set()
    for p, cs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        children = [q for q in under if len(q) == len(p) + 1]
        leaves = [q for q in under if not any(x[: len(q)] == q and len(x) > len(q) for x in under)]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in under if q)
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(conversations[c]) == len(p)))
        out.add((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def brute_rebuilt(rows):
    """Rebuilt conversations from (conv_id, turn, role, text) rows without ties."""
    own = defaultdict(list)
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1])):
        own[c].append((r or "", x or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def random_rows(seed, n=120, letters="ab"):
    rng = random.Random(seed)
    rows = []
    for c in range(-25, n):
        for t in range(rng.choice([0, 1, 2, 3, 5, 8])):
            rows.append((c, None if t == 0 and c % 3 else t, rng.choice(["user", "assistant", None]) if c % 5 == 0 else "user", rng.choice([*letters, "two words", None if c % 7 == 0 else letters[0]])))
    return rows


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("limit, turns", [(1, 1), (2, 5), (7, 30), (1000, 5), (1000, 100_000)])
def test_trie_equals_brute_force_at_every_burst_limit(spark, limit, turns):
    rows = random_rows(limit)
    got = tries.nodes(tries.rebuilt(spark.createDataFrame(rows, SCHEMA)), limit, turns).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute_nodes(brute_rebuilt(rows))


def test_trie_of_many_copies_and_a_long_shared_path(spark):
    shared = [("user", f"turn {i}") for i in range(70)]
    rows = [(c, i, r, x) for c in range(0, 4000, 20) for i, (r, x) in enumerate(shared)] + [(c, 70, "user", str(c % 3)) for c in range(0, 4000, 40)]
    rows += [(20_000_000 * k, 0, "user", "turn 0") for k in range(1, 300)]
    got = tries.nodes(tries.rebuilt(spark.createDataFrame(rows, SCHEMA)), 2, 100)
    assert {tuple(r) for r in got.collect()} == brute_nodes(brute_rebuilt(rows))


def test_trie_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 0, "user", "lost"), (7, 1, "user", "long " * 40_000), (40, 0, "use", "ra")]
    d = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("block", "conv", "id", "words", "path", "parent", "container", "depth", "n")})
    got = {tuple(r) for r in tries.nodes(tries.rebuilt(d)).collect()}
    assert got == brute_nodes(brute_rebuilt(rows))
    assert tries.nodes(tries.rebuilt(d.where("false"))).count() == 0
    ties = spark.createDataFrame([(20, 0, "user", x) for x in "abc"], SCHEMA)
    assert tries.nodes(tries.rebuilt(ties)).count() == 4
    # nothing but a turnless conversation: its only turn is among the three that its absent base would lend
    assert zlib.crc32(b"1") % 4 == 3
    alone = tries.nodes(tries.rebuilt(spark.createDataFrame([(1, 0, "user", "a")], SCHEMA))).collect()
    assert [tuple(r)[:7] for r in alone] == [(1, 0, None, 1, 0, 1, 0)]


def test_turn_ids_tell_role_from_text(spark):
    ids = [r[0] for r in spark.createDataFrame([("a", "bc"), ("ab", "c"), ("", "abc"), ("1:a", "b")], "r string, t string").select(tries.turn_id(F.col("r"), F.col("t"))).collect()]
    assert len({bytes(i) for i in ids}) == 4 and all(len(i) == 16 for i in ids)


def test_shared_depth(spark):
    a, b, c = b"a" * 16, b"b" * 16, b"c" * 16
    rows = [(a + b + c, a + b + a, 2), (a + b, a + b + c, 2), (b"", a, 0), (a, b, 0), (a, a, 1)]
    got = spark.createDataFrame(rows, "x binary, y binary, n int").select(tries.shared_depth(F.col("x"), F.col("y")), "n").collect()
    assert all(x == n for x, n in got)


# --- hard negatives


def brute_negatives(rows, anchor=lambda i: i % 100 == 0):
    seen = {}
    for i, label, vec in rows:
        if i is None or label is None or vec is None or any(x is None or not np.isfinite(x) for x in vec):
            continue
        seen[i, label, tuple(vec)] = [int(np.floor(256 * x)) for x in map(float, vec)]
    out = set()
    for (a, label, _), q in seen.items():
        if not anchor(a):
            continue
        score = sorted((-sum(x * y for x, y in zip(q, v)), i, other) for (i, other, _), v in seen.items() if i != a)
        for p, pid, _ in [s for s in score if s[2] == label][:5]:
            band = [(s, i) for s, i, other in score if other != label and -30 * p <= -100 * s <= -90 * p][:10]
            out |= {(a, pid, n + 1, i, -p, -s) for n, (s, i) in enumerate(band)}
    return out


def mined(spark, rows):
    d = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").withColumns({c: F.lit("own") for c in ("id", "vec", "key", "rb", "ab", "anchor")})
    return [tuple(r) for r in negatives.mine(negatives.usable(d), F.col("id") % 100 == 0).collect()]


@pytest.mark.parametrize("width, blocks, block_rows, anchor_rows", [(64, 64, 65_536, 32_768), (7, 3, 50, 2), (1, 1, 10**6, 1)])
def test_negatives_equal_brute_force(spark, monkeypatch, width, blocks, block_rows, anchor_rows):
    for name, value in (("BLOCKS", blocks), ("BLOCK_ROWS", block_rows), ("ANCHOR_ROWS", anchor_rows)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(width)
    rows = [(i, int(rng.integers(3)), (rng.normal(size=width).round(1) + 0.3).tolist()) for i in range(700)]
    rows += [(1000 + i, i % 3, rows[100][2]) for i in range(60)]  # ties
    got = mined(spark, rows)
    assert len(got) == len(set(got)) > 0
    assert set(got) == brute_negatives(rows)


def test_negatives_over_many_partitions(spark, monkeypatch):
    """Blocks meet by their key, not because few partitions were merged into one."""
    monkeypatch.setattr(negatives, "BLOCKS", 8)
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(4)), [float(x) for x in rng.normal(size=6) + 0.3]) for i in range(0, 1000, 4)]
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", False)
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    try:
        got = mined(spark, rows)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got and set(got) == brute_negatives(rows)


def test_negatives_odd_rows(spark):
    good = [(100, 1, [1.0, 2.0]), (1, 1, [1.0, 2.0]), (2, 1, [2.0, 1.0]), (3, 2, [1.0, 0.5]), (4, 3, [0.5, 1.0]), (4, 3, [0.5, 1.0]), (5, 2, [1.5])]
    odd = [(None, 2, [1.0, 0.5]), (6, None, [1.0, 0.5]), (7, 2, None), (8, 2, [None, 1.0]), (9, 2, [float("nan"), 1.0]), (10, 2, [float("inf"), 1.0]), (12, 2, []), (200, 9, [1.0, 1.0]), (300, 1, [-1.0, -1.0])]
    assert set(mined(spark, good + odd)) == brute_negatives(good + odd)
    assert (100, 1, 2, 3, 65536 * 5, 65536 * 2) in set(mined(spark, good))
    assert mined(spark, good[:1]) == [] and spark.createDataFrame([], "vec_id bigint, label int, embedding array<double>").transform(lambda d: negatives.mine(negatives.usable(d), F.lit(True))).count() == 0


def test_scores_beyond_double_precision_are_exact():
    a, b = np.array([[2.0**40 + 1, 3.0]]), np.array([[2.0**20 + 1, 5.0]])
    assert negatives.exact(a, b).tolist() == [(2**40 + 1) * (2**20 + 1) + 15]
    with pytest.raises(OverflowError):
        negatives.exact(np.array([[2.0**60]]), np.array([[2.0**60]]))


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_bounds_hold_and_refine(spread):
    rng = np.random.default_rng(4)
    a, b = (negatives.Block(np.floor(256 * (rng.normal(size=(20, 64)) * spread + np.repeat(rng.normal(size=(20, 16)), 4, axis=1)))) for _ in range(2))
    i, j = (x.ravel() for x in np.indices((20, 20)))
    score = negatives.exact(a.x[i], b.x[j])
    widths = []
    for level in range(len(a.levels)):
        lo, hi = negatives.bounds(a, i, b, j, level)
        assert (lo <= score).all() and (score <= hi).all()
        widths.append((hi - lo).mean())
    assert widths == sorted(widths, reverse=True)
    fits = np.ones((20, 20), bool)
    asked = np.full((20, 1), -np.inf), np.full((20, 1), np.inf)
    _, _, kept = negatives.search(a, b, fits, *asked, 3)
    if spread < 1:
        assert len(kept) < 200  # summaries settle most pairs of vectors that are flat within segments
