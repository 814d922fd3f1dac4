"""Each stage of the corpus pipeline against a plain computation over the smallest tables, in the pipeline's order."""

import hashlib
import math

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

import corpus_pipeline
from ratingloom.llm import bpe, mixing, quality, simhash, toxicity
from ratingloom.llm.common import cut, table


@pytest.fixture(scope="module")
def kept(spark, data):
    """What goes into each stage, and what comes out of the last, as pandas tables."""
    docs, out = table(spark, data, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = docs.toPandas()
        docs = cut(stage(spark, docs, data))
    return out | {"end": docs.toPandas()}


def after(kept, name):
    names = [*(s for s, _ in corpus_pipeline.STAGES), "end"]
    return set(kept[names[names.index(name) + 1]].doc_id)


def test_toxicity(spark, data, kept):
    model = toxicity.fit(table(spark, data, "documents"), table(spark, data, "labels"))
    clean = set()
    for d in kept["toxicity"].itertuples():
        clear = 1.0
        for sentence in toxicity.SENTENCE.split(d.text.encode().lower()):
            if words := sentence.split():
                z = model.bias + sum(model.weights.get(f, 0.0) for w in words for f in toxicity.features(w))
                clear *= 1 - 1 / (1 + math.exp(-max(-35, min(35, z))))
        if 1 - clear < 0.5:
            clean.add(d.doc_id)
    assert after(kept, "toxicity") == clean and 0 < len(clean) < len(kept["toxicity"])


def test_quality(kept):
    rows = [(d.doc_id, *quality.measure_text(d.text)) for d in kept["quality_rules"].itertuples()]
    votes = {i: [0 if bad(r[name]) else 1 if good(r[name]) else 2 for name, bad, good in quality.RULES] if b[0] else [2] * len(quality.RULES) for i, b, r in rows}
    q = {i: (v.count(1) + 1) / (v.count(0) + v.count(1) + 2) for i, v in votes.items()}
    for _ in range(500):  # over documents, not patterns
        chance = quality.BEFORE.copy()
        for i, v in votes.items():
            for rule, x in enumerate(v):
                chance[0, rule, x] += 1 - q[i]
                chance[1, rule, x] += q[i]
        chance /= chance.sum(axis=2, keepdims=True)
        prior = (sum(q.values()) + 1) / (len(q) + 2)
        new = {}
        for i, v in votes.items():
            good, bad = (p * math.prod(chance[k, rule, x] for rule, x in enumerate(v)) for k, p in ((1, prior), (0, 1 - prior)))
            new[i] = good / (good + bad)
        change, q = max(abs(new[i] - q[i]) for i in q), new
        if change < 1e-9:
            break
    fails = {i for i, b, _ in rows if b[0] < 50 or 100 * b[4] > 50 * b[0]}
    assert after(kept, "quality_rules") == {i for i in q if q[i] >= 0.5 and i not in fails}


def test_near_duplicates(kept):
    def shingles(text):
        w = text.encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    docs = {d.doc_id: shingles(d.text) for d in kept["simhash_near_dedup"].itertuples()}
    label = {i: i for i in docs}
    links = [(i, j) for i in docs for j in docs if i < j and len(docs[i] & docs[j]) >= 0.8 * len(docs[i] | docs[j])]
    for _ in docs:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    assert after(kept, "simhash_near_dedup") == set(label.values()) and links


def test_mixing(kept):
    docs = kept["mixing"]
    topic = [
        "table" if " | " in t else "notice" if "icensed under" in t or "ights reserved" in t else "dialogue" if "?" in t else "prose" for t in docs.text
    ]
    tokens = np.array([len(t.encode().split()) for t in docs.text], float)
    marks = [[v if v in m.target else "other" for v in column] for m, column in zip(mixing.MARGINALS, (docs.source, docs.lang, topic))]
    targets = []
    for m, column in zip(mixing.MARGINALS, marks):
        share = {v: tokens[[x == v for x in column]].sum() / tokens.sum() for v in set(column)}
        named = sum(m.target[v] for v in share if v != "other")
        targets.append({v: share[v] if v == "other" else m.target[v] / named * (1 - share.get("other", 0)) for v in share})
    weight = np.ones(len(docs))
    for _ in range(mixing.ROUNDS):
        for column, target in zip(marks, targets):
            now = {v: (weight * tokens)[[x == v for x in column]].sum() / tokens.sum() for v in target}
            weight = weight * np.array([target[v] / now[v] for v in column])
    rate = weight / weight.max()
    drawn = {d for d, r in zip(docs.doc_id, rate) if int(hashlib.md5(f"{mixing.SEED}:{d}".encode()).hexdigest()[:8], 16) / 2**32 < r}
    assert after(kept, "mixing") == drawn
    for column, target in zip(marks, targets):  # expected shares of tokens
        for v, want in target.items():
            assert (rate * tokens)[[x == v for x in column]].sum() / (rate * tokens).sum() == pytest.approx(want, abs=1e-3)


def test_tokens(kept):
    ranks = bpe.read_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    end = kept["end"].set_index("doc_id")
    for d in kept["byte_bpe"].itertuples():
        assert np.frombuffer(end.ids[d.doc_id], "<u4").tolist() == library.encode_ordinary(d.text)


def test_whole_rows_of_the_fingerprint_classes(spark, data):
    docs = table(spark, data, "documents").select("doc_id", "text").toPandas()

    def print_of(text):
        w = text.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = {d.doc_id: print_of(d.text) for d in docs.itertuples()}
    label = {i: i for i in fp}
    links = [(i, j) for i in fp for j in fp if i < j and (fp[i] ^ fp[j]).bit_count() <= 3]
    for _ in fp:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.classes(table(spark, data, "documents")).collect()}
    assert got == {i: (f"{fp[i]:016x}", label[i]) for i in fp} and links
