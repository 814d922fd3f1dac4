"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns: every operator has a defined result."""

import hashlib
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ratingloom.llm import bpe, licenses, mixing, ppm, quality, simhash, toxicity, urls, warc, webp

LONG = "word " * 30_000 + "x" * 50_000
TEXTS = [(1, "A fine day. You idiot!"), (2, None), (3, ""), (4, LONG), (5, "same text here"), (5, "same text here"), (None, "no id"), (6, " \t\n "), (7, "ünïcode — 漢字 \U0001f600 \u0000 end")]
CLASH = "score predicted n_tokens ids media n_bytes payload_bytes quality kept n_words pattern host path rule verdict rate topic id text_key row node label component_id _fp _id _tokens".split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "src1", None if t is None else len(t)) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").cache()


@pytest.fixture(scope="module")
def clashing(docs):
    odd = {"of": F.create_map(F.lit("k"), F.array("lang")), "maps": F.array(F.create_map("lang", "source")), "raw": F.unhex(F.lit("00FF")), "nothing": F.lit(None).cast("map<string,int>")}
    return docs.withColumns({c: F.lit("own") for c in CLASH} | odd)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 1), (1, 1, 0), (4, 1, 0), (5, 0, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


OPERATORS = {
    "toxicity": lambda d, labels: toxicity.classify(d, labels),
    "ppm": lambda d, labels: ppm.score_documents(d),
    "simhash": lambda d, labels: simhash.classes(d),
    "similar": lambda d, labels: simhash.similar_classes(d),
    "webp": lambda d, labels: webp.round_trip(d),
    "quality": lambda d, labels: (lambda m: quality.judge(m, quality.fit(m)))(quality.measure(d)),
    "bpe": lambda d, labels: bpe.round_trip(d, ranks(), public_tokenizers.PATTERN),
    "licenses": lambda d, labels: licenses.scan(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, docs, clashing, labels, name):
    op = OPERATORS[name]
    out = op(docs, labels).cache()
    assert out.count() == len(TEXTS)
    twins = out.where("doc_id = 5").toPandas().astype(str)
    assert len(twins) == 2 and twins.iloc[0].tolist() == twins.iloc[1].tolist()
    assert op(clashing, labels).count() == len(TEXTS)
    assert op(docs.where("false"), labels.where("false")).count() == 0


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, docs, labels, stage, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    f = dict(corpus_pipeline.STAGES)[stage]
    out = f(spark, docs, str(tmp_path))
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns
    assert out.count() <= len(TEXTS)
    assert f(spark, docs.where("false"), str(tmp_path)).count() == 0


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_that_share_a_name_with_theirs(spark, clashing, labels, stage, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    own = [c for c in CLASH if c != "topic"]  # the topic is an input of mixing
    out = dict(corpus_pipeline.STAGES)[stage](spark, clashing, str(tmp_path))
    assert out.columns == clashing.columns and all(set(r) == {"own"} for r in out.select(own).collect())


def test_one_row_of_each_group_stays_where_ids_repeat(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(7, long, "b"), (7, long, "a"), (7, long, "a"), (7, "another text", "c"), (3, long + " more", "d"), (9, "another text", "e"), (None, long, "f"), (None, "", "g"), (8, "", "h"), (6, None, "i")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = sorted(tuple(r) for r in simhash.deduplicated(d).where("doc_id IS NOT NULL").collect())
    assert got == [(3, long + " more", "d"), (6, None, "i"), (7, "another text", "c")]
    assert simhash.deduplicated(d.where("doc_id IS NULL")).count() == 2
    assert sorted(tuple(r) for r in simhash.deduplicated(d.where("doc_id = 7")).collect()) == [(7, "another text", "c"), (7, long, "a")]


def test_pages(spark):
    rows = [(1, "http://WWW.Example.com/en/x?a=1&b=2#f", "x" * 1200), (2, None, None), (3, "no scheme", ""), (3, "no scheme", ""), (None, "ftp://h", "x" * 1200), (5, "https://a.net/es/", "short"), (6, "https://net/es/1", "x" * 1200), (7, "https://x.com", "é" * 700)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    judged = {r.page_id: r for r in urls.judge(pages.withColumns({"host": F.lit("own"), "verdict": F.lit("own")})).collect()}
    assert (judged[1].host, judged[1].path, judged[1].rule, judged[1].verdict) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert (judged[2].host, judged[2].path, judged[2].rule) == ("", "", None) and judged[5].rule == "net/es/" and judged[6].verdict == "block" and judged[7].rule is None
    assert urls.judge(pages.where("false")).count() == 0
    back = warc.round_trip(pages.withColumn("file", F.lit("own"))).collect()
    assert len(back) == len(rows) and {r.page_id: r.refers_to for r in back}[1] == 6 and warc.round_trip(pages.where("false")).count() == 0


def test_text_ids_come_back_from_archives_whatever_they_hold(spark):
    ids = ["a\r\nX-Page-ID: evil", " blanks ", "100%25", "%", "tab\there", "plain", "ü"]
    pages = spark.createDataFrame([(i, "http://x.com", "y" * 1500) for i in ids], "page_id string, url string, html string")
    back = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert set(back) == set(ids)
    assert {r.refers_to for r in back.values()} == {max(ids, key=lambda x: x.encode()), None}


def test_long_urls_and_pages(spark):
    long = "http://a.org/" + "p/" * 400_000 + "?q=" + "1" * 4_000_000
    pages = spark.createDataFrame([(1, long, "z" * 5_000_000), (2, "http://b.com/x", "WARC/1.0\r\n" * 400_000)], "page_id bigint, url string, html string")
    pages = pages.withColumn("odd", F.create_map(F.lit("k"), "page_id"))
    judged = {r.page_id: r for r in urls.judge(pages).collect()}
    assert len(judged[1].path) == 1 + 800_000 and judged[2].verdict == "allow"
    back = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert {i: (r.payload_bytes, r.payload_digest) for i, r in back.items()} == {i: (len(x), hashlib.sha1(x.encode()).hexdigest()) for i, x in ((1, "z" * 5_000_000), (2, "WARC/1.0\r\n" * 400_000))}


def test_one_long_text_full_of_notices(spark):
    text = "All rights reserved. Released under the MIT license. " * 20_000
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert (row.n_words, row.n_base, row.labels, row.score) == (160_000, 20_000, "all-rights-reserved,mit", 1.0)


def test_mixing_odd_values(spark):
    d = spark.createDataFrame([(1, None, None, "a b"), (None, "src1", "en", None), (2, "src2", "xx", ""), (2, "src2", "xx", "")], "doc_id bigint, source string, lang string, text string")
    assert mixing.sample(d).columns == d.columns and mixing.sample(d.where("false")).count() == 0
    assert mixing.sample(d.withColumn("rate", F.lit("own"))).count() <= 4


def test_empty_text_digests(spark, docs):
    got = {r.doc_id: r for r in bpe.round_trip(docs, ranks(), public_tokenizers.PATTERN).collect()}
    assert got[2].n_tokens == 0 and got[2].decoded_sha256 == hashlib.sha256(b"").hexdigest() == got[2].ids_sha256
    assert got[7].decoded_sha256 == hashlib.sha256(TEXTS[-1][1].encode()).hexdigest()
    media = {r.doc_id: r for r in webp.round_trip(docs).collect()}
    assert (media[2].n_bytes, media[2].payload_bytes, media[2].payload_sha256) == (0, 64, hashlib.sha256(b"\0" * 64).hexdigest())


def test_url_suffix_statistics_cover_all_labelled_urls(spark, monkeypatch):
    rows = [(i, f"https://{'www.example' if i % 2 else 'example'}.com/en/{i}/p" if i % 3 else f"https://a.net/es/{i}") for i in range(240)]
    rows += [(i, f"https://x.b{i}.net/fr/") for i in range(240, 300)]
    seen, rated = [], urls.with_rates
    monkeypatch.setattr(urls, "with_rates", lambda df, stats, *more: seen.append((df, stats)) or rated(df, stats, *more))
    assert urls.judge(spark.createDataFrame(rows, "page_id bigint, url string"), max_train=60).count() == 300
    train, stats = seen[0]
    assert train.count() < 150
    assert {r["value"] for r in stats.where("kind = 'domain'").collect()} == {"example.com", "a.net", *(f"b{i}.net" for i in range(240, 300))}


def plain_rule(url):
    """The longest fitting rule, by the contract's words."""
    at = (url or "").find("://")
    rest = "" if at < 0 else url[at + 3 :]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = "".join(c.lower() if c.isascii() else c for c in rest[:end]), re.split(r"[?#]", rest[end:], maxsplit=1)[0]
    fits = [(len(r), r, v) for v, r in urls.RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules_equal_brute_force(spark, data):
    known = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url")
    odd = ["http://EXAMPLE.com/en/a", "http://notexample.com/en/", "x://www.example.com/en", "http://www.example.com/en/?q#f", "http://a.net/es/", "http://net/fr/x", "http://com", "http://com/", "http://b.com?x=/en/", "://", "a://b://c.com/en/", "http://ÄB.com/É", "http://u.example.com#/en/", " ", "http://x.com/" + "a/" * 20_000]
    pages = known.unionByName(spark.createDataFrame([(-k, u) for k, u in enumerate(odd, 1)], "page_id bigint, url string"))
    for r in urls.judge(pages).collect():
        host, path, rule, verdict = plain_rule(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule) and verdict in (None, r.verdict)


def test_trees_judge_unruled_urls_by_lexical_features_too(spark, data, monkeypatch):
    models, fit = [], urls.fit
    monkeypatch.setattr(urls, "fit", lambda *a: models.append(fit(*a)) or models[-1])
    out = urls.judge(spark.read.parquet(f"{data}/pages.parquet")).where("rule IS NULL")
    assert {r[0] for r in out.select("verdict").distinct().collect()} == {"allow", "block"}
    assert out.select("block_probability").distinct().count() > 0.8 * out.count()
    weight = dict(zip(urls.FEATURES, models[0].featureImportances.toArray().tolist()))
    print(weight)
    assert sum(w > 0 for f, w in weight.items() if not f.endswith("_rate")) >= 4


def test_trees_find_labels_of_hosts_that_they_have_not_seen(spark):
    # junk hosts have digits and hyphens and long queries; no suffix repeats, so only the lexical features can tell
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    urls_ = [(i, f"http://{word()}-{rng.randrange(10**6)}.{word()}.io/{word()}?{'&'.join(f'p{k}={k}' for k in range(rng.randint(2, 6)))}" if i % 2 else f"https://{word()}.{word()}.io/{word()}/{word()}") for i in range(1200)]
    pages = spark.createDataFrame([(i, u, float(i % 2)) for i, u in urls_], "page_id bigint, url string, label double")
    ruled = urls.with_rule(pages).withColumn("_row", F.xxhash64("page_id", "url"))
    known = urls.lexical(ruled).withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(urls.FOLDS)).cast("int"))
    train, test = known.where("page_id % 3 > 0"), known.where("page_id % 3 = 0")
    stats = urls.suffix_statistics(train)
    model = urls.fit(train, stats, 0.5, 800, 800, 20_000, 12, 4)
    out = model.transform(urls.gathered(urls.with_rates(test, stats, 0.5, 800, False)))
    assert BinaryClassificationEvaluator().evaluate(out) > 0.95


def test_suffix_rates_are_the_same_by_either_join(spark, monkeypatch):
    rows = [(i, f"http://h{i % 7}.x{i % 3}.{'com' if i % 2 else 'net'}/{'en' if i % 5 else 'es'}/{i}", float(i % 3 == 0) if i % 4 else None) for i in range(300)]
    d = spark.createDataFrame(rows, "page_id bigint, url string, label double")
    known = urls.lexical(urls.with_rule(d)).withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(urls.FOLDS)).cast("int"))
    stats = urls.suffix_statistics(known)
    columns = ["page_id", *(f"{s}_rate" for s in urls.SUFFIXES)]
    for held_out in (False, True):
        by_broadcast = urls.with_rates(known, stats, 0.4, 300, held_out).select(columns).toPandas().sort_values("page_id")
        with monkeypatch.context() as m:
            m.setattr(urls, "MAX_BROADCAST_ROWS", 0)
            by_salt = urls.with_rates(known, stats, 0.4, 300, held_out).select(columns).toPandas().sort_values("page_id")
        assert by_broadcast.round(12).values.tolist() == by_salt.round(12).values.tolist()
        table = known.toPandas()
        for s in urls.SUFFIXES:
            for i, want in zip(by_broadcast.page_id.head(40), by_broadcast[f"{s}_rate"].head(40)):
                own = table[table.page_id == i].iloc[0]
                same = table[(table[s] == own[s]) & ((table.fold != own.fold) | (not held_out))].label.dropna()
                assert want == pytest.approx((same.sum() + urls.SMOOTHING * 0.4) / (len(same) + urls.SMOOTHING))


def test_salted_joins_keep_all_rows(spark):
    from ratingloom.llm.common import hot_keys, join_unique

    rows = spark.createDataFrame([(i, None if i % 50 == 0 else "hot" if i % 3 else f"k{i}") for i in range(3000)], "n int, k string")
    rows = rows.withColumn("odd", F.create_map(F.lit("n"), "n"))
    unique = spark.createDataFrame([("hot", 1), ("k3", 2), ("k6", 3)], "k string, v int")
    hot = hot_keys(rows, "k")
    assert hot == ["hot"]
    for how in ("inner", "left"):
        a, b = (sorted((r.n, r.k or "", r.v or 0) for r in join_unique(rows, unique, "k", h, how).collect()) for h in (hot, []))
        assert a == b and len(a) == (3000 if how == "left" else len([x for x in a if x[2]]))
