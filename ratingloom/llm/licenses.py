"""License scans by diagonal voting, in DataFrame functions only.

Texts and license templates are cut into words. The hash of every run of ``K`` words of a text joins the positions of the same
run in the templates; the run's words are compared too, so a hash collision never counts. A hit votes for the diagonal (text
position minus template position). Neighbouring diagonals of a template (few words were put in or left out) merge into one span. A
span is verified in windows of the text, each somewhat more than twice as long as the template and half a template after the one
before: it is a finding if the votes in some window cover enough of the template's words, each counted once. So votes that lie
scattered over a long text aren't one, and a template that is repeated back to back, whole or in parts, is found however many
times it stands. Base phrases are templates that must stand whole: all runs of a phrase on one diagonal.

Templates are a parameter: one-line notices and, in ``license_texts``, whole licenses, of any length. Their runs (about 4,000) are
broadcast. Runs whose words can't begin, go on or end a run of a template are left out before they are joined and hashed. Each text
also emits one sentinel row that joins a sentinel template, so one pass over the texts yields both the hits and a row for texts
without any.

Edge cases: null and empty texts have no words and no labels; a text may hold any number of findings; texts of any length are
exploded run by run; rows with equal id and text are counted once and given back as often as they stood; null ids are kept.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 3
#: ASCII characters that aren't letters or digits separate words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that count wherever their words stand one after the other.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Wording of license notices, one line each.
NOTICES = (
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("all-rights-reserved", "all rights reserved"),
)


def whole_texts(folder: Path = Path(__file__).with_name("license_texts")) -> tuple[tuple[str, str], ...]:
    """(label, words) of each whole license: the label is the file's name."""
    return tuple((p.stem, " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", p.read_text().lower()))) for p in sorted(folder.glob("*.txt")))


TEMPLATES = (*NOTICES, *whole_texts())
MIN_COVER = 0.75
#: Diagonals of one template within this many words belong to one span, whose windows are so many times (and a half) as long as the template.
SHIFT, STRETCH = 3, 2


def words_of(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), GAP), lambda w: w != "")


def _template_rows(phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]], k: int) -> list[tuple]:
    rows = []
    for number, (label, text, base) in enumerate([*((x, y, True) for x, y in phrases), *((x, y, False) for x, y in templates)]):
        words = text.split()
        if len(words) < k:
            raise ValueError(f"a template has {k} words at least: {text}")
        rows += [(number, label, base, len(words), i, " ".join(words[i : i + k])) for i in range(len(words) - k + 1)]
    return rows


def _hits(docs: DataFrame, id_col: str, text_col: str, rows: list[tuple], k: int) -> DataFrame:
    """(id, text_key, n_words, pos) of every run of a text that stands in a template, with the template's columns."""
    runs = docs.sparkSession.createDataFrame([*rows, (-1, None, False, 0, -1, "")], "template int, label string, base boolean, length int, at int, run string")
    text = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), words_of(F.col(text_col)).alias("w"))
    # one run of k words a row; the sentinel is a run without words that carries the number of words as its position
    starts = F.when(F.size("w") >= k, F.sequence(F.lit(0), F.size("w") - k)).otherwise(F.array().cast("array<int>"))
    words = [r[5].split(" ") for r in rows]
    for j in range(k):
        known = sorted({w[j] for w in words})
        starts = F.filter(starts, lambda i: F.get("w", i + F.lit(j)).isin(known))  # noqa: B023
    cut_ = F.transform(starts, lambda i: F.struct(i.alias("pos"), F.array_join(F.slice("w", i + 1, k), " ").alias("run")))
    each = text.select("id", "text_key", F.size("w").alias("n_words"), F.explode(F.concat(cut_, F.array(F.struct(F.size("w").alias("pos"), F.lit("").alias("run"))))).alias("r"))
    hashed = each.select("id", "text_key", "n_words", "r.pos", F.col("r.run").alias("own"), F.xxhash64("r.run").alias("h"))
    return hashed.join(F.broadcast(runs.withColumn("h", F.xxhash64("run"))), "h").where("own = run")


TEXT = ("id", "text_key")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES,
          k: int = K, min_cover: float = MIN_COVER, shift: int = SHIFT) -> DataFrame:
    """Long form, a row a span: id, text_key, template, label, base, first and last word, cover, and ``found``.

    Template -1 is a text's sentinel: a row for each distinct text, with ``rows``, how often it stands.
    """
    hits = _hits(docs, id_col, text_col, _template_rows(phrases, templates, k), k)
    diagonal = F.when(F.col("template") >= 0, F.col("pos") - F.col("at"))
    votes = hits.groupBy(*TEXT, "template", "label", "base", "length", diagonal.alias("diagonal"), "at").agg(F.count("*").alias("times"), F.max("n_words").alias("n_words"))
    near = Window.partitionBy(*TEXT, "template").orderBy("diagonal", "at")
    gap = F.col("diagonal") - F.lag("diagonal").over(near)
    starts = gap.isNull() | (gap > F.when(F.col("base"), 0).otherwise(shift))
    dealt = votes.withColumn("new", F.when(starts, 1).otherwise(0)).withColumn("span", F.sum("new").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    # verified in windows: the words of the template that the span's runs cover there, each counted once
    pos = F.col("diagonal") + F.col("at")
    step = F.greatest(F.floor(F.col("length") / 2), F.lit(1))
    newest = F.floor(pos / step)
    oldest = F.greatest(F.floor((pos - STRETCH * F.col("length") - step) / step) + 1, F.lit(0))
    windows = F.when((F.col("template") < 0) | F.col("base"), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(oldest, newest))
    dealt = dealt.withColumn("window", F.explode(windows))
    ahead = F.lead("at").over(Window.partitionBy(*TEXT, "template", "span", "window").orderBy("at"))
    covered = dealt.withColumn("covered", F.least(F.lit(k), F.coalesce(ahead - F.col("at"), F.lit(k))))
    merged = covered.groupBy(*TEXT, "template", "label", "base", "length", "span", "window").agg(
        F.sum("covered").alias("covered"), F.count("*").alias("runs"), F.min(pos).alias("first"), F.max(pos + k - 1).alias("last"),
        F.sum(F.when(F.col("template") < 0, F.col("times"))).alias("rows"), F.max("n_words").alias("n_words"),
    )
    best = F.max_by(F.struct("covered", "runs", "first", "last", "rows", "n_words"), F.struct("covered", -F.col("window")))
    spans_ = merged.groupBy(*TEXT, "template", "label", "base", "length", "span").agg(best.alias("best")).select(*TEXT, "template", "label", "base", "length", "best.*")
    cover = F.col("covered") / F.greatest("length", F.lit(1))
    whole = F.col("runs") == F.col("length") - k + 1
    found = F.when(F.col("template") < 0, False).when(F.col("base"), whole).otherwise(cover >= min_cover)
    return spans_.withColumns({"cover": cover, "found": found}).drop("covered", "runs")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES,
         k: int = K, min_cover: float = MIN_COVER, shift: int = SHIFT) -> DataFrame:
    """A row for each row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    all_ = spans(docs, id_col, text_col, phrases, templates, k, min_cover, shift)
    base = F.col("found") & F.col("base")
    names = lambda flag, which: F.concat_ws(",", *(F.when(F.max(flag & (F.col("label") == x)), x) for x in sorted(set(which))))
    ours = {label for label, _ in phrases}
    per = all_.groupBy(*TEXT).agg(
        F.max("n_words").cast("long").alias("n_words"), F.max("rows").alias("rows"), F.count_if(base).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        names(base, ours).alias("base_labels"), names(F.col("found"), ours | {label for label, _ in templates}).alias("labels"),
        F.coalesce(F.max(F.when(F.col("found"), F.col("cover"))), F.lit(0.0)).alias("score"),
    )
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))
    return per.withColumn("_copy", copies).select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def base_sql(phrases: Sequence[tuple[str, str]] = PHRASES, table: str = "documents") -> Mapping[str, str]:
    """DuckDB expressions of the base columns for tests: places of each phrase by comparing slices of words."""
    out = {}
    for label, phrase in phrases:
        words = phrase.split()
        out[label] = f"list_filter(range(1, len(w) - {len(words) - 2}), lambda i: list_slice(w, i, i + {len(words) - 1}) = {words!r})"
    return out
