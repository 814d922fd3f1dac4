"""URL filter: host and path rules, and for all other URLs gradient-boosted trees on lexical features.

The rules label URLs; a bounded hash sample of the labelled rows trains the trees, which judge the URLs that no rule fits. The
features are lengths, depth, digit ratio, character entropy, parameter counts and suffix statistics: the smoothed share of
blocked URLs among all labelled URLs with the same top-level label, last two labels, first label and path head. A training row's
shares are taken out of its fold, so that neither its own label nor those of its host are among them: folds are dealt by host.
The statistics are one written table that grows with the number of suffixes. Kinds of few suffixes (they are counted) are broadcast;
of others the suffixes of many URLs are salted in the join.

Edge cases: a null URL or one without ``://`` has an empty host and path and is judged by the trees; if the rules label no URL,
or all alike, the verdict for the rest is ``allow``, or the only label; repeated rows are judged alike; extra columns are kept,
same-named ones replaced.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, cut, join_unique

ALLOW, BLOCK = "allow", "block"
#: (verdict, rule): a rule is a host and the beginning of a path.
RULES = ((ALLOW, "com/"), (BLOCK, "example.com/en/"), (ALLOW, "www.example.com/en/"), (BLOCK, "net/es/"), (BLOCK, "net/fr/"))
#: About how many labelled rows the trees are fitted to.
MAX_TRAIN = 20_000
SUFFIXES = ("tld", "domain", "first", "head")
#: Parts of the hosts that are held out of each other's suffix statistics, and the rows that stand for the base rate beforehand.
FOLDS, SMOOTHING = 5, 20.0
#: Suffixes of a kind up to which their statistics are broadcast, as rows of about 200 bytes.
MAX_BROADCAST_ROWS = 50_000
#: A node of a tree chooses among a third of the features, drawn anew: else the rates, which the rules' labels follow, would take all nodes.
SUBSET = "onethird"
FEATURES = ("url_len", "host_len", "path_len", "depth", "labels", "digits", "entropy", "params", "has_fragment", "hyphens", "secure", *(f"{s}_rate" for s in SUFFIXES))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then up to ``?``, ``#`` or the end."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def with_rule(pages: DataFrame, rules=RULES, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the longest that fits, else null) and ``rule_verdict``."""
    host, path = host_and_path(F.col(url_col))
    out = pages.withColumns({"host": host, "path": path})
    rule = verdict = F.lit(None).cast("string")
    for name, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # longer rules are asked first: they wrap the shorter
        h, _, p = text.partition("/")
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit("/" + p))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, name).otherwise(verdict)
    return out.withColumns({"rule": rule, "rule_verdict": verdict})


def lexical(df: DataFrame, url_col: str = "url") -> DataFrame:
    """The lexical features and the three suffixes of each URL."""
    url, host, path = F.coalesce(F.col(url_col), F.lit("")), F.col("host"), F.col("path")
    count = lambda text, what: F.regexp_count(text, F.lit(what)).cast("double")
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n
    symbols = F.filter(F.array_distinct(F.split(url, "")), lambda c: c != "")
    entropy = F.aggregate(symbols, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    return df.withColumns(
        {
            "url_len": F.length(url).cast("double"),
            "host_len": F.length(host).cast("double"),
            "path_len": F.length(path).cast("double"),
            "depth": count(path, "/"),
            "labels": count(host, r"\."),
            "digits": count(url, "[0-9]") / n,
            "entropy": entropy,
            "params": count(F.regexp_extract(url, r"\?([^#]*)", 1), "="),
            "has_fragment": F.contains(url, F.lit("#")).cast("double"),
            "hyphens": count(url, "-"),
            "secure": F.startswith(F.lower(url), F.lit("https")).cast("double"),
            "tld": F.regexp_extract(host, r"[^.]*$", 0),
            "domain": F.regexp_extract(host, r"[^.]*\.?[^.]*$", 0),
            "first": F.regexp_extract(host, r"^[^.]*", 0),
            "head": F.regexp_extract(path, r"^/([^/]*)", 1),
        }
    )


def suffix_statistics(known: DataFrame) -> DataFrame:
    """(kind, value, fold, blocked, labelled, rows) of the suffixes of all URLs; ``known`` has them, ``fold`` and ``label`` (null: none)."""
    each = known.select("fold", "label", F.explode(F.array(*(F.struct(F.lit(s).alias("kind"), F.col(s).alias("value")) for s in SUFFIXES))).alias("s"))
    return each.groupBy("s.kind", "s.value", "fold").agg(F.coalesce(F.sum("label"), F.lit(0.0)).alias("blocked"), F.count("label").alias("labelled"), F.count("*").alias("rows"))


def with_rates(df: DataFrame, stats: DataFrame, base: float, n: int, held_out: bool) -> DataFrame:
    """``df`` with a rate for each kind of suffix; with ``held_out``, of the other folds than the row's own."""
    sizes = {r["kind"]: r["count"] for r in stats.groupBy("kind").count().collect()}
    for s in SUFFIXES:
        own = stats.where(F.col("kind") == s)
        whole = own.groupBy("value").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("k"), F.sum("rows").alias("rows"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("blocked", "labelled")))).alias("of"))
        few = sizes.get(s, 0) <= MAX_BROADCAST_ROWS
        hot = [] if few else [r[0] for r in whole.where(F.col("rows") * HOT_SHARE > n).select("value").collect()]
        known = whole.select(F.col("value").alias(s), "b", "k", "of")
        df = join_unique(df, F.broadcast(known) if few else known, s, hot, "left")
        minus = (F.coalesce(F.element_at("of", F.col("fold"))[c], F.lit(0)) if held_out else F.lit(0) for c in ("blocked", "labelled"))
        b, k = (F.coalesce(c, F.lit(0)) - m for c, m in zip((F.col("b"), F.col("k")), minus))
        df = df.withColumn(f"{s}_rate", (b + SMOOTHING * base) / (k + SMOOTHING)).drop("b", "k", "of")
    return df


def fit(known: DataFrame, stats: DataFrame, base: float, n: int, labelled: int, max_train: int, trees: int, depth: int):
    """Trees fitted to about ``max_train`` of the labelled rows of ``known``, chosen by the hash of their ``_row``."""
    chosen = F.pmod(F.col("_row"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, max_train / labelled)) + 1
    ready = gathered(with_rates(known.where(F.col("label").isNotNull() & chosen), stats, base, n, True)).select("features", "label").coalesce(4)
    return GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, maxBins=32, featureSubsetStrategy=SUBSET).fit(ready)


def gathered(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)


def judge(pages: DataFrame, rules=RULES, url_col: str = "url", max_train: int = MAX_TRAIN, trees: int = 30, depth: int = 4, id_col: str = "page_id") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``block_probability`` (of the trees, null where a rule decides)."""
    new = ("host", "path", "rule", "verdict", "block_probability")
    kept = [c for c in pages.columns if c not in new]
    row = pages.select(F.struct(*kept).alias("_kept"), F.col(url_col).alias("_url"), F.xxhash64(id_col, url_col).alias("_row"))
    ruled = with_rule(row, rules, "_url").withColumn("label", (F.col("rule_verdict") == BLOCK).cast("double"))
    size = ruled.agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.sum("label").alias("blocked")).first()
    blocked = size["blocked"] or 0.0
    if not blocked or blocked == size["labelled"]:
        rest = BLOCK if blocked else ALLOW
        return ruled.select("_kept.*", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(rest)).alias("verdict"), F.lit(None).cast("double").alias("block_probability"))
    base = blocked / size["labelled"]
    known = lexical(ruled, "_url").withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int"))
    stats = cut(suffix_statistics(known))
    model = fit(known, stats, base, size["n"], size["labelled"], max_train, trees, depth)
    scored = model.transform(gathered(with_rates(known, stats, base, size["n"], False)))
    p = vector_to_array("probability")[1]
    verdict = F.coalesce("rule_verdict", F.when(p >= 0.5, BLOCK).otherwise(ALLOW))
    return scored.select("_kept.*", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNull(), p).alias("block_probability"))
