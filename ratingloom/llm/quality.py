"""Quality rules as weak supervision: rules vote or abstain, and expectation-maximisation weighs them.

Every rule looks at one statistic of a text and votes good, bad or not at all. The votes of all documents are counted per vote
pattern in Spark (at most 3 ** rules patterns, so the counts are exact over all data and small). Expectation-maximisation on
the pattern counts estimates the class prior and, for each rule and class, how often it votes good, bad or not at all, with a
weak prior (a few votes) that a rule is better than chance; it starts from each text's share of good votes. A document is kept if
its posterior probability of being good is at least one half, rather than if it passes all rules: where rules that usually go
together disagree, one bad vote alone needn't count. Two base rules (too few words, too many repeated three-word windows) overrule
the model.

Several rules look at the same kind of junk from different sides (symbols, words that end in one, few letters, no function
words), so that the votes of good and of bad texts differ in more than one rule: without that, nothing tells a bad text that one
rule finds from a good text on which it errs.

Edge cases: a null text or one without words fails the base rules, every rule abstains, and its posterior is what the model makes
of a text without votes; empty tables give empty results; repeated rows count and are judged one by one; extra columns are kept,
same-named replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULT = (*STATS, "pattern", "base_failed", "quality", "kept")
BLANK = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Frequent function words of English, German, French and Spanish, as they stand within a sentence.
FUNCTION_WORDS = frozenset(
    w.encode()
    for w in (
        "the of and to in is that for it with as on are be this was by der die das und ist nicht mit von zu den ein eine auf für "
        "le la les de des et en un une est dans que pour el los las y es por con del no se"
    ).split()
)


def _bytes_in(*parts: bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    for p in parts:
        out[list(p)] = True
    return out


BEYOND = re.compile(r"[^\x00-\x7f]+")
#: Bytes of letters (all beyond ASCII count as such), of white space, and those that a word usually ends in.
LETTER = _bytes_in(range(65, 91), range(97, 123), range(128, 256))
SPACE = _bytes_in(BLANK.encode())
ENDING = LETTER | _bytes_in(b"0123456789.,;:!?)\"'")


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pair = ids[:-1] * len(number) + ids[1:]
    if len(number) < 1 << 20:
        window = pair[:-1] * len(number) + ids[2:]
    else:  # three ids no longer fit 63 bits
        window = np.unique(pair, return_inverse=True)[1][:-1].astype(np.int64) * len(number) + ids[2:]
    order = np.sort(window)
    same = order[1:] == order[:-1]
    if not same.any():
        return 0
    twice = np.isin(window, np.unique(order[1:][same]))
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def duplicate_lines(lines: list[str]) -> int:
    seen: set[str] = set()
    out = 0
    for line in lines:
        if line in seen:
            out += bool(line.strip(BLANK))
        else:
            seen.add(line)
    return out


def measure_text(text: str | None) -> tuple[tuple[int, ...], dict[str, float]]:
    """(the five base statistics, ratios that the rules look at)."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    lines = text.split("\n")
    counted = {c: text.count(c) for c in SYMBOLS + "!.?"}
    base = (
        n,
        len(text) - sum(text.count(c) for c in BLANK),
        sum(counted[c] for c in SYMBOLS),
        duplicate_lines(lines) if len(lines) > 1 else 0,
        repeated_words(words),
    )
    at = np.frombuffer(text.encode(), np.uint8)
    capitals = int(np.count_nonzero((at >= 65) & (at <= 90))) + sum(map(str.isupper, "".join(BEYOND.findall(text))))
    per = max(n, 1)
    space = SPACE[at]
    last = at[~space & np.append(space[1:], True)] if n else at
    return base, {
        "symbols": (base[2] - counted["|"]) / per,
        "bars": counted["|"] / per,
        "bangs": counted["!"] / per,
        "capitals": capitals / max(base[1], 1),
        "lines": base[3] / max(len(lines), 1),
        "repeats": base[4] / per,
        "length": base[1] / per,
        "distinct": len(set(words)) / per,
        "stops": (counted["."] + counted["?"]) / per,
        "letters": int(np.count_nonzero(LETTER[at])) / max(len(at) - int(np.count_nonzero(space)), 1),
        "endings": int(np.count_nonzero(~ENDING[last])) / per,
        "function": sum(map(FUNCTION_WORDS.__contains__, words)) / per,
    }


#: Name of the statistic, and when it votes bad or good; else it abstains. Thresholds are parameters of the rules, not fitted.
RULES = (
    ("symbols", lambda x: x > 0.1, lambda x: x < 0.02),
    ("letters", lambda x: x < 0.9, lambda x: x >= 0.95),
    ("endings", lambda x: x > 0.3, lambda x: x < 0.05),
    ("bars", lambda x: x > 0.1, lambda x: x < 0.01),
    ("bangs", lambda x: x > 0.2, lambda x: x < 0.05),
    ("capitals", lambda x: x > 0.3, lambda x: x < 0.1),
    ("lines", lambda x: x > 0.3, lambda x: x < 0.1),
    ("repeats", lambda x: x > 0.3, lambda x: x < 0.1),
    ("length", lambda x: x < 3 or x > 12, lambda x: 3.5 <= x <= 8),
    ("distinct", lambda x: x < 0.2, lambda x: x > 0.3),
    ("stops", lambda x: x < 0.01, lambda x: 0.02 <= x <= 0.4),
    ("function", lambda x: x < 0.03, lambda x: x >= 0.08),
)


def votes(ratios: dict[str, float]) -> str:
    """One character a rule: 0 bad, 1 good, - none."""
    return "".join("0" if bad(ratios[name]) else "1" if good(ratios[name]) else "-" for name, bad, good in RULES)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base statistics, ``base_failed`` and ``pattern``, the votes of the rules."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, pattern string")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                base, ratios = measure_text(t)
                rows.append((*base, votes(ratios) if base[0] else "-" * len(RULES)))
            yield pd.DataFrame(rows, columns=[*STATS, "pattern"])

    out = docs.withColumn("_q", measured.asNondeterministic()(F.col(text_col))).select(*(c for c in docs.columns if c not in RESULT), "_q.*")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


@dataclass
class Model:
    prior: float  # probability of good
    chance: np.ndarray  # (2, rules, 3): probability of the votes bad, good and none of each rule in a bad, a good text

    def weights(self) -> tuple[float, np.ndarray]:
        """(log odds of good before any vote, what each vote (bad, good, none) of each rule adds to them)."""
        return float(np.log(self.prior) - np.log(1 - self.prior)), np.log(self.chance[1]) - np.log(self.chance[0])

    def posterior(self, patterns: list[str]) -> np.ndarray:
        first, more = self.weights()
        return 1 / (1 + np.exp(-np.clip(first + np.einsum("prv,rv->p", coded(patterns), more), -500, 500)))

    def accuracies(self) -> np.ndarray:
        """(2, rules): how often a vote is right in bad, in good texts."""
        return np.stack([self.chance[k, :, k] / self.chance[k, :, :2].sum(axis=1) for k in (0, 1)])


def coded(patterns: list[str]) -> np.ndarray:
    return np.array([[[c == "0", c == "1", c == "-"] for c in p] for p in patterns], float).reshape(len(patterns), len(RULES), 3)


#: Votes (bad, good, none) that stand for each rule beforehand, in bad and in good texts: better than chance, and few.
BEFORE = np.array([[[2.0, 1.0, 1.0]] * len(RULES), [[1.0, 2.0, 1.0]] * len(RULES)])


def expectation_maximisation(patterns: list[str], n: np.ndarray, rounds: int = 500) -> Model:
    """Prior and votes' chances from pattern counts. It starts from each pattern's share of good votes."""
    if not len(patterns):
        return Model(0.5, BEFORE / BEFORE.sum(axis=2, keepdims=True))
    x = coded(patterns)
    q = np.array([(p.count("1") + 1) / (p.count("0") + p.count("1") + 2) for p in patterns])
    m = None
    for _ in range(rounds):
        seen = np.stack([np.einsum("p,prv->rv", n * (1 - q), x), np.einsum("p,prv->rv", n * q, x)]) + BEFORE
        m = Model(float(((n * q).sum() + 1) / (n.sum() + 2)), seen / seen.sum(axis=2, keepdims=True))
        last, q = q, m.posterior(patterns)
        if np.abs(q - last).max() < 1e-9:
            break
    return m


def fit(measured: DataFrame) -> Model:
    """Model of all documents' votes: the counts of each pattern (3 ** 12 at most) go to the driver."""
    rows = measured.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()
    return expectation_maximisation([r["pattern"] for r in rows], np.array([r["n"] for r in rows], float))


def judge(measured: DataFrame, model: Model) -> DataFrame:
    """``measured`` with ``quality``, the posterior, and ``kept``."""
    first, more = model.weights()
    odds = F.lit(first)
    for rule, (bad, good, none) in enumerate(more.tolist()):
        vote = F.substring("pattern", rule + 1, 1)
        odds = odds + F.when(vote == "0", bad).when(vote == "1", good).otherwise(none)
    out = measured.withColumn("quality", 1 / (1 + F.exp(-odds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
