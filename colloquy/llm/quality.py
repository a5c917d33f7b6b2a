"""Quality rules: a learned decision list over text statistics.

Sequential covering on labelled documents grows conjunctions of thresholds by information gain, prunes each on held-out
rows, and emits the list as one ordered Spark conditional expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import plain_words

WINDOW = 8
SYMBOLS = re.compile(r"[#*$%&|<>]+")
DIGITS = re.compile(r"[0-9]+")
STOPS = re.compile(r"[.!?]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_digits", "n_upper", "n_stops")
STATS = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])

#: The statistics that rules may test, as expressions over the counts; all are defined for empty texts.
RATIOS = {
    "n_words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "digits_per_word": "n_digits / greatest(n_words, 1)",
    "upper_per_word": "n_upper / greatest(n_words, 1)",
    "stops_per_word": "n_stops / greatest(n_words, 1)",
}


def repeated_words(codes: np.ndarray, distinct: int, window: int = WINDOW) -> int:
    """Words in windows of ``window`` (a power of two) that are found twice or more, the first included. Exact: windows
    get ids by pairing the ids of their halves."""
    if len(codes) <= window or distinct == len(codes):
        return 0
    ids, width, at = codes, 1, distinct
    while width < window:
        pairs = ids[:-width] * at + ids[width:]
        unique, ids = np.unique(pairs, return_inverse=True)
        if len(unique) == len(pairs):
            return 0
        at, width = len(unique), 2 * width
    twice = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(codes) + 1, np.int64)
    edge[:-window][twice] += 1 if len(twice) == len(codes) - window + 1 else 0
    np.subtract.at(edge, np.flatnonzero(twice) + window, 1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts of one whole text, in the order of COUNTS; null as empty."""
    words = plain_words(text)
    if not words:
        return (0,) * len(COUNTS)
    codes: dict[str, int] = {}
    coded = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    upper = sum(w[0].isupper() for w in words)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    return (
        len(words), chars, sum(map(len, SYMBOLS.findall(text))), len(lines) - len(set(lines)), repeated_words(coded, len(codes)),
        len(lines), len(codes), sum(map(len, DIGITS.findall(text))), upper, len(STOPS.findall(text)),
    )


@F.pandas_udf(STATS)
def _counts(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([text_counts(t) for t in batch], columns=list(COUNTS), dtype="int64")


#: Not deterministic for the optimizer only: a filter on the counts must not run the function a second time.
counts_udf = _counts.asNondeterministic()


def with_counts(docs: DataFrame, column: str = "text", to: str = "_counts") -> DataFrame:
    """Adds the counts of each whole text as a struct; no shuffle."""
    return docs.withColumn(to, counts_udf(F.col(column)))


def base_failed(counts: str = "_counts") -> Column:
    """The fixed rules: fewer than 20 words, or over 30 of 100 words in repeated windows."""
    c = F.col(counts)
    return (c.n_words < 20) | (100 * c.n_repeat_words > 30 * c.n_words)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, threshold); documents that meet all are rejected."""

    conditions: tuple[tuple[str, bool, float], ...]
    precision: float

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([(x[f] > t) if above else (x[f] <= t) for f, above, t in self.conditions])


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray], most: int) -> tuple:
    """Adds the condition with the largest information gain until only bad rows are covered or nothing gains."""
    covered, chosen = np.ones(len(bad), bool), []
    while len(chosen) < most:
        p, n = (covered & bad).sum(), (covered & ~bad).sum()
        if not n or not p:
            break
        best = (1e-9, None, None)
        for f, values in x.items():
            side = values[:, None] > cuts[f]
            for above in (True, False):
                hit = (side == above) & covered[:, None]
                tp, fp = (hit & bad[:, None]).sum(0), (hit & ~bad[:, None]).sum(0)
                gain = tp * (np.log2(np.maximum(tp, 1e-9) / np.maximum(tp + fp, 1)) - np.log2(p / (p + n)))
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, above, float(cuts[f][k])), hit[:, k])
        if best[1] is None:
            break
        chosen.append(best[1])
        covered = best[2]
    return tuple(chosen)


def _centre(conditions: tuple, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple:
    """Moves each threshold halfway to the bad rows that its rule covers, so that rows unlike any bad one stay out."""
    moved = list(conditions)
    for k, (f, above, _) in enumerate(conditions):
        rest = Rule(tuple(moved[:k] + moved[k + 1 :]), 0)
        among = bad & (rest.covers(x) if rest.conditions else True)
        t, v = moved[k][2], x[f]
        if above and (hit := among & (v > t)).any():
            moved[k] = (f, above, float((v[v <= t].max(initial=t) + v[hit].min()) / 2))
        elif not above and (hit := among & (v <= t)).any():
            moved[k] = (f, above, float((v[v > t].min(initial=np.inf) + v[hit].max()) / 2) if (v > t).any() else t)
    return tuple(moved)


def learn_rules(stats: pd.DataFrame, bad: np.ndarray, min_precision: float = 0.95, min_support: int = 5, most_rules: int = 12, most_conditions: int = 4, seed: int = 7) -> list[Rule]:
    """Sequential covering: grow on two thirds of what is left, prune on the other third, keep a rule only if it is
    precise on both, remove what it covers, and go on until a rule is turned down."""
    rng = np.random.default_rng(seed)
    x_all = {f: stats[f].to_numpy(float) for f in RATIOS}
    left = np.ones(len(bad), bool)
    rules: list[Rule] = []
    cuts = {f: np.unique(np.quantile(v, np.linspace(0.01, 0.99, 50))) if len(v) else np.zeros(1) for f, v in x_all.items()}
    while len(rules) < most_rules and (left & bad).sum() >= 2 * min_support:
        rows = np.flatnonzero(left)
        held = rng.random(len(rows)) < 1 / 3
        part = lambda at: ({f: v[at] for f, v in x_all.items()}, bad[at])
        (x, y), (hx, hy) = part(rows[~held]), part(rows[held])
        conditions = _centre(_grow(x, y, cuts, most_conditions), x, y)
        if not conditions:
            break

        def worth(c: tuple, hx: dict = hx, hy: np.ndarray = hy) -> tuple[float, int]:
            hit = Rule(c, 0).covers(hx)
            return ((2 * hy[hit].mean() - 1) if hit.any() else -1.0, -len(c))

        conditions = max((conditions[:k] for k in range(1, len(conditions) + 1)), key=worth)
        hit, seen = Rule(conditions, 0).covers(hx), Rule(conditions, 0).covers(x)
        both = np.r_[hy[hit], y[seen]]
        if len(both) < min_support or not hit.any() or both.mean() < min_precision or hy[hit].mean() < min_precision:
            break
        rule = Rule(conditions, float(both.mean()))
        rules.append(rule)
        left &= ~rule.covers(x_all)
    return rules


def rules_expression(rules: list[Rule], counts: str = "_counts") -> Column:
    """Whether the list keeps a document: the first rule that holds rejects it, and the default keeps it."""
    stat = {f: F.expr(_within(e, counts)) for f, e in RATIOS.items()}
    listed = F.when(F.lit(False), F.lit(False))
    for rule in rules:
        holds = F.lit(True)
        for f, above, t in rule.conditions:
            holds = holds & ((stat[f] > t) if above else (stat[f] <= t))
        listed = listed.when(holds, F.lit(False))
    return listed.otherwise(F.lit(True))


def _within(expression: str, counts: str) -> str:
    for c in sorted(COUNTS, key=len, reverse=True):
        expression = re.sub(rf"(?<![\w.]){c}(?!\w)", f"`{counts}`.{c}", expression)
    return expression


def fit_rules(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000, **options: float) -> list[Rule]:
    """Learns rules from at most ``most_labelled`` labelled documents, those with the smallest hash of their id.

    ``labels`` has doc_id and quality (0: to reject); null ids or labels teach nothing, and no labels give no rules.
    The sample bounds what is broadcast (ids) and what the driver learns from (one row of counts each).
    """
    sample = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    stats = F.struct("_quality", *[F.expr(_within(e, "_counts")).cast("double").alias(f) for f, e in RATIOS.items()])
    counts = with_counts(known).groupBy("doc_id").agg(F.min(stats).alias("one")).select("one.*")  # one row an id, should it repeat
    rows = counts.toPandas().sort_values(list(RATIOS)).reset_index(drop=True)
    return learn_rules(rows, (rows["_quality"] == 0).to_numpy(bool), **options)


def judge_documents(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``_counts``, ``base_failed`` and ``kept`` (not base_failed, and no rule rejects it) to each document.

    Columns of those three names are replaced, all others stay; a null text has no words and fails; repeated rows are
    judged one by one; an empty table gives an empty result.
    """
    judged = with_counts(docs)
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules_expression(rules))
