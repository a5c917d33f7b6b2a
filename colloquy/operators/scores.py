"""Scores against classes: AUC, thresholds, confusion, rank tests, and summaries of safety scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.numeric import mann_whitney_p
from colloquy.operators.ranks import before, joined_by, quantiles, rank_sums, value_counts


def auc(rows: DataFrame, by: list[str], score: str, positive: Column) -> DataFrame:
    """Area under the ROC curve per group; null if a class is missing."""
    return rank_sums(rows, by, score, positive).select(*by, "n_pos", "n_neg", F.try_divide(F.col("u"), (F.col("n_pos") * F.col("n_neg")).cast("double")).alias("auc"))


def rank_test(rows: DataFrame, by: list[str], score: str, positive: Column) -> DataFrame:
    """Adds the two-sided Mann-Whitney p to the rank sums."""
    return rank_sums(rows, by, score, positive).withColumn("p", mann_whitney_p("u", "n_pos", "n_neg", "ties"))


def best_threshold(rows: DataFrame, by: list[str], score: str, positive: Column) -> DataFrame:
    """Per group, the midpoint and direction with the best accuracy (ties: smaller threshold, then above).

    Null scores are left out; a group of one distinct score has no midpoint and no row. Cuts inside a range of values are
    counted there, those between two ranges from the table of ranges, so no task orders all scores of a group.
    """
    counts = value_counts(rows, by, score, pos=F.count(F.when(positive, 1)), neg=F.count(F.when(~positive, 1)))
    inside = Window.partitionBy(*by, "_range").orderBy("value")
    upto, order, every = inside.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by).orderBy("_range"), Window.partitionBy(*by)
    cuts = counts.select(*by, "_range", "value", F.sum("pos").over(upto).alias("_p"), F.sum("neg").over(upto).alias("_n"), F.lead("value").over(inside).alias("_next"))
    ranges = counts.groupBy(*by, "_range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.min("value").alias("least"))
    ranges = ranges.select(
        *by, "_range", F.coalesce(F.sum("p").over(before(by, "_range")), F.lit(0)).alias("_lower_p"), F.coalesce(F.sum("n").over(before(by, "_range")), F.lit(0)).alias("_lower_n"),
        F.lead("least").over(order).alias("_following"), F.sum("p").over(every).alias("_all_p"), F.sum("n").over(every).alias("_all_n"),
    )
    above = (F.col("_all_p") - F.col("_p") - F.col("_lower_p") + F.col("_n") + F.col("_lower_n")) / (F.col("_all_p") + F.col("_all_n"))
    cut = joined_by(cuts, ranges, [*by, "_range"]).select(*by, ((F.col("value") + F.coalesce("_next", "_following")) / 2).alias("threshold"), above.alias("_above")).where("threshold is not null")
    way = lambda accuracy, side: F.struct((-F.round(accuracy, 9)).alias("worse"), "threshold", F.lit(side).alias("side"), accuracy.alias("accuracy"))
    best = cut.groupBy(*by).agg(F.min(F.least(way(F.col("_above"), "above"), way(1 - F.col("_above"), "below"))).alias("_best")).where("_best is not null")
    return best.select(*by, "_best.threshold", "_best.accuracy", "_best.side")


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts of each (truth, predicted)."""
    return rows.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def confusion_metrics(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: accuracy, majority baseline, mean absolute class error; classes are integers."""
    t = confusion(rows, truth, predicted)
    sizes = t.groupBy(truth).agg(F.sum("n").alias("n")).agg((F.max("n") / F.sum("n")).alias("majority"))
    return t.agg(
        (F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"),
        (F.sum(F.abs(F.col(truth) - F.col(predicted)) * F.col("n")) / F.sum("n")).alias("mean_abs_error"), F.sum("n").alias("n"),
    ).crossJoin(F.broadcast(sizes))


def recalls(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per class: rows, and the share predicted right."""
    return rows.groupBy(truth).agg(F.count("*").alias("n"), F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("recall"))


def mcc(rows: DataFrame, by: list[str], truth: Column, predicted: Column) -> DataFrame:
    """Matthews correlation per group; null if the denominator is 0."""
    n = lambda x: F.count(F.when(x, 1)).cast("double")
    t = rows.groupBy(*by).agg(n(truth & predicted).alias("tp"), n(~truth & predicted).alias("fp"), n(truth & ~predicted).alias("fn"), n(~truth & ~predicted).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return t.select(*by, F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"))


def safety_by_run(scored: DataFrame, unsafe_at: float = 0.5) -> DataFrame:
    """Per run: turns, unsafe turns, largest and mean score over valid ones (0 if none), verdict."""
    p = F.col("p_unsafe")
    return scored.groupBy("run_id").agg(
        F.count("*").alias("n_turns"), F.count(F.when(p >= unsafe_at, 1)).alias("n_unsafe"), F.coalesce(F.max(p), F.lit(0.0)).alias("max_p_unsafe"), F.coalesce(F.avg(p), F.lit(0.0)).alias("mean_p_unsafe"),
        F.when(F.coalesce(F.bool_or(p >= unsafe_at), F.lit(False)), "unsafe").otherwise("safe").alias("verdict"),
    )


def safety_distribution(scored: DataFrame, by: list[str]) -> DataFrame:
    """Per group: valid scores, median, 99th percentile, share and count at 0.5 or more."""
    p = F.col("p_unsafe")
    sizes = scored.where(p.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg((p >= 0.5).cast("double")).alias("share_flagged"), F.count(F.when(p >= 0.5, 1)).alias("n_flagged"))
    middle = quantiles(scored, by, "p_unsafe", {"median": 0.5, "p99": 0.99})
    joined = joined_by(sizes, middle, by)
    return joined.select(*by, "n", "median", "p99", "share_flagged", "n_flagged")


def histogram(rows: DataFrame, by: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts per bin from 0; the last bin is closed, values outside are left out."""
    at = F.least(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(bins - 1)).cast("long")
    return rows.where(F.col(value).between(low, high)).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))


def p_unsafe(top: Column) -> Column:
    """Probability of unsafe from (token, logprob) pairs: the sum over unsafe tokens, else one less that of safe ones."""
    mass = lambda word: F.aggregate(F.filter(top, lambda t: F.lower(F.trim(t.token)) == word), F.lit(0.0), lambda s, t: s + F.exp(t.logprob))
    return F.when(F.exists(top, lambda t: F.lower(F.trim(t.token)) == "unsafe"), mass("unsafe")).otherwise(F.greatest(F.lit(0.0), 1 - mass("safe")))
