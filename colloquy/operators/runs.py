"""Per-run and per-cell statistics. ``turns`` has run_id, turn_index, agent, content; ``runs`` has run_id, variant, seed,
stop_reason, completed_turns. A cell is a (variant, seed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.numeric import gzip_ratio
from colloquy.operators.ranks import joined_by, quantiles

NATURAL = ("completed", "degenerate_repetition")


def natural(stop: Column | str = "stop_reason") -> Column:
    """Whether a run ended by itself."""
    return (F.col(stop) if isinstance(stop, str) else stop).isin(*NATURAL)


def run_metrics(turns: DataFrame, gzip: bool = False) -> DataFrame:
    """Per run: n_turns, mean_chars, unique_ratio (distinct contents over turns), and gzip_ratio on request."""
    out = turns.groupBy("run_id").agg(
        F.count("*").alias("n_turns"), F.avg(F.length("content")).alias("mean_chars"), (F.countDistinct("content") / F.count("*")).alias("unique_ratio")
    )
    if gzip:
        out = out.join(run_documents(turns).select("run_id", gzip_ratio("document").alias("gzip_ratio")), "run_id")
    return out


def mean_elapsed(turns: DataFrame) -> DataFrame:
    """Per run: the mean of ``elapsed_ms``; turns without one don't count, and a run of none has 0."""
    return turns.groupBy("run_id").agg(F.coalesce(F.avg("elapsed_ms"), F.lit(0.0)).alias("mean_elapsed"))


def run_documents(turns: DataFrame) -> DataFrame:
    """Each run's contents joined by newlines in turn order."""
    rows = F.array_sort(F.collect_list(F.struct("turn_index", "content")))
    return turns.groupBy("run_id").agg(F.array_join(F.transform(rows, lambda r: F.coalesce(r.content, F.lit(""))), "\n").alias("document"))


def cell_stats(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per cell: runs, runs by way of ending, and medians and means over naturally ended runs (0 if none)."""
    ended = natural()
    over = lambda c, f: F.coalesce(f(F.when(ended, F.col(c))), F.lit(0.0))
    count_if = lambda x: F.count(F.when(x, 1))
    return runs.join(metrics, "run_id", "left").groupBy("variant", "seed").agg(
        F.count("*").alias("n_runs"), count_if(F.col("stop_reason") == "completed").alias("n_completed"),
        count_if(F.col("stop_reason") == "degenerate_repetition").alias("n_degenerate"), count_if(~ended).alias("n_aborted"),
        over("completed_turns", F.median).alias("median_turns"), over("unique_ratio", F.avg).alias("mean_unique"), over("mean_chars", F.avg).alias("mean_chars"),
        *([over("gzip_ratio", F.avg).alias("mean_gzip")] if "gzip_ratio" in metrics.columns else []),
    )


def reject_accounting(runs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Runs by outcome: kept, aborted, or of a seed that ``seeds`` (seed) doesn't list."""
    known = seeds.select("seed").distinct().withColumn("known", F.lit(True))
    outcome = F.when(F.col("known").isNull(), "legacy").when(~natural(), "aborted").otherwise("kept")
    return runs.join(F.broadcast(known), "seed", "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def length_features(turns: DataFrame, runs: DataFrame, full_length: int = 50) -> DataFrame:
    """Nine features of naturally ended runs: turns, early and degenerate flags, and statistics of message lengths."""
    n = F.length("content")
    sizes = turns.groupBy("run_id").agg(
        F.sum(n).cast("double").alias("total_chars"), F.avg(n).alias("mean_chars"), F.median(n).alias("median_chars"),
        F.stddev_pop(n).alias("std_chars"), F.max(n).cast("double").alias("max_chars"), F.min(n).cast("double").alias("min_chars"),
    )
    return runs.where(natural()).join(sizes, "run_id").select(
        "run_id", "variant", F.col("completed_turns").cast("double").alias("completed_turns"), (F.col("completed_turns") < full_length).cast("double").alias("is_early_stop"),
        (F.col("stop_reason") == "degenerate_repetition").cast("double").alias("is_degenerate"), "total_chars", "mean_chars", "median_chars", "std_chars", "max_chars", "min_chars",
    )


def long_features(features: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """Rows (keep..., feature, value) from columns."""
    return features.select(*keep, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in names])).alias("x")).select(*keep, "x.feature", "x.value")


def describe_by_class(long: DataFrame, positive: Column) -> DataFrame:
    """Per feature: mean and median of both classes, and Cohen's d with pooled variance (null if it is 0).

    Null values and rows whose class is null are left out. Medians go by ranges of values: a feature's values meet in no task.
    """
    one, two = F.when(positive, F.col("value")), F.when(~positive, F.col("value"))
    stats = long.groupBy("feature").agg(
        *[f(x).alias(f"{k}_{side}") for side, x in (("pos", one), ("neg", two)) for k, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))]
    )
    middle = quantiles(long.withColumn("_side", positive).where("_side is not null"), ["feature", "_side"], "value", {"median": 0.5})
    middle = middle.groupBy("feature").agg(F.max(F.when(F.col("_side"), F.col("median"))).alias("median_pos"), F.max(F.when(~F.col("_side"), F.col("median"))).alias("median_neg"))
    pooled = F.sqrt(F.try_divide((F.col("n_pos") - 1) * F.col("var_pos") + (F.col("n_neg") - 1) * F.col("var_neg"), F.col("n_pos") + F.col("n_neg") - 2))
    return joined_by(stats, middle, ["feature"]).select("feature", "mean_pos", "mean_neg", "median_pos", "median_neg", F.try_divide(F.col("mean_pos") - F.col("mean_neg"), pooled).alias("cohens_d"))


def turn_slice(turns: DataFrame, start: int | None, stop: int | None) -> DataFrame:
    """Turns by position in their run, as a Python slice would take them; negative bounds count from the end."""
    sizes = turns.groupBy("run_id").agg(F.count("*").alias("_n"))
    bound = lambda b, default: default if b is None else (F.lit(b) if b >= 0 else F.greatest(F.col("_n") + b, F.lit(0)))
    inside = (F.col("turn_index") >= bound(start, F.lit(0))) & (F.col("turn_index") < bound(stop, F.col("_n")))
    return turns.join(sizes, "run_id").where(inside).drop("_n")


def grid(variants: DataFrame, seeds: DataFrame, n_runs: int) -> DataFrame:
    """All planned runs: variant, seed, run_idx. The inputs are dimension lists, a few rows each."""
    each = F.explode(F.sequence(F.lit(0), F.lit(n_runs - 1))).alias("run_idx")
    return variants.select("variant", each).join(F.broadcast(seeds.select(F.collect_list("seed").alias("_seeds"))), F.lit(True)).select("variant", F.explode("_seeds").alias("seed"), "run_idx")


def pool_prompt(runs: DataFrame, pool: DataFrame) -> DataFrame:
    """Gives each run the prompt pool[run_idx % size]; ``pool`` has idx (0, 1, ...) and prompt."""
    size = pool.count()
    return runs.withColumn("idx", F.pmod(F.col("run_idx"), F.lit(max(size, 1)))).join(pool, "idx").drop("idx")
