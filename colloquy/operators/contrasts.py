"""Straight lines per group, what they leave, errors that allow for clusters of rows, and contrasts of classes by quarters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators.ranks import quantiles


def _sound(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())


def _lines(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Per group: rows, means, sum of squares of x about its mean, slope and intercept (null where x doesn't vary)."""
    d = lambda c: F.col(c).cast("double")
    sums = _sound(rows, x, y).groupBy(*by).agg(F.count("*").alias("n"), F.avg(d(x)).alias("mean_x"), F.avg(d(y)).alias("mean_y"), F.regr_sxx(d(y), d(x)).alias("sxx"), F.regr_sxy(d(y), d(x)).alias("sxy"))
    slope = F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx"))
    return sums.withColumn("slope", slope).withColumn("intercept", F.col("mean_y") - F.col("slope") * F.col("mean_x"))


def residuals(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Adds ``residual``: y less the line of its group over x. Rows without x or y go; groups whose x is constant have nulls.

    The lines are a row a group and are joined back; Spark broadcasts them while they are small."""
    lines = _lines(rows, by, x, y).select(*[F.col(c).alias(f"_{c}") for c in by], "slope", "intercept")
    held = _sound(rows, x, y)
    match = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    joined = held.join(lines, match) if by else held.crossJoin(F.broadcast(lines))
    return joined.withColumn("residual", F.col(y) - F.col("intercept") - F.col("slope") * F.col(x)).select(*held.columns, "residual")


def robust_slopes(rows: DataFrame, by: list[str], x: str, y: str, cluster: str) -> DataFrame:
    """Per group: rows, clusters, slope, intercept, the usual standard error of the slope, and one that lets rows of a cluster
    move together: summed scores of each cluster, squared, with the correction G / (G - 1) times (n - 1) / (n - 2).

    Rows with null clusters are a cluster. Scores are summed by group and cluster, so a large cluster is summed on both sides
    of the shuffle. Errors are null for fewer than three rows or, the robust one, fewer than two clusters.
    """
    lines = _lines(rows, by, x, y)
    named = lines.select(*[F.col(c).alias(f"_{c}") for c in by], "mean_x", "sxx", "slope", "intercept", F.col("n").alias("_n"))
    held = _sound(rows, x, y).select(*by, F.col(cluster).alias("_cluster"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    joined = held.join(named, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]) if by else held.crossJoin(F.broadcast(named))
    left = F.col("_y") - F.col("intercept") - F.col("slope") * F.col("_x")
    scores = joined.groupBy(*by, "_cluster").agg(F.sum((F.col("_x") - F.col("mean_x")) * left).alias("score"), F.sum(left * left).alias("rss"), *[F.first(c).alias(c) for c in ("sxx", "slope", "intercept", "_n")])
    out = scores.groupBy(*by).agg(F.first("_n").alias("n"), F.count("*").alias("n_clusters"), F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.first("sxx").alias("sxx"), F.sum("rss").alias("rss"), F.sum(F.col("score") * F.col("score")).alias("meat"))
    n, g = F.col("n"), F.col("n_clusters")
    fix = F.try_divide(g, g - 1) * F.try_divide(n - 1, n - 2)
    return out.select(*by, "n", "n_clusters", "slope", "intercept", F.when(n > 2, F.sqrt(F.col("rss") / (n - 2) / F.col("sxx"))).alias("error"), F.when(n > 2, F.sqrt(fix * F.col("meat")) / F.col("sxx")).alias("robust_error"))


def quarter_contrasts(rows: DataFrame, x: str, value: str, positive: Column) -> DataFrame:
    """Per quarter of x (1 to 4, bounds belong to the lower one): rows of both classes, their mean values, and the difference.

    ``positive`` null belongs to neither class. The bounds are exact, from counts of the distinct values of x."""
    held = _sound(rows, x, value)
    bounds = quantiles(held, [], x, {"q1": 0.25, "q2": 0.5, "q3": 0.75}).select(F.array("q1", "q2", "q3").alias("_b"))
    quarter = 1 + F.aggregate("_b", F.lit(0), lambda n, b: n + (F.col(x) > b).cast("int"))
    placed = held.crossJoin(F.broadcast(bounds)).withColumn("quarter", quarter.cast("long"))
    of = lambda c: F.when(c, F.col(value).cast("double"))
    out = placed.groupBy("quarter").agg(F.count(of(positive)).alias("n_pos"), F.count(of(~positive)).alias("n_neg"), F.avg(of(positive)).alias("mean_pos"), F.avg(of(~positive)).alias("mean_neg"))
    return out.withColumn("contrast", F.col("mean_pos") - F.col("mean_neg"))
