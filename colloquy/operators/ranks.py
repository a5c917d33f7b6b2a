"""Ranks and exact quantiles of groups of any size, by ranges of values.

Equal values meet first. Distinct values fall into ranges whose bounds are fixed beforehand, 4,096 to each doubling, so that a
table of ranges (a row a group and range, whatever the number of rows) tells how many rows lie below each, and only the
values of one range are ever ordered by one task.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges to each doubling of a value.
STEPS = 4_096


def value_range(value: Column | str) -> Column:
    """A whole number that never falls as the value grows: infinities and NaN (the largest) have ranges of their own."""
    x = F.col(value).cast("double") if isinstance(value, str) else value.cast("double")
    size = F.abs(x)
    power = F.floor(F.log2(size))
    at = (power + 1_100) * STEPS + F.floor((size / F.pow(F.lit(2.0), power) - 1) * STEPS)
    end = F.lit(1 << 40).cast("long")
    return F.when(F.isnan(x), end + 1).when(x == 0, F.lit(0).cast("long")).when(size == float("inf"), F.signum(x).cast("long") * end).otherwise(F.signum(x).cast("long") * at)


def value_counts(rows: DataFrame, by: list[str], value: str, **counts: Column) -> DataFrame:
    """(by, value, counts..., _range): what ``counts`` aggregates for each group and value that is not null."""
    held = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(*[c.alias(n) for n, c in counts.items()])
    return held.withColumn("_range", value_range("value"))


def before(by: list[str], order: str) -> Window:
    """The rows of a group before the present one."""
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def rank_sums(rows: DataFrame, by: list[str], score: str, positive: Column) -> DataFrame:
    """Per group: sizes of both classes, the U statistic of the positives (ties count half) and the tie sum.

    Rows below in the same range are counted there; those of lower ranges are added for a range's positives together.
    """
    counts = value_counts(rows, by, score, pos=F.count(F.when(positive, 1)), neg=F.count(F.when(~positive, 1)))
    below = F.coalesce(F.sum("neg").over(before([*by, "_range"], "value")), F.lit(0))
    t = (F.col("pos") + F.col("neg")).cast("double")
    ranges = counts.withColumn("_below", below).groupBy(*by, "_range").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / 2)).alias("u"), F.sum(t * t * t - t).alias("ties")
    )
    lower = F.coalesce(F.sum("neg").over(before(by, "_range")), F.lit(0))
    return ranges.withColumn("_lower", lower).groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("u") + F.col("pos") * F.col("_lower")).alias("u"), F.sum("ties").alias("ties"))


def quantiles(rows: DataFrame, by: list[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """Per group, a column for each of ``shares`` (0 to 1): the exact quantile with linear interpolation, nulls left out.

    A group without values has no row; without ``by`` there is one row, or none. Only ranges that hold a wanted place are
    looked into.
    """
    counts = value_counts(rows, by, value, n=F.count("*"))
    every = Window.partitionBy(*by)
    ranges = counts.groupBy(*by, "_range").agg(F.sum("n").alias("_size"))
    ranges = ranges.withColumn("_lower", F.coalesce(F.sum("_size").over(before(by, "_range")), F.lit(0))).withColumn("_of", F.sum("_size").over(every))
    wanted = []
    for name, share in shares.items():
        at = (F.col("_of") - 1) * F.lit(float(share))
        rest = at - F.floor(at)
        wanted += [F.struct(F.lit(name).alias("name"), F.floor(at).alias("place"), (1 - rest).alias("weight")), F.struct(F.lit(name).alias("name"), (F.floor(at) + 1).alias("place"), rest.alias("weight"))]
    place = F.col("_w.place")
    picks = ranges.withColumn("_w", F.explode(F.array(*wanted))).where((F.col("_w.weight") > 0) & (place >= F.col("_lower")) & (place < F.col("_lower") + F.col("_size")))
    picks = picks.select(*[F.col(c).alias(f"_{c}_by") for c in by], F.col("_range").alias("_there"), "_lower", "_w")
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}_by")) for c in by], F.col("_range") == F.col("_there"))
    inside = counts.withColumn("_below", F.coalesce(F.sum("n").over(before([*by, "_range"], "value")), F.lit(0)))
    found = inside.join(picks, match).where((place >= F.col("_lower") + F.col("_below")) & (place < F.col("_lower") + F.col("_below") + F.col("n")))
    part = F.col("value").cast("double") * F.col("_w.weight")
    out = found.groupBy(*by).agg(*[F.sum(F.when(F.col("_w.name") == name, part)).alias(name) for name in shares])
    return out.where(reduce(lambda a, b: a | b, [F.col(name).isNotNull() for name in shares]))


def joined_by(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Both tables' rows of the same group, null keys included; without ``by`` the one row of each."""
    other = right.select(*[F.col(c).alias(f"_{c}_by") if c in by else F.col(c) for c in right.columns])
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}_by")) for c in by], F.lit(True))
    return left.join(other, match, "left").drop(*[f"_{c}_by" for c in by])
