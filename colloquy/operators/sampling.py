"""Balanced samples and folds by deterministic hash order: same guarantees as a seeded shuffle, on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.sources.scratch import saved


def key_hash(key: str, salt: int = 0) -> Column:
    """Multiplicative hash of an integer key; the same in any SQL dialect."""
    return F.pmod((F.col(key) + salt) * F.lit(2654435761), F.lit(4294967296))


#: Ranges of the hash that are numbered apart, so that no task orders a whole class.
RANGES = 4_096


def numbered(rows: DataFrame, by: list[str], key: str, salt: int = 0) -> DataFrame:
    """Adds ``_at``, the place of each row in its class (from 1) in hash order, and ``_of``, the size of the class.

    Ranges of the hash are ordered apart and begin after the rows of the ranges before them; one row a range and class
    tells how many those are. Ties go by key; null keys share a range of their own, after all others.
    """
    spot = F.coalesce(F.floor(key_hash(key, salt) / F.lit(4294967296 // RANGES)), F.lit(RANGES)).cast("int")
    held = rows.withColumn("_range", spot)
    sizes = held.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_range").alias("_there"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"), F.sum("_n").over(Window.partitionBy(*by)).alias("_of"))
    match = (F.col("_range") == F.col("_there"))
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(key_hash(key, salt).asc_nulls_last(), key))
    return held.withColumn("_in", inside).join(begins, match).withColumn("_at", F.col("_begin") + F.col("_in")).drop("_range", "_in", "_there", "_begin", *[f"_{c}" for c in by])


def in_order(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Adds ``name``, each row's place (from 0) in the order of ``key``: ranges of keys are ordered by tasks of their own, and a
    table of the ranges' sizes, a row a range, tells where each begins. Equal keys come in any order."""
    held = saved(rows.repartitionByRange(key).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = held.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return held.withColumn("_in", inside).join(F.broadcast(begins), "_range").withColumn(name, F.col("_begin") + F.col("_in")).drop("_range", "_in", "_begin")


def balanced_sample(rows: DataFrame, by: list[str], key: str, target: int | None = None, salt: int = 0) -> DataFrame:
    """Equal groups: the rows of smallest hash, as many as the smallest group has or ``target``; smaller groups stay whole."""
    ranked = numbered(rows, by, key, salt)
    if target is not None:
        return ranked.where(F.col("_at") <= target).drop("_at", "_of")
    least = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.min("n").alias("_least"))
    return ranked.crossJoin(F.broadcast(least)).where(F.col("_at") <= F.col("_least")).drop("_at", "_of", "_least")


def stratified_folds(rows: DataFrame, label: str, key: str, n: int, repeat: int = 0) -> DataFrame:
    """Adds fold 0..n-1, dealt in hash order within each class."""
    return numbered(rows, [label], key, repeat).withColumn("fold", F.pmod(F.col("_at") - 1, F.lit(n)).cast("long")).drop("_at", "_of")


def group_folds(rows: DataFrame, group: str, n: int, repeat: int = 0, label: str | None = None) -> DataFrame:
    """Adds a fold that all rows of a group share: by the group's hash alone, without a shuffle, or with a label (one a
    group) dealt evenly within each class."""
    if label is None:
        return rows.withColumn("fold", F.floor(key_hash(group, repeat) * n / 4294967296).cast("long"))
    return rows.join(stratified_folds(rows.select(group, label).distinct(), label, group, n, repeat), [group, label])


def holdout(rows: DataFrame, label: str, key: str, share: float = 0.3, repeat: int = 0) -> DataFrame:
    """Adds ``held_out``: the first ``share`` of each class in hash order."""
    return numbered(rows, [label], key, repeat).withColumn("held_out", F.col("_at") <= F.round(F.col("_of") * share)).drop("_at", "_of")


def subsample(rows: DataFrame, key: str, n: int, salt: int = 0) -> DataFrame:
    """The ``n`` rows of smallest hash, without replacement."""
    return rows.orderBy(key_hash(key, salt), key).limit(n)


def leave_one_out(rows: DataFrame, group: str, label: str, least: int = 2) -> DataFrame:
    """Groups that can be left out: the rest has both classes, and the group at least ``least`` rows of each."""
    n = rows.groupBy(group).agg(F.count(F.when(F.col(label) == 1, 1)).alias("pos"), F.count(F.when(F.col(label) == 0, 1)).alias("neg"))
    total = n.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    fits = (F.col("pos") >= least) & (F.col("neg") >= least) & (F.col("all_pos") > F.col("pos")) & (F.col("all_neg") > F.col("neg"))
    return n.crossJoin(F.broadcast(total)).where(fits).select(group, "pos", "neg")
