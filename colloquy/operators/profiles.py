"""Purity profiles over many clusterings, tables of single clusters, and trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.numeric import cosine_distance, dot, norm
from colloquy.operators.ranks import quantiles


def purity_profile(assigned: DataFrame, targets: list[str], floor: int) -> DataFrame:
    """Mean and population deviation, over starts, of the largest share of each target among clusters of ``floor`` rows.

    ``assigned`` has space, k, start, cluster and the columns in ``targets``, whose values are the targets. A start none
    of whose clusters is large enough counts for nothing; a target without any such start has nulls.
    """
    run = ["space", "k", "start"]
    sizes = assigned.groupBy(*run, "cluster").agg(F.count("*").alias("n"))
    of = assigned.select(*run, "cluster", F.explode(F.array(*targets)).alias("target")).groupBy(*run, "cluster", "target").agg(F.count("*").alias("m"))
    share = F.when(F.col("n") >= floor, F.col("m") / F.col("n"))
    best = of.join(sizes, [*run, "cluster"]).groupBy(*run, "target").agg(F.max(share).alias("purity"))
    return best.groupBy("space", "k", "target").agg(F.avg("purity").alias("mean_purity"), F.stddev_pop("purity").alias("std_purity"), F.count("purity").alias("n_starts"))


def cluster_table(rows: DataFrame, cluster: str, target: Column, order: str, label: str) -> DataFrame:
    """Per cluster: rows, target rows and share, share over the base share, mean and median of ``order``, and the most
    frequent ``label`` (ties: the smaller one)."""
    base = rows.agg(F.avg(target.cast("double")).alias("base"))
    top = rows.groupBy(cluster, label).agg(F.count("*").alias("m")).groupBy(cluster).agg(F.min_by(label, F.struct(-F.col("m"), F.col(label))).alias("top_label"))
    stats = rows.groupBy(cluster).agg(F.count("*").alias("n"), F.count(F.when(target, 1)).alias("n_target"), F.avg(order).alias("order_mean"), F.median(order).cast("double").alias("order_median"))
    share = F.col("n_target") / F.col("n")
    return stats.crossJoin(F.broadcast(base)).join(top, cluster).select(cluster, "n", "n_target", share.alias("share"), F.try_divide(share, F.col("base")).alias("enrichment"), "order_mean", "order_median", "top_label")


def cluster_portrait(rows: DataFrame, cluster: str, run: str, order: str, target: Column, agent: Column) -> DataFrame:
    """Per cluster: rows, distinct runs, target and agent shares with their distance from the whole table's, and the 5th,
    25th, 50th, 75th and 95th percentile of ``order``."""
    whole = rows.agg(F.avg(target.cast("double")).alias("all_target"), F.avg(agent.cast("double")).alias("all_agent"))
    at = F.percentile(order, F.array(*[F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    part = rows.groupBy(cluster).agg(F.count("*").alias("n"), F.countDistinct(run).alias("n_runs"), F.avg(target.cast("double")).alias("target_share"), F.avg(agent.cast("double")).alias("agent_share"), at.alias("_p"))
    return part.crossJoin(F.broadcast(whole)).select(
        cluster, "n", "n_runs", "target_share", (F.col("target_share") - F.col("all_target")).alias("target_delta"), "agent_share", (F.col("agent_share") - F.col("all_agent")).alias("agent_delta"),
        *[F.col("_p")[i].alias(name) for i, name in enumerate(("p5", "p25", "p50", "p75", "p95"))],
    )


def histogram_of(rows: DataFrame, cluster: str, order: str, width: int) -> DataFrame:
    """Rows of each cluster in steps of ``width`` of an integer column."""
    return rows.groupBy(cluster, F.floor(F.col(order) / width).alias("step")).agg(F.count("*").alias("n"))


def most_similar_cluster(rows: DataFrame, centres: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Per row, the cluster whose centroid has the largest cosine. ``centres`` (cluster, centroid) is a row a cluster."""
    listed = centres.select(F.collect_list(F.struct("cluster", "centroid")).alias("_centres"))
    by = F.transform("_centres", lambda c: F.struct((-F.try_divide(dot(F.col(vector), c.centroid), norm(F.col(vector)) * norm(c.centroid))).alias("s"), c.cluster.alias("cluster")))
    first = F.array_sort(by)[0]
    return rows.crossJoin(F.broadcast(listed)).select(*keys, first.cluster.alias("nearest"), (-first.s).alias("cosine"))


def cosine_steps(rows: DataFrame, key: str, order: str, vector: str) -> DataFrame:
    """From each row of a key to its next: one less the cosine; a key's first row has none."""
    before = F.lag(vector).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_before", before).where("_before is not null").select(key, order, cosine_distance(vector, "_before").alias("step"))


def quarter_bounds(rows: DataFrame, value: str) -> DataFrame:
    """The three bounds of a column's quarters, one row (none without values)."""
    return quantiles(rows, [], value, {"q1": 0.25, "q2": 0.5, "q3": 0.75})


def path_segments(rows: DataFrame, key: str, order: str, vector: str, mean: list[float], axes: list[list[float]]) -> DataFrame:
    """Rows projected on two stored axes, each with the point before it in its key."""
    at = [F.aggregate(F.zip_with(F.zip_with(vector, F.array(*map(F.lit, mean)), lambda x, m: x - m), F.array(*map(F.lit, axis)), lambda x, a: x * a), F.lit(0.0), lambda s, x: s + x) for axis in axes]
    w = Window.partitionBy(key).orderBy(order)
    placed = rows.select(key, order, at[0].alias("x"), at[1].alias("y"))
    return placed.withColumn("from_x", F.lag("x").over(w)).withColumn("from_y", F.lag("y").over(w)).where("from_x is not null")


def replies(turns: DataFrame) -> DataFrame:
    """Each turn with the message that it answers, joined by a newline; a run's first turn stands alone."""
    before = F.lag("content").over(Window.partitionBy("run_id").orderBy("turn_index"))
    return turns.select("run_id", "turn_index", F.concat_ws("\n", before, "content").alias("pair"))
