"""Cluster characterisation: summaries, enrichment, purity, mutual information. ``labels`` rows carry a cluster column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.numeric import hypergeometric_p


def cluster_summary(rows: DataFrame, cluster: str, turn: str, variant: Column, agent: Column) -> DataFrame:
    """Per cluster: size, share, mean, median and spread of turns, share of the variant and the agent."""
    total = rows.agg(F.count("*").alias("_total"))
    return rows.groupBy(cluster).agg(
        F.count("*").alias("n"), F.avg(turn).alias("turn_mean"), F.median(turn).alias("turn_median"), F.stddev_pop(turn).alias("turn_std"),
        F.avg(variant.cast("double")).alias("variant_share"), F.avg(agent.cast("double")).alias("agent_share"),
    ).crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_total")).drop("_total")


def top_values(rows: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """The ``k`` most frequent values of each group; ties go to the smaller value."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), value))
    return rows.groupBy(group, value).agg(F.count("*").alias("n")).withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def enrichment(rows: DataFrame, cluster: str, target: Column, floor: int = 1) -> DataFrame:
    """Per cluster of at least ``floor`` rows: size, target rows, share, share over the base share, hypergeometric z."""
    marked = rows.groupBy(cluster).agg(F.count("*").alias("n"), F.count(F.when(target, 1)).alias("k"))
    totals = marked.agg(F.sum("n").alias("total"), F.sum("k").alias("marked"))
    n, k, t, m = (F.col(c).cast("double") for c in ("n", "k", "total", "marked"))
    spread = F.try_divide(n * m * (t - m) * (t - n), t * t * (t - 1))
    return marked.crossJoin(F.broadcast(totals)).where(F.col("n") >= floor).select(
        cluster, "n", "k", "total", "marked", (k / n).alias("frac"), F.try_divide(k / n, m / t).alias("enrichment"), F.try_divide(k - n * m / t, F.sqrt(spread)).alias("z")
    )


def enrichment_p(table: DataFrame) -> DataFrame:
    """Adds the upper tail probability of each cluster's target rows."""
    return table.withColumn("p", hypergeometric_p("k", "total", "marked", "n"))


def enriched_kinds(rows: DataFrame, cluster: str, target: Column, kind: Column, floor: int = 30, enrichment_at: float = 1.5, z_at: float = 6.0, share_at: float = 0.5) -> DataFrame:
    """Adds to each cluster's enrichment the share of its rows that are of a kind (null: not), and whether it counts: enough
    rows, enriched in the target at both bounds, and at least that share of the kind. Without a z it doesn't count."""
    share = rows.groupBy(F.col(cluster).alias("_cluster")).agg(F.avg(F.coalesce(kind, F.lit(False)).cast("double")).alias("kind_share"))
    counts = (F.col("enrichment") >= enrichment_at) & (F.col("z") >= z_at) & (F.col("kind_share") >= share_at)
    found = enrichment(rows, cluster, target, floor).join(share, F.col(cluster).eqNullSafe(F.col("_cluster"))).drop("_cluster")
    return found.withColumn("counted", F.coalesce(counts, F.lit(False)))


def max_purity(rows: DataFrame, cluster: str, target: Column, floor: int) -> DataFrame:
    """The largest target share among clusters of at least ``floor`` rows (null if there is none)."""
    share = rows.groupBy(cluster).agg(F.count("*").alias("n"), F.avg(target.cast("double")).alias("frac"))
    return share.where(F.col("n") >= floor).agg(F.max("frac").alias("max_purity"))


def winners(table: DataFrame, by: str, cluster: str) -> DataFrame:
    """Per ``by``, the cluster with the highest enrichment (ties: smaller p where the table has it, then smaller cluster)."""
    tie = [F.round("p", 9)] if "p" in table.columns else []
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round("enrichment", 9)), *tie, cluster))
    return table.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Joint counts with both margins and the total."""
    joint = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))  # one row
    margins = joint.select(a, b, "n", F.sum("n").over(Window.partitionBy(a)).alias("n_a"), F.sum("n").over(Window.partitionBy(b)).alias("n_b"))
    return margins.crossJoin(F.broadcast(total))


def mutual_information(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mutual information, both entropies, MI over the entropy of b (0 if that is 0), and NMI by their mean."""
    t = contingency(rows, a, b)
    p, pa, pb = F.col("n") / F.col("total"), F.col("n_a") / F.col("total"), F.col("n_b") / F.col("total")
    # each cell carries its share of the margins' entropies
    out = t.agg(F.sum(p * F.log(p / (pa * pb))).alias("mi"), F.sum(-p * F.log(pa)).alias("h_a"), F.sum(-p * F.log(pb)).alias("h_b"))
    return out.select(
        "mi", "h_a", "h_b", F.when(F.col("h_b") > 1e-12, F.col("mi") / F.col("h_b")).otherwise(0.0).alias("mi_over_h_b"),
        F.coalesce(F.try_divide(F.col("mi"), (F.col("h_a") + F.col("h_b")) / 2), F.lit(1.0)).alias("nmi"),
    )


def crosstab_shares(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Per group and value: rows, and the value's share there over its share overall."""
    t = contingency(rows, group, value)
    return t.select(group, value, "n", ((F.col("n") / F.col("n_a")) / (F.col("n_b") / F.col("total"))).alias("over_representation"))


def modal_purity(rows: DataFrame, group: str, cluster: str) -> DataFrame:
    """Per group, the share of its rows in its most frequent cluster."""
    n = rows.groupBy(group, cluster).agg(F.count("*").alias("n"))
    return n.groupBy(group).agg((F.max("n") / F.sum("n")).alias("purity"))


def tail_occupancy(rows: DataFrame, run: str, order: str, cluster: str, inside: list[int], last: int) -> DataFrame:
    """Share of runs whose last ``last`` turns all fall in the clusters ``inside``."""
    back = F.row_number().over(Window.partitionBy(run).orderBy(F.desc(order)))
    held = rows.withColumn("_back", back).where(F.col("_back") <= last).groupBy(run).agg(F.bool_and(F.col(cluster).isin(*inside)).alias("all_in"))
    return held.agg(F.avg(F.col("all_in").cast("double")).alias("share"), F.count("*").alias("n_runs"))
