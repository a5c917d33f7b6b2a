"""The separability suite: tiers of features, each tried on every seed under repeated folds, as rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators import folds
from colloquy.sources.scratch import saved

COLUMNS = ["seed", "tier", "n", "n_folds", "accuracy_mean", "accuracy_std", "auc_mean", "auc_std", "warning"]


def dealt_by_domain(runs: DataFrame, key: str, label: str, domain: str, n: int, repeats: int) -> tuple[DataFrame, list]:
    """Rows (key, y, folds, domain, name of the domain), classes dealt evenly within each domain; and the domains' names."""
    names = [r[0] for r in runs.select(domain).where(F.col(domain).isNotNull()).distinct().orderBy(domain).collect()]
    numbers = runs.sparkSession.createDataFrame(list(enumerate(names)), f"domain int, `{domain}` {runs.schema[domain].dataType.simpleString()}")
    rows = runs.join(F.broadcast(numbers), domain).select(key, domain, "domain", F.col(label).cast("double").alias("y"), F.concat_ws("|", F.col("domain"), F.col(label).cast("int")).alias("_class"))
    return saved(folds.with_folds(rows, "_class", key, n, repeats).drop("_class"), "dealt"), names


def dense_tier(features: DataFrame, dealt: DataFrame, n_domains: int, key: str, vector: str, n: int, repeats: int) -> DataFrame:
    """Predictions from a vector a run (key, vector)."""
    rows = saved(dealt.select(key, "y", "folds", "domain").join(features.select(key, vector).where(F.col(vector).isNotNull()), key), "tier")
    return folds.predict_dense(rows, folds.fit_dense(rows, vector, "y", n, repeats, domains=n_domains), key, vector, "y", n, repeats, "domain")


def term_tier(counts: DataFrame, dealt: DataFrame, n_domains: int, key: str, n: int, repeats: int) -> DataFrame:
    """Predictions from term counts (key, term, n), the vocabulary of each fold from its training runs."""
    documents, _, idf = folds.term_documents(counts, dealt.select(key, "y", "folds", "domain"), key, "y", n, repeats, domains=n_domains)
    return folds.predict_terms(documents, folds.fit_terms(documents, idf, n, repeats), key, n, repeats)


def run_suite(tiers: dict[str, Callable[[], DataFrame]], dealt: DataFrame, domain: str) -> DataFrame:
    """A row a domain and tier: runs, folds with an AUC, mean and deviation of accuracy and AUC, and a warning or null.

    ``tiers`` make predictions when they are called; one that fails (a missing table, no usable rows) is a warning in the rows
    of its tier, and the others go on. A domain without runs in a tier, or without both classes, has a warning too.
    """
    names, parts = dealt.select("domain", F.col(domain).alias("seed")).distinct(), []
    for tier, predict in tiers.items():
        warning = F.lit(None).cast("string")
        try:
            predicted = saved(predict(), "predicted")
            found = folds.cross_validated(predicted, ["domain"]).join(predicted.groupBy("domain").agg(F.countDistinct(predicted.columns[0]).alias("n")), "domain")
        except (PySparkException, ValueError, FileNotFoundError) as problem:
            warning = F.lit(f"{type(problem).__name__}: {problem}".splitlines()[0][:200])
            found = names.select("domain").limit(0).selectExpr("domain", "0L n_folds", "0d accuracy_mean", "0d accuracy_std", "0d auc_mean", "0d auc_std", "0L n")
        short = F.when(F.col("n").isNull(), "no rows").when(F.coalesce(F.col("n_folds"), F.lit(0)) == 0, "one class")
        parts.append(saved(names.join(found, "domain", "left").withColumn("tier", F.lit(tier)).withColumn("warning", F.coalesce(warning, short)).select(*COLUMNS), "tier"))
    return reduce(DataFrame.union, parts)


def headline(results: DataFrame, tiers: list[str]) -> DataFrame:
    """A row a seed: the mean AUC of each tier as a column of the tier's name, null where it failed."""
    return results.groupBy("seed").pivot("tier", tiers).agg(F.first("auc_mean"))
