"""Lexicon and token rankings: marker counts, log-odds with an informative prior, TF-IDF weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import MARKERS, STOP_WORDS, marker_count, tokens


def marker_counts(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Per document, one column a marker category."""
    return documents.select(key, *[marker_count(F.coalesce(text, F.lit("")), terms).alias(name) for name, terms in MARKERS.items()])


def marker_cells(counts: DataFrame, runs: DataFrame) -> DataFrame:
    """Per cell and category: mean count and share of runs with any."""
    long = counts.select("run_id", F.explode(F.array(*[F.struct(F.lit(m).alias("marker"), F.col(m).alias("n")) for m in MARKERS])).alias("x")).select("run_id", "x.*")
    return long.join(runs, "run_id").groupBy("variant", "seed", "marker").agg(F.avg("n").alias("mean_count"), F.avg((F.col("n") > 0).cast("double")).alias("share_any"))


def token_counts(documents: DataFrame, by: list[str], text: str) -> DataFrame:
    """Counts of each token in each group."""
    return documents.select(*by, F.explode(tokens(F.col(text))).alias("token")).groupBy(*by, "token").agg(F.count("*").alias("n"))


def log_odds(counts: DataFrame, least: int = 5) -> DataFrame:
    """z-scores of tokens between two corpora. ``counts`` has token, n_a, n_b; positive z leans to a.

    The pooled counts are the prior. Tokens with a pooled count below ``least`` are left out of the result, not of the
    totals, which are one broadcast row. A vocabulary of one token gives null.
    """
    totals = counts.agg(F.sum("n_a").alias("all_a"), F.sum("n_b").alias("all_b"))
    a, b, pool = F.col("n_a"), F.col("n_b"), F.col("n_a") + F.col("n_b")
    both = F.col("all_a") + F.col("all_b")
    omega = lambda y, n: F.log(F.try_divide((y + pool).cast("double"), (n + both - y - pool).cast("double")))
    z = (omega(a, F.col("all_a")) - omega(b, F.col("all_b"))) / F.sqrt(1.0 / (a + pool) + 1.0 / (b + pool))
    return counts.where(pool >= least).crossJoin(F.broadcast(totals)).select("token", z.alias("z"), "n_a", "n_b")


def top_and_bottom(ranked: DataFrame, value: str, tie: str, n: int) -> DataFrame:
    """The ``n`` largest and ``n`` smallest rows, marked by ``side``."""
    top = ranked.orderBy(F.desc(value), tie).limit(n).withColumn("side", F.lit("top"))
    return top.union(ranked.orderBy(value, tie).limit(n).withColumn("side", F.lit("bottom")))


def tfidf(counts: DataFrame, n_documents: int, key: str, least_df: int = 2, sublinear: bool = True) -> DataFrame:
    """Unit-length weights (key, term, weight) from counts (key, term, n): (1 + ln n) (ln((1 + N) / (1 + df)) + 1)."""
    df = counts.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least_df)
    tf = 1 + F.log(F.col("n")) if sublinear else F.col("n")
    raw = counts.join(df, "term").select(key, "term", (tf * (F.log((1 + F.lit(n_documents)) / (1 + F.col("df"))) + 1)).alias("w"))
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / size).alias("weight"))


def word_counts(documents: DataFrame, key: str, text: str, longest: int = 1) -> DataFrame:
    """Counts of lower-cased words of two or more letters, digits or underscores, without stop words; with ``longest`` 2
    also of neighbours among those that are left, joined by a blank."""
    found = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1)), lambda w: ~w.isin(STOP_WORDS))
    if longest > 1:
        held = F.greatest(F.size("_found") - 1, F.lit(0))
        pairs = F.zip_with(F.slice("_found", 1, held), F.slice("_found", 2, held), lambda a, b: F.concat_ws(" ", a, b))
        both = F.when(F.size("_found") > 1, F.concat("_found", pairs)).otherwise(F.col("_found"))
        return documents.select(key, found.alias("_found")).select(key, F.explode(both).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))
    return documents.select(key, F.explode(found).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))


def matrix_stats(weights: DataFrame, key: str) -> DataFrame:
    """Shape, entries and density of a sparse matrix (key, term, weight)."""
    shape = weights.agg(F.countDistinct(key).alias("n_rows"), F.countDistinct("term").alias("n_columns"), F.count("*").alias("nnz"))
    return shape.withColumn("density", F.try_divide(F.col("nnz").cast("double"), (F.col("n_rows") * F.col("n_columns")).cast("double")))


def char_counts(documents: DataFrame, key: str, text: str, longest: int = 1) -> DataFrame:
    """Counts of characters (and runs of up to ``longest``), case kept, two or more white spaces as one space."""
    chars = F.filter(F.split(F.regexp_replace(text, r"\s\s+", " "), ""), lambda c: c != "")
    held = documents.select(key, chars.alias("_chars"))

    def grams(k: int) -> Column:
        starts = F.when(F.size("_chars") >= k, F.sequence(F.lit(1), F.size("_chars") - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice("_chars", i, k), ""))

    return held.select(key, F.explode(F.concat(*[grams(k) for k in range(1, longest + 1)])).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))


def top_terms(weights: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` heaviest terms of each document."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("weight", 9)), "term"))
    return weights.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)
