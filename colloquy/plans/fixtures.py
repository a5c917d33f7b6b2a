"""The driver's tables seen as runs, turns, labelled vectors and scores. Variant, seed and stop reason are functions of
ids that only give the operators something to group by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def turns(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").where("role <> 'system'")
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return rows.select(F.col("conv_id").alias("run_id"), at.cast("long").alias("turn_index"), F.when(F.col("role") == "user", "A").otherwise("B").alias("agent"), F.col("text").alias("content"))


def runs(spark: SparkSession, folder: str) -> DataFrame:
    count = table(spark, folder, "conversations").where("role <> 'system'").groupBy(F.col("conv_id").alias("run_id")).agg(F.count("*").alias("completed_turns"))
    return with_cells(count).select("run_id", "variant", "seed", "stop_reason", "completed_turns")


def with_cells(rows: DataFrame) -> DataFrame:
    stop = F.when(F.col("run_id") % 10 == 9, "interrupted").when(F.col("run_id") % 5 == 3, "degenerate_repetition").otherwise("completed")
    return (
        rows.withColumn("variant", F.when(F.col("run_id") % 2 == 0, "vanilla").otherwise("jailbroken"))
        .withColumn("seed", F.concat(F.lit("seed"), (F.col("run_id") % 7).cast("string"))).withColumn("stop_reason", stop)
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", F.expr("vec_id div 10").alias("run_id"), (F.col("vec_id") % 10).alias("turn_index"), F.col("label").cast("long").alias("cluster"), F.col("embedding").alias("vector"))
    return with_cells(rows)


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return docs.join(table(spark, folder, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic")), "doc_id")


def scored(spark: SparkSession, folder: str) -> DataFrame:
    p = (F.col("doc_id") * 37 % 101) / 100.0
    rows = table(spark, folder, "documents").select((F.expr("doc_id div 10")).alias("run_id"), F.col("doc_id").alias("turn_index"), p.alias("p_unsafe"))
    return with_cells(rows)
