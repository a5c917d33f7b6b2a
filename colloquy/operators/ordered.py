"""Operators over ordered turns: trailing repeats, terminal states, stop rules, prefixes, trajectories.

``rows`` are keyed and ordered by columns that the caller names; equal contents are compared null-safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.numeric import distance
from colloquy.functions.text import has_words, tail


def trailing_collapse(rows: DataFrame, key: str, order: list[str], content: str) -> DataFrame:
    """Drops the trailing run of equal contents but for its first row."""
    whole = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = rows.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(*order))).withColumn("_last", F.last(content).over(whole))
    every = Window.partitionBy(key)
    differs = F.coalesce(F.max(F.when(~F.col(content).eqNullSafe(F.col("_last")), F.col("_at"))).over(every), F.lit(0))
    return numbered.withColumn("_keep", differs + 1).where("_at <= _keep").drop("_at", "_last", "_keep")


def terminal_state(turns: DataFrame, last: int = 5, most: int = 4000) -> DataFrame:
    """Per run: wordless turns dropped, trailing repeats collapsed, the last turns joined, their last characters kept.

    ``last`` of 0 or less takes all turns. Runs without words have an empty text.
    """
    kept = trailing_collapse(turns.where(has_words(F.col("content"))), "run_id", ["turn_index"], "content")
    if last > 0:
        kept = kept.withColumn("_back", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("turn_index")))).where(F.col("_back") <= last)
    rows = F.array_sort(F.collect_list(F.struct("turn_index", "content")))
    text = kept.groupBy("run_id").agg(F.array_join(F.transform(rows, lambda r: r.content), "\n").alias("_text"))
    return turns.select("run_id").distinct().join(text, "run_id", "left").select("run_id", F.coalesce(tail(F.col("_text"), most), F.lit("")).alias("terminal"))


def repetition_stops(rows: DataFrame, key: str, order: list[str], content: str, window: int) -> DataFrame:
    """Per key, the first position (from 1) at which the last ``window`` contents are equal; keys without are left out.

    A window of 0 or less finds none.
    """
    by = Window.partitionBy(key).orderBy(*order)
    if window <= 0:
        return rows.select(key, F.lit(0).cast("long").alias("stop_at")).limit(0)
    numbered = rows.withColumn("_at", F.row_number().over(by))
    for back in range(1, window):
        numbered = numbered.withColumn(f"_back{back}", F.lag(content, back).over(by))
    same = F.col("_at") >= window
    for back in range(1, window):
        same = same & F.col(content).eqNullSafe(F.col(f"_back{back}"))
    return numbered.where(same).groupBy(key).agg(F.min("_at").cast("long").alias("stop_at"))


def prefixes(turns: DataFrame) -> DataFrame:
    """Per turn, the conversation so far as (role, content): agent A is the user."""
    role = F.when(F.col("agent") == "A", "user").otherwise("assistant")
    so_far = Window.partitionBy("run_id").orderBy("turn_index").rowsBetween(Window.unboundedPreceding, 0)
    return turns.select("run_id", "turn_index", F.collect_list(F.struct(role.alias("role"), "content")).over(so_far).alias("messages"))


def message_rows(turns: DataFrame, runs: DataFrame, most: int = 3000) -> DataFrame:
    """Turns with words, cut to their last characters, with their run's columns."""
    return turns.where(has_words(F.col("content"))).join(runs, "run_id").select("run_id", "turn_index", "agent", "variant", "seed", "stop_reason", tail(F.col("content"), most).alias("text"))


def steps(rows: DataFrame, key: str, order: str, vector: str) -> DataFrame:
    """From each row to the next of its key: how far the vector moves; a key's first row has none."""
    before = F.lag(vector).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_before", before).where("_before is not null").select(key, order, distance(vector, "_before").alias("step"))


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Keys in the order of their first row."""
    return rows.groupBy(key).agg(F.min(order).alias("first_row"))
