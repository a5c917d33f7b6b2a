"""Run logs as a stream: files are parsed as they come, and a batch that runs twice leaves its rows once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colloquy.sources import runlogs


def write_logs(runs: DataFrame, turns: DataFrame, folder: str, batch: str) -> None:
    """Logs of runs (file, run_id, variant, seed, stop_reason, completed_turns) and their turns (run_id, turn_index, agent,
    content, elapsed_ms), one file a run: a header, the turns in order, and a footer unless the run is in flight.

    The files lie in ``folder/batch=.../file=...``; writing a batch again replaces it. A run is one row of text.
    """
    line = lambda **fields: F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    said = turns.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("turn_index", "agent", "content", "elapsed_ms"))).alias("t"))
    head = line(run_id=F.col("run_id"), turn_index=F.lit(-1), model_variant=F.col("variant"), seed_name=F.col("seed"))
    foot = line(turn_index=F.lit(-2), stop_reason=F.col("stop_reason"), completed_turns=F.col("completed_turns"))
    lines = F.concat(F.array(head), F.coalesce(F.transform("t", lambda t: F.to_json(t)), F.array().cast("array<string>")), F.when(F.col("stop_reason") != "in_flight", F.array(foot)).otherwise(F.array().cast("array<string>")))
    rows = runs.join(said, "run_id", "left").select("file", F.array_join(lines, "\n").alias("value"))
    rows.repartition("file").write.mode("overwrite").partitionBy("file").text(f"{folder}/batch={batch}")


def _parse(files: DataFrame) -> DataFrame:
    """(file, turn_index, agent, content, elapsed_ms) of whole files, torn lines skipped; headers and footers are rows too."""
    lines = files.select("file", F.explode(F.split("value", "\n")).alias("text")).where("trim(text) <> ''")
    parsed = lines.select("file", F.from_json("text", runlogs.RECORD).alias("r")).where("r.turn_index is not null")
    return parsed.select("file", "r.turn_index", "r.run_id", "r.agent", "r.content", "r.elapsed_ms", "r.stop_reason", "r.completed_turns")


def follow_logs(spark: SparkSession, folder: str, out: str, checkpoint: str, per_batch: int = 10_000) -> StreamingQuery:
    """Starts a stream that takes new ``*.jsonl`` or ``*.txt`` files below ``folder``, at most ``per_batch`` a batch, until
    there are no more, and writes their records to ``out/batch=N``. A batch that failed after it wrote is written over when
    the stream goes on from its checkpoint, so no record is lost or doubled."""
    source = spark.readStream.schema("value string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jsonl,txt}").option("maxFilesPerTrigger", per_batch)
    files = source.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")

    def put(rows: DataFrame, batch: int) -> None:
        _parse(rows).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_records(spark: SparkSession, out: str) -> DataFrame:
    """What the stream has written so far."""
    return spark.read.parquet(out).drop("batch")
