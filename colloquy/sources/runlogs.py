"""Run logs: one JSONL file a run, with a header (turn_index -1), turns, and a footer (-2); score logs; tables and sinks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = (
    "run_id string, turn_index int, model_tag string, model_variant string, seed_name string, seed_prompt string, system_prompt string, system_prompt_b string, n_turns int, "
    "sampling_params map<string,string>, degenerate_window int, ollama_version string, started_at string, agent string, content string, elapsed_ms int, timestamp string, "
    "completed_turns int, stop_reason string, finished_at string"
)
SCORES = "file string, n_turns int, verdict string, max_p_unsafe double, mean_p_unsafe double, error string, turns array<struct<turn_index:int,agent:string,p_unsafe:double,verdict:string,categories:array<string>,error:string>>"
FILE_NAME = r"^(vanilla|jailbroken)_(.+)_([0-9a-f]{32})_([0-9TZ]+)\.jsonl$"


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all logs: file, line (from 0, blank lines left out), and the record's fields (null for torn lines)."""
    files = spark.read.option("pathGlobFilter", "*.jsonl").text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    lines = files.select("file", F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("line", "text"))
    return lines.select("file", "line", F.from_json("text", RECORD).alias("r"))


def read_runs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(runs, turns) of all usable logs.

    A log counts if it has two lines or more and its first is a header. Torn lines are skipped; the last footer wins;
    without a footer the run is ``in_flight`` with as many turns as there are, and a footer without a reason is
    ``unknown``. Missing values become empty texts and zeros.
    """
    held = read_lines(spark, folder)
    header = F.max(F.when((F.col("line") == 0) & (F.col("r.turn_index") == -1), F.col("r"))).alias("h")
    # maps can't be compared: the header goes on without its parameters
    plain = held.withColumn("r", F.col("r").dropFields("sampling_params"))
    footers = F.max_by(F.when(F.col("r.turn_index") == -2, F.col("r")), F.when(F.col("r.turn_index") == -2, F.col("line"))).alias("f")
    files = plain.groupBy("file").agg(F.count("*").alias("lines"), header, footers, F.count(F.when(F.col("r.turn_index") >= 0, 1)).alias("present")).where("lines >= 2 and h is not null")
    text = lambda c, other="": F.coalesce(F.col(c), F.lit(other))
    runs = files.select(
        "file", text("h.run_id").alias("run_id"), text("h.model_variant", "unknown").alias("variant"), text("h.seed_name", "unknown").alias("seed"), text("h.system_prompt").alias("system_prompt"),
        F.col("h.system_prompt_b").alias("system_prompt_b"), F.when(F.col("f").isNull(), "in_flight").otherwise(text("f.stop_reason", "unknown")).alias("stop_reason"),
        F.when(F.col("f").isNull(), F.col("present")).otherwise(F.coalesce("f.completed_turns", F.lit(0))).cast("int").alias("completed_turns"),
    )
    turns = plain.where("r.turn_index >= 0").join(runs.select("file", "run_id"), "file").select(
        "run_id", F.col("r.turn_index").alias("turn_index"), text("r.agent").alias("agent"), text("r.content").alias("content"), F.coalesce("r.elapsed_ms", F.lit(0)).alias("elapsed_ms")
    )
    return runs, turns


def read_said(spark: SparkSession, folder: str) -> DataFrame:
    """What was said, for scoring: file, turn_index, agent, content, in the order of files and turns.

    Turns alone, with or without a header before them: lines without a turn number of 0 or more are left out, and so are
    torn lines and turns whose content is no string. A missing agent is A, a missing content is empty.
    """
    files = spark.read.option("pathGlobFilter", "*.jsonl").text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", "\n")).alias("line", "text")).select("file", "line", F.try_parse_json("text").alias("v"))
    part = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    content = part("content", "variant")
    turns = lines.select("file", "line", part("turn_index", "int").alias("turn_index"), F.coalesce(part("agent", "string"), F.lit("A")).alias("agent"), F.coalesce(F.schema_of_variant(content), F.lit("STRING")).alias("_kind"), F.coalesce(part("content", "string"), F.lit("")).alias("content"))
    return turns.where("turn_index >= 0 and _kind = 'STRING'").orderBy("file", "turn_index", "line").select("file", "turn_index", "agent", "content")


def run_index(spark: SparkSession, folder: str) -> DataFrame:
    """run_id and path of every log whose first line is a record with a run_id: no other line is parsed. Of several logs of
    a run the last path stands."""
    files = spark.read.option("pathGlobFilter", "*.jsonl").text(folder, wholetext=True)
    head = files.select(F.get_json_object(F.substring_index("value", "\n", 1), "$.run_id").alias("run_id"), F.col("_metadata.file_path").alias("path"))
    return head.where("run_id <> ''").groupBy("run_id").agg(F.max("path").alias("path"))


def named_runs(files: DataFrame, file: str = "file") -> DataFrame:
    """Variant, seed and id from file names; null where a name doesn't fit."""
    part = lambda i: F.nullif(F.regexp_extract(file, FILE_NAME, i), F.lit(""))
    return files.withColumn("name_variant", part(1)).withColumn("name_seed", part(2)).withColumn("name_id", part(3))


def read_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Score records, one row a turn; bad lines are skipped and runs without turns keep one row. A file in several batches is
    taken from the first of them by name."""
    held = spark.read.schema(SCORES + ", batch string, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(folder).where("_corrupt is null")
    first = held.groupBy("file").agg(F.min("batch").alias("_first"))
    held = held.join(first.withColumnRenamed("file", "_file"), F.col("file").eqNullSafe(F.col("_file"))).where(F.col("batch").eqNullSafe(F.col("_first")))
    return held.select("file", "n_turns", "verdict", "max_p_unsafe", "mean_p_unsafe", F.explode_outer("turns").alias("t")).select("*", "t.turn_index", "t.agent", "t.p_unsafe").drop("t")


def read_pool(spark: SparkSession, path: str, column: str, without: tuple[str, str] | None = None) -> DataFrame:
    """Non-empty prompts of a CSV column; ``without`` (column, value) leaves rows out, those with no value stay."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if without:
        rows = rows.where(~F.col(without[0]).eqNullSafe(without[1]))
    found = rows.select(F.col(column).alias("prompt")).where("prompt is not null and prompt <> ''")
    if found.isEmpty():
        raise ValueError(f"{path} has no prompts in {column}")
    return found


#: The named pools, their files, columns, and the rows each leaves out.
POOLS = {
    "advbench": ("advbench.csv", "goal", None),
    "jbb": ("jbb.csv", "Goal", None),
    "jbb_sans_advbench": ("jbb.csv", "Goal", ("Source", "AdvBench")),
    "alpaca": ("alpaca.csv", "instruction", None),
}


def named_pool(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The prompts of one of ``POOLS`` from its file in ``folder``; other names are an error that lists them."""
    if name not in POOLS:
        raise ValueError(f"no pool {name!r}, only {sorted(POOLS)}")
    file, column, without = POOLS[name]
    return read_pool(spark, f"{folder.rstrip('/')}/{file}", column, without)


def standalone(records: DataFrame, text: str = "instruction", context: str = "input", seed: int = 0) -> DataFrame:
    """Prompts that need no context (null or blank), in an order that a hash of prompt and seed fixes: the same on any
    cluster, so that any stretch of it is a fair sample. Equal prompts stay, next to each other."""
    alone = records.where(F.trim(F.coalesce(context, F.lit(""))) == "")
    return alone.select(text).orderBy(F.xxhash64(text, F.lit(seed)), text)


def write_pool(prompts: DataFrame, path: str) -> bool:
    """Prompts as CSV files with headers, in their order, quoted so that ``read_pool`` gives them back. A pool that is there
    already is left as it is, and False says so."""
    try:
        prompts.write.mode("errorifexists").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    except AnalysisException as there:
        if there.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        return False
    return True


def cached(spark: SparkSession, folder: str, compute: Callable[[], DataFrame], **parameters: object) -> DataFrame:
    """A result by the parameters that it was worked out with: read where it is there whole, else computed and written.

    The key is a digest of the sorted parameters, which are written last, beside the rows: rows without them were cut short
    and are worked out again.
    """
    held = json.dumps(parameters, sort_keys=True, default=str)
    path = f"{folder.rstrip('/')}/{hashlib.sha256(held.encode()).hexdigest()[:32]}"
    try:
        whole = spark.read.text(f"{path}/parameters").count() == 1
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        whole = False
    if not whole:
        compute().write.mode("overwrite").parquet(f"{path}/rows")
        spark.createDataFrame([(held,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/parameters")
    return spark.read.parquet(f"{path}/rows")


def append_scores(records: DataFrame, folder: str, batch: str) -> None:
    """Adds score records of files that the folder doesn't hold yet, as ``folder/batch=...``.

    A batch that is written again, by a retry or by a second writer, replaces its own records and adds none; files of other
    batches are left out. Batches of different names that run at the same moment may hold a file both; ``read_scores``
    takes it from the first of them.
    """
    spark, own = records.sparkSession, f"{folder}/batch={batch}"
    try:
        done = spark.read.schema(SCORES + ", batch string").json(folder).where(F.col("batch") != batch).select("file").distinct()
    except AnalysisException as missing:  # the folder comes with the first records
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        done = None
    fresh = records if done is None else records.join(done, "file", "left_anti")
    fresh.write.mode("overwrite").json(own)


def write_vectors(rows: DataFrame, path: str) -> None:
    """Vector tables by variant and seed, so that filters on either prune folders."""
    rows.write.mode("overwrite").partitionBy("variant", "seed").parquet(path)


def read_vectors(spark: SparkSession, path: str, seeds: list[str] | None = None) -> DataFrame:
    """Vector tables with plain types: ids and labels as text, turn numbers as long, vectors of double.

    ``seeds`` keeps those seeds, by their folders alone; seeds that the table doesn't hold are an error that lists what it holds.
    """
    rows = spark.read.parquet(path)
    to = {"run_id": "string", "variant": "string", "seed": "string", "stop_reason": "string", "agent": "string", "turn_index": "long", "completed_turns": "long", "vector": "array<double>"}
    lacking = {"run_id", "variant", "seed", "vector"} - set(rows.columns)
    if lacking:
        raise ValueError(f"{path} has no columns {sorted(lacking)}")
    rows = rows.select(*[F.col(c).cast(to[c]).alias(c) if c in to else F.col(f"`{c}`") for c in rows.columns])
    if seeds is None:
        return rows
    present = {r.seed for r in rows.select("seed").distinct().collect()}
    if set(seeds) - present:
        raise ValueError(f"{path} has no seeds {sorted(set(seeds) - present)}, only {sorted(x for x in present if x is not None)}")
    return rows.where(F.col("seed").isin(seeds))


def write_report(rows: DataFrame, path: str, order: list[str], places: dict[str, int] | None = None) -> None:
    """A folder of CSV files with headers, in ``order`` from file to file; ``places`` gives the decimals of a column; nulls are empty."""
    shown = [F.when(F.col(c).isNotNull(), F.format_string(f"%.{places[c]}f", F.col(c).cast("double"))).alias(c) if c in (places or {}) else F.col(c) for c in rows.columns]
    rows.orderBy(*order).select(*shown).write.mode("overwrite").option("header", True).csv(path)
