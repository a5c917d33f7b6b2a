"""What several corpus operators share: scratch tables in the cluster's shared folder, plain words, link components."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space that separates words: space and the five ASCII controls from tab to carriage return.
SPACES = "\t\n\v\f\r"


def plain_words(text: str | None) -> list[str]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null has none."""
    if not text:
        return []
    for c in SPACES:
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def ascii_lower(text: str) -> str:
    """Lower-cases A-Z only."""
    return text.encode("utf-8").lower().decode("utf-8")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``. Where that is unset a local session gets a
    temporary one; on a cluster that is an error, for a machine's own folder would be seen by one machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="colloquy-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` to the shared folder and reads it back, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes a table that ``write_table`` made and nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more: its cleaner waits for the driver's
    garbage collections, which are rare, and a query of many steps would hold the files of them all."""
    gc.collect()
    time.sleep(0.3)  # for listeners that still hold the last plan
    spark.sparkContext._jvm.System.gc()


def pieces(frames: Iterator[pd.DataFrame], column: str, most_chars: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Cuts Arrow batches into runs of rows whose texts hold about ``most_chars`` characters, so batch memory stays bounded."""
    for frame in frames:
        start, total = 0, 0
        for i, text in enumerate(frame[column]):
            total += len(text) if isinstance(text, str) else 0
            if total > most_chars:
                yield frame.iloc[start : i + 1]
                start, total = i + 1, 0
        if start < len(frame):
            yield frame.iloc[start:]


def encoded(docs: DataFrame, run: Callable, column: str, ids: str, decoded: str | None, most_chars: int) -> DataFrame:
    """Adds what ``run`` finds for texts, at most about ``most_chars`` characters at a time: ids of each text, and the texts
    that those decode to (None if ``decoded`` names no column). A null text is empty; columns of the results' names go."""
    added = {ids: pa.list_(pa.int32())} | ({decoded: pa.string()} if decoded else {})
    taken = {name.lower() for name in added}
    at = next(i for i, f in enumerate(docs.schema.fields) if f.name == column)
    kept = [(i, f) for i, f in enumerate(docs.schema.fields) if f.name.lower() not in taken]
    schema = T.StructType([*[f for _, f in kept], T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else []))
    names = [f.name for _, f in kept]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(at).to_pylist()]
            start = 0
            while start < len(texts):
                end, held = start, 0
                while end < len(texts) and (end == start or held + len(texts[end]) <= most_chars):
                    held += len(texts[end])
                    end += 1
                found, back = run(texts[start:end])
                offsets = np.cumsum([0, *map(len, found)])
                if isinstance(found[0], np.ndarray):
                    values = pa.array(np.concatenate(found).astype(np.int32))
                else:
                    values = pa.array(np.fromiter(chain.from_iterable(found), np.int32, offsets[-1]))
                columns = [batch.column(i).slice(start, end - start) for i, _ in kept]
                columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values))
                if decoded:
                    columns.append(pa.array(back, pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])
                start = end

    return docs.mapInArrow(each, schema)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``links`` has long columns ``a`` and ``b``; the result has ``node`` and ``component`` (the smallest node reachable)
    for every node with a link to another one. Each round is two aggregations (with map-side minima, so a hub costs
    no more than any node) and two equi-joins that AQE may split, of shuffled sides: files of links are so well compressed
    that what looks small enough to broadcast would fill the driver. The links shrink to stars in a logarithmic number
    of rounds. Each round is a table in the shared folder. Nulls link nothing; an empty table gives an empty result.
    """
    star = write_table(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        name,
    )
    mark = None
    while True:
        now = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            return star.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                star.select("v", "v").distinct()
            )
        mark = now
        both = star.union(star.select("v", "u"))
        least = write_table(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), name)
        large = write_table(both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        down = write_table(large.groupBy("u").agg(F.min("v").alias("m")), name)
        before, star = star, write_table(
            large.join(down.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(down.select("u", F.col("m").alias("v")))
            .distinct(),
            name,
        )
        for done in (before, least, large, down):
            drop_table(done)


def base32_of_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of SHA-1, from the hex digest five bits at a time."""
    digest = F.sha1(payload)
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    letters = []
    for i in range(32):
        at, shift = divmod(5 * i, 4)
        value = F.conv(F.substring(F.concat(digest, F.lit("0")), at + 1, 2), 16, 10).cast("int")
        letters.append(F.substring(alphabet, F.shiftright(value, 3 - shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def in_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of unsigned keys in ascending order, equal ones as they come, and the keys in that order."""
    index = max(1, len(keys).bit_length())
    if not len(keys) or int(keys.max()) >> (64 - index):
        order = np.argsort(keys, kind="stable")
        return order, keys[order]
    packed = np.sort((keys << np.uint64(index)) | np.arange(len(keys), dtype=np.uint64))  # much faster than an indirect sort
    return (packed & np.uint64((1 << index) - 1)).astype(np.int64), packed >> np.uint64(index)


def to_planes(values: np.ndarray) -> bytes:
    """Whole numbers, byte plane after byte plane: planes of zeros cost nothing once compressed."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.reshape(-1).view("<u8")


def range_edges(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of ``bits``-bit keys begins among ascending keys, and where the last one ends."""
    part = (((keys >> np.uint64(bits - 30)) * np.uint64(parts)) >> np.uint64(30)).astype(np.int64)
    return np.searchsorted(part, np.arange(parts + 1))
