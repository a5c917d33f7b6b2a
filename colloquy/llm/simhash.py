"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into halves. Two fingerprints at two or fewer differing bits have a half at one or fewer,
so a small Hamming ball (the half, and each half that one more set bit makes) is looked up in a table of all halves,
and complete distances are verified in the join. Equal fingerprints are grouped first and never paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import ascii_lower, components, plain_words, write_table

BITS, HALF = 64, 32
SEED = 42


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """A hash of each run of ``shingle`` words, A-Z lower-cased; of all words if there are fewer; none of no words."""
    words = plain_words(ascii_lower(text)) if text else []
    if not words:
        return np.empty(0, np.uint64)
    coded = [w.encode("utf-8") for w in words]
    joined = b" ".join(coded)
    starts = np.cumsum([0, *(len(w) + 1 for w in coded[:-1])])
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.r_[starts[shingle:] - 1, len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(ends)].tolist(), ends.tolist())], np.uint64)


def text_fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of one whole text as a signed 64-bit number: a bit is set if it is in over half the shingle hashes."""
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprint_of(hashes: np.ndarray) -> int:
    """SimHash of shingle hashes, as a signed 64-bit number; zero if there are none."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([text_fingerprint(t) for t in batch], dtype="int64")


#: Not deterministic for the optimizer only, so that the function runs once a row.
fingerprints_udf = _fingerprints.asNondeterministic()


def _half(fp: Column, which: int) -> Column:
    return F.shiftrightunsigned(fp, HALF) if which else fp.bitwiseAND((1 << HALF) - 1)


def fingerprint_links(fingerprints: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column ``fp``, no repeats) at two or fewer differing bits.

    Of two halves that differ in one bit, one lacks it: only bits that are not set are flipped, which halves the balls.
    The planner takes a ball for one row and would send all balls to the driver, to be broadcast: both sides are shuffled.
    """
    segments = F.array(*[F.struct(F.lit(i).alias("segment"), _half(F.col("fp"), i).alias("half")) for i in (0, 1)])
    table = fingerprints.select("fp", F.explode(segments).alias("s")).select("fp", "s.segment", "s.half")
    unset = F.filter(F.array(*[F.lit(1 << k).cast("long") for k in range(HALF)]), lambda bit: F.col("half").bitwiseAND(bit) == 0)
    ball = F.concat(F.array(F.lit(0).cast("long")), unset)
    probes = table.select(F.col("fp").alias("probe"), "segment", "half", F.explode(ball).alias("flip")).select(
        "probe", "segment", F.col("half").bitwiseOR(F.col("flip")).alias("half"), (F.col("flip") == 0).alias("same")
    )
    near = F.bit_count(F.col("probe").bitwiseXOR(F.col("fp"))) <= 2
    once = ~F.col("same") | (F.col("probe") < F.col("fp"))
    return probes.join(table.hint("merge"), ["segment", "half"]).where(near & once).select(F.least("probe", "fp").alias("a"), F.greatest("probe", "fp").alias("b"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, fp, component_id) for every row of ``docs``: component_id is the smallest key reachable over links.

    Null and wordless texts have fingerprint zero and link with each other like any others; repeated rows fall in one
    group; a null key never names a group unless all its keys are null. An empty table gives an empty result.
    """
    marked = write_table(docs.select(key, fingerprints_udf(F.col(text)).alias("fp")), "simhash")
    groups = write_table(marked.groupBy("fp").agg(F.min(key).alias("least")), "simhash-groups")
    joined = components(fingerprint_links(groups.select("fp")), "simhash-links")
    member = groups.join(joined.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "least")
    named = member.groupBy("component").agg(F.min("least").alias("component_id"))
    names = write_table(member.select("fp", "component").join(named.hint("merge"), "component").select("fp", "component_id"), "simhash-names")
    return marked.join(names.hint("merge"), "fp").select(key, "fp", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The row with the smallest key of each group (nulls last; of repeated rows, one), all columns as they are."""
    rows = write_table(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")), "simhash-rows")
    keyed = F.col(f"doc.`{key}`")
    named = rows.select(F.struct(keyed.isNull().alias("none"), keyed.alias("key"), "row").alias("name"), F.col(f"doc.`{text}`").alias("body"))
    found = near_duplicates(named, "body", "name")
    kept = write_table(found.where("name = component_id").select("name.row"), "simhash-kept")
    return rows.join(kept, "row", "left_semi").select("doc.*")
