"""Mixing sources to target weights by Pfair scheduling.

A source's documents are laid end to end and cut into blocks of ``block`` characters. With share a of a period of Q
slots, block k of a source is released at slot floor(k Q / a) and due by slot ceil((k + 1) Q / a); each slot goes to the
released block with the earliest deadline, so that no source is ever a whole block away from its target. Shares are the
weights as exact fractions. The schedule repeats after Q slots: one period is worked out from the weights alone, and the
slot of any block follows from it by arithmetic. When a source ends, the others go on among themselves in proportion;
every document is placed once.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping, Sequence
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import write_table

#: Characters in a block.
BLOCK = 65_536
#: Rows in a run of a source's documents, which is numbered by one task.
RUN = 4_096
#: Slots that the driver works out for one phase: a longer period over more blocks is refused, never rounded.
MOST_SLOTS = 1 << 20
PLAN = "source_key int, n_blocks long, phases array<struct<first:long,past:long,slot:long,share:decimal(38,0),period:decimal(38,0),slots:array<int>>>"
PLACES = ("mix_block", "mix_start", "mix_slot", "mix_release", "mix_deadline")


def exact_shares(weights: Sequence[float | int | str | Fraction]) -> list[int]:
    """Positive weights as whole slots of a period, in the very proportion given; a float counts as the decimal it prints."""
    exact = [Fraction(str(w)) if isinstance(w, float) else Fraction(w) for w in weights]
    if not exact or min(exact) <= 0:
        raise ValueError("every weight must be above zero")
    scale = math.lcm(*(w.denominator for w in exact))
    whole = [int(w * scale) for w in exact]
    common = math.gcd(*whole)
    return [n // common for n in whole]


def period_schedule(shares: Sequence[int], upto: int | None = None) -> list[list[int]]:
    """Slots of each source's blocks in one period of ``sum(shares)`` slots (or its first ``upto``), earliest deadline first."""
    period = sum(shares)
    waiting = [(0, s, 0) for s, share in enumerate(shares) if share]
    ready: list[tuple[int, int, int]] = []
    slots: list[list[int]] = [[] for _ in shares]
    heapq.heapify(waiting)
    for slot in range(min(period, period if upto is None else upto)):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // shares[s]), s, k))
        due, s, k = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a block misses its deadline")
        slots[s].append(slot)
        if k + 1 < shares[s]:
            heapq.heappush(waiting, ((k + 1) * period // shares[s], s, k + 1))
    return slots


def plan_phases(shares: Mapping[int, int], blocks: Mapping[int, int]) -> dict[int, list[tuple]]:
    """Phases of each source: first block, block after the last, first slot, share, period, slots in a period.

    A phase ends with the slot that uses up a source; there are at most as many as sources, whatever the data's size.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    used = dict.fromkeys(left, 0)
    phases: dict[int, list[tuple]] = {s: [] for s in blocks}
    at = 0
    while left:
        order = sorted(left)
        common = math.gcd(*(shares[s] for s in order))
        share = {s: shares[s] // common for s in order}
        period, total = sum(share.values()), sum(left.values())
        if min(period, total) > MOST_SLOTS:
            raise ValueError(f"the weights repeat after {period} slots only; give rounder weights or larger blocks")
        slots = dict(zip(order, period_schedule([share[s] for s in order], total)))
        ends = []
        for s, n in left.items():
            whole, rest = divmod(n - 1, share[s])
            if rest < len(slots[s]):
                ends.append(whole * period + slots[s][rest])
        last = min(ends)
        for s in order:
            whole, rest = divmod(last + 1, period)
            done = whole * share[s] + sum(x < rest for x in slots[s])
            if done:
                phases[s].append((used[s], used[s] + done, at, share[s], period, slots[s][:done]))
            used[s] += done
            left[s] -= done
            if not left[s]:
                del left[s]
        at += last + 1
    return phases


def _placed(docs: DataFrame, weights: Mapping[str, float], rest: float, source: str, text: str, block: int, seed: int) -> DataFrame:
    """Rows as a struct ``doc``, beside the columns of PLACES: no column of ``docs`` can clash with those in between."""
    names = list(weights)
    shares = exact_shares([*weights.values(), rest])
    key = F.lit(len(names))
    for i, name in reversed(list(enumerate(names))):
        key = F.when(F.col(source) == name, i).otherwise(key)
    size = F.coalesce(F.length(text), F.lit(0)).cast("long")
    rows = write_table(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), key.alias("src"), size.alias("size"), F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)).alias("hash")), "mix-rows")
    bits = max(0, (rows.count() // RUN).bit_length())
    run = F.shiftrightunsigned(F.col("hash"), 64 - bits) if bits else F.lit(0).cast("long")
    runs = write_table(rows.groupBy("src", run.alias("run")).agg(F.sum("size").alias("held")), "mix-runs")
    before = Window.partitionBy("src").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    begins = write_table(runs.select("src", "run", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("begin")), "mix-begins")
    totals = {r[0]: r[1] for r in runs.groupBy("src").agg(F.sum("held")).collect()}  # one row per named source
    blocks = {s: max(1, -(-n // block)) for s, n in totals.items()}
    phases = plan_phases(dict(enumerate(shares)), blocks)
    exact = lambda s: [(a, b, c, Decimal(d), Decimal(e), f) for a, b, c, d, e, f in phases[s]]
    plan = docs.sparkSession.createDataFrame([(s, blocks[s], exact(s)) for s in blocks], PLAN)
    inside = Window.partitionBy("src", "run").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("run", run)
        .withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(begins, ["src", "run"])
        .withColumn("mix_start", F.col("begin") + F.col("inside"))
        .join(F.broadcast(plan), F.col("src") == F.col("source_key"))
        .withColumn("mix_block", F.least(F.floor(F.col("mix_start") / F.lit(block)), F.col("n_blocks") - 1))
        .withColumn("phase", F.filter("phases", lambda p: (p.first <= F.col("mix_block")) & (F.col("mix_block") < p.past))[0])
        .withColumn("job", F.col("mix_block") - F.col("phase.first"))
    )
    first = F.col("phase.slot")
    return (
        placed.withColumn("mix_slot", first + F.expr("job div phase.share * cast(phase.period as bigint) + phase.slots[int(job % phase.share)]"))
        .withColumn("mix_release", first + F.expr("job * phase.period div phase.share"))
        .withColumn("mix_deadline", first + F.expr("((job + 1) * phase.period + phase.share - 1) div phase.share"))
        .select("doc", *PLACES)
    )


def mix(docs: DataFrame, weights: Mapping[str, float], rest: float = 0.01, source: str = "source", text: str = "text", block: int = BLOCK, seed: int = 42) -> DataFrame:
    """Adds mix_block, mix_start (characters of the source before the document), mix_slot, mix_release and mix_deadline.

    Documents in the order (mix_slot, mix_start) follow the weights, by less than one block at any slot. Sources that
    ``weights`` doesn't name, and null sources, share the weight ``rest``. A null text is empty; a document longer than a
    block starts in one and takes up the following ones; repeated rows are placed one by one; an empty table gives an
    empty result. Columns of ``docs`` with the names of those five are replaced, all others stay as they are, whatever
    their names. Within a source the order is a hash of row numbers, which a table fixes: no source, however large, and
    no repeated row meets in one task. One row per named source is broadcast, with at most MOST_SLOTS slots a phase.
    Weights are exact (floats as the decimals they print, or fractions); weights that are not above zero, or whose
    period and number of blocks are both above MOST_SLOTS, raise ValueError.
    """
    placed = _placed(docs, weights, rest, source, text, block, seed)
    return placed.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c.lower() not in PLACES], *PLACES)


def mixed_order(docs: DataFrame, weights: Mapping[str, float], rest: float = 0.01, source: str = "source", text: str = "text", block: int = BLOCK, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` in mixed order, all columns as they are: partitions, and rows in each, follow the schedule, so
    every file that is written from them is a stretch of the mix. Cases as for ``mix``."""
    placed = _placed(docs, weights, rest, source, text, block, seed)
    return placed.repartitionByRange("mix_slot", "mix_start").sortWithinPartitions("mix_slot", "mix_start").select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
