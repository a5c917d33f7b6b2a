"""Removal of long repeats by bucket-pointer refinement over sampled suffixes.

A text is a row of units: bytes, or words. Of each run of ``gram`` neighbouring suffixes the one with the smallest
``gram``-unit string is its anchor, so equal windows have equal anchors at equal offsets, and only anchors are kept as
suffixes. The strings at the anchors are the initial buckets, and each anchor has a pointer: its bucket's identifier.
A bucket is refined by the pointer at a later offset, that of the next anchor, fetched by a join on its position; the
new identifiers are written back and the next round reads them, so that after r rounds a pointer stands for r + 1
anchors and all units between them. Buckets of one member hold no repeat: those after an anchor that is alone go with
the join, the others when classes are made.

What is left is settled exactly. The windows of one anchor form a piece; pieces of a bucket with equal units (128-bit
digests) form a class, classes of two or more are repeated as a whole, and what is left of a bucket is cut into blocks of
windows and then single windows, each with a bucket of its own. Equality stands in for order: only the boundaries of
buckets matter for repeats.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import drop_table, free_shuffles, from_planes, in_order, range_edges, to_planes, write_table

#: Bytes of a string that must not start twice, and words of a passage that is reported when it does.
LENGTH, PASSAGE = 400, 51
#: Windows in a piece after each cut; the first pieces have as many as their anchor.
CUTS = (16, 1)
#: Units of one text that are worked on at once, and bytes of a chunk.
SLICE = 1 << 20
#: Bytes of small texts that are looked at together: few enough for a core's cache.
TOGETHER = 1 << 17
PIECE = "row long, start long, windows int, at int, needed boolean, off long, size int, bucket long, k1 long, k2 long"
ANCHOR = "row long, pos long, next long, start long, windows int, off long, size int, bucket long, k1 long, k2 long"
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE_IDS = np.frombuffer(b"".join(blake2b(bytes([b]), digest_size=8).digest() for b in range(256)), np.uint64)
_LEFT, _RIGHT, _HIGH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(32)
_INVERSE = np.uint64(pow(int(_LEFT), -1, 1 << 64))
_AT = np.uint64((1 << 24) - 1)


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a place, and of its inverse."""
    return np.cumprod(np.full(n, _LEFT)), np.cumprod(np.full(n, _INVERSE))


class Bytes:
    """Units are bytes: identifiers, where each begins, and where it ends, in a text's bytes."""

    @staticmethod
    def read(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(len(data))
        return _BYTE_IDS[data], at, at + 1


class Words:
    """Units are words, set apart by white space; an identifier is a sum over the word's bytes, by powers of their place."""

    @staticmethod
    def read(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        edges = np.flatnonzero(np.diff(np.r_[True, _SPACE[data], True]))
        begin, end = edges[::2], edges[1::2]
        powers, back = _powers(max(1 << 18, 1 << len(data).bit_length()))
        sums = np.r_[np.uint64(0), np.cumsum(_BYTE_IDS[data] * powers[: len(data)])]
        ids = (sums[end] - sums[begin]) * back[begin]
        return ids ^ (ids >> _HIGH), begin, end


def gram_ids(ids: np.ndarray, gram: int) -> np.ndarray:
    """Identifiers of all strings of ``gram`` units, doubled up by joining identifiers at later offsets."""
    have = 1
    while have < gram and len(ids) > have:
        step = min(have, gram - have)
        joined = ids[:-step] * _LEFT
        joined += ids[step:] * _RIGHT
        joined ^= joined >> _HIGH
        ids, have = joined, have + step
    return ids if have == gram else ids[:0]


def anchors(ids: np.ndarray, ends: np.ndarray, gram: int, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of joined texts (``ends``: the unit where each ends): place, next anchor (-1: none), first suffix and number
    of windows of ``length`` units that have it, and its string's identifier."""
    strings = gram_ids(ids, gram)
    least = (strings & ~_AT) | np.arange(len(strings), dtype=np.uint64)
    have = 1
    while have < gram and len(least) > have:
        step = min(have, gram - have)
        least, have = np.minimum(least[:-step], least[step:]), have + step
    left = np.repeat(ends, np.diff(np.r_[0, ends])) - np.arange(len(ids))
    at = np.flatnonzero(left[: len(least)] >= 2 * gram - 1) if have == gram else np.empty(0, np.int64)
    if not len(at):
        return (np.empty(0, np.int64),) * 5
    anchor = (least[at] & _AT).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])
    place, start = anchor[first], at[first]
    windows = np.clip(np.minimum(np.diff(np.r_[first, len(at)]), left[start] - length + 1), 0, None)
    goes_on = left[place] >= 2 * gram
    after = np.where(goes_on, (least[np.where(goes_on, place + 1, 0)] & _AT).astype(np.int64), -1)
    return place, after, start, windows, strings[place].view(np.int64)


def _digests(strings: Iterator[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blake2b(x, digest_size=16).digest() for x in strings), np.int64).reshape(-1, 2)


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    named = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, named)], names=[n for n, _ in named])


CHUNK, ASKED, TOLD = "chunk long, rows array<long>, texts array<binary>", "part int, kind int, chunk long, keys binary", "chunk long, kind int, part int, shared binary"
#: Bytes of texts for each range of identifiers.
RANGE_BYTES = 16 << 20
Kind = tuple[type[Bytes] | type[Words], int, int]


def make_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows (row, text) in chunks of about SLICE bytes or one longer text."""
    number, rows, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

    def chunk() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([rows], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.binary()))], names=["chunk", "rows", "texts"])

    for batch in batches:
        for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
            rows.append(row)
            texts.append(text or b"")
            size += len(text or b"") + 16
            if size >= SLICE:
                yield chunk()
                number, rows, texts, size = number + 1, [], [], 0
    if rows:
        yield chunk()


def _slices(rows: list[int], texts: list[bytes], kind: Kind) -> Iterator[list[tuple[int, int, int, bytes, int]]]:
    """A chunk's texts, some together: row, first unit, whether one unit leads, bytes, and their place in the text. Long
    texts are cut into slices that overlap by all that the anchors of a slice depend on."""
    unit, length, gram = kind
    held, size = [], 0
    for row, body in zip(rows, texts):
        if len(body) > SLICE:
            _, begin, end = unit.read(np.frombuffer(body, np.uint8))
            for base in range(0, max(0, len(begin) - 2 * gram + 2), SLICE):
                low, high = max(0, base - 1), min(len(begin), base + SLICE + length + gram)
                yield [(row, low, base - low, body[begin[low] : end[high - 1]], int(begin[low]))]
        elif len(body) >= length:
            held.append((row, 0, 0, body, 0))
            size += len(body)
            if size >= TOGETHER:
                yield held
                held, size = [], 0
    if held:
        yield held


def _distinct(strings: list[np.ndarray]) -> np.ndarray:
    """The strings of a chunk in order. One that comes twice or more is there twice, which is enough to find it shared."""
    _, ordered = in_order(np.concatenate([np.empty(0, np.int64), *strings]).view(np.uint64))
    return ordered[np.r_[True, True, ordered[2:] != ordered[:-2]][: len(ordered)]]


def _anchored(held: list[tuple[int, int, int, bytes, int]], kind: Kind) -> tuple:
    """Units and anchors of texts; an anchor belongs to the slice where its windows begin."""
    unit, length, gram = kind
    data = np.frombuffer((b" " if unit is Words else b"").join(x[3] for x in held), np.uint8)
    ids, begin, end = unit.read(data)
    byte_ends = np.cumsum([len(x[3]) + (unit is Words) for x in held])
    ends = np.searchsorted(begin, byte_ends)
    found = anchors(ids, ends, gram, length)
    of = np.searchsorted(ends, found[2], side="right")
    first = np.r_[0, ends[:-1]][of]
    lead = np.array([x[2] for x in held])[of]
    inside = (found[2] - first >= lead) & (found[2] - first < lead + SLICE)
    return (data, ids, begin, end, byte_ends), tuple(x[inside] for x in found), of[inside], first[inside]


def _pieces(held: list[tuple[int, int, int, bytes, int]], kind: Kind, number: int, live: np.ndarray, anchored: tuple) -> pa.RecordBatch:
    """Anchors whose strings are in ``live``, each with the piece of windows that have it."""
    unit, length, _ = kind
    (data, ids, begin, end, byte_ends), found, of, first = anchored
    strings = found[4].view(np.uint64)
    kept = live[np.minimum(np.searchsorted(live, strings), len(live) - 1)] == strings if len(live) else np.zeros(len(strings), bool)
    (place, after, start, windows, bucket), of, first = (x[kept] for x in found), of[kept], first[kept]
    row, low, from_byte = (np.array([x[i] for x in held])[of] for i in (0, 1, 4))
    last = np.where(windows > 0, start + windows + length - 2, start)
    cells = ids if unit is Words else data
    keys = _digests(cells[a : a + n + length - 1].tobytes() if n else b"" for a, n in zip(start.tolist(), windows.tolist()))
    shift = low - first
    off = from_byte + begin[start] - np.r_[0, byte_ends[:-1]][of]
    columns = [np.full(len(row), number), row, place + shift, np.where(after < 0, -1, after + shift), start + shift, windows, off, end[last] - begin[start], bucket, keys[:, 0], keys[:, 1]]
    return _batch(f"kind int, {ANCHOR}", columns)


def _tell(asked: pd.DataFrame) -> pd.DataFrame:
    """Of one range of identifiers: which ones come twice or more, for every chunk that asked."""
    lists = [np.cumsum(from_planes(k)) for k in asked["keys"]]
    keys = np.concatenate(lists)
    order, ordered = in_order(keys)
    fresh = np.r_[True, ordered[1:] != ordered[:-1]]
    shared = np.empty(len(keys), np.uint64)
    shared[order] = ~fresh | ~np.r_[fresh[1:], True]
    edges = np.cumsum([0, *map(len, lists)])
    return pd.DataFrame({"chunk": asked["chunk"], "kind": asked["kind"], "part": asked["part"], "shared": [to_planes(shared[a:b]) for a, b in zip(edges[:-1], edges[1:])]})


def first_anchors(texts: DataFrame, kinds: list[Kind]) -> DataFrame:
    """Anchors of all whole texts (row, text) whose strings come twice or more: the initial buckets.

    Most strings come once. So that these need no rows of their own, each chunk of texts asks for its distinct strings in
    sorted arrays cut by ranges, and each range is looked through by a task of its own.
    """
    chunks = write_table(texts.select("row", F.col("text").cast("binary").alias("text")).mapInArrow(make_chunks, CHUNK), "suffix-chunks")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(4, -(-size // RANGE_BYTES))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, rows, bodies in zip(*(batch.column(c) for c in ("chunk", "rows", "texts"))):
                out: list[list] = [[], [], [], []]
                for k, kind in enumerate(kinds):
                    strings = _distinct([_anchored(held, kind)[1][4] for held in _slices(rows.as_py(), bodies.as_py(), kind)])
                    edges = range_edges(strings, 64, parts)
                    for part in np.flatnonzero(np.diff(edges)).tolist():
                        own = strings[edges[part] : edges[part + 1]]
                        for column, value in zip(out, (part, k, number.as_py(), to_planes(np.r_[own[0], np.diff(own)]))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["part", "kind", "chunk", "keys"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, bodies, told in zip(*(batch.column(c) for c in ("rows", "texts", "told"))):
                rows, bodies, told = rows.as_py(), bodies.as_py(), sorted(told.as_py() or [], key=lambda x: x["part"])
                for k, kind in enumerate(kinds):
                    # kept for the usual chunk, worked out once more for the slices of a very long text
                    kept = [(held, _anchored(held, kind)) for held in _slices(rows, bodies, kind)] if sum(map(len, bodies)) <= 4 * SLICE else None
                    strings = _distinct([a[1][4] for _, a in kept] if kept is not None else [_anchored(held, kind)[1][4] for held in _slices(rows, bodies, kind)])
                    shared = np.concatenate([np.empty(0, np.uint64), *(from_planes(x["shared"]) for x in told if x["kind"] == k)])
                    live = np.unique(strings[shared > 0])
                    for held, anchored in kept if kept is not None else ((held, _anchored(held, kind)) for held in _slices(rows, bodies, kind)):
                        yield _pieces(held, kind, k, live, anchored)

    told = write_table(chunks.select("chunk", "rows", "texts").mapInArrow(ask, ASKED).groupBy("part", "kind").applyInPandas(_tell, TOLD), "suffix-told")
    answers = told.groupBy("chunk").agg(F.collect_list(F.struct("kind", "part", "shared")).alias("told"))
    found = write_table(chunks.join(answers, "chunk", "left").mapInArrow(emit, f"kind int, {ANCHOR}"), "suffix-anchors")
    drop_table(chunks)
    drop_table(told)
    return found


def _with_others(members: DataFrame) -> DataFrame:
    """Members of buckets of two or more; ``members`` is deleted."""
    live = write_table(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "suffix-live")
    # the few live buckets of a partition are hashed, so that the many members need no sorting
    held = write_table(members.join(live.hint("shuffle_hash"), "bucket").select(*members.columns), "suffix-pointers")
    drop_table(members)
    drop_table(live)
    free_shuffles(members.sparkSession)
    return held


def refine_pointers(held: DataFrame, rounds: int) -> DataFrame:
    """Refines buckets by the pointers of the next anchors; each round reads what the round before it wrote.

    An anchor whose next one is alone has left with it. The few that are alone themselves stay until classes are made of
    their buckets, which leaves them out: to look for them after every round would deal all anchors two times more.
    """
    first = held
    for _ in range(rounds):
        later = held.select("row", F.col("pos").alias("next"), F.col("bucket").alias("later"))
        joined = held.join(later.hint("shuffle_hash"), ["row", "next"]).withColumn("bucket", F.xxhash64("bucket", F.col("next") - F.col("pos"), "later")).select(*held.columns)
        before, held = held, write_table(joined, "suffix-finer")
        if before is not first:
            drop_table(before)
        del joined, later
        free_shuffles(held.sparkSession)
    return held


def cut_piece(n_windows: int, at: int, size: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """Smaller pieces of a piece whose first window lies ``at`` units before the anchor: first window, windows, block, and
    the first of the units that all windows of the block share. Blocks of ``size`` windows are counted from the anchor,
    which equal windows have in common."""
    for block in range((at - n_windows + 1) // size, at // size + 1):
        low, high = max(0, at - size * block - size + 1), min(n_windows - 1, at - size * block)
        yield low, high - low + 1, block, at - size * block


def smaller_pieces(members: DataFrame, texts: DataFrame, unit: type[Bytes] | type[Words], size: int, length: int) -> DataFrame:
    """Cuts the members of open buckets into pieces of ``size`` windows."""
    context = F.substring(F.col("text").cast("binary"), (F.col("off") + 1).cast("int"), F.col("size"))
    held = members.join(texts.select("row", "text"), "row").select("row", "start", "windows", "at", "needed", "off", "bucket", context.alias("context"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("row", "start", "windows", "at", "needed", "off", "bucket", "context"))))
            for i in range(0, len(rows), 2_000):
                out, shared, full = [], [], []
                for row, start, windows, at, needed, off, bucket, body in rows[i : i + 2_000]:
                    data = np.frombuffer(body, np.uint8)
                    ids, begin, end = unit.read(data)
                    cells, width = (ids.tobytes(), 8) if unit is Words else (body, 1)
                    for low, n, block, common in cut_piece(windows, at, size, length):
                        last = low + n + length - 2
                        out.append((row, start + low, n, at - low, needed, off + int(begin[low]), int(end[last] - begin[low])))
                        shared.append(b"%d %d " % (bucket, block) + cells[common * width : (common - size + 1 + length) * width])
                        full.append(cells[low * width : (last + 1) * width])
                if out:
                    keys, buckets = _digests(iter(full)), _digests(iter(shared))[:, 0]
                    yield _batch(PIECE, [*map(list, zip(*out)), buckets, keys[:, 0], keys[:, 1]])

    return held.mapInArrow(run, PIECE)


def _classes(pieces: DataFrame, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Splits buckets into classes: repeated pieces (row, start, windows), and the members of buckets still open.

    A bucket is open if a needed piece has no equal but other classes share its bucket. Of each class one member goes on:
    pieces with equals are repeated already and serve as partners only. All groupings combine on the map side and all
    joins are plain ones between tables, which Spark can split when a bucket is hot.
    """
    key, one = ["bucket", "k1", "k2"], ["row", "start", "windows", "at", "off", "size"]
    classes = write_table(
        pieces.groupBy(*key).agg(F.count("*").alias("n"), F.max("needed").alias("needed"), *[F.first(c).alias(c) for c in one])  # any member, as they are equal
        .withColumn("needed", F.col("needed") & (F.col("n") == 1)),
        "suffix-classes",
    )
    repeated = write_table(pieces.join(classes.where("n > 1").select(*key).hint("shuffle_hash"), key).select("row", "start", "windows"), "suffix-repeated")
    members = None
    if not last:
        still = write_table(classes.groupBy("bucket").agg(F.max("needed").alias("open"), F.count("*").alias("kinds")).where("open and kinds > 1").select("bucket"), "suffix-open")
        members = write_table(classes.join(still.hint("shuffle_hash"), "bucket").select(*one, "needed", "bucket"), "suffix-members")
    drop_table(classes)
    return repeated, members


def rounds_for(length: int) -> int:
    """Three anchors in a row, with all that they depend on, fit into a window; into a short one, one anchor."""
    return 2 if length >= 100 else 0


def repeated_spans(anchored: DataFrame, texts: DataFrame, kind: Kind) -> DataFrame:
    """Spans (row, starts, ends: arrays in units, not merged) of ``length``-unit strings that also start elsewhere."""
    unit, length, _ = kind
    held = refine_pointers(anchored, rounds_for(length))
    pieces = held.where("windows > 0").select("row", "start", "windows", (F.col("pos") - F.col("start")).cast("int").alias("at"), F.lit(True).alias("needed"), "off", "size", "bucket", "k1", "k2")
    found, members = _classes(pieces, False)
    if held is not anchored:
        drop_table(held)
    repeated = [found]
    for size in CUTS:
        smaller = _with_others(write_table(smaller_pieces(members, texts, unit, size, length), "suffix-smaller"))  # blocks of few windows: most are alone
        drop_table(members)
        found, members = _classes(smaller, size == CUTS[-1])
        drop_table(smaller)
        repeated.append(found)
    spans = repeated[0].union(repeated[1]).union(repeated[2]).select("row", "start", (F.col("start") + F.col("windows") + length - 1).alias("end"))
    return write_table(spans.groupBy("row").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")), "suffix-spans")


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans as maximal runs."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return start[first], reach[np.r_[first[1:] - 1, len(reach) - 1]]


def _merged(starts: pa.ListScalar, ends: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    if not starts.is_valid:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return merge_spans(starts.values.to_numpy(), ends.values.to_numpy())


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """One row per document: key, n_bytes, spans (removed bytes: start, end exclusive; maximal runs), kept (binary),
    n_passage_words.

    Removes each byte that is covered by a ``length``-byte string which also starts anywhere else, in the same text or
    another. n_passage_words reports, and removes nothing for, the words covered by a run of ``passage`` words (white
    space apart, case as it is) that also starts anywhere else: such a passage may be shorter than ``length`` bytes.
    Null texts are empty; repeated rows repeat each other; keys may be null or repeat (rows are numbered in a table of
    their own); texts shorter than ``length`` stay whole; an empty table gives an empty result.
    """
    texts = write_table(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")), "suffix-texts")
    kinds = [(unit, n, (n + 1) // (rounds_for(n) + 2)) for unit, n in ((Bytes, length), (Words, passage))]
    anchored = first_anchors(texts, kinds)
    by_row, words = (repeated_spans(anchored.where(F.col("kind") == k).drop("kind"), texts, kind) for k, kind in enumerate(kinds))
    words = words.select("row", F.col("starts").alias("word_starts"), F.col("ends").alias("word_ends"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                bodies, kept, spans, covered = [x.as_buffer() for x in part.column("text")], [], [], []
                for body, *listed in zip(bodies, *(part.column(c) for c in ("starts", "ends", "word_starts", "word_ends"))):
                    start, end = (x.tolist() for x in _merged(*listed[:2]))
                    first, last = _merged(*listed[2:])
                    kept.append(b"".join(bytes(body[i:j]) for i, j in zip([0, *end], [*start, len(body)])))
                    spans.append([{"start": i, "end": j} for i, j in zip(start, end)])
                    covered.append(int((last - first).sum()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array([len(x) for x in bodies], pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()), pa.array(covered, pa.int64())],
                    names=["key", "n_bytes", "spans", "kept", "n_passage_words"],
                )

    marked = texts.withColumn("text", F.col("text").cast("binary")).join(by_row.join(words, "row", "full"), "row", "left").select("key", "text", "starts", "ends", "word_starts", "word_ends")
    kind = docs.schema[key].dataType.simpleString()
    return marked.mapInArrow(cut, f"key {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary, n_passage_words long").withColumnRenamed("key", key)
