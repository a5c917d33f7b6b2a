"""Vectors as short codes: each part of a vector is the index of the nearest entry of that part's codebook.

All arithmetic is in whole numbers. Before an entry's distance to a part is worked out it is bounded from below, first by
the means of the two and the norms of what the means leave, then by the means of eight segments and the norms of what
those leave; entries whose bound is above the distance to a likely entry go, the others get their exact distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Components of this size or more are left out, for their squared distances would pass 64 bits.
TOO_LARGE = float(1 << 18)
#: How finely bounds cut a part, one after the other.
SEGMENTS = (1, 8)
#: Rows that a task looks at together.
BLOCK = 256


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, index]`` are whole numbers; vectors have ``dims`` components of ``scale`` times their size."""

    entries: np.ndarray
    dims: int
    scale: int

    def digest(self) -> str:
        """SHA-256, in hex, of all components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def _bounds(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: the means of equal segments times the root of their length, and the norm of what the means leave."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)[:-1]
    sizes = np.diff(np.r_[edges, x.shape[1]])
    means = np.add.reduceat(x, edges, axis=1) / np.sqrt(sizes)
    rest = (x.astype(float) ** 2).sum(1) - (means**2).sum(1)
    return means, np.sqrt(np.maximum(rest, 0))


def nearest_entries(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Per row of whole numbers: index of the nearest entry (ties to the lower one), its squared distance; and how many
    distances were worked out."""
    if not x.shape[1]:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), 0
    n, k = len(x), len(entries)
    slack = 1e-6 + 1e-7 * ((x.astype(float) ** 2).sum(1) + (entries.astype(float) ** 2).sum(1).max())  # more than rounding can do to a bound
    above, worked = np.full(n, np.iinfo(np.int64).max), 0
    pairs = np.arange(n * k)  # row times entries plus entry
    for segments in SEGMENTS:
        if segments > x.shape[1]:
            break
        (mx, rx), (me, re) = _bounds(x, segments), _bounds(entries, segments)
        if segments == SEGMENTS[0]:
            bound = ((mx - me.T) ** 2 + (rx[:, None] - re[None]) ** 2).reshape(-1)
        else:
            row, at = np.divmod(pairs, k)
            bound = np.square(mx[row] - me[at]).sum(1) + np.square(rx[row] - re[at])
        row = pairs // k
        begins = np.searchsorted(row, np.arange(n))
        lowest = np.flatnonzero(bound == np.minimum.reduceat(bound, begins)[row])
        likely = lowest[np.searchsorted(row[lowest], np.arange(n))]  # the entry of the lowest bound tells how near the nearest is at most
        above = np.minimum(above, np.square(x - entries[pairs[likely] % k]).sum(1))
        worked += n
        pairs = pairs[bound <= (above + slack)[row]]
    row, at = np.divmod(pairs, k)
    exact = np.square(x[row] - entries[at]).sum(1)
    least = np.minimum.reduceat(exact, np.searchsorted(row, np.arange(n)))
    hits = np.flatnonzero(exact == least[row])
    first = hits[np.searchsorted(row[hits], np.arange(n))]
    return at[first], least, worked + len(row)


def _parts(values: pa.Array, books: Codebooks) -> np.ndarray:
    """Whole-number parts (row, part, position) of a list column."""
    n_parts, width = books.entries.shape[0], books.entries.shape[2]
    x = np.zeros((len(values), n_parts * width), np.int64)
    x[:, : books.dims] = np.floor(books.scale * values.flatten().to_numpy(zero_copy_only=False)).reshape(len(values), books.dims)
    return x.reshape(len(values), n_parts, width)


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and holds neither nulls nor numbers that are not finite or of 2^18 and more in size."""
    return rows.where(F.col(vector).isNotNull() & F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < TOO_LARGE, F.lit(False))), F.lit(False)))


def fit_codebooks(rows: DataFrame, key: str, vector: str, parts: int = 4, size: int = 256, rounds: int = 4, scale: int = 1024) -> Codebooks | None:
    """Codebooks of ``size`` entries for each of ``parts`` equal consecutive parts; None if no row is usable.

    Components become floor(scale x). The first entries are the parts of the ``size`` smallest keys (equal keys by vector,
    null keys last; fewer rows, fewer entries). Each round assigns all rows in parallel and replaces each used entry by the
    floor of its members' mean: tasks send one sum an entry, so what reaches the driver has the size of the codebooks.
    The row of smallest key tells the length of vectors; rows of another length are left out. A length that is no
    multiple of ``parts`` is filled up with zeros, which changes no distance.
    """
    held = usable(rows, vector).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("x"))
    first = held.orderBy(F.asc_nulls_last("k"), "x").limit(1).collect()
    if not first:
        return None
    dims = len(first[0].x)
    held = held.where(F.size("x") == dims)
    width = -(-dims // parts)
    start = np.zeros((0, parts * width), np.int64)
    found = [r.x for r in held.orderBy(F.asc_nulls_last("k"), "x").limit(size).collect()]
    start = np.zeros((len(found), parts * width), np.int64)
    start[:, :dims] = np.floor(scale * np.array(found, float).reshape(len(found), dims))
    books = Codebooks(np.ascontiguousarray(start.reshape(len(found), parts, width).transpose(1, 0, 2)), dims, scale)
    for _ in range(rounds):
        entries = books.entries.copy()
        for r in _sums(held.select("x"), books).collect():
            entries[r.part, r.entry] = [s // r.n for s in r.sums]
        books = Codebooks(entries, dims, scale)
    return books


def _sums(held: DataFrame, books: Codebooks) -> DataFrame:
    """Per part and entry with members: how many, and the sums of their components."""
    n_parts, n_entries, width = books.entries.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((n_parts, n_entries), np.int64), np.zeros((n_parts, n_entries, width), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = _parts(batch.column(0).slice(at, BLOCK), books)
                for p in range(n_parts):
                    entry, _, _ = nearest_entries(x[:, p], books.entries[p])
                    count[p] += np.bincount(entry, minlength=n_entries)
                    np.add.at(total[p], entry, x[:, p])
        part, entry = np.nonzero(count)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * width, pa.int32()), pa.array(total[part, entry].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), sums], names=["part", "entry", "n", "sums"])

    partial = held.mapInArrow(add, "part int, entry int, n long, sums array<long>")
    each = [F.sum(F.col("sums")[i]) for i in range(width)]
    return partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*each).alias("sums") if each else F.array().cast("array<long>").alias("sums"))


def encode_vectors(rows: DataFrame, books: Codebooks | None, vector: str, code: str = "code", error: str = "error") -> DataFrame:
    """Adds ``code`` (array of int, one index a part) and ``error`` (squared distance over all parts, in scaled units).

    Rows that aren't usable or of another length than the codebooks' are left out; without codebooks all are. Other columns
    and repeated rows stay; existing columns of the results' names, whatever their case, are replaced. No shuffle.
    """
    held = usable(rows, vector).where(F.size(vector) == books.dims if books else F.lit(False))
    taken = {code.lower(), error.lower()}
    kept = [i for i, f in enumerate(held.schema.fields) if f.name.lower() not in taken]
    at = held.columns.index(vector)
    fields = [held.schema.fields[i] for i in kept]
    schema = T.StructType([*fields, T.StructField(code, T.ArrayType(T.IntegerType())), T.StructField(error, T.LongType())])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_parts = books.entries.shape[0]
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                x = _parts(batch.column(at), books)
                found = [nearest_entries(x[:, p], books.entries[p]) for p in range(n_parts)]
                index = np.stack([f[0] for f in found], 1).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * n_parts, pa.int32()), pa.array(index.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], lists, pa.array(sum(f[1] for f in found))], names=names)

    return held.mapInArrow(run, schema)
