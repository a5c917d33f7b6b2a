"""Sparse rows (key, codes, values): spherical k-means and non-negative factors. What the driver sends are the models,
k times the number of codes; rows stay where they are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators.folds import dense_codes
from colloquy.operators.sparse import Rows
from colloquy.operators.sums import PIECE, Piece, add_to, array_sums, matrix, pack, packed_sums
from colloquy.sources.scratch import dropped, free_shuffles, saved


def packed(weights: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Tables of (key, codes, values), a row a key, and (term, code), from rows (key, term, weight)."""
    codes = saved(dense_codes(weights, "term"), "codes")
    entries = F.array_sort(F.collect_list(F.struct("code", F.col("weight").cast("double").alias("value"))))
    rows = weights.join(codes, "term").groupBy(key).agg(entries.alias("e"))
    return saved(rows.select(key, F.col("e.code").alias("codes"), F.col("e.value").alias("values")), "packed"), codes


def packed_tfidf(counts: DataFrame, n_documents: int, key: str, least_df: int = 2) -> tuple[DataFrame, DataFrame]:
    """``packed`` of ``lexical.tfidf`` from counts (key, term, n): terms are written once and dealt once, their weights never, and
    each step's files go before the next."""
    counts = saved(counts.select(key, "term", "n"), "counts")
    free_shuffles(counts.sparkSession)
    df = saved(counts.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least_df), "frequencies")
    codes = saved(dense_codes(df, "term"), "codes")
    value = (1 + F.log("n")) * (F.log((1 + F.lit(n_documents)) / (1 + F.col("df"))) + 1)
    coded = saved(counts.join(df.join(codes, "term"), "term").select(key, "code", "n", "df"), "coded")
    dropped(counts)
    free_shuffles(coded.sparkSession)
    rows = coded.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("code", value.alias("value")))).alias("e"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = batch.column("codes")
                values = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(pc.list_value_length(codes).to_numpy())], pa.int32()), pa.array(_rows(batch, unit=True)[0].values))
                yield pa.RecordBatch.from_arrays([batch.column(key), codes, values], names=[key, "codes", "values"])

    kind = rows.schema[key].dataType.simpleString()
    out = saved(rows.select(key, F.col("e.code").alias("codes"), F.col("e.value").alias("values")).mapInArrow(unit, f"`{key}` {kind}, codes array<int>, values array<double>"), "packed")
    dropped(coded)
    del rows, coded
    free_shuffles(out.sparkSession)
    return out, codes


def _rows(batch: pa.RecordBatch, unit: bool = False) -> tuple[Rows, np.ndarray]:
    """The rows of a batch one after the other, of unit length if asked for, and which row each entry is of."""
    sizes = pc.list_value_length(batch.column("codes")).to_numpy()
    codes, values = (batch.column(c).flatten().to_numpy() for c in ("codes", "values"))
    begins, of = np.r_[0, np.cumsum(sizes)[:-1]], np.repeat(np.arange(len(sizes)), sizes)
    if unit:
        size = np.sqrt(np.add.reduceat(values * values, begins))
        values = values / np.where(size > 0, size, 1.0)[of]
    return Rows(codes, values, begins, np.empty(0, np.int32)), of


class Spherical:
    """Unit-length centroids, and the summed cosines of the rows to their own centroid, step by step.

    The number of code ``j`` and centroid ``c`` has place ``j * k + c``; the driver holds the packed pieces of ``sums``, and most
    centroids have few of all codes.
    """

    def __init__(self, k: int, n_codes: int, pieces: dict[int, Piece], objective: list[float]) -> None:
        self.k, self.n_codes, self.pieces, self.objective, self.piece = k, n_codes, pieces, objective, PIECE

    def table(self) -> np.ndarray:
        """Codes times centroids."""
        out = np.zeros(self.n_codes * self.k)
        for i, piece in self.pieces.items():
            add_to(out[i * self.piece : (i + 1) * self.piece], piece)
        return out.reshape(self.n_codes, self.k)

    @property
    def centroids(self) -> np.ndarray:
        return self.table().T

    def _piece(self, i: int) -> np.ndarray:
        out = np.zeros(min(self.piece, self.n_codes * self.k - i * self.piece))
        if i in self.pieces:
            add_to(out, self.pieces[i])
        return out

    def _of(self, i: int, size: int) -> np.ndarray:
        """The centroid of each place of a piece."""
        return (i * self.piece + np.arange(size)) % self.k

    def put(self, c: int, codes: np.ndarray, values: np.ndarray) -> None:
        """Adds a row to a centroid."""
        places = codes.astype(np.int64) * self.k + c
        for i in np.unique(places // self.piece).tolist():
            at, total = places // self.piece == i, self._piece(i)
            total[places[at] % self.piece] += values[at]
            self.pieces[i] = pack(total)

    def sizes(self) -> np.ndarray:
        out = np.zeros(self.k)
        for i in self.pieces:
            total = self._piece(i)
            out += np.bincount(self._of(i, len(total)), total * total, minlength=self.k)
        return np.sqrt(out)

    def shorten(self) -> None:
        """Makes the centroids of unit length."""
        size = np.maximum(self.sizes(), 1e-12)
        for i in list(self.pieces):
            total = self._piece(i)
            self.pieces[i] = pack(total / size[self._of(i, len(total))])

    def distance(self, other: Spherical) -> float:
        return float(np.sqrt(sum(((self._piece(i) - other._piece(i)) ** 2).sum() for i in {*self.pieces, *other.pieces})))


def spherical_kmeans(rows: DataFrame, key: str, n_codes: int, k: int, seed: int = 0, most: int = 30, tolerance: float = 1e-4) -> Spherical:
    """Centroids of rows by cosine: ``k`` rows in the order of a hash are the first, each step is one pass over the rows, and a
    centroid that no row is nearest to becomes the next row in that order. Ends when the centroids move by less than
    ``tolerance`` together. Fewer rows than ``k`` give as many centroids."""
    order = rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).select("codes", "values")
    first = [(np.array(r["codes"]), np.array(r["values"], float)) for r in order.limit(2 * k).collect()]
    spare, k = first[k:] or first[:1], min(k, len(first))
    model = Spherical(k, n_codes, {}, [])
    for c, (codes, values) in enumerate(first[:k]):
        model.put(c, codes, values)
    model.shorten()
    for step in range(most if first else 0):
        sent, tables = rows.sparkSession.sparkContext.broadcast(model), []

        def add(batch: pa.RecordBatch, total: np.ndarray, sent: Broadcast = sent, tables: list[np.ndarray] = tables) -> None:
            if not tables:
                tables.append(sent.value.table())  # once a task
            held, of = _rows(batch, unit=True)
            near = held.times(tables[0])
            np.add.at(total, held.codes.astype(np.int64) * k + near.argmax(1)[of], held.values)
            total[-1] += near.max(1).sum()

        pieces, size = packed_sums(rows.select("codes", "values"), n_codes * k + 1, add), n_codes * k
        sent.destroy()
        last = np.zeros(min(PIECE, size + 1 - size // PIECE * PIECE))
        if size // PIECE in pieces:
            add_to(last, pieces.pop(size // PIECE))
        if last[:-1].any():
            pieces[size // PIECE] = pack(last[:-1])
        moved = Spherical(k, n_codes, pieces, [*model.objective, float(last[-1])])
        dead = np.flatnonzero(moved.sizes() == 0)
        for i, c in enumerate(dead):
            moved.put(int(c), *spare[i % len(spare)])
        spare = spare[len(dead) % len(spare) :] + spare[: len(dead) % len(spare)]
        moved.shorten()
        change, model = moved.distance(model), moved
        if change < tolerance:
            break
        if step % 4 == 3:
            free_shuffles(rows.sparkSession)
    return model


def assign_spherical(rows: DataFrame, model: Spherical, key: str) -> DataFrame:
    """(key, cluster, cosine): each row's nearest centroid, the lower one of equals."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value.table()
        for batch in batches:
            if batch.num_rows:
                near = _rows(batch, unit=True)[0].times(table)
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(near.argmax(1)), pa.array(near.max(1))], names=[key, "cluster", "cosine"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, cluster long, cosine double")


LEAST = 1e-12

#: Rounds that rows follow anew in each pass before their topics are written: rows are far larger than the codes' topics.
FOLLOWED = 8


def factorise(rows: DataFrame, key: str, n_codes: int, k: int, rounds: int = 20, seed: int = 0) -> tuple[DataFrame, np.ndarray, list[float]]:
    """Non-negative factors by multiplicative updates: (key, codes, values, topics), topics times codes, and the squared error
    before and after each round.

    A round updates every row's topics from the codes' and then the codes' from sums over the rows; besides those only k times
    k numbers are needed of either. Both start from hashes of key or code, between 0.5 and 1.5.
    """
    spark = rows.sparkSession
    start = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1_000)) / 1_000 + 0.5
    held = rows.select(key, "codes", "values", F.array(*[start(F.lit(i), F.col(key)) for i in range(k)]).alias("topics"))
    kept: list[DataFrame] = []
    since: list[Broadcast] = []  # what the codes' topics were in the rounds that the rows' topics in ``held`` have yet to follow

    def begin(batch: pa.RecordBatch, total: np.ndarray) -> None:
        total.reshape(k, n_codes)[:, batch.column("id").to_numpy()] = matrix(batch.column("h")).T

    grid = spark.range(n_codes).select("id", F.array(*[start(F.lit(i), F.col("id")) for i in range(k)]).alias("h"))
    by_code = array_sums(grid, k * n_codes, begin).reshape(k, n_codes)
    kind = rows.schema[key].dataType.simpleString()
    errors = []

    def now(batch: pa.RecordBatch, since: list[Broadcast]) -> tuple[Rows, np.ndarray, np.ndarray]:
        (entries, of), w = _rows(batch), matrix(batch.column("topics"))
        for sent in since:
            h, square = sent.value
            w = w * entries.times(h) / np.maximum(w @ square, LEAST)
        return entries, of, w

    def sums() -> tuple[np.ndarray, np.ndarray, float]:
        """Of the rows' topics: with the values by code, with one another, and the squared values."""
        followed = list(since)

        def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
            by = total[: k * n_codes].reshape(k, n_codes)
            for part in (batch.slice(a, 2_000) for a in range(0, batch.num_rows, 2_000)):
                entries, of, w = now(part, followed)
                for t in range(k):
                    by[t] += np.bincount(entries.codes, entries.values * w[of, t], minlength=n_codes)
                total[k * n_codes : -1] += (w.T @ w).ravel()
                total[-1] += (entries.values * entries.values).sum()

        found = array_sums(held.select("codes", "values", "topics"), k * n_codes + k * k + 1, add)
        return found[: k * n_codes].reshape(k, n_codes), found[k * n_codes : -1].reshape(k, k), float(found[-1])

    def updated() -> DataFrame:
        followed = list(since)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    w = now(batch, followed)[2]
                    topics = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k), pa.int32()), pa.array(w.ravel()))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, "codes", "values")), topics], names=[key, "codes", "values", "topics"])

        return held.mapInArrow(run, f"`{key}` {kind}, codes array<int>, values array<double>, topics array<double>") if followed else held

    with_values, gram, squares = sums()
    errors.append(squares - 2 * np.vdot(with_values, by_code) + (gram * (by_code @ by_code.T)).sum())
    for _ in range(rounds):
        if len(since) == FOLLOWED:
            held = saved(updated(), "topics")
            for sent in since:
                sent.destroy()
            since.clear()
            kept.append(held)
            for table in kept[:-1]:
                dropped(table)
            kept = kept[-1:]
        since.append(spark.sparkContext.broadcast((np.ascontiguousarray(by_code.T), by_code @ by_code.T)))
        free_shuffles(spark)
        with_values, gram, _ = sums()
        by_code *= with_values / np.maximum(gram @ by_code, LEAST)
        errors.append(squares - 2 * np.vdot(with_values, by_code) + (gram * (by_code @ by_code.T)).sum())
    return updated(), by_code, errors


def top_terms_of_topics(by_code: np.ndarray, codes: DataFrame, n: int) -> DataFrame:
    """(topic, rank, term, weight): the ``n`` heaviest terms of each topic, ties to the lower code."""
    rows = []
    for t, h in enumerate(by_code):
        rows += [(t, i + 1, int(c), float(h[c])) for i, c in enumerate(np.lexsort((np.arange(len(h)), -h))[:n])]
    top = codes.sparkSession.createDataFrame(rows, "topic long, rank long, code int, weight double")
    return top.join(codes, "code").select("topic", "rank", "term", "weight")
