"""Ranked search over documents by dual-sorted wavelet trees, one a shard.

A shard's lists of postings, each in falling order of impact, stand one after the other as a sequence of document numbers,
and a wavelet tree over the numbers stores it: every node stands for a range of documents, and what a list has there is a
stretch, still in order of impact, whose first posting bounds the rest. Search opens the nodes of the highest sums of
bounds first, meets all lists of a query in each, and ends when no node's bound reaches the k-th best document found. So
the best k are exact. The levels of a tree lie one under the other: at each, numbers with the bit 0 first.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import drop_table, in_order, new_path, write_table

#: Terms are maximal runs of letters A-Z, digits and all that is not ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of UTF-8 as terms have them: A-Z lower-cased, other ASCII but letters and digits as blanks.
FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())
#: Stands for a null document id, after all others.
NO_ID = np.iinfo(np.int64).max
#: Nodes that a search opens together.
TOGETHER = 1_024


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in order; null has none."""
    return text.encode("utf-8").translate(FOLD).split() if text else []


def index_stats(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """How many documents have a term, and how many terms all have together."""
    n = docs.select(F.regexp_count(text, F.lit(TERM)).cast("long").alias("n"))
    row = n.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return row[0], row[1]


class Tree:
    """One shard: the wavelet tree, the lists' starts, the impacts in the order of the sequence."""

    def __init__(self, ids: np.ndarray, terms: bytes, starts: np.ndarray, impacts: np.ndarray, levels: list[np.ndarray]) -> None:
        self.ids, self.terms, self.starts, self.impacts, self.levels = ids, terms, starts, impacts, levels

    @classmethod
    def build(cls, ids: list[int | None], texts: list[list[bytes]], n_docs: int, n_terms: int) -> Tree:
        """The tree of a shard's documents (ids, and terms of each), given the numbers of documents and terms of all."""
        own = np.array([NO_ID if i is None else i for i in ids], np.int64)
        order = np.argsort(own, kind="stable")
        place = np.empty(len(own), np.int64)
        place[order] = np.arange(len(own))
        lengths = np.array([len(x) for x in texts])
        codes: defaultdict[bytes, int] = defaultdict()
        codes.default_factory = codes.__len__
        flat = np.fromiter((codes[x] for words in texts for x in words), np.uint64, lengths.sum())
        size = np.uint64(len(own))
        both, tf = np.unique(flat * size + np.repeat(place, lengths).astype(np.uint64), return_counts=True)
        term, doc = both // size, (both % size).astype(np.int64)
        spread = np.empty(len(own), np.int64)
        spread[place] = 100 - 25 + 25 * lengths * n_docs // n_terms
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * spread[doc])
        at, _ = in_order((term << np.uint64(20)) | (np.uint64((1 << 20) - 1) - impact.astype(np.uint64)))  # ties stay in order of documents
        sequence, levels = doc[at], []
        for shift in range(max(1, (len(own) - 1).bit_length()) - 1, -1, -1):
            bit = (sequence >> shift & 1).astype(bool)
            levels.append(bit)
            sequence = np.r_[sequence[~bit], sequence[bit]]
        starts = np.r_[0, np.cumsum(np.bincount(term.astype(np.int64), minlength=len(codes)))]
        return cls(own[order], b" ".join(codes), starts.astype(np.int32), impact[at].astype(np.int32), levels)

    def row(self) -> tuple[bytes, ...]:
        """The shard as the columns of the index table."""
        return self.ids.tobytes(), self.terms, self.starts.tobytes(), self.impacts.tobytes(), b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def of_row(cls, ids: bytes, terms: bytes, starts: bytes, impacts: bytes, levels: bytes) -> Tree:
        own, values = np.frombuffer(ids, np.int64), np.frombuffer(impacts, np.int32)
        bits = np.frombuffer(levels, np.uint8).reshape(max(1, (len(own) - 1).bit_length()), -1)
        return cls(own, terms, np.frombuffer(starts, np.int32), values, [np.unpackbits(x, count=len(values)).astype(bool) for x in bits])

    def open(self) -> Tree:
        """Works out ranks (bits set before each place) and the impacts in the order of every level, for searching."""
        n = len(self.impacts)
        self.rank = np.zeros((len(self.levels), n + 1), np.int32)
        self.value = np.empty((len(self.levels) + 1, n), np.int32)
        self.value[0] = self.impacts
        for k, bit in enumerate(self.levels):
            np.cumsum(bit, out=self.rank[k, 1:])
            zeros = n - self.rank[k, -1]
            self.value[k + 1, :zeros], self.value[k + 1, zeros:] = self.value[k][~bit], self.value[k][bit]
        self.zeros = n - self.rank[:, -1]
        self.code = {x: i for i, x in enumerate(self.terms.split(b" "))}
        return self

    def best(self, query: dict[bytes, int], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of documents that may be among the best ``k``: all of those that reach ``least`` and the shard's
        own k-th best score are among them."""
        lists = [(self.code[x], w) for x, w in query.items() if x in self.code and w > 0]
        scores, found = np.empty(0, np.int64), np.empty(0, np.int64)
        if not lists:
            return scores, found
        weight = np.array([w for _, w in lists], np.int64)
        which = np.array([c for c, _ in lists])
        depth = len(self.levels)
        # stretches of lists (list, from, to), and nodes (bound, level, number, first stretch, stretches) that lie on them
        stretch = np.stack([np.arange(len(lists)), self.starts[which], self.starts[which + 1]], 1).astype(np.int64)
        node = np.array([[(weight * self.value[0, stretch[:, 1]]).sum(), 0, 0, 0, len(lists)]], np.int64)
        while len(node):
            node = node[node[:, 0] >= least]
            if len(node) > TOGETHER:
                first = np.argpartition(-node[:, 0], TOGETHER)
                now, later = node[first[:TOGETHER]], node[first[TOGETHER:]]
            else:
                now, later = node, node[:0]
            if not len(now):
                break
            size = now[:, 4]
            ends = np.cumsum(size)
            own = stretch[np.repeat(now[:, 3] - ends + size, size) + np.arange(ends[-1])]
            of = np.repeat(np.arange(len(now)), size)
            level = now[of, 1]
            ones = self.rank[level, own[:, 1]], self.rank[level, own[:, 2]]
            parts = [(0, own[:, 1] - ones[0], own[:, 2] - ones[1]), (1, self.zeros[level] + ones[0], self.zeros[level] + ones[1])]
            nodes, stretches, base = [later], [stretch], len(stretch)
            for bit, begin, end in parts:
                some = end > begin
                if not some.any():
                    continue
                kept, parent = np.stack([own[some, 0], begin[some], end[some]], 1), of[some]
                bound = weight[kept[:, 0]] * self.value[level[some] + 1, kept[:, 1]]
                begins = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
                total, up = np.add.reduceat(bound, begins), now[parent[begins]]
                child = np.stack([total, up[:, 1] + 1, up[:, 2] * 2 + bit, base + begins, np.diff(np.r_[begins, len(parent)])], 1)
                leaf = (child[:, 1] == depth) & (total >= least)
                scores, found = np.r_[scores, total[leaf]], np.r_[found, child[leaf, 2]]
                nodes.append(child[(child[:, 1] < depth) & (total >= least)])
                stretches.append(kept)
                base += len(kept)
            if len(scores) >= k:
                least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                good = scores >= least
                scores, found = scores[good], found[good]
            node, stretch = np.concatenate(nodes), np.concatenate(stretches)
            if len(node) and len(stretch) > 65_536 and 4 * node[:, 4].sum() < len(stretch):  # forget stretches that no node has
                size = node[:, 4]
                ends = np.cumsum(size)
                stretch = stretch[np.repeat(node[:, 3] - ends + size, size) + np.arange(ends[-1])]
                node[:, 3] = ends - size
        return scores, self.ids[found]


INDEX = "ids binary, terms binary, starts binary, impacts binary, levels binary"


def build_index(docs: DataFrame, stats: tuple[int, int], key: str = "doc_id", text: str = "text", most_terms: int = 2_000_000) -> DataFrame:
    """The index of all documents, a row a shard, as a table in the shared folder; all terms are in it. ``stats`` are those of
    ``index_stats`` over the same documents.

    A task cuts its own rows into shards of about ``most_terms`` terms (one document at least), so nothing is shuffled and a
    hot source or a long list is spread as the rows are; documents without terms are in no shard, those of null id are.
    """
    n_docs, n_terms = stats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0

        def shard() -> pa.RecordBatch:
            row = Tree.build(ids, texts, n_docs, n_terms).row()
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], names=[f.split()[0] for f in INDEX.split(", ")])

        for batch in batches:
            for i, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(content.as_py())
                if not words:
                    continue
                ids.append(i)
                texts.append(words)
                held += len(words)
                if held >= most_terms:
                    yield shard()
                    ids, texts, held = [], [], 0
        if ids:
            yield shard()

    return write_table(docs.select(F.col(key).cast("long"), text).mapInArrow(run, INDEX), "ranked")


def document_counts(index: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """How many documents hold each of some terms: every task adds up its shards."""
    sent = index.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter[bytes] = Counter()
        for batch in batches:
            for terms, starts in zip(*(c.to_pylist() for c in batch.columns)):
                size = np.diff(np.frombuffer(starts, np.int32)).tolist()
                df.update({x: n for x, n in zip(terms.split(b" "), size) if x in sent.value})
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.binary()), pa.array(list(df.values()), pa.int64())], names=["term", "df"])

    rows = index.select("terms", "starts").mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    sent.unpersist()
    return {bytes(r.term): r.df for r in rows}


def search(index: DataFrame, items: DataFrame, n_docs: int, k: int = 20, key: str = "item_id", text: str = "text", most_bytes: int = 64_000_000) -> DataFrame:
    """Each item's ``k`` highest-scoring documents with a score above 0: ``item_id``, ``rank`` (from 1), ``doc_id``, ``score``.

    Equal scores go by ascending document id, null last. Items are taken in blocks of at most ``most_bytes`` of text (one
    item at least), each sent to all tasks; a task keeps the best of each item over its shards, whose k-th score is the
    next shard's bound. Items without terms have no rows; each row of ``items`` is an item, ranked apart from others of its id.
    """
    spark, path = index.sparkSession, new_path(index.sparkSession, "found")
    schema = f"{key} {items.schema[key].dataType.simpleString()}, rank int, doc_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    block, held = [], 0

    def finish() -> None:
        queries = [Counter(terms_of(x)) for _, x in block]
        df = document_counts(index, {t for q in queries for t in q})
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
        asked = [(i, {t: weight[t] * n for t, n in q.items() if t in weight}) for i, q in enumerate(queries)]
        sent = spark.sparkContext.broadcast([x for x in asked if x[1]])
        numbers = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], f"_item long, {schema.split(',')[0]}")
        found = index.mapInArrow(lambda batches: _search_task(batches, sent.value, k), "_item long, doc_id long, score long")
        at = F.row_number().over(Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        ranked = found.withColumn("rank", at).where(F.col("rank") <= k).join(numbers, "_item")
        ranked.select(key, F.col("rank").cast("int").alias("rank"), "doc_id", "score").write.mode("append").parquet(path)
        sent.unpersist()

    for row in items.select(key, text).toLocalIterator():
        size = len(row[1] or "") * 4
        if block and held + size > most_bytes:
            finish()
            block, held = [], 0
        block.append((row[0], row[1]))
        held += size
    if block:
        finish()
    return spark.read.schema(schema).parquet(path)


def _search_task(batches: Iterator[pa.RecordBatch], asked: list[tuple[int, dict[bytes, int]]], k: int) -> Iterator[pa.RecordBatch]:
    """The best of each item over the shards of a task."""
    best = {i: (np.empty(0, np.int64), np.empty(0, np.int64)) for i, _ in asked}
    for batch in batches:
        for row in range(batch.num_rows):
            tree = Tree.of_row(*(c[row].as_py() for c in batch.columns)).open()
            for i, query in asked:
                scores, ids = best[i]
                more, where = tree.best(query, k, int(scores[-1]) if len(scores) == k else 1)
                scores, ids = np.r_[scores, more], np.r_[ids, where]
                order = np.lexsort((ids, -scores))[:k]
                best[i] = scores[order], ids[order]
    for i, (scores, ids) in best.items():
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i, np.int64)), pa.array(ids, mask=ids == NO_ID), pa.array(scores)], names=["_item", "doc_id", "score"])


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """Ranks all ``docs`` (doc_id, text) for each of ``items`` (item_id, text): builds the index, searches it, deletes it."""
    stats = index_stats(docs)
    index = build_index(docs, stats)
    found = search(index, items, stats[0], k)
    drop_table(index)
    return found
