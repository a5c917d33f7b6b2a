"""Near-duplicates by exact Jaccard similarity of sets of word shingles.

Sets are first met by their SimHash fingerprints: each asks for one that differs in two or fewer bits, by multi-index
hashing of fingerprint halves. Similar texts may differ in more bits, so what fingerprints don't find is searched exactly.

Of two sets in one common order, each without its last ``ceil(t n) - 1`` members, some member is shared if the
similarity is at least ``t`` (prefix filtering), so no pair is missed. Shingles that a sample of texts shows to be common
come last: the order decides what the search costs, never what it finds. Pairs that share a prefix member are first made
with one text of each such bucket, that with the fewest shingles not seen to be common: the least edited of a group of
copies is like nearly all of them, so a large group is linked without all its pairs. Then the texts still apart from it
meet the whole bucket. A pair goes on if what follows the shared member in both is enough (it holds for the first shared
one) and if the parities of 1,024 classes of members don't differ too often; what is left is verified on whole sets.
Neither filter loses a pair. In the second step both are part of the join, so what it makes does not grow with the square
of a group, though it still looks at each text apart with all of its buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import components, drop_table, free_shuffles, write_table
from colloquy.llm.simhash import fingerprint_links, fingerprint_of, shingle_hashes

#: Texts about that many are looked through for common shingles, and how often one is seen to be common.
LOOKED_AT, COMMON = 20_000, 4
#: Shingles are worked on in slices by their hash, pairs in parts by their first text, so that the files of an exchange take a
#: share of the disk only: posts and pairs that make a slice, and how many there are at most, for each reads all texts' marks.
SLICE_POSTS, SLICE_PAIRS, SLICES = 4_000_000, 50_000, 8


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle).view(np.int64))


def parities(members: np.ndarray) -> np.ndarray:
    """Of 1,024 classes of members by their low bits, which are of odd size: 16 words of 64 bits. Two sets differ in at
    least as many members as these differ in bits."""
    return np.packbits(np.bincount(members & 1023, minlength=1024).astype(np.uint8) & 1).view(np.int64)


def _sets(text: str, shingle: int) -> Column:
    @F.pandas_udf("array<long>")
    def sets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shingle_set(t, shingle) for t in batch], dtype=object)

    return sets.asNondeterministic()(F.col(text))


def common_shingles(rows: DataFrame, text: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles of a sample of bounded size, sorted, and the logarithm of how often each was seen."""
    share = min(1.0, LOOKED_AT / max(rows.count(), 1))
    sample = rows.where(F.pmod(F.xxhash64("_row"), F.lit(1_000_000)) < share * 1_000_000)
    seen = sample.select(F.explode(_sets(text, shingle)).alias("s")).groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).toPandas().sort_values("s")
    return seen["s"].to_numpy(np.int64), np.log2(seen["n"].to_numpy(float)).astype(np.int8)


def fingerprint_pairs(heads: DataFrame) -> DataFrame:
    """Pairs (a, b: ids, a < b) of sets (id, fp), in a table: each with the first set of its fingerprint, and each of those
    with the first set of one fingerprint that differs in two or fewer bits. A set has one partner each, so that a large
    group of near copies makes few pairs."""
    spark = heads.sparkSession
    prints = write_table(heads.groupBy("fp").agg(F.min("id").alias("head")), "similar-prints")
    same = heads.join(prints.hint("merge"), "fp").where("id <> head").select(F.col("head").alias("x"), F.col("id").alias("y"))
    ways = F.array(F.struct(F.col("a").alias("p"), F.col("b").alias("q")), F.struct(F.col("b").alias("p"), F.col("a").alias("q")))
    one = fingerprint_links(prints.select("fp")).select(F.explode(ways).alias("w")).groupBy(F.col("w.p").alias("a")).agg(F.min("w.q").alias("b"))
    of = lambda fp, name: prints.select(F.col("fp").alias(fp), F.col("head").alias(name)).hint("merge")
    near = one.join(of("a", "x"), "a").join(of("b", "y"), "b").select("x", "y")
    pairs = write_table(same.union(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "similar-pairs")
    drop_table(prints)
    free_shuffles(spark)
    return pairs


def similar_rows(rows: DataFrame, text: str, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows (_row, component) for every row of a table with a long ``_row``: component is the smallest row reachable over
    pairs of a similarity of at least ``similarity``. Wordless and null texts are one group."""
    shared = rows.sparkSession.sparkContext.broadcast(common_shingles(rows, text, shingle))

    @F.pandas_udf("digest binary, fp long, n int, rare int, prefix array<long>, parity array<long>")
    def marks(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        common, level = shared.value
        for batch in texts:
            out = []
            for t in batch:
                s = shingle_set(t, shingle)
                at = np.minimum(np.searchsorted(common, s), max(len(common) - 1, 0))
                of = np.where(common[at] == s, level[at], 0) if len(common) else np.zeros(len(s))
                most = len(s) - math.ceil(similarity * len(s) - 1e-9) + 1 if len(s) else 0
                out.append((xxhash.xxh3_128_digest(s.tobytes()), fingerprint_of(s.view(np.uint64)), len(s), int((of == 0).sum()), s[np.lexsort((s, of))][:most], parities(s)))
            yield pd.DataFrame(out, columns=["digest", "fp", "n", "rare", "prefix", "parity"])

    spark = rows.sparkSession
    free_shuffles(spark)
    marked = write_table(rows.select("_row", marks.asNondeterministic()(F.col(text)).alias("m")).select("_row", "m.*"), "similar")
    sets = write_table(marked.groupBy("digest").agg(F.min("_row").alias("id")), "similar-sets")
    heads = write_table(marked.join(sets.select(F.col("id").alias("_row")), "_row", "left_semi").withColumnRenamed("_row", "id").drop("digest"), "similar-heads")
    members = write_table(marked.select("_row", "digest"), "similar-members")
    drop_table(marked)
    free_shuffles(spark)
    slices = max(1, min(SLICES, -(-(heads.agg(F.sum(F.size("prefix"))).first()[0] or 0) // SLICE_POSTS)))

    def may_be(n: str, at: str, other_n: str, other_at: str) -> Column:
        """Whether sizes allow the similarity, and the members from a shared one on, were it the first, are enough."""
        n, at, other_n, other_at = map(F.col, (n, at, other_n, other_at))
        enough = F.least(n - at, other_n - other_at) * (1 + similarity) >= similarity * (n + other_n) - 1e-9
        return enough & (F.least(n, other_n) >= similarity * F.greatest(n, other_n) - 1e-9)

    def close(p: str, p_n: str, q: str, q_n: str) -> Column:
        """Whether the parities differ in no more bits than sets of that similarity can differ in members."""
        odd = sum((F.bit_count(F.col(p)[i].bitwiseXOR(F.col(q)[i])) for i in range(16)), F.lit(0))
        return odd * (1 + similarity) <= (1 - similarity) * (F.col(p_n) + F.col(q_n)) + 1e-9

    def in_order(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def all_of(tables: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.union, tables)

    def buckets(part: int) -> DataFrame:
        """The posts of shingles of a slice that several texts have, with the leader of each."""
        posts = heads.select("id", "n", "rare", F.posexplode("prefix").alias("at", "s")).where(F.pmod("s", F.lit(slices)) == part)
        # most shingles are in one text only: counting them first costs a narrow exchange, and only posts of the others are kept
        often = write_table(posts.groupBy("s").agg(F.count("*").alias("texts")).where("texts > 1").select("s"), "similar-often")
        free_shuffles(spark)
        posts = write_table(posts.join(often, "s", "left_semi"), "similar-posts")
        drop_table(often)
        free_shuffles(spark)
        first = posts.groupBy("s").agg(F.min(F.struct("rare", "id", "n", "at")).alias("f"))
        leaders = first.select("s", F.col("f.id").alias("leader"), F.col("f.n").alias("leader_n"), F.col("f.at").alias("leader_at"))
        held = write_table(posts.drop("rare").join(leaders, "s"), "similar-buckets")
        drop_table(posts)
        free_shuffles(spark)
        return held

    def with_leaders(held: DataFrame) -> DataFrame:
        met = held.where("id <> leader").where(may_be("n", "at", "leader_n", "leader_at")).select(F.col("id").alias("x"), F.col("leader").alias("y"))
        pairs = write_table(in_order(met), "similar-pairs")
        free_shuffles(spark)
        return pairs

    def verified(likely: DataFrame) -> DataFrame:
        """The pairs that are as similar as that, a part of them after the other."""
        parts = max(1, min(SLICES, -(-likely.count() // SLICE_PAIRS)))
        links = []
        for part in range(parts):
            these = likely.where(F.pmod(F.xxhash64("a"), F.lit(parts)) == part)
            wanted = write_table(these.select(F.col("a").alias("_row")).union(these.select("b")).distinct().sort("_row"), "similar-wanted")
            whole = write_table(rows.join(wanted, "_row", "left_semi").select("_row", _sets(text, shingle).alias("set")), "similar-shingles")
            both = these.join(whole.select(F.col("_row").alias("a"), F.col("set").alias("p")), "a").join(whole.select(F.col("_row").alias("b"), F.col("set").alias("q")), "b")
            alike = F.size(F.array_intersect("p", "q")) * (1 + similarity) >= similarity * (F.size("p") + F.size("q")) - 1e-9
            links.append(write_table(both.where(alike).select("a", "b"), "similar-links"))
            drop_table(wanted)
            drop_table(whole)
            free_shuffles(spark)
        drop_table(likely)
        return all_of(links)

    led = [fingerprint_pairs(heads.select("id", "fp"))]
    held = [buckets(part) for part in range(slices)]
    bits = write_table(heads.select("id", "n", "parity"), "similar-bits")
    drop_table(heads)
    side = lambda row, n, parity: bits.select(F.col("id").alias(row), F.col("n").alias(n), F.col("parity").alias(parity))
    led += [with_leaders(one) for one in held]
    pairs = all_of(led).distinct()
    likely = write_table(pairs.join(side("a", "p_n", "p"), "a").join(side("b", "q_n", "q"), "b").where(close("p", "p_n", "q", "q_n")).select("a", "b"), "similar-likely")
    for one in led:
        drop_table(one)
    free_shuffles(spark)
    near = verified(likely)
    group = components(near, "similar-groups")
    of = lambda column, name: group.select(F.col("node").alias(column), F.col("component").alias(name))

    def apart_in(held: DataFrame) -> DataFrame:
        """Likely pairs of a text apart from its bucket's leader and any other of the bucket."""
        placed = held.join(of("id", "g"), "id", "left").join(of("leader", "leader_g"), "leader", "left").select("s", "leader", "id", "n", "at", F.coalesce("g", "id").alias("g"), F.coalesce("leader_g", "leader").alias("leader_g"))
        placed = write_table(placed, "similar-placed")
        drop_table(held)
        free_shuffles(spark)
        # only buckets with a text apart from their leader go on
        met = placed.join(placed.where("g <> leader_g").select("s").distinct(), "s", "left_semi").join(bits.select("id", "parity"), "id")
        met = write_table(met, "similar-met")
        drop_table(placed)
        free_shuffles(spark)
        apart = met.where("g <> leader_g").select("s", F.col("id").alias("x"), F.col("n").alias("x_n"), F.col("at").alias("x_at"), F.col("g").alias("x_g"), F.col("parity").alias("x_parity"))
        fits = (F.col("x_g") != F.col("g")) & may_be("n", "at", "x_n", "x_at") & close("x_parity", "x_n", "parity", "n")
        likely = write_table(in_order(apart.join(met.where("id <> leader"), "s").where(fits).select("x", F.col("id").alias("y"))), "similar-likely")
        drop_table(met)
        free_shuffles(spark)
        return likely

    found = [apart_in(one) for one in held]
    rest = verified(write_table(all_of(found).distinct(), "similar-apart"))
    for one in found:
        drop_table(one)
    joined = components(near.union(rest), "similar-groups")
    named = sets.join(joined.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    return members.join(named, "digest").select("_row", "component")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The row with the smallest key of each group (nulls last; of repeated rows, one), all columns as they are."""
    rows = write_table(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("_row")), "similar-rows")
    groups = write_table(similar_rows(rows.select("_row", F.col(f"doc.`{text}`").alias("_text")), "_text", shingle, similarity), "similar-named")
    keys = rows.select("_row", F.col(f"doc.`{key}`").alias("_key"))
    best = F.min(F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"), F.col("_row").alias("row")))
    kept = groups.join(keys, "_row").groupBy("component").agg(best.alias("b")).select(F.col("b.row").alias("_row"))
    gone = write_table(groups.select("_row").join(kept, "_row", "left_anti").sort("_row"), "similar-gone")
    return rows.join(gone, "_row", "left_anti").select("doc.*")
