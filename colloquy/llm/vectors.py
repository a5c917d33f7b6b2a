"""Embedding near-duplicates by tiled comparison in PCA order.

Unit vectors are rotated to principal components. Vectors with a cosine of at least t are at most sqrt(2 - 2t) apart in
every component, so a grid over the two leading ones limits which cells meet. Cells are cut into chunks of bounded
size, and each pair of chunks is a tile: leading components are multiplied first, the rest is bounded by the product of
suffix norms, and pairs that cannot reach the threshold are left; survivors get the full product and an exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import components, write_table

#: Vectors in a chunk: a tile holds at most twice as many.
CHUNK = 1024
#: Leading components that are multiplied before each bound.
STAGES = (8, 24)
SLACK = 1e-9


def principal_axes(vectors: DataFrame) -> np.ndarray:
    """Principal axes (columns, by variance) of unit vectors in column ``unit``, over all rows.

    Each task adds up its own products; one row per entry of the matrix and task is summed by Spark.
    """

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            for size, group in frame.groupby(frame["unit"].map(len)):
                x = np.c_[np.ones(len(group)), np.stack(group["unit"].to_numpy())]
                total[size] = total.get(size, 0) + x.T @ x
        for size, m in total.items():
            yield pd.DataFrame({"size": size, "k": np.arange(m.size), "v": m.ravel()})

    entries = vectors.select("unit").mapInPandas(products, "size int, k int, v double").groupBy("size", "k").agg(F.sum("v").alias("v")).toPandas()
    axes = {}
    for size, part in entries.groupby("size"):
        m = part.sort_values("k")["v"].to_numpy().reshape(size + 1, size + 1)
        mean = m[0, 1:] / m[0, 0]
        axes[int(size)] = np.ascontiguousarray(np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))[1][:, ::-1])
    return axes


def _linked(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``a`` and ``b`` (raw vectors, doubles) with a cosine of at least ``threshold``."""
    norm_a, norm_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    x, y = (a / norm_a[:, None]) @ axes, (b / norm_b[:, None]) @ axes
    rest = lambda z, k: np.sqrt(np.maximum(0, (z[:, k:] ** 2).sum(1)))
    lead = min(STAGES[0], x.shape[1])
    dots = x[:, :lead] @ y[:, :lead].T
    i, j = np.nonzero(dots + np.outer(rest(x, lead), rest(y, lead)) >= threshold - SLACK)
    found_i, found_j = [], []
    for at in range(0, len(i), 100_000):
        p, q = i[at : at + 100_000], j[at : at + 100_000]
        sums, done = dots[p, q], lead
        for upto in (*STAGES[1:], x.shape[1]):
            upto = min(upto, x.shape[1])
            sums = sums + np.einsum("ij,ij->i", x[p, done:upto], y[q, done:upto])
            keep = sums + rest(x, upto)[p] * rest(y, upto)[q] >= threshold - SLACK
            p, q, sums, done = p[keep], q[keep], sums[keep], upto
        exact = np.einsum("ij,ij->i", a[p], b[q]) / (norm_a[p] * norm_b[q]) >= threshold
        found_i.append(p[exact])
        found_j.append(q[exact])
    empty = np.empty(0, np.int64)
    return np.concatenate([*found_i, empty]), np.concatenate([*found_j, empty])


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable by links (i, j), for each of n."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, chunk: int = CHUNK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Columns vec_id, embedding (array of numbers) and label; only vectors of equal, non-null labels and equal length are
    compared, in double precision. A vector that is null, empty, zero or holds null or non-finite components links with
    nothing. Equal vectors of a label are grouped first and counted by their number; each group has a number of its own,
    so rows that share a vec_id have their own links, and only links join components. A row with null vec_id has links
    like others, and a component of null ids only has none. Extra columns are left; an empty table gives an empty
    result. Nothing is capped.
    """
    near = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    sound = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")), F.lit(False))) & (size > 0) & F.col("label").isNotNull()
    held = write_table(rows.withColumn("ok", F.coalesce(sound, F.lit(False))), "vectors")
    groups = write_table(
        held.where("ok").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
        .select("label", "v", "least", F.monotonically_increasing_id().alias("node"), "copies", F.transform("v", lambda x: x / size).alias("unit")),
        "vector-groups",
    )
    axes = principal_axes(groups)

    def grid(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lead = [(u @ axes[len(u)][:, :2]) if len(u) > 1 else np.array([u[0], 0.0]) for u in frame["unit"]]
            cell = np.floor(np.array(lead).reshape(-1, 2) / near).astype(int)
            yield frame.drop(columns="unit").assign(size=frame["v"].map(len), cx=cell[:, 0], cy=cell[:, 1])

    placed = write_table(groups.select("label", "v", "node", "copies", "unit").mapInPandas(grid, f"label {groups.schema['label'].dataType.simpleString()}, v array<double>, node long, copies long, size int, cx int, cy int"), "vector-cells")
    cell = ["label", "size", "cx", "cy"]
    cells = write_table(placed.groupBy(*cell).agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")), "vector-grid")
    # a cell meets itself and the eight around it; of two cells, the first in reading order is the left side
    around = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)])).alias("d")
    other = cells.select("label", "size", F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("chunks").alias("theirs"))
    met = cells.select("*", around).select("*", (F.col("cx") + F.col("d.x")).alias("ox"), (F.col("cy") + F.col("d.y")).alias("oy"), (F.col("d.x") * 2 + F.col("d.y")).alias("side")).join(other, ["label", "size", "ox", "oy"])
    plans = write_table(met.groupBy(*cell, "chunks").agg(F.collect_list(F.struct("ox", "oy", "theirs", "side")).alias("meets")), "vector-plans")
    mine = F.pmod(F.xxhash64("node", "v"), F.col("chunks")).cast("int")
    dealt = placed.join(plans, cell).withColumn("mine", mine).select("*", F.explode("meets").alias("m")).select("*", F.explode(F.sequence(F.lit(0), F.col("m.theirs") - 1)).alias("their"))
    left = (F.col("m.side") > 0) | ((F.col("m.side") == 0) & (F.col("mine") <= F.col("their")))
    ours, others = F.struct("cx", "cy", F.col("mine").alias("c")), F.struct(F.col("m.ox").alias("cx"), F.col("m.oy").alias("cy"), F.col("their").alias("c"))
    tiles = dealt.select("label", "size", F.when(left, ours).otherwise(others).alias("first"), F.when(left, others).otherwise(ours).alias("second"), left.alias("is_left"), (F.col("m.side").eqNullSafe(0) & (F.col("mine") == F.col("their"))).alias("alone"), "node", "copies", "v")

    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(tile["v"].to_numpy())
        a = np.flatnonzero(tile["is_left"].to_numpy())
        alone = bool(tile["alone"].iloc[0])
        b = a if alone else np.flatnonzero(~tile["is_left"].to_numpy())
        if not len(a) or not len(b):
            return pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")
        i, j = _linked(x[a], x[b], axes[x.shape[1]], threshold)
        if alone:
            i, j = i[i < j], j[i < j]
        i, j = a[i], b[j]
        copies, node = tile["copies"].to_numpy(), tile["node"].to_numpy()
        links = np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
        at = np.flatnonzero(links)
        return pd.DataFrame({"node": node[at], "links": links[at].astype("int64"), "root": node[_roots(len(x), i, j)[at]]})

    found = write_table(tiles.groupBy("label", "size", "first", "second").applyInPandas(compare, "node long, links long, root long"), "vector-links")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "vector-components")
    member = groups.select("label", "v", "node", "least", "copies").join(linked, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = member.groupBy("component").agg(F.min("least").alias("component_id"))
    keyed = write_table(member.select("label", "v", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")).join(names, "component").drop("component"), "vector-names")
    return (
        held.join(keyed, ["label", "v"], "left")
        .select("vec_id", F.when(F.col("ok"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
