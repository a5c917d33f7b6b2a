import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import folds, lexical, suite, sweeps, topics


def sparse_rows(spark, n=60, vocabulary=25, seed=0):
    rng = np.random.default_rng(seed)
    x = np.zeros((n, vocabulary))
    for i in range(n):
        at = rng.choice(np.arange(vocabulary).reshape(5, -1)[i % 5] if i % 7 else vocabulary, 4, replace=False)
        x[i, at] = rng.uniform(0.2, 2, 4)
    data = [(int(i), f"t{j:02d}", float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    rows, codes = topics.packed(spark.createDataFrame(data, "id long, term string, weight double").repartition(3), "id")
    code = {r.term: r.code for r in codes.collect()}
    dense = np.zeros_like(x)
    for j in range(vocabulary):
        if f"t{j:02d}" in code:
            dense[:, code[f"t{j:02d}"]] = x[:, j]
    return rows, codes, dense[:, : len(code)]


def test_spherical_kmeans_rises_and_is_the_slow_version(spark):
    rows, codes, x = sparse_rows(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    model = topics.spherical_kmeans(rows, "id", x.shape[1], 5, seed=3)
    assert all(b >= a - 1e-9 for a, b in zip(model.objective, model.objective[1:])) and len(model.objective) > 1
    order = [r.id for r in rows.orderBy(F.xxhash64(F.lit(3), "id"), "id").collect()]
    c = u[order[:5]]
    for step in range(len(model.objective)):
        near = u @ c.T
        assert near.max(1).sum() == pytest.approx(model.objective[step])
        sums = np.array([u[near.argmax(1) == k].sum(0) for k in range(5)])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    assert np.allclose(c, model.centroids)
    got = {r.id: (r.cluster, r.cosine) for r in topics.assign_spherical(rows, model, "id").collect()}
    near = u @ c.T
    assert {i: k for i, (k, _) in got.items()} == dict(enumerate(near.argmax(1))) and np.allclose([got[i][1] for i in range(60)], near.max(1))


def test_dead_centroids_come_alive(spark):
    same = spark.createDataFrame([(i, "a" if i < 9 else "b", 1.0) for i in range(12)], "id long, term string, weight double")
    rows, _ = topics.packed(same, "id")
    model = topics.spherical_kmeans(rows, "id", 2, 4, seed=1)
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1) and model.objective[-1] == pytest.approx(12)
    assert topics.spherical_kmeans(rows.limit(0), "id", 2, 4).centroids.shape == (0, 2)


def test_factors_are_numpys_and_the_error_falls(spark):
    rows, codes, x = sparse_rows(spark, 40, 20, 1)
    held, h, errors = topics.factorise(rows, "id", x.shape[1], 4, rounds=6)
    first, h0, start = topics.factorise(rows, "id", x.shape[1], 4, rounds=0)
    w = np.array([r.topics for r in first.orderBy("id").collect()])
    want = [((x - w @ h0) ** 2).sum()]
    for _ in range(6):
        w = w * (x @ h0.T) / (w @ (h0 @ h0.T))
        h0 = h0 * (w.T @ x) / (w.T @ w @ h0)
        want.append(((x - w @ h0) ** 2).sum())
    assert np.allclose(errors, want) and all(b <= a + 1e-9 for a, b in zip(errors, errors[1:])) and errors[-1] < errors[0] / 2
    assert np.allclose(h, h0) and np.allclose([r.topics for r in held.orderBy("id").collect()], w)
    top = topics.top_terms_of_topics(h, codes, 3).collect()
    assert len(top) == 12 and all(r.weight == pytest.approx(np.sort(h[r.topic])[-r.rank]) for r in top)


def test_grid_is_single_clusterings(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 3)) + rng.integers(0, 3, (90, 1)) * 4
    df = spark.createDataFrame([(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(x)] + [(90, None, "a")], "id long, vector array<double>, kind string").repartition(4)
    sound = df.where("vector is not null")
    grid = sweeps.fit_grid(sound, "id", "vector", [2, 4], 3)
    for (k, start), centres in grid.items():
        order = [r.id for r in sound.orderBy(sweeps.key_hash("id", 101 * start + 1), "id").limit(k).collect()]
        c = x[order]
        for _ in range(30):
            at = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            c = np.array([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(k)])
        assert np.allclose(centres, c)
    assigned = sweeps.assign_grid(df, grid, "vector", "id", "kind")
    assert assigned.count() == 90 * 6
    for r in assigned.collect()[::17]:
        assert r.cluster == ((x[r.id] - grid[r.k, r.start]) ** 2).sum(1).argmin()
    enriched = sweeps.grid_enrichment(assigned, F.col("kind") == "a", 5)
    one = enriched.where("k = 4 and start = 1").collect()
    members = {r.id for r in assigned.where("k = 4 and start = 1").where(F.col("cluster") == one[0].cluster).collect()}
    assert one[0].n == len(members) and one[0].enrichment == pytest.approx(np.mean([i % 2 == 0 for i in members]) / 0.5)
    winners = {(r.k, r.start): r.enrichment for r in sweeps.grid_winners(enriched).collect()}
    assert winners == {(r.k, r.start): pytest.approx(r.m) for r in enriched.groupBy("k", "start").agg(F.max("enrichment").alias("m")).collect()}


def test_suite_has_a_row_a_seed_and_tier_and_warnings_for_what_fails(spark):
    rng = np.random.default_rng(5)
    rows = [(i, ["s1", "s2", "s3"][i % 3], float(i // 3 % 2) if i % 3 < 2 else 1.0, rng.normal(size=3).tolist(), "yes good fine" if i // 3 % 2 else "no bad poor") for i in range(90)]
    rows = [(i, s, y, [v[0] + 4 * y, *v[1:]], t) for i, s, y, v, t in rows]
    runs = spark.createDataFrame(rows, "id long, seed string, y double, vector array<double>, text string")
    dealt, names = suite.dealt_by_domain(runs, "id", "y", "seed", 3, 2)
    assert names == ["s1", "s2", "s3"]
    tiers = {
        "vectors": lambda: suite.dense_tier(runs.select("id", "vector"), dealt, 3, "id", "vector", 3, 2),
        "words": lambda: suite.term_tier(lexical.word_counts(runs, "id", "text"), dealt, 3, "id", 3, 2),
        "broken": lambda: spark.read.parquet("/nowhere/at/all"),
        "partly": lambda: suite.dense_tier(runs.where("seed = 's1'").select("id", "vector"), dealt, 3, "id", "vector", 3, 2),
    }
    got = {(r.seed, r.tier): r for r in suite.run_suite(tiers, dealt, "seed").collect()}
    assert len(got) == 12
    assert got["s1", "vectors"].auc_mean > 0.95 and got["s2", "words"].auc_mean == 1.0 and got["s1", "vectors"].n_folds == 6 and got["s1", "vectors"].n == 30
    assert got["s3", "vectors"].warning == got["s3", "words"].warning == "one class" and got["s3", "vectors"].auc_mean is None
    assert "PATH_NOT_FOUND" in got["s1", "broken"].warning and got["s2", "partly"].warning == "no rows" and got["s1", "partly"].warning is None
    table = suite.headline(suite.run_suite({"vectors": tiers["vectors"], "broken": tiers["broken"]}, dealt, "seed"), ["vectors", "broken"]).orderBy("seed").collect()
    assert [r.seed for r in table] == names and table[0].vectors > 0.95 and table[0].broken is None
    # one seed alone has the same folds within it, hence the same figures
    alone, _ = suite.dealt_by_domain(runs.where("seed = 's1'"), "id", "y", "seed", 3, 2)
    assert folds.cross_validated(suite.dense_tier(runs.select("id", "vector"), alone, 1, "id", "vector", 3, 2)).first().auc_mean == pytest.approx(got["s1", "vectors"].auc_mean)
