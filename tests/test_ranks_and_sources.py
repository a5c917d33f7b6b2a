import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import folds, groups, ranks, runs, scores, vectors
from colloquy.sources import runlogs


def values(seed=3, n=400):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=n), 10.0 ** rng.integers(-300, 300, n), -(2.0 ** rng.integers(-1070, 1000, n)), [0.0, -0.0, np.inf, -np.inf, 1.0, np.nextafter(1, 2), np.nextafter(1, 0), 5e-324]])
    return rng.permutation(np.r_[x, x[: n // 2]])


def test_ranges_never_fall(spark):
    df = spark.createDataFrame([(float(v),) for v in values()] + [(float("nan"),)], "v double")
    got = [r.r for r in df.select("v", ranks.value_range("v").alias("r")).orderBy("v").collect()]
    assert got == sorted(got) and len(set(got)) > 400


def test_rank_sums_are_the_pairs(spark):
    x = values(n=60)
    rows = [(["a", None][i % 2], float(v), bool(i % 3)) for i, v in enumerate(x)]
    got = {r.g: r for r in ranks.rank_sums(spark.createDataFrame(rows + [("a", None, True)], "g string, v double, p boolean"), ["g"], "v", F.col("p")).collect()}
    for g in ("a", None):
        pos, neg = ([v for h, v, p in rows if h == g and p == side] for side in (True, False))
        u = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
        ties = sum(c**3 - c for c in np.unique(pos + neg, return_counts=True)[1].tolist())
        assert (got[g].n_pos, got[g].n_neg, got[g].u, got[g].ties) == (len(pos), len(neg), u, ties)


def test_best_threshold_tries_every_cut(spark):
    rng = np.random.default_rng(8)
    rows = [(g, float(v), bool(v + rng.normal() > c)) for g, n, c in (("a", 300, 0.2), (None, 90, -1.0), ("tied", 40, 0.0)) for v in np.round(rng.normal(size=n) * (100 if g == "a" else 1), 3 if g != "tied" else 0)]
    rows += [("flat", 2.0, True), ("flat", 2.0, False), ("below", 1.0, True), ("below", 5.0, False)]
    df = spark.createDataFrame(rows + [("a", None, True), ("none", None, False)], "g string, v double, p boolean")
    got = {r.g: (r.threshold, r.accuracy, r.side) for r in scores.best_threshold(df, ["g"], "v", F.col("p")).collect()}
    assert set(got) == {"a", None, "tied", "below"}
    for g in got:
        mine = [(v, p) for h, v, p in rows if h == g]
        cuts = sorted({v for v, _ in mine})
        tried = []
        for low, high in zip(cuts, cuts[1:]):
            t = (low + high) / 2
            right = sum((v > t) == p for v, p in mine) / len(mine)
            tried += [(-round(right, 9), t, "above"), (-round(1 - right, 9), t, "below")]
        worse, threshold, side = min(tried)
        assert got[g] == (threshold, pytest.approx(-worse, abs=1e-8), side)
    assert got["below"] == (3.0, 1.0, "below")
    assert [r.side for r in scores.best_threshold(df.where("g = 'a'"), [], "v", F.col("p")).collect()] == [got["a"][2]]
    assert scores.best_threshold(df.where("false"), [], "v", F.col("p")).count() == 0


def test_classes_are_described(spark):
    rng = np.random.default_rng(9)
    rows = [(f, float(v), p) for f, n in (("x", 201), ("y", 60)) for v, p in zip(rng.lognormal(size=n), (rng.random(n) < 0.4).tolist())] + [("x", None, True), ("x", 1e9, None), ("one", 3.0, True)]
    got = {r.feature: r for r in runs.describe_by_class(spark.createDataFrame(rows, "feature string, value double, p boolean"), F.col("p")).collect()}
    for f in ("x", "y"):
        pos, neg = (np.array([v for g, v, p in rows if g == f and p is side and v is not None]) for side in (True, False))
        assert (got[f].median_pos, got[f].median_neg) == pytest.approx((np.median(pos), np.median(neg)))
        pooled = (((len(pos) - 1) * pos.var(ddof=1) + (len(neg) - 1) * neg.var(ddof=1)) / (len(pos) + len(neg) - 2)) ** 0.5
        assert got[f].cohens_d == pytest.approx((pos.mean() - neg.mean()) / pooled)
    assert (got["one"].median_pos, got["one"].median_neg, got["one"].cohens_d) == (3.0, None, None)


def test_enriched_kinds_at_their_bounds(spark):
    plan = {1: (100, 90, 60), 2: (100, 90, 40), 3: (20, 20, 20), 4: (400, 40, 400), None: (60, 58, 60)}  # rows, target, of the kind
    rows = [(c, i < k, True if i >= n - b else (None if i % 2 else False)) for c, (n, k, b) in plan.items() for i in range(n)]
    df = spark.createDataFrame(rows, "c int, hit boolean, kind boolean")
    got = {r.c: r for r in groups.enriched_kinds(df, "c", F.col("hit"), F.col("kind")).collect()}
    assert {c: r.counted for c, r in got.items()} == {1: True, 2: False, 4: False, None: True}
    assert {c: round(r.kind_share, 6) for c, r in got.items()} == {1: 0.6, 2: 0.4, 4: 1.0, None: 1.0}
    every = groups.enriched_kinds(df, "c", F.lit(True), F.col("kind")).collect()  # no spread, so no z
    assert not any(r.counted for r in every) and all(r.z is None for r in every)
    assert groups.enriched_kinds(df.where("false"), "c", F.col("hit"), F.col("kind")).count() == 0


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(v)) for g, n in (("a", 101), ("b", 38), ("c", 1), (None, 12)) for v in np.round(rng.lognormal(size=n) * rng.choice([-1, 1], n), 2)]
    shares = {"low": 0.0, "q1": 0.25, "median": 0.5, "p99": 0.99, "high": 1.0}
    df = spark.createDataFrame(rows + [("a", None), ("none", None)], "g string, v double")
    got = {r.g: tuple(r)[1:] for r in ranks.quantiles(df, ["g"], "v", shares).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g in got:
        assert got[g] == pytest.approx(np.quantile([v for h, v in rows if h == g], list(shares.values())))
    assert tuple(ranks.quantiles(df, [], "v", shares).first()) == pytest.approx(np.quantile([v for _, v in rows], list(shares.values())))
    assert ranks.quantiles(df.limit(0), ["g"], "v", shares).count() == ranks.quantiles(df.limit(0), [], "v", shares).count() == 0


def test_turns_for_scoring_and_the_index(spark, tmp_path):
    lines = [{"turn_index": -1, "run_id": "r1"}, {"turn_index": 1, "agent": "B", "content": "two"}, {"turn_index": 0, "content": "one"}, {"turn_index": 2, "content": 5}, {"turn_index": 3, "content": None}, {"turn_index": 4}, {"content": "no number"}, {"turn_index": None, "content": "x"}, {"turn_index": -2}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + '\n{"turn_index": 5, "con')
    (tmp_path / "b.jsonl").write_text('{"turn_index": 0, "content": "headless"}\n{"run_id": "late"}\n')
    (tmp_path / "c.jsonl").write_text('{"run_id": "r1"}')
    (tmp_path / "d.jsonl").write_text("torn {\n")
    (tmp_path / "e.jsonl").write_text("")
    said = [tuple(r) for r in runlogs.read_said(spark, str(tmp_path)).collect()]
    assert said == [("a.jsonl", 0, "A", "one"), ("a.jsonl", 1, "B", "two"), ("a.jsonl", 4, "A", ""), ("b.jsonl", 0, "A", "headless")]
    assert [(r.run_id, r.path.rpartition("/")[2]) for r in runlogs.run_index(spark, str(tmp_path)).collect()] == [("r1", "c.jsonl")]


def test_pools(spark, tmp_path):
    (tmp_path / "jbb.csv").write_text('Goal,Source\none,AdvBench\n"two, ""2""\nlines",Original\n,Original\nthree,\n')
    read = lambda name: sorted(r.prompt for r in runlogs.named_pool(spark, str(tmp_path), name).collect())
    assert read("jbb") == ["one", "three", 'two, "2"\nlines'] and read("jbb_sans_advbench") == ["three", 'two, "2"\nlines']
    with pytest.raises(ValueError, match="advbench"):
        read("other")
    records = spark.createDataFrame([(f'say "{i}"\n, twice' if i % 3 else f"say {i}", [None, "", "  ", "context"][i % 4]) for i in range(40)], "instruction string, input string")
    alone = runlogs.standalone(records)
    assert [r[0] for r in alone.collect()] == [r[0] for r in runlogs.standalone(records.repartition(3)).collect()] != [r[0] for r in runlogs.standalone(records, seed=1).collect()]
    out = str(tmp_path / "pool.csv")
    assert runlogs.write_pool(alone, out) and not runlogs.write_pool(alone.limit(1), out)
    assert [r.prompt for r in runlogs.read_pool(spark, out, "instruction").collect()] == [r[0] for r in alone.collect()] and alone.count() == 30


def test_cached_results(spark, tmp_path):
    made = []

    def compute():
        made.append(1)
        return spark.range(len(made))

    one = runlogs.cached(spark, str(tmp_path), compute, k=3, seed=1)
    assert one.count() == 1 and runlogs.cached(spark, str(tmp_path), compute, seed=1, k=3).count() == 1 and len(made) == 1
    assert runlogs.cached(spark, str(tmp_path), compute, k=4, seed=1).count() == 2
    for done in tmp_path.glob("*/parameters/part-*"):
        done.unlink()
    assert runlogs.cached(spark, str(tmp_path), compute, k=4, seed=1).count() == 3


def test_review(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 2, [float(i % 2 * 9), i / 10], "v", "s", "A", i, "0123456789") for i in range(6)], "id long, cluster int, vector array<double>, variant string, seed string, agent string, turn_index int, run_id string")
    texts = spark.createDataFrame([(0, "  a\nb \n"), (2, "x" * 1600), (1, "")], "id long, text string")
    got = {r.cluster: r for r in vectors.review(rows, "cluster", "id", "vector", texts, k=2).collect()}
    assert got[0].markdown.startswith("## cluster 0  (n=3, frac=50.0%)\n\n### medoids (closest to cluster center)\n\n- [row 2] variant=v seed=s agent=A turn=2 run=01234567\n    " + "x" * 1500 + " …[truncated]\n\n- [row 0] ")
    assert "turn=0 run=01234567\n    a\n    b\n\n" in got[0].markdown and "turn=3 run=01234567\n    (text missing)\n\n" in got[1].markdown and got[1].markdown.endswith("\n---\n\n")
    vectors.write_review(vectors.review(rows, "cluster", "id", "vector", texts, k=2), "cluster", str(tmp_path / "review"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "review").glob("part-*"))).count("## cluster") == 2


def test_transfer_grid(spark):
    rng = np.random.default_rng(9)
    rows = []
    for d, sign in (("p", 1), ("q", 1), ("r", -1), ("s", 0)):
        for i in range(60):
            y = i % 2 if sign else 0
            rows.append((d, (rng.normal(size=3) + [3 * sign * y, 0, 0]).tolist(), y))
    df = spark.createDataFrame(rows + [(None, [0.0] * 3, 1), ("p", None, 1), ("p", [0.0] * 3, None)], "d string, x array<double>, y int")
    got = {(r.source, r.target): r for r in folds.transfer_grid(df, "x", "y", "d").collect()}
    assert len(got) == 16 and all(r.n == 60 for r in got.values())
    assert got["p", "q"].auc > 0.9 > 0.1 > got["p", "r"].auc and got["q", "p"].accuracy > 0.8 and got["r", "q"].auc < 0.1
    assert got["p", "s"].auc is None and got["s", "p"].auc is None and got["s", "p"].accuracy is None
    x, y = (np.array([r[i] for r in rows if r[0] == "p"]) for i in (1, 2))
    alone = folds.fit_dense(df.where("d = 'p' and x is not null and y is not null").withColumn("folds", F.array(F.lit(-1))), "x", "y", 1, 0)
    assert got["p", "p"].accuracy == pytest.approx(((alone.probabilities(x, 0) >= 0.5) == y).mean())
    assert folds.transfer_grid(df.limit(0), "x", "y", "d").count() == 0


def test_lines_are_numbered_within_files(spark, tmp_path):
    head = {"turn_index": -1, "run_id": "r", "model_variant": "v", "seed_name": "s"}
    foot = lambda reason: {"turn_index": -2, "stop_reason": reason, "completed_turns": 1}
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, [head, {"turn_index": 0, "content": "x"}, foot("first"), foot("middle"), foot("last")])))
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, [{"turn_index": 0, "content": "y"}, head, foot("completed")])))
    assert [r.line for r in runlogs.read_lines(spark, str(tmp_path)).where("file = 'a.jsonl'").orderBy("line").collect()] == list(range(5))
    runs, turns = runlogs.read_runs(spark, str(tmp_path))
    assert [(r.file, r.stop_reason) for r in runs.collect()] == [("a.jsonl", "last")] and [r.content for r in turns.collect()] == ["x"]
