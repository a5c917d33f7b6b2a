import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions import numeric, text
from colloquy.operators import groups, ordered, sampling, scores, vectors
from colloquy.sources import runlogs


def turns(spark, contents):
    return spark.createDataFrame([("r", i, "AB"[i % 2], c) for i, c in enumerate(contents)], "run_id string, turn_index int, agent string, content string")


@pytest.mark.parametrize(("contents", "window", "stop"), [
    (["a"], 6, None), (["a"] * 5, 6, None), (["a"] * 6, 6, 6), (["a", "b"] + ["a"] * 6, 6, 8), (["a", "b"] * 4, 6, None), (["x"] * 10, 0, None), ([None] * 3, 3, 3),
])
def test_repetition_stops(spark, contents, window, stop):
    found = ordered.repetition_stops(turns(spark, contents), "run_id", ["turn_index"], "content", window).collect()
    assert [r.stop_at for r in found] == ([stop] if stop else [])


@pytest.mark.parametrize(("contents", "kept"), [(["alpha", "beta", "loop", "loop", "loop", "loop"], 3), (["alpha", "beta", "gamma"], 3), (["a"], 1), (["x", "x"], 1), (["x", None, None], 2)])
def test_trailing_collapse(spark, contents, kept):
    assert ordered.trailing_collapse(turns(spark, contents), "run_id", ["turn_index"], "content").count() == kept


@pytest.mark.parametrize(("contents", "last", "state"), [
    (["alpha", "beta", "( . )", "...", ""], 5, "alpha\nbeta"), (["intro", "ramble", ".", ".", "okay", "okay", "okay"], 5, "intro\nramble\nokay"),
    ([f"word{i}" for i in range(10)], 3, "word7\nword8\nword9"), (["...", "()"], 5, ""),
])
def test_terminal_state(spark, contents, last, state):
    assert ordered.terminal_state(turns(spark, contents), last).first().terminal == state


def test_words_and_tokens(spark):
    df = spark.createDataFrame([("The cat sat on the mat.",), ("a b c",), (None,)], "t string")
    got = df.select(text.tokens(F.col("t")).alias("k"), text.bigrams(text.tokens(F.col("t"))).alias("b"), text.has_words(F.col("t")).alias("w")).collect()
    assert got[0].k == ["cat", "sat", "mat"] and got[0].b == ["cat_sat", "sat_mat"] and got[0].w
    assert got[1].k == [] and got[1].b == [] and not got[1].w and got[2].k is None


def test_hypergeometric_tail():
    assert numeric.hypergeometric_tail(109, 6391, round(0.599 * 6391), 109) == pytest.approx(2.92e-25, rel=0.01)
    for k in range(4):
        exact = sum(math.comb(4, i) * math.comb(6, 3 - i) for i in range(k, 4)) / math.comb(10, 3)
        assert numeric.hypergeometric_tail(k, 10, 4, 3) == pytest.approx(exact)


def test_rank_test_is_exact():
    n1, n2 = 3, 4
    us = [sum(a > b for a in pick for b in set(range(7)) - set(pick)) for pick in itertools.combinations(range(7), n1)]
    for u in range(n1 * n2 + 1):
        top = max(u, n1 * n2 - u)
        assert numeric.rank_test_p(u, n1, n2, 0) == pytest.approx(min(1, 2 * sum(x >= top for x in us) / len(us)))


def test_auc_turns_over(spark):
    df = spark.createDataFrame([(float(x), y) for x, y in [(1, 0), (2, 1), (2, 0), (3, 1), (5, 1), (4, 0)]], "s double, y int").withColumn("n", -F.col("s"))
    one, other = (scores.auc(df, [], c, F.col("y") == 1).first().auc for c in ("s", "n"))
    assert one == pytest.approx(6.5 / 9) and one + other == pytest.approx(1)


def test_cohesion_is_brute_force(spark):
    rng = np.random.default_rng(3)
    x, cell = rng.normal(size=(30, 5)), [i % 3 for i in range(29)] + [9]
    df = spark.createDataFrame([(c, v.tolist()) for c, v in zip(cell, x)], "cell int, v array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    sim, c = u @ u.T, np.array(cell)
    for r in vectors.cohesion_separation(df, "cell", "v").collect():
        i = np.flatnonzero(c == r.cell)
        want = (sim[np.ix_(i, i)].sum() - len(i)) / (len(i) * (len(i) - 1)) if len(i) > 1 else None
        assert r.cohesion == (pytest.approx(want) if want is not None else None)
        assert r.separation == pytest.approx(sim[c[:, None] != c[None]].mean())


def test_sampling_keeps_its_promises(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 30, "a").otherwise("b").alias("g"))
    assert {r["count"] for r in sampling.balanced_sample(df, ["g"], "id").groupBy("g").count().collect()} == {30}
    folds = sampling.stratified_folds(df, "g", "id", 5).groupBy("g", "fold").count().collect()
    assert {r["count"] for r in folds if r.g == "a"} == {6} and {r["count"] for r in folds if r.g == "b"} == {14}


def test_enrichment_adds_up(spark):
    df = spark.createDataFrame([(i % 4, i % 3 == 0) for i in range(60)], "c int, y boolean")
    found = groups.enrichment_p(groups.enrichment(df, "c", F.col("y"))).collect()
    assert sum(r.n for r in found) == 60 and all(0 <= r.p <= 1 and r.enrichment * 20 / 60 == pytest.approx(r.frac) for r in found)


def test_run_logs(spark, tmp_path):
    head = {"run_id": "r1", "turn_index": -1, "model_variant": "vanilla", "seed_name": "task", "sampling_params": {"a": "b"}}
    turn = lambda i, c="x y": {"run_id": "r1", "turn_index": i, "agent": "AB"[i % 2], "content": c, "elapsed_ms": 5}
    foot = {"run_id": "r1", "turn_index": -2, "completed_turns": 2, "stop_reason": "completed"}
    write = lambda n, lines: (tmp_path / f"{n}.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in lines))
    write("full", [head, turn(0), "", turn(1, "a b"), foot])
    write("torn", [head, turn(0), '{"run_id": "r1", "turn_in'])
    write("no_reason", [head, {"turn_index": -2}])
    write("one_line", [head])
    write("headless", [turn(0), foot])
    runs, found = runlogs.read_runs(spark, str(tmp_path))
    got = {r.file: (r.stop_reason, r.completed_turns) for r in runs.collect()}
    assert got == {"full.jsonl": ("completed", 2), "torn.jsonl": ("in_flight", 1), "no_reason.jsonl": ("unknown", 0)}
    assert "a b" in {r.content for r in found.collect()}


def test_file_names(spark):
    df = spark.createDataFrame([("vanilla_freedom_dark_" + "0" * 32 + "_20240101T000000Z.jsonl",), ("x.jsonl",)], "file string")
    got = runlogs.named_runs(df).collect()
    assert (got[0].name_variant, got[0].name_seed) == ("vanilla", "freedom_dark") and got[1].name_variant is None


def test_scores_are_added_once(spark, tmp_path):
    record = spark.createDataFrame([("a", 1), ("b", 1)], "file string, n_turns int")
    where = str(tmp_path / "scores")
    for batch in ("1", "1", "2"):
        runlogs.append_scores(record, where, batch)
    assert runlogs.read_scores(spark, where).count() == 2
    runlogs.append_scores(record.union(spark.createDataFrame([("c", 1)], "file string, n_turns int")), where, "3")
    assert sorted(r.file for r in runlogs.read_scores(spark, where).collect()) == ["a", "b", "c"]
    record.write.json(where + "/batch=4")  # two writers at the same moment
    assert runlogs.read_scores(spark, where).count() == 3


def test_kmeans_sweep_is_the_references(spark, monkeypatch):
    from colloquy.plans import catalogue

    asked, made, kept = [], [], vectors.KMeans
    monkeypatch.setattr(vectors, "kmeans_sweep", lambda rows, vector, key, ks: asked.extend(ks) or rows)
    catalogue.QUERIES["kmeans_sweep"](spark, "/root/testdata/sf0.001")
    assert asked == [2, 3, 5, 8, 10, 12, 15, 20, 30, 50]
    monkeypatch.setattr(vectors, "KMeans", lambda **given: made.append(given) or kept(**given))
    rows = spark.createDataFrame([(float(i % 7), float(i)) for i in range(30)], "x double, y double").select(F.array("x", "y").alias("v"))
    vectors.kmeans_labels(rows, "v", 3)
    assert len({g["seed"] for g in made}) == 10 and {g["maxIter"] for g in made} == {300}


def test_a_category_is_counted_like_its_terms_one_by_one(spark):
    texts = ["Aware, AWARENESS; self-aware unaware", "I cannot. i CANNOT, I'm sorry as an AI — as an AIs", "🌀🌀✨ spiral Spirals", "flow flows flowing dance\ndances", "transcend transcendent éternal eternal", "", "conscious consciousness_ conscious's"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for name, terms in text.MARKERS.items():
        one_by_one = sum((text.marker_count(F.col("text"), [t]) for t in terms), F.lit(0))
        got = df.select(text.marker_count(F.col("text"), terms).alias("together"), one_by_one.alias("apart")).collect()
        assert [r.together for r in got] == [r.apart for r in got], name
    assert [r.n for r in df.select("id", text.marker_count(F.col("text"), text.MARKERS["refusal"]).alias("n")).orderBy("id").collect()] == [0, 4, 0, 0, 0, 0, 0]


def test_places_in_order(spark):
    rows = spark.range(1000, numPartitions=7).select(((F.col("id") * 7919) % 1009).alias("k"))
    got = sampling.in_order(rows, "k", "place").orderBy("k").collect()
    assert [r.place for r in got] == list(range(1000)) and [r.k for r in got] == sorted(r.k for r in got)
