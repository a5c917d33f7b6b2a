import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import contrasts, vectors
from colloquy.streaming import logs


def test_robust_errors_are_the_sandwich(spark):
    rng = np.random.default_rng(6)
    x, g, c = rng.normal(size=120), rng.integers(0, 2, 120), rng.integers(0, 9, 120)
    y = 2 * x + g + rng.normal(size=9)[c] + rng.normal(size=120)
    rows = [(int(a), int(b), float(v), float(w)) for a, b, v, w in zip(g, c, x, y)] + [(0, 1, None, 1.0), (2, 1, 3.0, 1.0), (2, 2, 3.0, 2.0), (None, 1, 0.0, 1.0), (None, None, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "g int, c int, x double, y double")
    got = {r.g: r for r in contrasts.robust_slopes(df, ["g"], "x", "y", "c").collect()}
    for k in (0, 1):
        a, b, who = np.c_[np.ones((g == k).sum()), x[g == k]], y[g == k], c[g == k]
        inverse = np.linalg.inv(a.T @ a)
        beta = inverse @ a.T @ b
        e = b - a @ beta
        scores = np.array([(a[who == j] * e[who == j, None]).sum(0) for j in np.unique(who)])
        n, m = len(b), len(scores)
        robust = m / (m - 1) * (n - 1) / (n - 2) * inverse @ scores.T @ scores @ inverse
        assert (got[k].n, got[k].n_clusters) == (n, m)
        assert (got[k].intercept, got[k].slope) == pytest.approx(tuple(beta)) and got[k].robust_error == pytest.approx(np.sqrt(robust[1, 1]))
        assert got[k].error == pytest.approx(np.sqrt(e @ e / (n - 2) * inverse[1, 1]))
        left = {round(r.y, 9): r.residual for r in contrasts.residuals(df, ["g"], "x", "y").where(F.col("g") == k).collect()}
        assert np.allclose([left[round(v, 9)] for v in b], e)
    assert got[2].slope is None and got[2].error is None and got[None].slope == pytest.approx(2) and got[None].error is None
    assert contrasts.robust_slopes(df.limit(0), ["g"], "x", "y", "c").count() == 0


def test_contrasts_by_quarters(spark):
    df = spark.createDataFrame([(float(i), float(i % 3), i % 2 == 0 if i else None) for i in range(9)], "x double, v double, p boolean")
    got = {r.quarter: tuple(r)[1:] for r in contrasts.quarter_contrasts(df, "x", "v", F.col("p")).collect()}
    assert got == {1: (1, 1, 2.0, 1.0, 1.0), 2: (1, 1, 1.0, 0.0, 1.0), 3: (1, 1, 0.0, 2.0, -2.0), 4: (1, 1, 2.0, 1.0, 1.0)}


def test_stored_axes_project_as_the_fit(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(80, 5)) * [5, 3, 1, 1, 1] + 2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    mean, axes = vectors.stored_axes(vectors.fit_axes(df, "vector"))
    assert np.allclose(mean, x.mean(0))
    fitted = np.array([(r.pc1, r.pc2) for r in vectors.pca_2d(df, "vector").orderBy("id").collect()])
    own = (x - mean) @ np.array(axes).T
    assert np.allclose(np.abs(own), np.abs(fitted)) and all(a[np.abs(a).argmax()] > 0 for a in np.array(axes))


def test_a_batch_that_runs_twice_adds_nothing(spark, tmp_path, monkeypatch):
    runs = spark.createDataFrame([(f"r{i}.jsonl", f"r{i}", "v", "s", "completed" if i else "in_flight", 2) for i in range(6)], "file string, run_id string, variant string, seed string, stop_reason string, completed_turns int")
    turns = spark.createDataFrame([(f"r{i}", k, "A", f"text {i}\n\"{k}\"", 5) for i in range(6) for k in range(2)], "run_id string, turn_index int, agent string, content string, elapsed_ms int")
    folder, out, checkpoint = (str(tmp_path / x) for x in ("logs", "out", "checkpoint"))
    for _ in range(2):
        logs.write_logs(runs, turns, folder, "1")
    torn = tmp_path / "logs" / "torn.jsonl"
    torn.write_text('{"turn_index": -1, "run_id": "t"}\n{"turn_index": 0, "content": "x"}\n{"turn_ind')
    parse, made = logs._parse, []

    def failing(rows):
        made.append(1)
        if len(made) == 2:  # the batch has written its rows, then the driver is lost before it is committed
            parse(rows).write.mode("overwrite").parquet(f"{out}/batch=1")
            raise RuntimeError("lost")
        return parse(rows)

    monkeypatch.setattr(logs, "_parse", failing)
    with pytest.raises(Exception, match="lost"):
        logs.follow_logs(spark, folder, out, checkpoint, per_batch=3).awaitTermination()
    logs.follow_logs(spark, folder, out, checkpoint, per_batch=3).awaitTermination()
    found = logs.read_records(spark, out).collect()
    assert sorted((r.content, r.elapsed_ms) for r in found if r.turn_index >= 0 and r.content != "x") == sorted((f"text {i}\n\"{k}\"", 5) for i in range(6) for k in range(2))
    assert sorted(r.turn_index for r in found) == [-2] * 5 + [-1] * 7 + [0] * 7 + [1] * 6
    logs.follow_logs(spark, folder, out, checkpoint, per_batch=3).awaitTermination()
    assert logs.read_records(spark, out).count() == len(found)
