import numpy as np
import pytest

from colloquy.operators import probes
from colloquy.sources import runlogs


def test_vector_tables_are_read_by_seed(spark, tmp_path):
    path = str(tmp_path / "vectors")
    rows = [(1, 0, "vanilla", "a", [1.0, 2.0]), (2, 0, "jailbroken", "b", [3.0, 4.0])]
    runlogs.write_vectors(spark.createDataFrame(rows, "run_id int, turn_index int, variant string, seed string, vector array<float>"), path)
    every = runlogs.read_vectors(spark, path)
    assert dict(every.dtypes) == {"run_id": "string", "turn_index": "bigint", "vector": "array<double>", "variant": "string", "seed": "string"}
    assert [r.run_id for r in runlogs.read_vectors(spark, path, ["b"]).collect()] == ["2"]
    with pytest.raises(ValueError, match=r"no seeds \['c'\], only \['a', 'b'\]"):
        runlogs.read_vectors(spark, path, ["a", "c"])
    spark.range(1).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="no columns"):
        runlogs.read_vectors(spark, str(tmp_path / "other"))


def test_reports_have_headers_order_and_decimals(spark, tmp_path):
    path = str(tmp_path / "report")
    runlogs.write_report(spark.createDataFrame([("b", 2.0), ("a", 1.23456), ("c", None)], "token string, z double"), path, ["token"], {"z": 4})
    lines = [x for f in sorted((tmp_path / "report").glob("part-*")) for x in f.read_text().splitlines()]
    assert [x for x in lines if x != "token,z"] == ["a,1.2346", "b,2.0000", "c,"]


def test_softmax_probe_is_at_the_optimum_of_its_objective(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 3))
    y = (x @ rng.normal(size=(3, 3)) + rng.normal(size=(150, 3))).argmax(1)
    rows = spark.createDataFrame([(i, v.tolist(), float(c)) for i, (v, c) in enumerate(zip(x, y))], "id long, vector array<double>, y double")
    found = probes.softmax_predict(rows, rows, "vector", "y", l2=0.01).orderBy("id").collect()
    p = np.array([r.probabilities for r in found])
    assert np.allclose(p.sum(1), 1) and [r.predicted for r in found] == p.argmax(1).tolist()
    # the gradient by the weights is zero: what is left of it is l2 times the weights, whose logits give p back
    w = -(x.T @ (p - np.eye(3)[y])) / len(x) / 0.01
    logits = x @ w
    shift = np.log(p) - logits
    shift -= shift.mean(1, keepdims=True)
    assert np.abs(shift - shift.mean(0)).max() < 1e-2
