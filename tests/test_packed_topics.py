import numpy as np
from pyspark.sql import functions as F

from colloquy.operators import lexical, sums, topics


def words(spark, n=50):
    rng = np.random.default_rng(9)
    return spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.integers(0, 60, 15))) for i in range(n)], "id long, text string").repartition(3)


def test_packed_weights_are_tfidf(spark):
    counts = lexical.word_counts(words(spark), "id", "text")
    rows, codes = topics.packed_tfidf(counts, 50, "id")
    code = {r.code: r.term for r in codes.collect()}
    got = {(r.id, code[c]): v for r in rows.collect() for c, v in zip(r.codes, r.values)}
    want = {(r.id, r.term): r.weight for r in lexical.tfidf(counts, 50, "id").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items()) and sorted(code) == list(range(len(code)))


def test_pieces_and_followed_rounds_change_nothing(spark, monkeypatch):
    """The driver held dense matrices and a row a number; now packed pieces, in any size."""
    rows, codes = topics.packed_tfidf(lexical.word_counts(words(spark), "id", "text"), 50, "id")
    n, found = codes.count(), []
    for piece, followed in ((1 << 15, 4), (11, 2)):
        monkeypatch.setattr(sums, "PIECE", piece)
        monkeypatch.setattr(topics, "PIECE", piece)
        monkeypatch.setattr(topics, "FOLLOWED", followed)
        model = topics.spherical_kmeans(rows, "id", n, 5, most=6)
        held, h, errors = topics.factorise(rows, "id", n, 3, rounds=5)
        w = np.array([r.topics for r in held.orderBy("id").collect()])
        found.append((model.centroids, model.objective, w, h, errors))
    assert len(model.pieces) > 5 and all(np.allclose(a, b) for a, b in zip(*found))
    labels = [r.cluster for r in topics.assign_spherical(rows, model, "id").orderBy("id").collect()]
    assert len(labels) == 50 and set(labels) <= set(range(5)) and rows.where(F.size("codes") == 0).count() == 0
