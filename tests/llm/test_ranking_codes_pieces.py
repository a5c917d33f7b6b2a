import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import SF
from pyspark.sql import functions as F

from colloquy.llm import bpe, codes, piece, queries, ranked

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " \t\n", "a", "aaaa" * 300, "Ünï 🌀 çode", "x\x00y", "é́ Σς İ", "word " * 3000, "  a  b ", "▁x▁ y", "\n\n a\n", "�"]


def test_pieces_are_the_library(spark):
    model, library = piece.load(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(3)
    texts = [x for x in ODD if x is not None] + [" " * n + "the" + " " * n + "\n" + " " * (n // 2) for n in range(70)]
    texts += ["".join(rng.choice("abet in  \n▁éж🌀.1") for _ in range(rng.randrange(60))) for _ in range(500)]
    texts += ["".join(rng.choice(model.texts) for _ in range(rng.randrange(20))) for _ in range(1_000)]
    for x in texts:
        ids = library.encode(x)
        assert model.encode(x).tolist() == ids and model.decode(ids) == library.decode(ids), x
    pool = [*range(260), *range(28_700, 28_710), *rng.sample(range(32_000), 200)]
    for _ in range(3_000):
        ids = [rng.choice(pool) for _ in range(rng.randrange(9))]
        assert model.decode(ids) == library.decode(ids), ids
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op13_piece_round_trip(spark, SF).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for r in docs.collect():
        ids = library.encode(r.text or "")
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    assert got == want


def test_pieces_of_a_long_word():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(4)
    word = "".join(rng.choice("etaoinshrdlu漢字") for _ in range(300_000))
    assert piece.load(MODEL).encode(word).tolist() == library.encode(word)


@pytest.mark.parametrize("encode", [lambda d, **k: piece.encode_texts(d, MODEL, **k), lambda d, **k: bpe.encode_texts(d, public_tokenizers.path("word_bpe_49k.json"), **k)])
def test_rows_and_columns_around_ids(spark, encode):
    docs = spark.createDataFrame([(i, t, "old", 7.0) for i, t in enumerate([*ODD, *ODD[:3]])], "doc_id long, text string, IDS string, Decoded double")
    coded = encode(docs, decoded="decoded", most_chars=50)
    assert coded.columns == ["doc_id", "text", "ids", "decoded"]
    got = coded.collect()
    assert [(r.doc_id, r.text) for r in got] == [(r.doc_id, r.text) for r in docs.collect()]
    assert all((r.ids, r.decoded) == ([], "") for r in got if not r.text)
    assert encode(docs.limit(0)).count() == 0


def test_long_words_merge_alike():
    words = bpe.load(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(5)
    some = ["".join(rng.choice("abcdefgéж"[: rng.randrange(1, 10)]) for _ in range(rng.randrange(1, 80))) for _ in range(400)]
    assert [words.merge_long(w) for w in some] == words.merge(some)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for text in ("a" * 5_000, "".join(rng.choice("etaoinshrdlu") for _ in range(30_000)), "short " + "漢字かな" * 2_000 + " x"):
        assert words.encode([text, "x"])[0] == library.encode(text, add_special_tokens=False).ids


def brute_ranking(docs, items, k):
    """docs and items: (id, text) rows; terms by a loop over characters."""

    def terms(text):
        folded = "".join(c.lower() if c.isascii() and c.isalpha() else c if not c.isascii() or c.isdigit() else " " for c in text or "")
        return [w for w in folded.split(" ") if w]

    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, c.total()) for i, c in counted if c]
    n_docs, n_terms, df = len(counted), sum(n for _, _, n in counted), Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in counted:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def test_ranking_is_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"{a}{b}" for a in ("Alpha", "be-ta", "ж", "x_", "9") for b in range(30)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (1 + i) for i in range(150)], k=rng.randrange(1, 80))) for _ in range(400)]
    docs = [(i if i != 7 else None, t) for i, t in enumerate([*ODD, *texts, *texts[:40], *[texts[3]] * 60])] + [(11, texts[9]), (11, texts[9])]
    items = [(i, t) for i, t in enumerate([None, "", "?!", "nothing here", texts[3], texts[3] + " " + texts[3], " ".join(vocabulary), *texts[20:30]])] + [(4, "alpha1")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    stats = ranked.index_stats(frame)
    want = brute_ranking(docs, items, 20)
    for most_terms, most_bytes in ((1_000, 2_000), (10, 64_000_000), (10**9, 64_000_000)):
        index = ranked.build_index(frame, stats, most_terms=most_terms)
        got = sorted(map(tuple, ranked.search(index, asked, stats[0], most_bytes=most_bytes).collect()), key=str)
        assert got == want
    assert len(want) > 200


def test_ranking_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, None), (2, " .")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.rank_documents(docs, items).count() == 0 and ranked.rank_documents(docs.limit(0), items).count() == 0
    assert ranked.rank_documents(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string"), items.limit(0)).count() == 0


def brute_codes(rows, parts, size, rounds):
    kept = sorted((i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    width = len(kept[0][1]) // parts
    cut = [(i, [v[p * width : (p + 1) * width] for p in range(parts)]) for i, v in kept]
    books = [[v[p] for _, v in cut[:size]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, v in cut:
                members[near(v[p], books[p])[1]].append(v[p])
            for k, of in members.items():
                books[p][k] = [sum(x) // len(of) for x in zip(*of)]
    found = [[near(v[p], books[p]) for p in range(parts)] for _, v in cut]
    return [(i, [k for _, k in f], sum(d for d, _ in f)) for (i, _), f in zip(cut, found)], books


@pytest.mark.parametrize("width", [1, 3, 16])
def test_codes_are_brute_force(spark, width):
    rng = np.random.default_rng(width)
    centres = rng.normal(size=(9, 4 * width))
    rows = [(int(i), (centres[i % 9] + rng.normal(size=4 * width) * rng.choice([0, 0.05, 1])).tolist()) for i in range(250)]
    rows += [(300, None), (301, [float("nan")] * 4 * width), (302, [None] * 4 * width), (303, [math.inf] * 4 * width), (10, rows[10][1]), (10, rows[11][1]), (304, [-0.00001] * 4 * width)]
    df = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, vector array<double>, CODE int, extra string").repartition(3)
    books = codes.fit_codebooks(df, "vec_id", "vector", size=24)
    coded = codes.encode_vectors(df, books, "vector")
    want, entries = brute_codes(rows, 4, 24, 4)
    assert books.entries.tolist() == entries and coded.columns == ["vec_id", "vector", "extra", "code", "error"]
    assert sorted((r.vec_id, r.code, r.error) for r in coded.collect()) == sorted(want)
    assert books.digest() == hashlib.sha256(",".join(str(x) for part in entries for e in part for x in e).encode()).hexdigest()


def test_bounds_keep_the_nearest_and_filter():
    rng = np.random.default_rng(8)
    x, entries = rng.integers(-2_000, 2_000, (500, 16)) + rng.integers(-3_000, 3_000, (500, 1)), rng.integers(-2_000, 2_000, (256, 16)) + rng.integers(-3_000, 3_000, (256, 1))
    entries[7] = entries[3]
    every = ((x[:, None] - entries[None]) ** 2).sum(2)
    at, least, worked = codes.nearest_entries(x, entries)
    assert at.tolist() == every.argmin(1).tolist() and least.tolist() == every.min(1).tolist() and worked < every.size / 2


def test_odd_vectors(spark):
    empty = spark.createDataFrame([(1, None), (2, [None])], "vec_id long, vector array<double>")
    assert codes.fit_codebooks(empty, "vec_id", "vector") is None and codes.encode_vectors(empty, None, "vector").count() == 0
    mixed = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0]), (None, [0.0, 0.0, -1.0]), (3, [1e300, 0.0, 0.0])], "vec_id long, vector array<double>")
    books = codes.fit_codebooks(mixed, "vec_id", "vector")
    assert sorted(map(tuple, codes.encode_vectors(mixed, books, "vector").select("vec_id", "error").collect()), key=str) == [(1, 0), (None, 0)]
    bare = spark.createDataFrame([(1, [])], "vec_id long, vector array<double>")
    assert codes.encode_vectors(bare, codes.fit_codebooks(bare, "vec_id", "vector"), "vector").select(F.sum("error")).first()[0] == 0
