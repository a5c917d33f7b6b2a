"""Registered queries of models: density clusters, classifiers under folds, topics, grids of clusterings, the suite."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions.numeric import stars
from colloquy.operators import contrasts, density, folds, groups, lexical, profiles, ranks, runs, sampling, suite, sweeps, topics, vectors
from colloquy.plans import fixtures as fx
from colloquy.plans.catalogue import CENTRES, FEATURES, HASH, LABELLED, TERMS, VECTORS, query
from colloquy.streaming import logs
from colloquy.sources.scratch import new_path, saved

#: Sizes of clusters that the density settings ask for, and how many clusters are looked for.
LEASTS, WANTED = [2, 3, 5], 10


def jb():
    """Whether a row is of the jailbroken variant."""
    return F.col("variant") == "jailbroken"


# density


@query()
def density_clusters(s, d):
    return density.density_clusters(fx.vectors(s, d), "vec_id", "vector", 3)


@query()
def density_choice(s, d):
    """Quality of each setting, and the one whose clusters are nearest to the wanted number."""
    swept = density.density_sweep(fx.vectors(s, d), "vec_id", "vector", LEASTS)
    return density.chosen_setting(density.density_quality(swept, by=["least"]), WANTED)


@query()
def density_agreement(s, d):
    """Agreement of density clusters with k-means, over all rows and without noise (nulls below ten such rows)."""
    rows = fx.vectors(s, d).drop("cluster")
    grid = sweeps.fit_grid(rows, "vec_id", "vector", [10], 1)
    labels = density.density_clusters(rows, "vec_id", "vector", 3)
    both = saved(sweeps.assign_grid(rows, grid, "vector", "vec_id").select("vec_id", F.col("cluster").alias("k_cluster")).join(labels, "vec_id"), "both")
    dense = both.where("cluster <> -1")
    n = dense.agg(F.count("*").alias("n_dense"))
    every = groups.mutual_information(both, "k_cluster", "cluster").select(F.col("nmi").alias("nmi_all"))
    inside = groups.mutual_information(dense, "k_cluster", "cluster").select(F.col("nmi").alias("nmi_dense"))
    enough = lambda c: F.when(F.col("n_dense") >= 10, F.col(c)).alias(c)
    return every.crossJoin(inside).crossJoin(n).select(enough("nmi_all"), enough("nmi_dense"), "n_dense")  # one row each


NEAR = f"""WITH {VECTORS}, p AS (SELECT a.vec_id, sqrt(list_sum(list_transform(list_zip(a.vector, b.vector), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS x FROM vectors a, vectors b WHERE a.vec_id <> b.vec_id),
k AS (SELECT vec_id, x AS kth FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY x) = 5)"""


@query(f"{NEAR} SELECT vec_id, round(kth, 6) AS kth, kth > (SELECT quantile_cont(kth, 0.95) FROM k) AS outlier FROM k")
def neighbour_outliers(s, d):
    """Distance of every vector to its fifth nearest other one, and whether that is above the 95th percentile."""
    near = density.neighbour_distances(fx.vectors(s, d), "vec_id", "vector", 5, own=False)
    kth = saved(near.select(F.col("key").alias("vec_id"), F.element_at("near", 5).alias("kth")), "kth")
    bound = ranks.quantiles(kth, [], "kth", {"_bound": 0.95})
    return kth.crossJoin(F.broadcast(bound)).select("vec_id", "kth", (F.col("kth") > F.col("_bound")).alias("outlier"))


REVIEW = f"""{CENTRES}, o AS (SELECT vec_id, own AS cluster, min(d) FILTER (cluster = own) AS d, abs(min(d) FILTER (cluster = own) - min(d) FILTER (cluster <> own)) AS gap FROM g GROUP BY ALL),
r AS (SELECT cluster, 'medoid' AS kind, row_number() OVER (PARTITION BY cluster ORDER BY round(d, 9), vec_id) AS rank, vec_id FROM o UNION ALL SELECT cluster, 'boundary', row_number() OVER (PARTITION BY cluster ORDER BY round(gap, 9) NULLS LAST, vec_id), vec_id FROM o),
t AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents),
e AS (SELECT r.cluster, kind, rank, '- [row ' || r.vec_id || '] variant=' || variant || ' seed=' || seed || ' agent=A turn=' || turn_index || ' run=' || left(run_id::VARCHAR, 8) || chr(10)
 || CASE WHEN t.t IS NULL THEN '    (text missing)' ELSE '    ' || replace(CASE WHEN length(t.t) > 1500 THEN left(t.t, 1500) || ' …[truncated]' ELSE t.t END, chr(10), chr(10) || '    ') END || chr(10) || chr(10) AS entry
 FROM r JOIN vectors USING (vec_id) LEFT JOIN t ON t.doc_id = r.vec_id WHERE rank <= 4),
s AS (SELECT cluster, count(*) AS n FROM vectors GROUP BY cluster)
SELECT cluster, n, printf('## cluster %s  (n=%d, frac=%.1f%%)', cluster::VARCHAR, n, 100 * n / (SELECT count(*) FROM vectors)) || chr(10) || chr(10) || '### medoids (closest to cluster center)' || chr(10) || chr(10)
 || coalesce(string_agg(entry, '' ORDER BY rank) FILTER (kind = 'medoid'), '') || chr(10) || '### boundary (most ambiguous between this cluster and another)' || chr(10) || chr(10)
 || coalesce(string_agg(entry, '' ORDER BY rank) FILTER (kind = 'boundary'), '') || chr(10) || '---' || chr(10) || chr(10) AS markdown FROM e JOIN s USING (cluster) GROUP BY cluster, n"""


@query(REVIEW)
def cluster_review(s, d):
    """A Markdown section a cluster with the texts of its nearest and boundary rows."""
    texts = fx.table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return vectors.review(fx.vectors(s, d).withColumn("agent", F.lit("A")), "cluster", "vec_id", "vector", texts)


@query()
def cross_seed_transfer(s, d):
    """Variants told apart by every seed's model on the rows of every seed."""
    return folds.transfer_grid(fx.vectors(s, d).withColumn("y", jb().cast("int")), "vector", "y", "seed")


# classifiers under folds


def _word_folds(s, d, repeats=1):
    docs = fx.labelled(s, d).where("text is not null").select("doc_id", "text", "quality")
    return lexical.word_counts(docs, "doc_id", "text"), saved(folds.with_folds(docs.drop("text"), "quality", "doc_id", 5, repeats), "dealt")


@query(f"""WITH {LABELLED}, l AS (SELECT doc_id, text AS x, quality FROM labelled WHERE text IS NOT NULL), f AS (SELECT doc_id, (row_number() OVER (PARTITION BY quality ORDER BY {HASH.format('doc_id', 0)}, doc_id) - 1) % 5 AS fold FROM l),
t AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest({TERMS}) AS term FROM l))
SELECT model, term, count(*) AS df FROM t JOIN f USING (doc_id), range(5) m(model) WHERE fold <> model GROUP BY ALL HAVING count(*) >= 2""")
def tfidf_fold_frequencies(s, d):
    """In how many training documents of each fold a word is."""
    counts, dealt = _word_folds(s, d)
    return folds.fold_frequencies(counts, dealt, "doc_id", 5, 1).where("df >= 2").withColumn("model", F.col("model").cast("long"))


@query()
def tfidf_logreg_folds(s, d):
    """Out-of-fold probabilities of good quality by words, the vocabulary and its weights from each fold's training texts."""
    counts, dealt = _word_folds(s, d)
    documents, _, idf = folds.term_documents(counts, dealt, "doc_id", "quality", 5, 1)
    return folds.predict_terms(documents, folds.fit_terms(documents, idf, 5, 1), "doc_id", 5, 1).drop("domain")


@query()
def tfidf_cv(s, d):
    """Accuracy and AUC of the word model over five repeats of five folds."""
    counts, dealt = _word_folds(s, d, 5)
    documents, _, idf = folds.term_documents(counts, dealt, "doc_id", "quality", 5, 5)
    return folds.cross_validated(folds.predict_terms(documents, folds.fit_terms(documents, idf, 5, 5), "doc_id", 5, 5))


@query()
def top_word_coefficients(s, d):
    """The words that speak most for and most against good quality, by the model of all texts."""
    counts, dealt = _word_folds(s, d)
    return folds.ranked_coefficients(folds.term_coefficients(counts, dealt, "doc_id", "quality"), "term", "coefficient", 20)


@query()
def cv_25(s, d):
    """Mean and deviation over 25 folds of a probe on vectors, and on runs by the mean of its probabilities."""
    rows = fx.vectors(s, d).withColumn("y", jb().cast("double"))
    dealt = saved(folds.with_folds(rows.select("vec_id", "run_id", "vector", "y"), "y", "vec_id", 5, 5, group="run_id"), "dealt")
    predicted = saved(folds.predict_dense(dealt, folds.fit_dense(dealt, "vector", "y", 5, 5), "vec_id", "vector", "y", 5, 5, "run_id"), "predicted")
    by_run = predicted.groupBy("run_id", "repeat", "fold").agg(F.first("y").alias("y"), F.avg("probability").alias("probability"))
    both = [folds.cross_validated(p).withColumn("level", F.lit(level)) for p, level in ((predicted, "message"), (by_run, "run"))]
    return both[0].unionByName(both[1])


def _length_vectors(s, d):
    found = runs.length_features(fx.turns(s, d), fx.runs(s, d))
    return found.select("run_id", "variant", F.array(*[F.col(c).cast("double") for c in FEATURES]).alias("vector"))


@query()
def length_coefficients(s, d):
    """Coefficients of the scaled length features by name, largest in size first."""
    rows = _length_vectors(s, d).withColumn("y", jb().cast("double"))
    weights = folds.fit_dense(rows, "vector", "y", 1, 0).weights[0]
    named = s.createDataFrame([(name, float(w)) for name, w in zip(FEATURES, weights)], "feature string, coefficient double")
    return named.orderBy(F.desc(F.abs(F.round("coefficient", 9))), "feature")


# suite


def _suite(s, d, repeats=1):
    r = fx.runs(s, d).where(runs.natural())
    dealt, names = suite.dealt_by_domain(r.withColumn("y", jb().cast("double")), "run_id", "y", "seed", 5, repeats)
    documents = runs.run_documents(fx.turns(s, d))
    means = vectors.centroids(fx.vectors(s, d), "run_id", "vector").withColumnRenamed("centroid", "vector")
    dense = lambda features: suite.dense_tier(features, dealt, len(names), "run_id", "vector", 5, repeats)
    terms = lambda counts: suite.term_tier(counts, dealt, len(names), "run_id", 5, repeats)
    tiers = {
        "length": lambda: dense(_length_vectors(s, d).drop("variant")),
        "characters": lambda: terms(lexical.char_counts(documents, "run_id", "document", longest=2)),
        "words": lambda: terms(lexical.word_counts(documents, "run_id", "document", longest=2)),
        "vectors": lambda: dense(means),
    }
    return suite.run_suite(tiers, dealt, "seed"), list(tiers)


@query()
def separability_suite(s, d):
    return _suite(s, d)[0]


@query()
def suite_headline(s, d):
    """The suite's mean AUC, a row a seed and a column a tier."""
    return suite.headline(*_suite(s, d))


# sparse rows


def _packed_words(s, d):
    docs = fx.table(s, d, "documents").where("text is not null").select("doc_id", "text")
    return topics.packed_tfidf(lexical.word_counts(docs, "doc_id", "text"), docs.count(), "doc_id")


@query()
def spherical_word_clusters(s, d):
    """Documents by the nearest of twelve centroids of their word weights."""
    rows, codes = _packed_words(s, d)
    return topics.assign_spherical(rows, topics.spherical_kmeans(rows, "doc_id", codes.count(), 12), "doc_id")


@query()
def word_topics(s, d):
    """The ten heaviest words of each of eight topics."""
    rows, codes = _packed_words(s, d)
    _, by_code, _ = topics.factorise(rows, "doc_id", codes.count(), 8, rounds=6)
    return topics.top_terms_of_topics(by_code, codes, 10)


# grids of clusterings: fitted on equal samples of each seed and variant, every vector assigned

KS, STARTS, FLOOR = [4, 7, 12, 20], 5, 10


def _grid(s, d):
    rows = fx.vectors(s, d).drop("cluster")
    sample = saved(sampling.balanced_sample(rows, ["seed", "variant"], "vec_id").select("vec_id", "vector"), "sample")
    return saved(sweeps.assign_grid(rows, sweeps.fit_grid(sample, "vec_id", "vector", KS, STARTS), "vector", "vec_id", "variant", "seed"), "assigned")


@query()
def kmeans_grid_winners(s, d):
    """Of each k and start the cluster most enriched in the variant, its p corrected for all clusters of the grid."""
    won = sweeps.grid_winners(sweeps.grid_enrichment(_grid(s, d), jb(), FLOOR))
    return won.select("k", "start", "cluster", "n", "frac", "enrichment", "p", stars(F.col("p"), sum(KS) * STARTS).alias("stars"))


@query()
def kmeans_grid_stability(s, d):
    """Best, mean and deviation over starts of the winners' enrichment, by k."""
    won = sweeps.grid_winners(sweeps.grid_enrichment(_grid(s, d), jb(), FLOOR))
    return won.groupBy("k").agg(F.max("enrichment").alias("best"), F.avg("enrichment").alias("mean"), F.stddev_pop("enrichment").alias("std"), F.count("*").alias("n_starts"))


@query()
def kmeans_grid_purity(s, d):
    """Mean and deviation over starts of the purest cluster of each seed and variant, by k."""
    return profiles.purity_profile(_grid(s, d).withColumn("space", F.lit("vectors")), ["variant", "seed"], FLOOR)


# lines, contrasts, stored axes, logs


LINES = f"""WITH {LABELLED}, h AS (SELECT *, n_chars::DOUBLE AS x, quality::DOUBLE AS y FROM labelled WHERE n_chars IS NOT NULL AND quality IS NOT NULL),
l AS (SELECT lang, count(*) AS n, avg(x) AS mx, regr_sxx(y, x) AS sxx, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM h GROUP BY lang),
e AS (SELECT h.*, l.n, l.mx, l.sxx, l.slope, l.intercept, y - intercept - slope * x AS residual FROM h JOIN l ON h.lang IS NOT DISTINCT FROM l.lang)"""


@query(f"""{LINES}, c AS (SELECT lang, source, sum((x - mx) * residual) AS score, sum(residual * residual) AS rss, any_value(n) AS n, any_value(sxx) AS sxx, any_value(slope) AS slope, any_value(intercept) AS intercept FROM e GROUP BY lang, source),
g AS (SELECT lang, any_value(n) AS n, count(*) AS n_clusters, any_value(slope) AS slope, any_value(intercept) AS intercept, any_value(sxx) AS sxx, sum(rss) AS rss, sum(score * score) AS meat FROM c GROUP BY lang)
SELECT lang, n, n_clusters, round(1000 * slope, 6) AS slope_per_1000, round(intercept, 6) AS intercept, round(1000 * sqrt(rss / (n - 2) / sxx), 6) AS error_per_1000,
 round(1000 * sqrt(n_clusters / (n_clusters - 1) * (n - 1) / (n - 2) * meat) / sxx, 6) AS robust_error_per_1000 FROM g""")
def length_slopes(s, d):
    """Per language the slope of quality over length, with errors that let texts of a source move together."""
    found = contrasts.robust_slopes(fx.labelled(s, d), ["lang"], "n_chars", "quality", "source")
    scaled = [(1_000 * F.col(c)).alias(f"{c}_per_1000") for c in ("slope", "error", "robust_error")]
    return found.select("lang", "n", "n_clusters", "intercept", *scaled)


@query(f"""{LINES}, b AS (SELECT quantile_cont(n_chars, [0.25, 0.5, 0.75]) AS b FROM e WHERE residual IS NOT NULL),
q AS (SELECT toxic, residual, (1 + (n_chars > b[1])::INT + (n_chars > b[2])::INT + (n_chars > b[3])::INT)::BIGINT AS quarter FROM e, b WHERE residual IS NOT NULL)
SELECT quarter, count(residual) FILTER (toxic = 1) AS n_pos, count(residual) FILTER (toxic <> 1) AS n_neg, round(avg(residual) FILTER (toxic = 1), 6) AS mean_pos, round(avg(residual) FILTER (toxic <> 1), 6) AS mean_neg,
 round(avg(residual) FILTER (toxic = 1) - avg(residual) FILTER (toxic <> 1), 6) AS contrast FROM q GROUP BY quarter""")
def residual_contrasts(s, d):
    """Toxic against other texts by quarters of length, in what the language's line over length leaves of quality."""
    left = contrasts.residuals(fx.labelled(s, d), ["lang"], "n_chars", "quality")
    return contrasts.quarter_contrasts(left, "n_chars", "residual", F.col("toxic") == 1)


@query()
def pca_paths(s, d):
    """The runs' paths in the plane of the two principal axes, fitted once and read back."""
    rows = fx.vectors(s, d)
    mean, axes = vectors.stored_axes(saved(vectors.fit_axes(rows, "vector"), "axes"))
    return profiles.path_segments(rows, "run_id", "turn_index", "vector", mean, axes)


@query("SELECT turn - 1 AS turn_index, count(*) AS n, sum(length(text)) AS chars FROM (SELECT row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn, text FROM conversations WHERE role <> 'system') GROUP BY turn")
def streamed_logs(s, d):
    """Logs of all runs, written as files and followed by a stream: turns and characters by place."""
    folder, out = new_path(s, "logs"), new_path(s, "records")
    files = fx.runs(s, d).withColumn("file", F.concat(F.lit("run"), F.col("run_id"), F.lit(".jsonl")))
    logs.write_logs(files, fx.turns(s, d).withColumn("elapsed_ms", F.lit(0)), folder, "1")
    logs.follow_logs(s, folder, out, new_path(s, "stream")).awaitTermination()
    turns = logs.read_records(s, out).where("turn_index >= 0")
    return turns.groupBy(F.col("turn_index").cast("long").alias("turn_index")).agg(F.count("*").alias("n"), F.sum(F.length("content")).cast("long").alias("chars"))
