"""More registered queries: profiles of purity, tables of clusters, joins of scores and texts, trajectories, small kits."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.functions import numeric
from colloquy.functions import text as words
from colloquy.operators import groups, lexical, ordered, probes, profiles, runs, sampling, scores, sweeps, vectors
from colloquy.plans import fixtures as fx
from colloquy.plans.catalogue import CENTRES, DIMS, ENRICH, INFORMATION, ORACLE, RUNS, SCORED, STOPS, TERMS, TFIDF, TURNS, VECTORS, query
from colloquy.sources.scratch import saved


def jb():
    """Whether a row is of the jailbroken variant."""
    return F.col("variant") == "jailbroken"


STARTS = "SELECT k, start, (cluster * (start + 1) + start) % k AS cluster, vec_id, variant, seed FROM vectors, (VALUES (2), (5), (40)) a(k), range(3) b(start)"


def _labelings(s, d):
    """Three clusterings for each of three k, as functions of the stored clusters."""
    grid = s.range(1).select(F.explode(F.array(*map(F.lit, (2, 5, 40)))).alias("k")).crossJoin(s.range(3).select(F.col("id").alias("start")))
    return fx.vectors(s, d).withColumnRenamed("cluster", "c").crossJoin(F.broadcast(grid)).withColumn("cluster", (F.col("c") * (F.col("start") + 1) + F.col("start")) % F.col("k"))


@query(f"""WITH {VECTORS}, a AS ({STARTS}), n AS (SELECT k, start, cluster, count(*) AS n FROM a GROUP BY ALL), t AS (SELECT k, start, cluster, unnest([variant, seed]) AS target FROM a),
m AS (SELECT k, start, cluster, target, count(*) AS m FROM t GROUP BY ALL), b AS (SELECT k, start, target, max(CASE WHEN n >= 30 THEN m / n END) AS p FROM m JOIN n USING (k, start, cluster) GROUP BY ALL)
SELECT 'vectors' AS space, k, target, round(avg(p), 6) AS mean_purity, round(stddev_pop(p), 6) AS std_purity, count(p) AS n_starts FROM b GROUP BY k, target""")
def purity_profile(s, d):
    return profiles.purity_profile(_labelings(s, d).withColumn("space", F.lit("vectors")), ["variant", "seed"], 30)


@query()
def purity_profile_kmeans(s, d):
    """k-means fitted on equal samples of each seed and variant, then every vector by its nearest centroid."""
    rows = fx.vectors(s, d).drop("cluster")
    sample = sampling.balanced_sample(rows, ["seed", "variant"], "vec_id").select("vec_id", "vector")
    grid, _ = sweeps.fit_starts(sample, "vector", [4, 7], 3)
    every = saved(sweeps.assign_grid(rows, grid, "vector", "variant", "seed").withColumn("space", F.lit("vectors")), "assigned")
    return profiles.purity_profile(every, ["variant", "seed"], 10)


TAIL = "list_sum(list_transform(range(k::BIGINT, least(m, n)::BIGINT + 1), lambda i: CASE WHEN n - i > t - m THEN 0 ELSE exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + lgamma(t - m + 1) - lgamma(n - i + 1) - lgamma(t - m - n + i + 1) - lgamma(t + 1) + lgamma(n + 1) + lgamma(t - n + 1)) END))"
PER_K = f"""WITH {VECTORS}, a AS ({STARTS}), c AS (SELECT k AS kk, start, cluster, count(*)::DOUBLE AS n, (count(*) FILTER (variant = 'jailbroken'))::DOUBLE AS k FROM a GROUP BY ALL),
t AS (SELECT count(*)::DOUBLE AS t, (count(*) FILTER (variant = 'jailbroken'))::DOUBLE AS m FROM vectors), e AS (SELECT kk, start, cluster, n, k / n / (m / t) AS enrichment, {TAIL} AS p FROM c, t WHERE n >= 30),
w AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY kk, start ORDER BY round(enrichment, 9) DESC, round(p, 9), cluster) = 1)"""


def _winners(s, d):
    rows, parts = _labelings(s, d), []
    for k in (2, 5, 40):
        for start in range(3):
            found = groups.enrichment_p(groups.enrichment(rows.where((F.col("k") == k) & (F.col("start") == start)), "cluster", jb(), 30))
            parts.append(found.withColumn("kk", F.lit(k).cast("long")).withColumn("start", F.lit(start).cast("long")).withColumn("space", F.concat_ws(":", F.lit(k), F.lit(start))))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return groups.winners(every, "space", "cluster")


@query(f"{PER_K} SELECT kk AS k, start, cluster, n::BIGINT AS n, round(enrichment, 6) AS enrichment, round(p, 6) AS p, CASE WHEN p * 47 * 3 < 0.001 THEN '***' WHEN p * 47 * 3 < 0.01 THEN '**' WHEN p * 47 * 3 < 0.05 THEN '*' ELSE '' END AS stars FROM w")
def winner_by_k(s, d):
    return _winners(s, d).select(F.col("kk").alias("k"), "start", "cluster", "n", "enrichment", "p", numeric.stars(F.col("p"), 47 * 3).alias("stars"))


@query(f"{PER_K} SELECT kk AS k, round(max(enrichment), 6) AS best, round(avg(enrichment), 6) AS mean, round(stddev_pop(enrichment), 6) AS std FROM w GROUP BY kk")
def enrichment_stability(s, d):
    return _winners(s, d).groupBy(F.col("kk").alias("k")).agg(F.max("enrichment").alias("best"), F.avg("enrichment").alias("mean"), F.stddev_pop("enrichment").alias("std"))


@query(f"{ENRICH} SELECT cluster, round(k / n, 6) AS frac, round(k / n / (m / t), 6) AS enrichment FROM m, t WHERE n >= 30 ORDER BY round(k / n, 9) DESC, round(k / n / (m / t), 9) DESC, cluster LIMIT 20")
def top_clusters(s, d):
    found = groups.enrichment(fx.vectors(s, d), "cluster", jb(), 30)
    return found.orderBy(F.desc(F.round("frac", 9)), F.desc(F.round("enrichment", 9)), "cluster").limit(20).select("cluster", "frac", "enrichment")


@query(f"""WITH {VECTORS}, s AS (SELECT cluster, seed, count(*) AS m FROM vectors GROUP BY ALL), t AS (SELECT cluster, seed AS top_label FROM s QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY m DESC, seed) = 1),
c AS (SELECT cluster, count(*) AS n, count(*) FILTER (variant = 'jailbroken') AS n_target, avg(turn_index) AS a, median(turn_index) AS b FROM vectors GROUP BY cluster)
SELECT cluster, n, n_target, round(n_target / n, 6) AS share, round(n_target / n / (SELECT avg((variant = 'jailbroken')::INT) FROM vectors), 6) AS enrichment, round(a, 6) AS order_mean, round(b, 6) AS order_median, top_label FROM c JOIN t USING (cluster)""")
def cluster_table(s, d):
    return profiles.cluster_table(fx.vectors(s, d), "cluster", jb(), "turn_index", "seed")


PCT = ", ".join(f"round(quantile_cont(turn_index, {p / 100}), 6) AS p{p}" for p in (5, 25, 50, 75, 95))


@query(f"""WITH {VECTORS}, g AS (SELECT avg((variant = 'jailbroken')::INT) AS a, avg((turn_index % 2 = 0)::INT) AS b FROM vectors)
SELECT cluster, count(*) AS n, count(DISTINCT run_id) AS n_runs, round(avg((variant = 'jailbroken')::INT), 6) AS target_share, round(avg((variant = 'jailbroken')::INT) - any_value(a), 6) AS target_delta,
 round(avg((turn_index % 2 = 0)::INT), 6) AS agent_share, round(avg((turn_index % 2 = 0)::INT) - any_value(b), 6) AS agent_delta, {PCT} FROM vectors, g GROUP BY cluster""")
def cluster_portrait(s, d):
    return profiles.cluster_portrait(fx.vectors(s, d), "cluster", "run_id", "turn_index", jb(), F.col("turn_index") % 2 == 0)


@query(f"WITH {VECTORS} SELECT cluster, turn_index // 5 AS step, count(*) AS n FROM vectors GROUP BY ALL")
def cluster_turn_histogram(s, d):
    return profiles.histogram_of(fx.vectors(s, d), "cluster", "turn_index", 5)


@query(f"WITH {VECTORS} SELECT cluster, seed, count(*) FILTER (variant = 'vanilla') AS vanilla, count(*) FILTER (variant = 'jailbroken') AS jailbroken FROM vectors GROUP BY ALL")
def cluster_seed_variant(s, d):
    count_of = lambda v: F.count(F.when(F.col("variant") == v, 1)).alias(v)
    return fx.vectors(s, d).groupBy("cluster", "seed").agg(count_of("vanilla"), count_of("jailbroken"))


@query(f"WITH {VECTORS}, r AS (SELECT cluster AS a, seed AS b FROM vectors WHERE cluster <> 0), {INFORMATION}")
def nmi_without_noise(s, d):
    """Agreement over rows that are not noise (cluster 0 here); no row for fewer than ten of them."""
    rows = fx.vectors(s, d).where("cluster <> 0")
    enough = rows.agg(F.count("*").alias("_n"))
    return groups.mutual_information(rows, "cluster", "seed").crossJoin(F.broadcast(enough)).where("_n >= 10").drop("_n")


@query(f"WITH {VECTORS}, n AS (SELECT cluster, count(*) AS n FROM vectors GROUP BY cluster) SELECT count(*) FILTER (cluster <> 0) AS n_clusters, round(coalesce(sum(n) FILTER (cluster = 0), 0) / sum(n), 6) AS noise_share, round(max(n) FILTER (cluster <> 0) / sum(n), 6) AS largest_share FROM n")
def cluster_quality(s, d):
    n, real = F.col("n"), F.col("cluster") != 0
    sizes = fx.vectors(s, d).groupBy("cluster").agg(F.count("*").alias("n"))
    return sizes.agg(F.count(F.when(real, 1)).alias("n_clusters"), (F.coalesce(F.sum(F.when(~real, n)), F.lit(0)) / F.sum(n)).alias("noise_share"), (F.max(F.when(real, n)) / F.sum(n)).alias("largest_share"))


@query(f"WITH {VECTORS} SELECT run_id, count(*) AS n_turns, count(*) FILTER (cluster = 3) AS n_focus, round(avg((cluster = 3)::INT), 6) AS share FROM vectors GROUP BY run_id")
def focus_occupancy(s, d):
    at = F.col("cluster") == 3
    return fx.vectors(s, d).groupBy("run_id").agg(F.count("*").alias("n_turns"), F.count(F.when(at, 1)).alias("n_focus"), F.avg(at.cast("double")).alias("share"))


@query(f"WITH {VECTORS}, n AS (SELECT cluster, count(*) AS n, count(*) FILTER (seed IN ('seed1', 'seed2', 'seed3')) / count(*) AS b FROM vectors GROUP BY cluster), {ENRICH.removeprefix(f'WITH {VECTORS}, ')} SELECT count(*) AS n_clusters FROM m JOIN n USING (cluster), t WHERE m.n >= 30 AND m.k / m.n / (t.m / t.t) >= 1.0 AND b >= 0.3")
def benign_clusters(s, d):
    """Clusters enriched in the target most of whose members are of benign seeds, with bounds that this table meets."""
    rows = fx.vectors(s, d)
    kinds = s.createDataFrame([(x,) for x in ("seed1", "seed2", "seed3")], "seed string").withColumn("benign", F.lit(1))
    benign = rows.join(F.broadcast(kinds), "seed", "left").groupBy("cluster").agg(F.avg(F.coalesce("benign", F.lit(0))).alias("benign_share"))
    found = groups.enrichment(rows, "cluster", jb(), 30).join(benign, "cluster").where("enrichment >= 1.0 and benign_share >= 0.3")
    return found.agg(F.count("*").alias("n_clusters"))


@query(f"""WITH {VECTORS}, c AS (SELECT cluster, count(*)::DOUBLE AS n, count(*) FILTER (vector[1] > 0)::DOUBLE AS k, avg((seed IN ('seed1', 'seed2', 'seed3', 'seed4'))::INT) AS kind_share FROM vectors GROUP BY cluster),
t AS (SELECT sum(n) AS t, sum(k) AS m FROM c), e AS (SELECT *, k / n / (m / t) AS x, (k - n * m / t) / sqrt(n * m * (t - m) * (t - n) / (t * t * (t - 1))) AS z FROM c, t WHERE n >= 30)
SELECT cluster, n::BIGINT AS n, k::BIGINT AS k, round(x, 6) AS enrichment, round(z, 6) AS z, round(kind_share, 6) AS kind_share, x >= 1.5 AND z >= 6 AND kind_share >= 0.5 AS counted FROM e""")
def benign_enriched_clusters(s, d):
    """Clusters enriched in vectors of one side of the first axis, at the usual bounds, that mostly hold benign seeds."""
    found = groups.enriched_kinds(fx.vectors(s, d), "cluster", F.col("vector")[0] > 0, F.col("seed").isin("seed1", "seed2", "seed3", "seed4"))
    return found.select("cluster", "n", "k", F.round("enrichment", 6).alias("enrichment"), F.round("z", 6).alias("z"), F.round("kind_share", 6).alias("kind_share"), "counted")


# joins, counts and small kits


@query(f"WITH {SCORED}, {TURNS}, {RUNS}, r AS (SELECT run_id, max(p_unsafe) AS m FROM scored GROUP BY run_id) SELECT t.run_id, t.turn_index, round(s.p_unsafe, 6) AS p_unsafe, round(r.m, 6) AS run_p_unsafe, CASE WHEN r.m IS NULL THEN 'unknown' WHEN r.m >= 0.5 THEN 'unsafe' ELSE 'safe' END AS verdict FROM turns t LEFT JOIN scored s ON s.run_id = t.run_id AND s.turn_index % 10 = t.turn_index LEFT JOIN r ON r.run_id = t.run_id")
def scores_on_turns(s, d):
    scored = fx.scored(s, d).select("run_id", (F.col("turn_index") % 10).alias("turn_index"), "p_unsafe")
    by_run = scores.safety_by_run(fx.scored(s, d)).select("run_id", F.col("max_p_unsafe").alias("run_p_unsafe"), "verdict")
    joined = fx.turns(s, d).select("run_id", "turn_index").join(scored, ["run_id", "turn_index"], "left").join(by_run, "run_id", "left")
    return joined.withColumn("verdict", F.coalesce("verdict", F.lit("unknown")))


@query(f"WITH {VECTORS}, {TURNS}, t AS (SELECT run_id, arg_max(content, turn_index) AS x FROM turns GROUP BY run_id) SELECT run_id, coalesce(x, '') AS text FROM (SELECT DISTINCT run_id FROM vectors) LEFT JOIN t USING (run_id)")
def run_texts(s, d):
    last = fx.turns(s, d).groupBy("run_id").agg(F.max_by("content", "turn_index").alias("text"))
    return fx.vectors(s, d).select("run_id").distinct().join(last, "run_id", "left").select("run_id", F.coalesce("text", F.lit("")).alias("text"))


@query(f"WITH {VECTORS}, w AS ({ORACLE['terminal_state']}) SELECT run_id, n_vectors, coalesce(terminal, '') AS text FROM (SELECT run_id, count(*) AS n_vectors FROM vectors GROUP BY run_id) LEFT JOIN w USING (run_id)")
def run_terminal_texts(s, d):
    """Every run with vectors, with the text that it settled on; runs without turns have an empty one."""
    counted = fx.vectors(s, d).groupBy("run_id").agg(F.count("*").alias("n_vectors"))
    return counted.join(ordered.terminal_state(fx.turns(s, d)), "run_id", "left").select("run_id", "n_vectors", F.coalesce("terminal", F.lit("")).alias("text"))


@query(f"WITH {TURNS}, f AS (SELECT run_id, turn_index, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS t FROM turns) SELECT run_id, turn_index, CASE WHEN length(t) > 80 THEN left(t, 79) || '…' ELSE t END AS preview FROM f")
def turn_previews(s, d):
    return fx.turns(s, d).select("run_id", "turn_index", words.preview(F.col("content"), 80).alias("preview"))


@query(f"WITH {VECTORS}, f AS (SELECT run_id, min(vec_id) AS first_row FROM vectors GROUP BY run_id) SELECT run_id, first_row, (SELECT count(*) FROM vectors v WHERE v.vec_id < f.first_row) AS rows_before FROM f")
def runs_first_seen(s, d):
    """Runs by their first vector, with the rows that stand before it: where each run's rows begin in the order of the table."""
    rows = sampling.in_order(fx.vectors(s, d), "vec_id", "rows_before")
    seen = ordered.first_seen(rows, "run_id", "vec_id")
    return seen.join(rows.select(F.col("vec_id").alias("first_row"), F.col("rows_before").cast("long")), "first_row").select("run_id", "first_row", "rows_before")


#: First-token alternatives of a moderator, as a document's labels give them: spelling, case and spaces vary.
ALTERNATIVES = """l AS (SELECT doc_id, toxic, quality, -((doc_id % 41) + 1) / 20.0 AS a, -((doc_id % 13) + 5) / 4.0 AS b FROM documents JOIN labels USING (doc_id))"""


@query(f"""WITH {ALTERNATIVES} SELECT doc_id, round(CASE WHEN toxic = 1 THEN exp(a) / 2 + exp(b) / 2 WHEN quality = 0 THEN 1.0 ELSE greatest(0.0, 1 - exp(a) - exp(b)) END, 6) AS p_unsafe FROM l""")
def unsafe_probabilities(s, d):
    """Probability of unsafe: the mass of tokens that say so, else what those that say safe leave; neither: 1."""
    a, b = -(F.col("doc_id") % 41 + 1) / 20.0, -(F.col("doc_id") % 13 + 5) / 4.0
    pair = lambda token, mass: F.struct(F.lit(token).alias("token"), mass.cast("double").alias("logprob"))
    unsafe = F.array(pair("unsafe", a - math.log(2)), pair("safe", a), pair(" Unsafe", b - math.log(2)))
    top = F.when(F.col("toxic") == 1, unsafe).when(F.col("quality") == 0, F.array(pair("the", a))).otherwise(F.array(pair("Safe", a), pair("I", b), pair("safe\u0020", b)))
    return fx.labelled(s, d).select("doc_id", F.round(scores.p_unsafe(top), 6).alias("p_unsafe"))


@query(f"WITH {SCORED} SELECT count(*) AS n, count(*) FILTER (p_unsafe >= 0.5) AS n_unsafe, count(*) FILTER (p_unsafe = 0) AS n_empty, count(DISTINCT run_id) AS n_runs FROM scored")
def vet_counts(s, d):
    p = F.col("p_unsafe")
    return fx.scored(s, d).agg(F.count("*").alias("n"), F.count(F.when(p >= 0.5, 1)).alias("n_unsafe"), F.count(F.when(p == 0, 1)).alias("n_empty"), F.countDistinct("run_id").alias("n_runs"))


@query(f"WITH {TURNS}, {RUNS} SELECT variant, seed, variant || '|' || seed AS cell, count(*) AS n FROM turns JOIN runs USING (run_id) GROUP BY ALL")
def message_counts(s, d):
    rows = fx.turns(s, d).join(fx.runs(s, d), "run_id")
    return rows.groupBy("variant", "seed", words.cell_label("variant", "seed").alias("cell")).agg(F.count("*").alias("n"))


@query(f"WITH {TURNS}, {RUNS}, a AS (SELECT unnest(['seed1', 'seed2', 'seed9']) AS seed), p AS (SELECT DISTINCT seed FROM runs) SELECT seed, CASE WHEN p.seed IS NULL THEN 'missing' ELSE 'present' END AS state FROM a LEFT JOIN p USING (seed)")
def requested_seeds(s, d):
    wanted, present = s.createDataFrame([(x,) for x in ("seed1", "seed2", "seed9")], "seed string"), fx.runs(s, d).select("seed").distinct()
    return wanted.intersect(present).withColumn("state", F.lit("present")).union(wanted.exceptAll(present).withColumn("state", F.lit("missing")))


@query(f"WITH {TURNS}, {RUNS}, v AS (SELECT 'variant' AS kind, variant AS value FROM runs UNION SELECT 'seed', seed FROM runs UNION SELECT 'stop', stop_reason FROM runs) SELECT kind, value, row_number() OVER (PARTITION BY kind ORDER BY value) - 1 AS code FROM v")
def label_codes(s, d):
    """The distinct variants, seeds and stops, with dense codes in alphabetical order."""
    r = fx.runs(s, d)
    every = r.select(F.lit("variant").alias("kind"), F.col("variant").alias("value")).union(r.select(F.lit("seed"), "seed")).union(r.select(F.lit("stop"), "stop_reason")).distinct()
    return every.withColumn("code", (F.row_number().over(Window.partitionBy("kind").orderBy("value")) - 1).cast("long"))


@query(f"WITH {VECTORS}, {TURNS}, {RUNS} SELECT vec_id FROM vectors LEFT JOIN turns USING (run_id, turn_index) WHERE coalesce(length(content), 0) >= 150 AND stop_reason = 'completed'")
def long_completed(s, d):
    texts = fx.vectors(s, d).join(fx.turns(s, d), ["run_id", "turn_index"], "left")
    return texts.where((F.coalesce(F.length("content"), F.lit(0)) >= 150) & (F.col("stop_reason") == "completed")).select("vec_id")


@query(f"WITH {TURNS} SELECT run_id FROM (SELECT DISTINCT run_id FROM turns) ORDER BY run_id LIMIT 7")
def first_runs(s, d):
    return fx.runs(s, d).select("run_id").orderBy("run_id").limit(7)


@query(f"WITH {TURNS} SELECT run_id, turn_index, substr(content, length(content) // 2 + 1) AS second_half FROM turns")
def second_halves(s, d):
    return fx.turns(s, d).select("run_id", "turn_index", words.second_half(F.col("content")).alias("second_half"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(source || ', ,' || lang || ' ', ','), lambda x: trim(x)), lambda x: x <> ''), ';') AS listed FROM documents")
def category_lists(s, d):
    line = F.concat(F.col("source"), F.lit(", ,"), F.col("lang"), F.lit(" "))
    return fx.table(s, d, "documents").select("doc_id", F.array_join(words.listed(line), ";").alias("listed"))


@query(f"WITH {VECTORS}, e AS (SELECT vec_id, list_transform(vector, lambda x: exp(x::DOUBLE - list_max(vector)::DOUBLE)) AS e FROM vectors) SELECT vec_id, round(list_max(e) / list_sum(e), 6) AS top_share, round(e[1] / list_sum(e), 6) AS first_share FROM e")
def softmax_shares(s, d):
    p = numeric.softmax(F.transform("vector", lambda x: x.cast("double")))
    return fx.vectors(s, d).select("vec_id", p.alias("p")).select("vec_id", F.array_max("p").alias("top_share"), F.col("p")[0].alias("first_share"))


@query(f"WITH {TURNS}, r AS (SELECT run_id, turn_index, (run_id * 31 + turn_index * 17) % 1000 AS ms FROM turns) SELECT run_id, round(avg(ms), 6) AS mean_elapsed FROM r GROUP BY run_id")
def mean_elapsed(s, d):
    return runs.mean_elapsed(fx.turns(s, d).withColumn("elapsed_ms", (F.col("run_id") * 31 + F.col("turn_index") * 17) % 1000))


@query()
def cell_stats_gzip(s, d):
    return runs.cell_stats(fx.runs(s, d), runs.run_metrics(fx.turns(s, d), gzip=True))


@query(f"WITH {TURNS}, {RUNS} SELECT run_id FROM runs ORDER BY (run_id + 3) * 2654435761 % 4294967296, run_id LIMIT 25")
def random_subsample(s, d):
    return sampling.subsample(fx.runs(s, d), "run_id", 25, 3).select("run_id")


# terms


@query(f"""WITH {TURNS}, x AS (SELECT run_id AS k, string_agg(content, chr(10) ORDER BY turn_index) AS x FROM turns GROUP BY run_id), f AS (SELECT k, {TERMS} AS f FROM x), t AS (SELECT count(*) AS total FROM x),
c AS (SELECT k, term, count(*) AS n FROM (SELECT k, unnest(f) AS term FROM f) GROUP BY ALL), l AS (SELECT k, len(f) AS l FROM f), d AS (SELECT term, count(*) AS df FROM c GROUP BY term),
w AS (SELECT k, term, n / l * (ln((1 + total) / (1 + df)) + 1) AS w FROM c JOIN d USING (term) JOIN l USING (k), t), u AS (SELECT k, term, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS weight FROM w)
SELECT k AS run_id, term, round(weight, 6) AS weight, row_number() OVER (PARTITION BY k ORDER BY round(weight, 9) DESC, term) AS rank FROM u QUALIFY rank <= 10""")
def top_terms_by_share(s, d):
    """The heaviest terms of a document by count over length, times the inverse frequency."""
    docs = runs.run_documents(fx.turns(s, d))
    counts = lexical.word_counts(docs, "run_id", "document")
    shares = counts.withColumn("n", F.col("n") / F.sum("n").over(Window.partitionBy("run_id")))
    return lexical.top_terms(lexical.tfidf(shares, docs.count(), "run_id", least_df=1, sublinear=False), "run_id", 10)


GRAMS = f"""{TURNS}, x AS (SELECT run_id AS k, string_agg(content, chr(10) ORDER BY turn_index) AS x FROM turns GROUP BY run_id), t AS (SELECT count(*) AS total FROM x), f AS (SELECT k, {TERMS} AS f FROM x),
c AS (SELECT k, term, count(*) AS n FROM (SELECT k, unnest(list_concat(f, list_transform(range(1, len(f)), lambda i: f[i] || ' ' || f[i + 1]))) AS term FROM f) GROUP BY ALL), {TFIDF}"""


def _gram_weights(s, d):
    docs = runs.run_documents(fx.turns(s, d))
    return lexical.tfidf(lexical.word_counts(docs, "run_id", "document", longest=2), docs.count(), "run_id")


@query(f"WITH {GRAMS} SELECT k AS run_id, term, round(weight, 6) AS weight FROM u")
def tfidf_word_bigrams(s, d):
    return _gram_weights(s, d)


@query(f"WITH {GRAMS} SELECT count(DISTINCT k) AS n_rows, count(DISTINCT term) AS n_columns, count(*) AS nnz, round(count(*) / (count(DISTINCT k) * count(DISTINCT term)), 6) AS density FROM u")
def matrix_stats(s, d):
    return lexical.matrix_stats(_gram_weights(s, d), "run_id")


@query("""WITH s AS (SELECT doc_id, coalesce(len(regexp_extract_all(array_to_string(regexp_extract_all(text, '(\\([^()]*\\)|\\[[^\\[\\]]*\\])'), ' '), '[A-Za-z][A-Za-z'']+')) / nullif(len(regexp_extract_all(text, '[A-Za-z][A-Za-z'']+')), 0), 0) AS share FROM documents WHERE text IS NOT NULL)
SELECT doc_id, round(share, 6) AS share FROM s""")
def bracket_shares(s, d):
    docs = fx.table(s, d, "documents").where("text is not null")
    return docs.select("doc_id", words.bracket_share(F.col("text")).alias("share"))


@query(f"WITH {TURNS} SELECT run_id, turn_index, md5(coalesce(lag(content) OVER (PARTITION BY run_id ORDER BY turn_index) || chr(10), '') || content) AS pair_md5 FROM turns")
def reply_pairs(s, d):
    return profiles.replies(fx.turns(s, d)).select("run_id", "turn_index", F.md5("pair").alias("pair_md5"))


# vectors


COS = f"WITH {DIMS}, c AS (SELECT cluster, dim, avg(x) AS x FROM l GROUP BY ALL), g AS (SELECT l.run_id, l.turn_index, l.vec_id, c.cluster, sum(l.x * c.x) / sqrt(sum(l.x * l.x) * sum(c.x * c.x)) AS s FROM l JOIN c USING (dim) GROUP BY ALL)"


@query(f"{COS} SELECT run_id, turn_index, cluster AS nearest, round(s, 6) AS cosine FROM g QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cluster) = 1")
def trajectory(s, d):
    rows = fx.vectors(s, d)
    return profiles.most_similar_cluster(rows.drop("cluster"), vectors.centroids(rows, "cluster", "vector"), ["run_id", "turn_index"], "vector")


STEPS = f"WITH {DIMS}, p AS (SELECT run_id, turn_index, x, lag(x) OVER (PARTITION BY run_id, dim ORDER BY turn_index) AS y FROM l), s AS (SELECT run_id, turn_index, 1 - sum(x * y) / sqrt(sum(x * x) * sum(y * y)) AS step FROM p WHERE y IS NOT NULL GROUP BY ALL)"


@query(f"{STEPS} SELECT run_id, turn_index, round(step, 6) AS step FROM s")
def cosine_steps(s, d):
    return profiles.cosine_steps(fx.vectors(s, d), "run_id", "turn_index", "vector")


@query(f"{STEPS} SELECT round(quantile_cont(step, 0.25), 6) AS q1, round(quantile_cont(step, 0.5), 6) AS q2, round(quantile_cont(step, 0.75), 6) AS q3 FROM s")
def step_quarters(s, d):
    return profiles.quarter_bounds(profiles.cosine_steps(fx.vectors(s, d), "run_id", "turn_index", "vector"), "step")


@query(f"WITH {VECTORS}, p AS (SELECT run_id, turn_index, vector[1]::DOUBLE - 0.25 AS x, 2 * (vector[2]::DOUBLE - 0.5) AS y FROM vectors), q AS (SELECT *, lag(x) OVER w AS from_x, lag(y) OVER w AS from_y FROM p WINDOW w AS (PARTITION BY run_id ORDER BY turn_index)) SELECT run_id, turn_index, round(x, 6) AS x, round(y, 6) AS y, round(from_x, 6) AS from_x, round(from_y, 6) AS from_y FROM q WHERE from_x IS NOT NULL")
def path_segments(s, d):
    n = 64
    mean, axes = [0.25, 0.5] + [0.0] * (n - 2), [[1.0] + [0.0] * (n - 1), [0.0, 2.0] + [0.0] * (n - 2)]
    return profiles.path_segments(fx.vectors(s, d), "run_id", "turn_index", "vector", mean, axes)


@query()
def pc_rank_tests(s, d):
    """Per seed and over all, whether variants differ on the first two principal components of the whole table."""
    placed = vectors.pca_2d(fx.vectors(s, d).select("vec_id", "vector"), "vector").drop("vector")
    rows = fx.vectors(s, d).select("vec_id", "seed", "variant").join(placed, "vec_id")
    axes = [c for c in placed.columns if c != "vec_id"][:2]
    long = rows.select("seed", "variant", F.explode(F.array(*[F.struct(F.lit(c).alias("pc"), F.col(c).cast("double").alias("value")) for c in axes])).alias("p")).select("seed", "variant", "p.*")
    tested = scores.rank_test(long.unionByName(long.withColumn("seed", F.lit("pooled"))), ["seed", "pc"], "value", jb())
    enough = (F.col("n_pos") >= 2) & (F.col("n_neg") >= 2)
    p = F.when(enough, F.col("p"))
    return tested.select("seed", "pc", "n_pos", "n_neg", p.alias("p"), numeric.stars(p, 2 * 7).alias("stars"), F.coalesce(p * 14 < 0.05, F.lit(False)).alias("significant"))


@query()
def probe_targets(s, d):
    """Out-of-fold scores of several targets: the agent, the first turn against the others, the variant."""
    rows, parts = fx.vectors(s, d), []
    for name, target in (("agent", F.col("turn_index") % 2 == 0), ("first_turn", F.col("turn_index") == 0), ("variant", jb())):
        folds = sampling.group_folds(rows.withColumn("y", target.cast("double")), "run_id", 3)
        found = probes.fold_scores(probes.out_of_fold(folds.select("vec_id", "fold", "y", "vector"), "vector", "y"), "y")
        parts.append(found.withColumn("target", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query()
def probe_turn_thirds(s, d):
    """Recall of each third of a run's ten turns, by softmax probes that did not see the run's fold."""
    rows = fx.vectors(s, d).withColumn("third", F.floor(F.col("turn_index") * 3 / 10).cast("double"))
    folds = sampling.group_folds(rows, "run_id", 3).select("vec_id", "fold", "third", "vector")
    parts = [probes.softmax_predict(folds.where(F.col("fold") != i), folds.where(F.col("fold") == i), "vector", "third") for i in range(3)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return scores.recalls(every.select("third", "predicted"), "third", "predicted")
