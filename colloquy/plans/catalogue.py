"""Registered queries, one or more an operator, and DuckDB SQL for those that SQL can express.

``QUERIES`` has callables of (spark, folder); ``ORACLE`` has SQL with the same columns. Doubles are rounded to 6 places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import text as words
from colloquy.operators import groups, lexical, ordered, probes, runs, sampling, scores, vectors
from colloquy.plans import fixtures as fx
from colloquy.sources.scratch import new_path
from colloquy.streaming import repeats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TURNS = """turns AS (SELECT conv_id AS run_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_index,
 CASE WHEN role = 'user' THEN 'A' ELSE 'B' END AS agent, text AS content FROM conversations WHERE role <> 'system')"""
CELL = """CASE WHEN {0} % 2 = 0 THEN 'vanilla' ELSE 'jailbroken' END AS variant, 'seed' || ({0} % 7) AS seed,
 CASE WHEN {0} % 10 = 9 THEN 'interrupted' WHEN {0} % 5 = 3 THEN 'degenerate_repetition' ELSE 'completed' END AS stop_reason"""
RUNS = f"runs AS (SELECT run_id, {CELL.format('run_id')}, count(*) AS completed_turns FROM turns GROUP BY run_id)"
VECTORS = f"vectors AS (SELECT vec_id, vec_id // 10 AS run_id, vec_id % 10 AS turn_index, label::BIGINT AS cluster, embedding AS vector, {CELL.format('(vec_id // 10)')} FROM embeddings)"
LABELLED = "labelled AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality::BIGINT AS quality, l.toxic::BIGINT AS toxic FROM documents d JOIN labels l USING (doc_id))"
SCORED = f"scored AS (SELECT doc_id // 10 AS run_id, doc_id AS turn_index, (doc_id * 37 % 101) / 100.0::DOUBLE AS p_unsafe, {CELL.format('(doc_id // 10)')} FROM documents)"
STOPS = "[" + ", ".join(f"'{w}'" for w in words.STOP_WORDS) + "]"
TOKENS = f"list_filter(list_transform(regexp_extract_all({{0}}, '[A-Za-z][A-Za-z'']+'), lambda w: lower(w)), lambda w: NOT list_contains({STOPS}, w))"
TERMS = f"list_filter(regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({STOPS}, w))"
HASH = "(({0} + {1}) * 2654435761) % 4294967296"
U = "sqrt(list_sum(list_transform(vector, lambda x: x::DOUBLE * x::DOUBLE)))"


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as long, doubles rounded."""
    to = {"int": lambda c: F.col(c).cast("long"), "tinyint": lambda c: F.col(c).cast("long"), "double": lambda c: F.round(c, 6)}
    return df.select(*[to.get(t, F.col)(c).alias(c) for c, t in df.dtypes])


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, folder: tidy(f(spark, folder))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


CELL_STATS = f"""WITH {TURNS}, {RUNS}, m AS (SELECT run_id, count(DISTINCT content) / count(*) AS u, avg(length(content)) AS c FROM turns GROUP BY run_id)
SELECT variant, seed, count(*) AS n_runs, count(*) FILTER (stop_reason = 'completed') AS n_completed, count(*) FILTER (stop_reason = 'degenerate_repetition') AS n_degenerate,
 count(*) FILTER (stop_reason = 'interrupted') AS n_aborted, round(coalesce(median(completed_turns) FILTER (stop_reason <> 'interrupted'), 0), 6) AS median_turns,
 round(coalesce(avg(u) FILTER (stop_reason <> 'interrupted'), 0), 6) AS mean_unique, round(coalesce(avg(c) FILTER (stop_reason <> 'interrupted'), 0), 6) AS mean_chars
FROM runs JOIN m USING (run_id) GROUP BY variant, seed"""


@query(CELL_STATS)
def cell_stats(s, d):
    return runs.cell_stats(fx.runs(s, d), runs.run_metrics(fx.turns(s, d)))


@query(f"WITH {TURNS} SELECT run_id, count(*) AS n_turns, round(avg(length(content)), 6) AS mean_chars, round(count(DISTINCT content) / count(*), 6) AS unique_ratio FROM turns GROUP BY run_id")
def run_metrics(s, d):
    return runs.run_metrics(fx.turns(s, d))


@query()
def run_metrics_gzip(s, d):
    return runs.run_metrics(fx.turns(s, d), gzip=True)


@query(f"WITH {TURNS}, {RUNS} SELECT CASE WHEN seed IN ('seed5', 'seed6') THEN 'legacy' WHEN stop_reason = 'interrupted' THEN 'aborted' ELSE 'kept' END AS outcome, count(*) AS n FROM runs GROUP BY 1")
def reject_accounting(s, d):
    return runs.reject_accounting(fx.runs(s, d), s.range(5).select(F.concat(F.lit("seed"), F.col("id").cast("string")).alias("seed")))


@query(f"WITH {TURNS} SELECT run_id, string_agg(content, chr(10) ORDER BY turn_index) AS document FROM turns GROUP BY run_id")
def run_documents(s, d):
    return runs.run_documents(fx.turns(s, d))


FEATURES = ["completed_turns", "is_early_stop", "is_degenerate", "total_chars", "mean_chars", "median_chars", "std_chars", "max_chars", "min_chars"]
LENGTHS = f"""{TURNS}, {RUNS}, features AS (SELECT run_id, variant, completed_turns::DOUBLE AS completed_turns, (completed_turns < 50)::INT::DOUBLE AS is_early_stop,
 (stop_reason = 'degenerate_repetition')::INT::DOUBLE AS is_degenerate, sum(length(content))::DOUBLE AS total_chars, avg(length(content)) AS mean_chars, median(length(content)) AS median_chars,
 stddev_pop(length(content)) AS std_chars, max(length(content))::DOUBLE AS max_chars, min(length(content))::DOUBLE AS min_chars
 FROM runs JOIN turns USING (run_id) WHERE stop_reason <> 'interrupted' GROUP BY run_id, variant, completed_turns, stop_reason)"""
LONG = "long AS (UNPIVOT features ON " + ", ".join(FEATURES) + " INTO NAME feature VALUE value)"


@query(f"WITH {LENGTHS} SELECT run_id, variant, " + ", ".join(f"round({c}, 6) AS {c}" for c in FEATURES) + " FROM features")
def length_features(s, d):
    return runs.length_features(fx.turns(s, d), fx.runs(s, d))


def _long(s, d):
    return runs.long_features(runs.length_features(fx.turns(s, d), fx.runs(s, d)), FEATURES, ["run_id", "variant"])


@query(f"""WITH {LENGTHS}, {LONG}, t AS (SELECT feature, variant = 'jailbroken' AS p, count(*) AS n, avg(value) AS m, median(value) AS md, var_samp(value) AS v FROM long GROUP BY ALL)
SELECT a.feature, round(a.m, 6) AS mean_pos, round(b.m, 6) AS mean_neg, round(a.md, 6) AS median_pos, round(b.md, 6) AS median_neg,
 round((a.m - b.m) / nullif(sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 0), 6) AS cohens_d FROM t a JOIN t b ON a.feature = b.feature AND a.p AND NOT b.p""")
def cohens_d_by_variant(s, d):
    return runs.describe_by_class(_long(s, d), F.col("variant") == "jailbroken")


@query(f"""WITH {LENGTHS}, {LONG}, v AS (SELECT feature, value, count(*) FILTER (variant = 'jailbroken') AS pos, count(*) FILTER (variant <> 'jailbroken') AS neg FROM long GROUP BY ALL),
c AS (SELECT feature, (value + lead(value) OVER w) / 2 AS threshold, sum(pos) OVER w AS p, sum(neg) OVER w AS n, sum(pos) OVER (PARTITION BY feature) AS ap, sum(neg) OVER (PARTITION BY feature) AS an FROM v WINDOW w AS (PARTITION BY feature ORDER BY value)),
b AS (SELECT feature, threshold, (ap - p + n) / (ap + an) AS accuracy, 'above' AS side FROM c WHERE threshold IS NOT NULL UNION ALL SELECT feature, threshold, 1 - (ap - p + n) / (ap + an), 'below' FROM c WHERE threshold IS NOT NULL)
SELECT feature, round(threshold, 6) AS threshold, round(accuracy, 6) AS accuracy, side FROM b QUALIFY row_number() OVER (PARTITION BY feature ORDER BY round(accuracy, 9) DESC, threshold, side) = 1""")
def best_threshold(s, d):
    return scores.best_threshold(_long(s, d), ["feature"], "value", F.col("variant") == "jailbroken")


def _marker_sql(name: str) -> str:
    # RE2's word edge knows ASCII only, so single words are compared with whole words of any script
    parts = []
    for t in words.MARKERS[name]:
        q = t.replace("'", "''")
        if t.isascii() and t.isalpha():
            parts.append(f"len(list_filter(regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w = '{q}'))")
        else:
            parts.append(f"(length(x) - length(replace(x, '{q}', ''))) // length('{q}')")
    return f"({' + '.join(parts)})::BIGINT AS {name}"


# terms of several words are searched as they are written here; the texts hold none in another case
@query(f"WITH {TURNS}, t AS (SELECT run_id, string_agg(content, chr(10) ORDER BY turn_index) AS x FROM turns GROUP BY run_id) SELECT run_id, {', '.join(map(_marker_sql, words.MARKERS))} FROM t")
def marker_counts(s, d):
    return lexical.marker_counts(runs.run_documents(fx.turns(s, d)), "run_id", "document")


@query(f"WITH {TURNS}, {RUNS}, t AS (SELECT run_id, string_agg(content, chr(10) ORDER BY turn_index) AS x FROM turns GROUP BY run_id), m AS (SELECT run_id, {', '.join(map(_marker_sql, words.MARKERS))} FROM t), l AS (UNPIVOT m ON {', '.join(words.MARKERS)} INTO NAME marker VALUE n) SELECT variant, seed, marker, round(avg(n), 6) AS mean_count, round(avg((n > 0)::INT), 6) AS share_any FROM l JOIN runs USING (run_id) GROUP BY ALL")
def marker_cells(s, d):
    return lexical.marker_cells(lexical.marker_counts(runs.run_documents(fx.turns(s, d)), "run_id", "document"), fx.runs(s, d))


@query(f"WITH {TURNS}, {RUNS}, w AS (SELECT run_id, unnest({TOKENS.format('content')}) AS token FROM turns) SELECT variant, token, count(*) AS n FROM w JOIN runs USING (run_id) GROUP BY ALL")
def token_counts(s, d):
    return lexical.token_counts(fx.turns(s, d).join(fx.runs(s, d).select("run_id", "variant"), "run_id"), ["variant"], "content")


@query(f"WITH {TURNS}, t AS (SELECT {TOKENS.format('content')} AS w FROM turns), g AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) AS token FROM t) SELECT token, count(*) AS n FROM g GROUP BY token")
def bigram_counts(s, d):
    return fx.turns(s, d).select(F.explode(words.bigrams(words.tokens(F.col("content")))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


ODDS = f"""WITH {LABELLED}, w AS (SELECT toxic, unnest({TOKENS.format('text')}) AS token FROM labelled), c AS (SELECT token, count(*) FILTER (toxic = 1) AS a, count(*) FILTER (toxic = 0) AS b FROM w GROUP BY token),
t AS (SELECT sum(a) AS na, sum(b) AS nb FROM c), z AS (SELECT token, (ln((2 * a + b) / (2 * na + nb - 2 * a - b)) - ln((a + 2 * b) / (na + 2 * nb - a - 2 * b))) / sqrt(1 / (2 * a + b) + 1 / (a + 2 * b)) AS z, a AS n_a, b AS n_b FROM c, t WHERE a + b >= 5)"""


def _odds(s, d):
    rows = fx.labelled(s, d).select("toxic", F.explode(words.tokens(F.col("text"))).alias("token"))
    return lexical.log_odds(rows.groupBy("token").agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("n_a"), F.count(F.when(F.col("toxic") == 0, 1)).alias("n_b")))


@query(f"{ODDS} SELECT token, round(z, 6) AS z, n_a, n_b FROM z")
def log_odds(s, d):
    return _odds(s, d)


@query(f"{ODDS}, r AS (SELECT token, round(z, 6) AS z, n_a, n_b FROM z) (SELECT *, 'top' AS side FROM r ORDER BY z DESC, token LIMIT 20) UNION ALL (SELECT *, 'bottom' FROM r ORDER BY z, token LIMIT 20)")
def log_odds_top_bottom(s, d):
    return lexical.top_and_bottom(_odds(s, d).withColumn("z", F.round("z", 6)), "z", "token", 20)


TFIDF = """d AS (SELECT term, count(*) AS df FROM c GROUP BY term HAVING count(*) >= 2), w AS (SELECT k, term, (1 + ln(n)) * (ln((1 + total) / (1 + df)) + 1) AS w FROM c JOIN d USING (term), t),
u AS (SELECT k, term, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS weight FROM w)"""
WORD_TFIDF = f"""WITH {TURNS}, x AS (SELECT run_id AS k, string_agg(content, chr(10) ORDER BY turn_index) AS x FROM turns GROUP BY run_id), t AS (SELECT count(*) AS total FROM x),
c AS (SELECT k, term, count(*) AS n FROM (SELECT k, unnest({TERMS}) AS term FROM x) GROUP BY ALL), {TFIDF}"""


def _word_weights(s, d):
    docs = runs.run_documents(fx.turns(s, d))
    return lexical.tfidf(lexical.word_counts(docs, "run_id", "document"), docs.count(), "run_id")


@query(f"{WORD_TFIDF} SELECT k AS run_id, term, round(weight, 6) AS weight FROM u")
def tfidf_word_weights(s, d):
    return _word_weights(s, d)


@query(f"{WORD_TFIDF} SELECT k AS run_id, term, round(weight, 6) AS weight, row_number() OVER (PARTITION BY k ORDER BY round(weight, 9) DESC, term) AS rank FROM u QUALIFY rank <= 10")
def top_tokens_per_doc(s, d):
    return lexical.top_terms(_word_weights(s, d), "run_id", 10)


@query(f"""WITH {TURNS}, x AS (SELECT run_id AS k, regexp_replace(string_agg(content, chr(10) ORDER BY turn_index), '\\s\\s+', ' ', 'g') AS x FROM turns GROUP BY run_id), t AS (SELECT count(*) AS total FROM x),
c AS (SELECT k, term, count(*) AS n FROM (SELECT k, unnest(list_concat(list_transform(range(1, length(x) + 1), lambda i: substr(x, i, 1)), list_transform(range(1, length(x)), lambda i: substr(x, i, 2)))) AS term FROM x) GROUP BY ALL), {TFIDF}
SELECT k AS run_id, term, round(weight, 6) AS weight FROM u""")
def tfidf_char_weights(s, d):
    docs = runs.run_documents(fx.turns(s, d))
    return lexical.tfidf(lexical.char_counts(docs, "run_id", "document", 2), docs.count(), "run_id")


EVENTS = "e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, last_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM events)"


@query(f"WITH {EVENTS}, m AS (SELECT user_id, coalesce(max(pos) FILTER (event_type <> l), 0) AS m FROM e GROUP BY user_id) SELECT user_id, event_id FROM e JOIN m USING (user_id) WHERE pos <= m + 1")
def trailing_collapse(s, d):
    return ordered.trailing_collapse(fx.table(s, d, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id")


@query("""WITH e AS (SELECT user_id, event_type, lag(event_type) OVER w AS a, lag(event_type, 2) OVER w AS b, row_number() OVER w AS pos FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, min(pos) AS stop_at FROM e WHERE event_type = a AND a = b GROUP BY user_id""")
def degenerate_flags(s, d):
    return ordered.repetition_stops(fx.table(s, d, "events"), "user_id", ["ts", "event_id"], "event_type", 3)


@query(f"""WITH {TURNS}, w AS (SELECT *, row_number() OVER p AS pos, last_value(content) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM turns WHERE regexp_matches(content, '[A-Za-z][A-Za-z'']+') WINDOW p AS (PARTITION BY run_id ORDER BY turn_index)),
k AS (SELECT *, coalesce(max(pos) FILTER (content <> l) OVER (PARTITION BY run_id), 0) + 1 AS m FROM w), b AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY turn_index DESC) AS back FROM k WHERE pos <= m),
x AS (SELECT run_id, right(string_agg(content, chr(10) ORDER BY turn_index), 4000) AS t FROM b WHERE back <= 5 GROUP BY run_id) SELECT run_id, coalesce(t, '') AS terminal FROM (SELECT DISTINCT run_id FROM turns) LEFT JOIN x USING (run_id)""")
def terminal_state(s, d):
    return ordered.terminal_state(fx.turns(s, d))


@query(f"WITH {TURNS} SELECT run_id, turn_index, md5(string_agg(CASE agent WHEN 'A' THEN 'user' ELSE 'assistant' END || ':' || content, chr(10)) OVER (PARTITION BY run_id ORDER BY turn_index)) AS prefix_md5 FROM turns")
def conversation_prefix(s, d):
    said = F.array_join(F.transform("messages", lambda m: F.concat(m.role, F.lit(":"), m.content)), "\n")
    return ordered.prefixes(fx.turns(s, d)).select("run_id", "turn_index", F.md5(said).alias("prefix_md5"))


@query(f"WITH {TURNS}, {RUNS} SELECT run_id, turn_index, agent, variant, seed, stop_reason, right(content, 3000) AS text FROM turns JOIN runs USING (run_id) WHERE regexp_matches(content, '[A-Za-z][A-Za-z'']+')")
def message_rows(s, d):
    return ordered.message_rows(fx.turns(s, d), fx.runs(s, d))


@query(f"WITH {TURNS}, n AS (SELECT run_id, count(*) AS n FROM turns GROUP BY run_id) SELECT t.run_id, turn_index, agent, content FROM turns t JOIN n USING (run_id) WHERE turn_index >= 1 AND turn_index < greatest(n - 1, 0)")
def turn_slice(s, d):
    return runs.turn_slice(fx.turns(s, d), 1, -1)


@query(f"WITH {VECTORS}, {TURNS} SELECT vec_id, content AS text FROM vectors LEFT JOIN turns USING (run_id, turn_index)")
def text_alignment(s, d):
    return fx.vectors(s, d).join(fx.turns(s, d), ["run_id", "turn_index"], "left").select("vec_id", F.col("content").alias("text"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def unvetted(s, d):
    return fx.table(s, d, "documents").join(fx.table(s, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def in_scope(s, d):
    return fx.table(s, d, "documents").join(fx.table(s, d, "labels").where("toxic = 1"), "doc_id", "left_semi").select("doc_id")


@query("SELECT v AS variant, 'seed' || x AS seed, i::BIGINT AS run_idx FROM (VALUES ('jailbroken'), ('vanilla')) a(v), range(7) b(x), range(4) c(i)")
def grid(s, d):
    cells = fx.runs(s, d)
    return runs.grid(cells.select("variant").distinct(), cells.select("seed").distinct(), 4)


@query(f"WITH {TURNS}, r AS (SELECT DISTINCT run_id FROM turns), p AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS idx, text FROM benchmark), n AS (SELECT count(*) AS n FROM p) SELECT run_id, text AS prompt FROM r, n JOIN p ON run_id % n = idx")
def seed_prompt_assignment(s, d):
    pool = sampling.in_order(fx.table(s, d, "benchmark"), "item_id", "idx").select("idx", F.col("text").alias("prompt"))
    return runs.pool_prompt(fx.runs(s, d).select("run_id", F.col("run_id").alias("run_idx")), pool).select("run_id", "prompt")


@query(f"WITH {TURNS}, {RUNS} SELECT run_id, CASE seed WHEN 'seed0' THEN 'control' WHEN 'seed1' THEN 'benign' WHEN 'seed2' THEN 'benign' ELSE 'other' END AS category FROM runs")
def seed_category(s, d):
    kinds = s.createDataFrame([("seed0", "control"), ("seed1", "benign"), ("seed2", "benign")], "seed string, category string")
    return fx.runs(s, d).join(F.broadcast(kinds), "seed", "left").select("run_id", F.coalesce("category", F.lit("other")).alias("category"))


@query(f"WITH {TURNS} SELECT run_id, turn_index, CASE WHEN turn_index < 2 THEN '0-1' WHEN turn_index < 5 THEN '2-4' WHEN turn_index < 51 THEN '5-50' END AS bucket, turn_index // 5 AS fives, dense_rank() OVER (PARTITION BY run_id ORDER BY turn_index) - 1 AS class_id FROM turns")
def turn_buckets(s, d):
    from pyspark.sql import Window

    at = F.col("turn_index")
    return fx.turns(s, d).select("run_id", at, words.bucket_label(at, [0, 2, 5, 51]).alias("bucket"), F.expr("turn_index div 5").alias("fives"), (F.dense_rank().over(Window.partitionBy("run_id").orderBy("turn_index")) - 1).alias("class_id"))


RANKS = f"""WITH {LABELLED}, r AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS r FROM labelled WHERE n_chars IS NOT NULL),
g AS (SELECT lang, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS n, sum(r) FILTER (quality = 1) AS s FROM r GROUP BY lang)"""


@query(f"{RANKS} SELECT lang, p AS n_pos, n AS n_neg, round((s - p * (p + 1) / 2) / nullif(p * n, 0), 6) AS auc FROM g")
def auc_by_group(s, d):
    return scores.auc(fx.labelled(s, d), ["lang"], "n_chars", F.col("quality") == 1)


@query()
def mann_whitney_by_group(s, d):
    return scores.rank_test(fx.labelled(s, d), ["lang"], "n_chars", F.col("quality") == 1)


PREDICTED = f"WITH {LABELLED}, p AS (SELECT *, (n_chars > 600)::BIGINT AS guess FROM labelled)"


def _guessed(s, d):
    return fx.labelled(s, d).withColumn("guess", (F.col("n_chars") > 600).cast("long"))


@query(f"{PREDICTED} SELECT quality, guess, count(*) AS n FROM p GROUP BY ALL")
def confusion(s, d):
    return scores.confusion(_guessed(s, d), "quality", "guess")


@query(f"{PREDICTED} SELECT round(avg((quality = guess)::INT), 6) AS accuracy, round(avg(abs(quality - guess)), 6) AS mean_abs_error, count(*) AS n, round(greatest(avg(quality), 1 - avg(quality)), 6) AS majority FROM p")
def confusion_metrics(s, d):
    return scores.confusion_metrics(_guessed(s, d), "quality", "guess")


@query(f"{PREDICTED} SELECT quality, count(*) AS n, round(avg((quality = guess)::INT), 6) AS recall FROM p GROUP BY quality")
def recalls(s, d):
    return scores.recalls(_guessed(s, d), "quality", "guess")


@query(f"{PREDICTED}, t AS (SELECT lang, (count(*) FILTER (quality = 1 AND guess = 1))::DOUBLE AS tp, (count(*) FILTER (quality = 0 AND guess = 1))::DOUBLE AS fp, (count(*) FILTER (quality = 1 AND guess = 0))::DOUBLE AS fn, (count(*) FILTER (quality = 0 AND guess = 0))::DOUBLE AS tn FROM p GROUP BY lang) SELECT lang, round((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) AS mcc FROM t")
def mcc(s, d):
    return scores.mcc(_guessed(s, d), ["lang"], F.col("quality") == 1, F.col("guess") == 1)


@query(f"WITH {VECTORS} SELECT cluster, count(*) AS n, round(avg(turn_index), 6) AS turn_mean, round(median(turn_index), 6) AS turn_median, round(stddev_pop(turn_index), 6) AS turn_std, round(avg((variant = 'vanilla')::INT), 6) AS variant_share, round(avg((turn_index % 2 = 0)::INT), 6) AS agent_share, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM vectors GROUP BY cluster")
def cluster_summary(s, d):
    return groups.cluster_summary(fx.vectors(s, d), "cluster", "turn_index", F.col("variant") == "vanilla", F.col("turn_index") % 2 == 0)


@query(f"WITH {VECTORS} SELECT cluster, seed, count(*) AS n, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, seed) AS rank FROM vectors GROUP BY cluster, seed QUALIFY rank <= 3")
def top3_per_cluster(s, d):
    return groups.top_values(fx.vectors(s, d), "cluster", "seed", 3)


ENRICH = f"""WITH {VECTORS}, c AS (SELECT seed, cluster, count(*)::DOUBLE AS n, (count(*) FILTER (variant = 'jailbroken'))::DOUBLE AS k FROM vectors GROUP BY ALL),
m AS (SELECT cluster, sum(n) AS n, sum(k) AS k FROM c GROUP BY cluster), t AS (SELECT sum(n) AS t, sum(k) AS m FROM m)"""


@query(f"{ENRICH} SELECT cluster, n::BIGINT AS n, k::BIGINT AS k, t::BIGINT AS total, m::BIGINT AS marked, round(k / n, 6) AS frac, round(k / n / (m / t), 6) AS enrichment, round((k - n * m / t) / sqrt(n * m * (t - m) * (t - n) / (t * t * (t - 1))), 6) AS z FROM m, t WHERE n >= 30")
def purity_enrichment(s, d):
    return groups.enrichment(fx.vectors(s, d), "cluster", F.col("variant") == "jailbroken", 30)


@query()
def purity_pvalues(s, d):
    return groups.enrichment_p(groups.enrichment(fx.vectors(s, d), "cluster", F.col("variant") == "jailbroken", 30))


@query(f"{ENRICH} SELECT round(max(k / n), 6) AS max_purity FROM m WHERE n >= 30")
def max_purity(s, d):
    return groups.max_purity(fx.vectors(s, d), "cluster", F.col("variant") == "jailbroken", 30)


@query(f"{ENRICH} SELECT cluster, round(k / n / (m / t), 6) AS enrichment FROM m, t WHERE n >= 30 ORDER BY round(k / n / (m / t), 9) DESC, cluster LIMIT 1")
def purity_winner(s, d):
    found = groups.enrichment(fx.vectors(s, d), "cluster", F.col("variant") == "jailbroken", 30).withColumn("space", F.lit("all"))
    return groups.winners(found, "space", "cluster").select("cluster", "enrichment")


INFORMATION = """j AS (SELECT a, b, count(*) AS n FROM r GROUP BY a, b), p AS (SELECT n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY a) / sum(n) OVER () AS pa, sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS pb FROM j),
i AS (SELECT sum(p * ln(p / (pa * pb))) AS mi, sum(-p * ln(pa)) AS h_a, sum(-p * ln(pb)) AS h_b FROM p)
SELECT round(mi, 6) AS mi, round(h_a, 6) AS h_a, round(h_b, 6) AS h_b, round(CASE WHEN h_b > 1e-12 THEN mi / h_b ELSE 0 END, 6) AS mi_over_h_b, round(coalesce(mi / nullif((h_a + h_b) / 2, 0), 1), 6) AS nmi FROM i"""


@query(f"WITH {LABELLED}, r AS (SELECT lang AS a, toxic AS b FROM labelled), {INFORMATION}")
def normalized_mi(s, d):
    return groups.mutual_information(fx.labelled(s, d), "lang", "toxic")


@query(f"WITH {VECTORS}, r AS (SELECT cluster AS a, seed AS b FROM vectors), {INFORMATION}")
def nmi_agreement(s, d):
    return groups.mutual_information(fx.vectors(s, d), "cluster", "seed")


@query(f"WITH {VECTORS} SELECT cluster, seed, count(*) AS n, round((count(*) / sum(count(*)) OVER (PARTITION BY cluster)) / (sum(count(*)) OVER (PARTITION BY seed) / sum(count(*)) OVER ()), 6) AS over_representation FROM vectors GROUP BY cluster, seed")
def crosstab_shares(s, d):
    return groups.crosstab_shares(fx.vectors(s, d), "cluster", "seed")


@query(f"WITH {VECTORS}, n AS (SELECT seed, cluster, count(*) AS n FROM vectors GROUP BY ALL) SELECT seed, round(max(n) / sum(n), 6) AS purity FROM n GROUP BY seed")
def modal_purity(s, d):
    return groups.modal_purity(fx.vectors(s, d), "seed", "cluster")


@query(f"WITH {VECTORS}, b AS (SELECT run_id, bool_and(cluster IN (0, 1, 2, 3, 4, 5, 6, 7)) AS a FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY turn_index DESC) AS k FROM vectors) WHERE k <= 3 GROUP BY run_id) SELECT round(avg(a::INT), 6) AS share, count(*) AS n_runs FROM b")
def tail_occupancy(s, d):
    return groups.tail_occupancy(fx.vectors(s, d), "run_id", "turn_index", "cluster", list(range(8)), 3)


@query(f"""WITH {VECTORS}, u AS (SELECT cluster, vec_id, unnest(list_transform(vector, lambda x: x::DOUBLE / {U})) AS x, generate_subscripts(vector, 1) AS i FROM vectors), s AS (SELECT cluster, i, sum(x) AS s FROM u GROUP BY ALL), n AS (SELECT cluster, count(DISTINCT vec_id) AS n, sum(x * x) AS own FROM u GROUP BY cluster),
c AS (SELECT cluster, sum(s * s) AS w FROM s GROUP BY cluster), a AS (SELECT sum(s * s) AS a FROM (SELECT i, sum(s) AS s FROM s GROUP BY i)), t AS (SELECT sum(w) AS w, sum(n) AS t, sum(n * n) AS q FROM c JOIN n USING (cluster))
SELECT cluster, n, round((c.w - own) / nullif(n * (n - 1), 0), 6) AS cohesion, round((a - t.w) / nullif(t.t * t.t - q, 0), 6) AS separation FROM c JOIN n USING (cluster), a, t""")
def cohesion_separation(s, d):
    return vectors.cohesion_separation(fx.vectors(s, d), "cluster", "vector")


DIMS = f"{VECTORS}, l AS (SELECT run_id, turn_index, vec_id, cluster, unnest(vector)::DOUBLE AS x, generate_subscripts(vector, 1) - 1 AS dim FROM vectors)"


@query(f"WITH {DIMS} SELECT run_id, dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(max_by(x, turn_index), 6) AS terminal FROM l GROUP BY run_id, dim")
def run_vector_agg(s, d):
    return vectors.run_vectors(fx.vectors(s, d), "run_id", "turn_index", "vector")


CENTRES = f"WITH {DIMS}, c AS (SELECT cluster, dim, avg(x) AS x FROM l GROUP BY ALL), g AS (SELECT l.vec_id, l.cluster AS own, c.cluster, sqrt(sum((l.x - c.x) * (l.x - c.x))) AS d FROM l JOIN c USING (dim) GROUP BY ALL)"


@query(f"{CENTRES} SELECT vec_id, cluster AS nearest, round(d, 6) AS d_nearest FROM g QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) = 1")
def nearest_centroid(s, d):
    rows = fx.vectors(s, d)
    return vectors.nearest(rows.select("vec_id", "vector"), vectors.centroids(rows, "cluster", "vector"), "vec_id", "vector").select("vec_id", "nearest", "d_nearest")


@query(f"""{CENTRES}, o AS (SELECT vec_id, own AS cluster, min(d) FILTER (cluster = own) AS d, abs(min(d) FILTER (cluster = own) - min(d) FILTER (cluster <> own)) AS gap FROM g GROUP BY ALL),
r AS (SELECT cluster, 'medoid' AS kind, row_number() OVER (PARTITION BY cluster ORDER BY round(d, 9), vec_id) AS rank, vec_id FROM o UNION ALL SELECT cluster, 'boundary', row_number() OVER (PARTITION BY cluster ORDER BY round(gap, 9) NULLS LAST, vec_id), vec_id FROM o) SELECT * FROM r WHERE rank <= 4""")
def medoids_boundary(s, d):
    return vectors.medoids_and_boundary(fx.vectors(s, d), "cluster", "vec_id", "vector", 4)


@query(f"WITH {DIMS}, p AS (SELECT run_id, turn_index, x - lag(x) OVER (PARTITION BY run_id, dim ORDER BY turn_index) AS x FROM l) SELECT run_id, turn_index, round(sqrt(sum(x * x)), 6) AS step FROM p WHERE x IS NOT NULL GROUP BY ALL")
def trajectory_steps(s, d):
    return ordered.steps(fx.vectors(s, d), "run_id", "turn_index", "vector")


@query(f"WITH {TURNS}, {RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY seed, variant ORDER BY {HASH.format('run_id', 0)}, run_id) AS k, count(*) OVER (PARTITION BY seed, variant) AS n FROM runs) SELECT run_id, seed, variant FROM r WHERE k <= (SELECT min(n) FROM r)")
def balanced_sample(s, d):
    return sampling.balanced_sample(fx.runs(s, d), ["seed", "variant"], "run_id").select("run_id", "seed", "variant")


@query(f"WITH {TURNS}, {RUNS} SELECT run_id, variant, (row_number() OVER (PARTITION BY variant ORDER BY {HASH.format('run_id', 1)}, run_id) - 1) % 5 AS fold FROM runs")
def stratified_folds(s, d):
    return sampling.stratified_folds(fx.runs(s, d), "variant", "run_id", 5, 1).select("run_id", "variant", "fold")


@query(f"WITH {VECTORS}, g AS (SELECT DISTINCT run_id, variant FROM vectors), f AS (SELECT run_id, (row_number() OVER (PARTITION BY variant ORDER BY {HASH.format('run_id', 0)}, run_id) - 1) % 5 AS fold FROM g) SELECT vec_id, fold FROM vectors JOIN f USING (run_id)")
def group_folds(s, d):
    return sampling.group_folds(fx.vectors(s, d), "run_id", 5, 0, "variant").select("vec_id", "fold")


@query(f"WITH {TURNS}, {RUNS} SELECT run_id, row_number() OVER (PARTITION BY variant ORDER BY {HASH.format('run_id', 0)}, run_id) <= round(count(*) OVER (PARTITION BY variant) * 0.3) AS held_out FROM runs")
def holdout_split(s, d):
    return sampling.holdout(fx.runs(s, d), "variant", "run_id").select("run_id", "held_out")


@query(f"WITH {TURNS}, {RUNS}, n AS (SELECT seed, count(*) FILTER (variant = 'jailbroken') AS pos, count(*) FILTER (variant <> 'jailbroken') AS neg FROM runs GROUP BY seed) SELECT seed, pos, neg FROM n WHERE pos >= 2 AND neg >= 2 AND (SELECT sum(pos) FROM n) > pos AND (SELECT sum(neg) FROM n) > neg")
def leave_one_seed_out(s, d):
    return sampling.leave_one_out(fx.runs(s, d).withColumn("y", (F.col("variant") == "jailbroken").cast("int")), "seed", "y")


@query(f"WITH {SCORED} SELECT run_id, count(*) AS n_turns, count(*) FILTER (p_unsafe >= 0.5) AS n_unsafe, round(max(p_unsafe), 6) AS max_p_unsafe, round(avg(p_unsafe), 6) AS mean_p_unsafe, CASE WHEN bool_or(p_unsafe >= 0.5) THEN 'unsafe' ELSE 'safe' END AS verdict FROM scored GROUP BY run_id")
def vet_run_summary(s, d):
    return scores.safety_by_run(fx.scored(s, d))


SAFETY = "count(*) AS n, round(median(p_unsafe), 6) AS median, round(quantile_cont(p_unsafe, 0.99), 6) AS p99, round(avg((p_unsafe >= 0.5)::INT), 6) AS share_flagged, count(*) FILTER (p_unsafe >= 0.5) AS n_flagged"


@query(f"WITH {SCORED} SELECT variant, {SAFETY} FROM scored GROUP BY variant")
def vet_distribution(s, d):
    return scores.safety_distribution(fx.scored(s, d), ["variant"])


@query(f"WITH {SCORED} SELECT variant, seed, {SAFETY} FROM scored GROUP BY variant, seed")
def vet_by_seed(s, d):
    return scores.safety_distribution(fx.scored(s, d), ["variant", "seed"])


@query(f"WITH {SCORED} SELECT variant, least(floor(p_unsafe * 40), 39)::BIGINT AS bin, count(*) AS n FROM scored WHERE p_unsafe BETWEEN 0 AND 1 GROUP BY ALL")
def vet_histogram(s, d):
    return scores.histogram(fx.scored(s, d), ["variant"], "p_unsafe", 0, 1, 40)


@query(f"WITH {SCORED}, r AS (SELECT run_id, round(max(p_unsafe), 6) AS max_p_unsafe FROM scored GROUP BY run_id) SELECT * FROM r ORDER BY max_p_unsafe DESC, run_id LIMIT 20")
def vet_top_runs(s, d):
    return scores.safety_by_run(fx.scored(s, d)).select("run_id", F.round("max_p_unsafe", 6).alias("max_p_unsafe")).orderBy(F.desc("max_p_unsafe"), "run_id").limit(20)


@query(f"{RANKS} SELECT max(CASE WHEN lang = 'de' THEN a END) AS de, max(CASE WHEN lang = 'en' THEN a END) AS en, max(CASE WHEN lang = 'es' THEN a END) AS es, max(CASE WHEN lang = 'fr' THEN a END) AS fr FROM (SELECT lang, round((s - p * (p + 1) / 2) / nullif(p * n, 0), 6) AS a FROM g)")
def suite_pivot(s, d):
    found = scores.auc(fx.labelled(s, d), ["lang"], "n_chars", F.col("quality") == 1)
    return found.groupBy().pivot("lang", ["de", "en", "es", "fr"]).agg(F.first("auc"))


@query()
def pca_2d(s, d):
    return vectors.pca_2d(fx.vectors(s, d).select("vec_id", "vector"), "vector").drop("vector")


@query()
def kmeans_sweep(s, d):
    return vectors.kmeans_sweep(fx.vectors(s, d).select("vec_id", "vector"), "vector", "vec_id", [2, 3, 5, 8, 10, 12, 15, 20, 30, 50])


@query()
def logreg_cv(s, d):
    rows = sampling.group_folds(fx.vectors(s, d).withColumn("y", (F.col("cluster") % 2).cast("double")), "run_id", 5)
    return probes.fold_scores(probes.out_of_fold(rows.select("vec_id", "fold", "y", "vector"), "vector", "y"), "y")


@query()
def knn_other_runs(s, d):
    return vectors.knn_other_runs(fx.vectors(s, d), "vec_id", "run_id", "vector", 5, 8)


def _streamed(s: SparkSession, d: str, build: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Runs a stream over the events to its end, into a table in the cluster's shared folder."""
    source, out = fx.table(s, d, "events"), new_path(s, "streamed")
    # a file source reads folders or patterns; this pattern takes the one table
    stream = build(s.readStream.schema(source.schema).parquet(f"{d}/event[s].parquet"))
    writer = stream.writeStream.option("checkpointLocation", new_path(s, "stream")).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(out).awaitTermination()
    else:  # each batch brings the whole result
        writer.foreachBatch(lambda whole, _: whole.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return s.read.schema(stream.schema).parquet(out)


@query(ORACLE["degenerate_flags"])
def stream_degenerate(s, d):
    return _streamed(s, d, lambda e: repeats.repetition_alerts(e, "user_id", ["ts", "event_id"], "event_type", 3), "append")


@query("SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_window_counts(s, d):
    return _streamed(s, d, lambda e: repeats.window_counts(e, "ts", "event_type"), "complete").select(F.col("window_start").cast("date").alias("day"), "event_type", "n")
