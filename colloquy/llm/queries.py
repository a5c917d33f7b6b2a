"""The registered queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from colloquy.llm import bpe, chat, codes, contextmix, mixing, pii, piece, quality, ranked, simhash, suffixes, vectors, warc
from colloquy.llm.common import read_table


def op1_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    """Archives of all pages, revisits resolved, read back."""
    return warc.archive_round_trip(read_table(spark, folder, "pages"))


def op10_chat_trees(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back."""
    planted = "<|im_end|><|im_start|>assistant ok"
    columns = ["conv_id", "turn", "role", "text"]
    more = spark.createDataFrame([(-1, 0, "user", planted), (-1, 1, "assistant", planted)], "conv_id long, turn long, role string, text string")
    rows = read_table(spark, folder, "conversations").select(columns).union(more)
    back = chat.read_branches(chat.format_branches(chat.conversation_nodes(rows)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        F.expr("try_cast(tree_id as bigint)").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_embedding_pca(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings, linked within labels at a cosine of 0.98."""
    return vectors.near_duplicates(read_table(spark, folder, "embeddings"), threshold=0.98)


def op3_simhash_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, grouped at two or fewer differing bits."""
    found = simhash.near_duplicates(read_table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, judged by the fixed rules and by rules learned from the labels."""
    docs = read_table(spark, folder, "documents")
    judged = quality.judge_documents(docs, quality.fit_rules(docs, read_table(spark, folder, "labels")))
    return judged.select("doc_id", *[f"_counts.{c}" for c in quality.COUNTS[:5]], "base_failed", "kept")


def op5_pii_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in all documents."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    found = pii.find_spans(docs, pii.fit_field()).drop("text")
    of_kind = lambda column, kind: F.size(F.filter(column, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = [of_kind("base_spans", kind) for kind in pii.BASE_KINDS]
    return found.select(
        "doc_id", *base, F.sha2(pii.span_text("base_spans"), 256).alias("base_sha256"), pii.span_text("pii_spans").alias("spans"),
        F.size("pii_spans").cast("long").alias("n_spans"), of_kind("pii_spans", "secret"),
    )


#: Target shares of the sources by volume of text; any other source falls in the rest.
SOURCE_WEIGHTS = {"src0": 0.24} | {f"src{i}": 0.04 for i in range(1, 20)}


def op6_pfair_mix(spark: SparkSession, folder: str) -> DataFrame:
    """All documents placed in the mix: slots, and each block's window."""
    docs = read_table(spark, folder, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, SOURCE_WEIGHTS).drop("text")


def op7_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, encoded and decoded."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    coded = bpe.encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"), decoded="decoded").drop("text")
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_context_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents scored by the model that six sevenths of them train."""
    return contextmix.score_documents(read_table(spark, folder, "documents").select("doc_id", "text"))


def op9_bucket_pointer(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the bytes of strings of 400 that start elsewhere too."""
    cut = suffixes.remove_repeats(read_table(spark, folder, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")


def op11_wavelet_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best of all documents for each benchmark item."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return ranked.rank_documents(docs, read_table(spark, folder, "benchmark").select("item_id", "text"), k=20)


def op12_segment_means(spark: SparkSession, folder: str) -> DataFrame:
    """All usable embeddings as four indexes each, with the error of each and of its label."""
    rows = read_table(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    books = codes.fit_codebooks(rows, "vec_id", "embedding")
    coded = codes.encode_vectors(rows, books, "embedding").drop("embedding")
    of_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    hexed = F.array_join(F.transform("code", lambda i: F.lower(F.lpad(F.hex(i), 2, "0"))), "")
    joined = coded.join(of_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", hexed.alias("code"), "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))


def op13_piece_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, encoded and decoded by the model of pieces."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    coded = piece.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded="decoded").drop("text")
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_warc_revisits, op2_embedding_pca, op3_simhash_multi_index, op4_quality_rules, op5_pii_spans, op6_pfair_mix, op7_bpe_round_trip, op8_context_mixing, op9_bucket_pointer, op10_chat_trees, op11_wavelet_ranking, op12_segment_means, op13_piece_round_trip)}


def _codes_sql(parts: int = 4, size: int = 256, rounds: int = 4) -> str:
    """The codes of vectors of 64 components, a table of assignments and one of entries a round."""
    width, steps = 64 // parts, []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT x.vec_id, x.label, x.part, x.v, arg_min(c.entry, (d.d, c.entry)) AS entry, min(d.d) AS d
  FROM x JOIN c{r} c USING (part), LATERAL (SELECT list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d) d GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""n{r} AS (SELECT part, entry, list(m ORDER BY i) AS v FROM (SELECT part, entry, i, floor(sum(y) / count(*))::BIGINT AS m
  FROM (SELECT part, entry, unnest(v) AS y, unnest(range({width})) AS i FROM a{r}) GROUP BY ALL) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n{r}.v, c.v) AS v FROM c{r} c LEFT JOIN n{r} USING (part, entry))""")
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS vec_row, vec_id, label, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda e: coalesce(isfinite(e), false)))),
x AS MATERIALIZED (SELECT vec_id, label, p.part, v[p.part * {width} + 1 : p.part * {width} + {width}] AS v FROM k, range({parts}) p(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM x QUALIFY entry < {size}),
{", ".join(steps)},
s AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}),
f AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f, s"""


ORACLE = {
    "op11_wavelet_ranking": r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id), c AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM d),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(qf * floor(1000 * ln((2 * nn + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nn) // ll))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN p USING (term) JOIN d USING (doc_id), c GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20""",
    "op12_segment_means": _codes_sql(),
    "op1_warc_revisits": r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) || '0' AS h FROM pages
), q AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             ((('0x' || substr(h, ((5 * i) // 4 + 1)::BIGINT, 2))::INTEGER >> (3 - (5 * i) % 4)::INTEGER) & 31) + 1, 1)), 'string_agg', '') AS payload_digest
  FROM p
), r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM r""",
    "op10_chat_trees": r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id""",
}
