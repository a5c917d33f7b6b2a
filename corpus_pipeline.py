"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import bpe, mixing, pii, quality, similar
from colloquy.llm.common import read_table, write_table
from colloquy.llm.queries import SOURCE_WEIGHTS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules and the rules learned from the labels both keep, all columns as they are.

    A null or empty text has no words and goes; repeated rows stay or go alike; no documents give none.
    """
    rules = quality.fit_rules(docs, read_table(spark, sf_dir, "labels"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    return quality.judge_documents(packed, rules).where("kept").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a Jaccard similarity of 0.8 or more in shingles of five words: that of smallest
    doc_id, nulls last; of rows that share it, one. Wordless texts are one group; no documents give none."""
    return similar.one_of_each(docs, shingle=5, similarity=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets replaced by their kind; n_chars follows the text, and is null where the text is."""
    clean = pii.redact(docs, pii.fit_field())
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: every file is a stretch of the schedule. Null texts are empty, null sources
    share the rest's weight, repeated rows stay."""
    return mixing.mixed_order(docs, SOURCE_WEIGHTS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and the digest of the text they decode to, in the order of its file. A null text has
    no tokens."""
    coded = bpe.encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"), decoded="decoded")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("personal data", personal_data), ("source mix", source_mix), ("tokens", tokens)]

#: Learned rules and fields, fingerprints and tokenizers are beyond SQL: brute-force versions test them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
