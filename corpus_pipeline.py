"""The corpus pipeline: documents in, a mixed and filtered corpus out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet in the shared folder and read again as the next stage's docs.  All stages but
the last return the columns of documents; the last returns the mixed corpus, with its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmata.llm import decontaminate, langid, linededup, mixing, neardup
from lemmata.llm.common import materialize, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a sufficient margin."""
    return langid.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds; n_chars follows the text."""
    return linededup.dedup_lines(docs).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.8 or more): the one of the smallest doc_id."""
    return neardup.keep_one(docs, percent=80)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.remove_leaking(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus, a row for each slot of it: shard, slot, source, block, n_words, text, and doc_ids, the documents whose words it holds."""
    return mixing.mixed_texts(docs)


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines), ("near_dedup", dedup_documents), ("decontamination", remove_benchmark), ("source_mix", mix_sources)]

#: Compression, signatures and pseudorandom permutations have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
