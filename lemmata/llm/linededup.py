"""Line deduplication across documents, with DataFrame operations only.

Lines become 128-bit hashes of their normalised keys (blanks stripped at both ends, A-Z
lower-cased).  Each partition gets one range of the hashes; a salt taken from the document
moves a hash on by so many ranges, so that a line held by a third of all documents is
spread over as many partitions as there are salts, which grow with the root of the number
of documents.  Partitions are sorted by hash, then document and position: the first
occurrence of a key within its salt is a streaming ``first_value``.  The firsts of the
salts of a key meet in a second, small window that finds the corpus-wide first.  What goes
on from there is not text but one compressed keep bitmap per document: 64-bit words in
which a set bit is a line that stays; words that keep all their lines are left out.

Rows are told apart by (doc_id, hash of the text), so a doc_id that comes more than once
is one document when it comes to owning a line, and rows that are wholly equal get equal
results.  A null doc_id sorts after all others.  A null or empty text is one empty line.
Columns other than doc_id and text are passed through untouched, whatever their names.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, spare, text_of

#: Salts of a key at least; there are an eighth of the root of the number of documents if that is more.
SALTS = 16
LAST = (1 << 63) - 1


def _identity(doc_id: str, text: str) -> tuple[Column, Column]:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("_doc"), F.xxhash64(text_of(text)).alias("_text")


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """(_doc, _text, keep map<word number, bits>) of the documents that lose a line.

    A key of at least ``min_chars`` code points that two documents hold loses all its lines except in the smallest doc_id.
    """
    spark = docs.sparkSession
    salts, parts = max(SALTS, isqrt(docs.count()) // 8), int(spark.conf.get("spark.sql.shuffle.partitions"))
    split = docs.select(*_identity(doc_id, text), F.split(text_of(text), "\n", -1).alias("_lines"))
    lines = split.select("_doc", "_text", F.posexplode("_lines").alias("_pos", "_line")).withColumn("_line", F.btrim("_line", F.lit(BLANKS))).where(F.char_length("_line") >= min_chars)
    key = ascii_lower(F.col("_line"))
    hashed = lines.select("_doc", "_text", "_pos", F.xxhash64(key).alias("_h1"), F.xxhash64(F.lit(1), key).alias("_h2"), F.pmod(F.xxhash64("_doc"), F.lit(salts)).cast("int").alias("_salt"))
    # Hashes are uniform, so equal slices of their span are ranges of equal size and need no sampling pass.
    place = F.shiftright(F.shiftrightunsigned("_h1", 32) * parts, 32)
    hashed = hashed.withColumn("_range", F.pmod(place + F.col("_salt"), F.lit(parts)).cast("int"))
    group = ("_range", "_salt", "_h1", "_h2")
    stream = Window.partitionBy(*group).orderBy("_doc", "_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranged = hashed.repartitionById(parts, "_range").withColumn("_first", F.first("_doc").over(stream))
    by_doc = ranged.groupBy(*group, "_doc", "_text", "_first").agg(F.collect_list("_pos").alias("_at"))
    # Rows behind the first of their own range are decided; they go on under a key of their own so that no task gets them all.
    behind = F.col("_doc") > F.col("_first")
    meet = Window.partitionBy("_h1", "_h2", "_own")
    decided = by_doc.withColumn("_own", F.when(behind, F.xxhash64("_doc", "_text")).otherwise(F.lit(0).cast("long"))).withColumn("_all", F.min("_doc").over(meet))
    gone = decided.where(behind | (F.col("_doc") > F.col("_all"))).select("_doc", "_text", F.explode("_at").alias("_pos"))
    bits = gone.repartition("_doc", "_text").groupBy("_doc", "_text", F.expr("_pos div 64").cast("int").alias("_word")).agg(F.expr("~bit_or(shiftleft(1L, _pos % 64))").alias("_bits"))
    return bits.groupBy("_doc", "_text").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text", lines: str = "_lines", kept: str = "_kept") -> DataFrame:
    """``docs`` with the lines before (``lines``) and those that stay (``kept``), two names that ``docs`` must not have."""
    doc_, text_, keep_ = spare(docs.withColumns({lines: F.lit(0), kept: F.lit(0)}), "_doc", "_text", "_keep")
    own, other = _identity(doc_id, text)
    marked = docs.withColumns({doc_: own, text_: other})
    named = bitmaps.select(F.col("_doc").alias(doc_), F.col("_text").alias(text_), F.col("keep").alias(keep_))
    bit = F.expr(f"filter(`{lines}`, (x, i) -> coalesce(shiftright(`{keep_}`[cast(i div 64 as int)], i % 64) & 1L, 1L) = 1L)")
    joined = marked.join(named.hint("shuffle_hash"), [doc_, text_], "left").withColumn(lines, F.split(text_of(text), "\n", -1))
    return joined.withColumn(kept, F.when(F.col(keep_).isNull(), F.col(lines)).otherwise(bit)).drop(doc_, text_, keep_)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """``docs`` with the text of each row reduced to the lines that stay; a row that loses no line keeps its text, null included."""
    lines, kept = spare(docs, "_lines", "_kept")
    out = apply_bitmaps(docs, keep_bitmaps(docs, doc_id, text, min_chars), doc_id, text, lines, kept)
    changed = F.size(kept) < F.size(lines)
    return out.withColumn(text, F.when(changed, F.array_join(kept, "\n")).otherwise(F.col(text))).select(*docs.columns)


def line_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of each row."""
    out = apply_bitmaps(docs.select(doc_id, text), keep_bitmaps(docs, doc_id, text, min_chars), doc_id, text)
    return out.select(
        doc_id, F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"), F.sha2(F.array_join("_kept", "\n"), 256).alias("kept_sha256")
    )
