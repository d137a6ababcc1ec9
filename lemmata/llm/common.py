"""Reading inputs, shared working tables and row helpers for the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words and are stripped from lines: space and 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary one on a single machine, as in tests; on a cluster it has to be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lemmata-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage ends there, and every copy of a task sees the same rows."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that may be broadcast once they are counted.
BROADCAST_ROWS = 1_000_000
#: A key is hot if it has more than this many rows, and more than one in HOT_SHARE of all.
HOT_ROWS, HOT_SHARE = 256, 100_000


def join_spread(rows: DataFrame, lookup: DataFrame, on: list[str], times: str, spread: Column) -> DataFrame:
    """``rows`` left-joined with ``lookup``, which holds each key once and in ``times`` how many rows have it.

    Keys with many rows, fewer than HOT_SHARE by their share of all, are looked up in a broadcast table, and their rows are
    dealt by ``spread``, so that no key's rows meet in one task.  ``lookup`` is read three times: pass a written table.
    """
    values = [c for c in lookup.columns if c not in (*on, times)]
    total, most = lookup.agg(F.sum(times), F.max(times)).first()
    least = max(HOT_ROWS, (total or 0) // HOT_SHARE)
    if (most or 0) <= least:
        return rows.join(lookup.drop(times), on, "left")
    hot = F.coalesce(F.col(times), F.lit(0)) > least
    hot_rows = lookup.where(hot).select(*on, F.struct(F.lit(True).alias("_hit"), *values).alias("_hot_values"))
    # Zero, but no constant: the optimiser would take a constant out of the join's keys, and the rows would be dealt by ``on`` alone.
    none = F.least(F.col(times).cast("long"), F.lit(0).cast("long"))
    cold = lookup.where(~hot).select(*on, none.alias("_deal"), F.struct(*values).alias("_cold_values"))
    # Rows with a null in a key match nothing and are dealt like those of hot keys.
    whole = reduce(Column.__and__, (F.col(c).isNotNull() for c in on))
    first = rows.join(F.broadcast(hot_rows), on, "left").withColumn("_deal", F.when(F.col("_hot_values").isNull() & whole, F.lit(0).cast("long")).otherwise(F.xxhash64(spread).bitwiseOR(F.lit(1))))
    both = first.join(cold, [*on, "_deal"], "left")
    return both.select(*rows.columns, *(F.when(F.col("_hot_values._hit"), F.col(f"_hot_values.{c}")).otherwise(F.col(f"_cold_values.{c}")).alias(c) for c in values))


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, so that helper columns never meet a column of the caller's."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(column: str | Column = "text") -> Column:
    """A text, the empty one where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def word_array(column: Column) -> Column:
    """The words of a text; none for an empty one."""
    return F.filter(F.split(column, f"{BLANK_CLASS}+"), lambda w: w != "")


def is_held_out(column: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of an id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus == remainder, F.lit(False))
