"""Facts from tables: every source is a DataFrame of (subject, predicate, object) strings."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import table

SPO = ("subject", "predicate", "object")
TRIPLE_SCHEMA = T.StructType([T.StructField(c, T.StringType(), False) for c in SPO])
TRIPLE = "struct<subject:string,predicate:string,object:string>"


def of_rows(spark: SparkSession, rows: Iterable[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], TRIPLE_SCHEMA)


def of_columns(df: DataFrame, subject: Column, predicate: str | Column, obj: Column) -> DataFrame:
    p = F.lit(predicate) if isinstance(predicate, str) else predicate
    return df.select(subject.cast("string").alias("subject"), p.alias("predicate"), obj.cast("string").alias("object")).where("subject IS NOT NULL AND object IS NOT NULL")


def tag(kind: str, column: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def union(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """located_in: customer and supplier in nation, nation in region."""
    return union(
        [
            of_columns(table(spark, sf_dir, "customer"), tag("customer", "c_custkey"), "located_in", tag("nation", "c_nationkey")),
            of_columns(table(spark, sf_dir, "supplier"), tag("supplier", "s_suppkey"), "located_in", tag("nation", "s_nationkey")),
            of_columns(table(spark, sf_dir, "nation"), tag("nation", "n_nationkey"), "located_in", tag("region", "n_regionkey")),
        ]
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """replies_to: each turn of a conversation answers the one before."""
    c = table(spark, sf_dir, "conversations").where("turn > 0")
    name = lambda turn: F.concat_ws(":", F.lit("turn"), F.col("conv_id"), turn)
    return of_columns(c, name(F.col("turn")), "replies_to", name(F.col("turn") - 1))


def part_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """is_a: part in its size band; subclass_of: a chain of classes over the bands."""
    p = table(spark, sf_dir, "part")
    seeds = of_columns(p, tag("part", "p_partkey"), "is_a", F.concat(F.lit("class:"), (F.col("p_size") % 5).cast("string")))
    chain = of_rows(spark, [(f"class:{k}", "subclass_of", f"class:{k + 1}") for k in range(9)])
    return union([seeds, chain])


def causal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations (source, target, predicate, deleted) from region down to customers and suppliers, with deleted and non-causal rows among them."""
    rel = lambda df, s, t, p, d: df.select(s.alias("source"), t.alias("target"), F.lit(p).alias("predicate"), d.alias("deleted"))
    no = F.lit(False)
    nation, customer, supplier = (table(spark, sf_dir, n) for n in ("nation", "customer", "supplier"))
    return union(
        [
            rel(nation, tag("region", "n_regionkey"), tag("nation", "n_nationkey"), "causes", no),
            rel(customer, tag("nation", "c_nationkey"), tag("customer", "c_custkey"), "spawns", F.col("c_custkey") % 10 == 0),
            rel(supplier, tag("nation", "s_nationkey"), tag("supplier", "s_suppkey"), "depends_on", no),
            rel(supplier, tag("supplier", "s_suppkey"), tag("nation", "s_nationkey"), "located_in", no),
        ]
    )
