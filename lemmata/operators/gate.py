"""The gate for claims, the router before it, and rule paths."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import Saturation
from ..plans.terms import Rule
from ..sources.triples import SPO
from .provenance import measures, spo

NO_DERIVATION = "no derivation in the executable Y-graph"


def gate(sat: Saturation, claims: DataFrame, with_proof: bool = False) -> DataFrame:
    """Each claim with verdict PROVEN or UNPROVEN, the reason of the latter and, if asked for, its proof and text."""
    known = measures(sat, claims, ("proof",)).select(*SPO, "proof", F.lit(True).alias("_known")) if with_proof else sat.rows.select(*SPO, F.lit(True).alias("_known"))
    out = claims.join(known, list(SPO), "left").withColumn("verdict", F.when(F.col("_known"), "PROVEN").otherwise("UNPROVEN")).withColumn("reason", F.when(F.col("_known").isNull(), NO_DERIVATION))
    if with_proof:
        flagged = F.concat(F.lit("UNPROVEN (flagged → neural): "), spo(), F.lit("  — "), F.col("reason"))
        out = out.withColumn("rendered", F.when(F.col("_known"), F.concat(F.lit("PROVEN: "), spo(), F.lit("\nproof:\n"), F.col("proof"))).otherwise(flagged))
    return out.drop("_known")


def summarize(gated: DataFrame) -> DataFrame:
    return gated.agg(F.count_if(F.col("verdict") == "PROVEN").alias("proven"), F.count_if(F.col("verdict") == "UNPROVEN").alias("unproven"))


def predicates_of_rules(rules: Sequence[Rule]) -> tuple[set[str], bool]:
    """(constant predicates of bodies and heads, whether a variable one accepts all)."""
    terms = [p.predicate for r in rules for p in (*r.lhs, *r.rhs)]
    return {t.name for t in terms if not t.is_var}, any(t.is_var for t in terms)


def predicates_of_facts(facts: DataFrame) -> DataFrame:
    return facts.select("predicate").distinct()


def classify(claims: DataFrame, known: DataFrame | Iterable[str], accept_all: bool = False) -> DataFrame:
    """Each claim with route Symbolic, or Neural and a reason, by whether its predicate is known."""
    if not isinstance(known, DataFrame):
        known = claims.sparkSession.createDataFrame([(p,) for p in sorted(known)], "predicate string")
    out = claims.join(known.select("predicate").distinct().withColumn("_in", F.lit(True)), "predicate", "left")
    symbolic = F.col("_in").isNotNull() | F.lit(accept_all)
    reason = F.concat(F.lit("predicate `"), F.col("predicate"), F.lit("` is not in the engine's symbolic domain"))
    return out.select(*claims.columns, F.when(symbolic, "Symbolic").otherwise("Neural").alias("route"), F.when(~symbolic, reason).alias("route_reason"))


def route_summary(routed: DataFrame) -> DataFrame:
    return routed.agg(F.count_if(F.col("route") == "Symbolic").alias("symbolic"), F.count_if(F.col("route") == "Neural").alias("neural"))


def rule_path(rule_ids: Column) -> Column:
    """Rule ids root first, joined by >; empty for an axiom."""
    return F.array_join(rule_ids, ">")
