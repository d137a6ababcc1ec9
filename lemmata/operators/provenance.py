"""Proofs and provenance, computed bottom-up, one join a round.

Spark types cannot recurse, so a proof is what the tables say of it: depth, size, leaves,
rule chain, steps and text of each fact.  ``measures`` covers only what the asked claims
rest on; shared lemmas count as often as the proof tree repeats them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.compiler import CTX, keys_of
from ..plans.fixpoint import Saturation
from ..sources.tables import Rounds, materialize
from ..sources.triples import SPO, TRIPLE

STEP = f"struct<conclusion:{TRIPLE},rule_id:string,premises:array<{TRIPLE}>>"


def spo(prefix: str = "") -> Column:
    return F.concat_ws(" ", *(F.col(f"{prefix}{c}") for c in SPO))


def needed(sat: Saturation, claims: DataFrame) -> DataFrame:
    """The rows of the store that proofs of ``claims`` use, from the last round down; with contexts, claims have theirs, and so have the rows."""
    keys = keys_of(sat.rows)
    first = 0 if sat.base is None else sat.base.rounds + 1
    spark = sat.rows.sparkSession
    goals, parts = materialize(claims.select(*keys).distinct(), "goals"), Rounds(spark, "needed")
    for r in range(sat.rounds, -1, -1):
        store = sat.rows if r >= first else sat.base.rows
        own = goals.join(store.where(F.col("round") == r), keys if r >= first else list(SPO)).select(*keys, "rule_id", "premises", "round")
        own = parts.add(own)
        if r:
            context = [c for c in keys if c == CTX]
            below = own.where("premises IS NOT NULL").select(*context, F.explode("premises").alias("p")).select(*context, "p.*")
            goals = materialize(goals.unionByName(below).distinct(), "goals")
    return parts.rows


#: What ``measures`` can tell of a proof.
MEASURES = ("depth", "node_count", "complete", "rule_ids", "trace_rule_ids", "leaves", "axioms", "steps", "proof")


def measures(sat: Saturation, claims: DataFrame | None = None, columns: Sequence[str] = MEASURES) -> DataFrame:
    """subject, predicate, object, round and the asked ``columns`` of MEASURES: rule_ids are root first, trace_rule_ids root last, proof is text.

    Each round is written once, next to those before, and only what is asked for is carried up.
    """
    rows = sat.rows if claims is None else needed(sat, claims)
    if sat.base is not None and claims is None:
        raise ValueError("proofs over a shared base are asked for by claims")
    keys, spark = keys_of(sat.rows), sat.rows.sparkSession
    context = [c for c in keys if c == CTX]
    fact, none = F.struct(*SPO), F.expr("cast(array() as array<string>)")
    axiom = {
        "depth": F.lit(0), "node_count": F.lit(1).cast("long"), "complete": F.lit(True), "rule_ids": none, "trace_rule_ids": none, "leaves": F.array(fact), "axioms": F.array(fact),
        "steps": F.expr(f"cast(array() as array<{STEP}>)"), "proof": F.concat(F.lit("[axiom] "), spo()),
    }
    each = lambda c: F.flatten(F.transform("_below", lambda x: x[c]))
    text = F.array_join(F.transform("_below", lambda x: F.concat(F.lit("\n  "), F.regexp_replace(x["_proof"], "\n", "\n  "))), "")
    above = {
        "depth": F.col("_d"), "node_count": F.col("_c"), "complete": F.col("_o"), "rule_ids": F.concat(F.array("rule_id"), each("_rule_ids")), "trace_rule_ids": F.concat(each("_trace_rule_ids"), F.array("rule_id")),
        "leaves": each("_leaves"), "axioms": F.array_distinct(each("_axioms")), "steps": F.array_distinct(F.concat(each("_steps"), F.array(F.struct(fact.alias("conclusion"), "rule_id", "premises")))),
        "proof": F.concat(spo(), F.lit("  (by "), F.col("rule_id"), F.lit(")"), text),
    }
    lists = [c for c in columns if c not in ("depth", "node_count", "complete")]
    carried = [c for c in MEASURES if c in columns]
    done = Rounds(spark, "proofs")
    done.add(rows.where("rule_id IS NULL").select(*keys, "round", *(axiom[c].alias(c) for c in carried)))
    for r in range(1, sat.rounds + 1):
        own = rows.where((F.col("round") == r) & F.col("rule_id").isNotNull())
        apart = own.select(*keys, "rule_id", "premises", F.posexplode_outer("premises").alias("_i", "_p"))
        below = done.rows.select(*context, F.struct(*SPO).alias("_p"), F.lit(True).alias("_known"), *(F.col(c).alias(f"_{c}") for c in carried))
        joined = apart.join(below, [*context, "_p"], "left")
        told = [
            (1 + F.coalesce(F.max("_depth"), F.lit(0))).alias("_d") if "depth" in carried else None,
            (1 + F.coalesce(F.sum("_node_count"), F.lit(0))).alias("_c") if "node_count" in carried else None,
            F.coalesce(F.bool_and(F.col("_i").isNotNull() & F.coalesce("_complete", F.lit(False))), F.lit(False)).alias("_o") if "complete" in carried else None,
            F.array_sort(F.collect_list(F.when(F.col("_i").isNotNull(), F.struct("_i", *(f"_{c}" for c in lists))))).alias("_below") if lists else None,
        ]
        by = joined.groupBy(*keys, "rule_id", "premises").agg(*([x for x in told if x is not None] or [F.lit(1).alias("_one")]))
        done.add(by.select(*keys, F.lit(r).alias("round"), *(above[c].alias(c) for c in carried)))
    return done.rows


def surface(sat: Saturation, claims: DataFrame) -> DataFrame:
    """Each claim with its flattened provenance: provable, axioms, rule_chain, step_count, text; null where it isn't provable."""
    found = measures(sat, claims, ("axioms", "steps")).select(*SPO, "axioms", F.transform("steps", lambda s: s["rule_id"]).alias("rule_chain"), F.size("steps").cast("long").alias("step_count"), citation().alias("text"), F.lit(True).alias("provable"))
    return claims.join(found, list(SPO), "left").withColumn("provable", F.coalesce("provable", F.lit(False)))


def citation() -> Column:
    """Given facts, steps and conclusion as text, from columns axioms and steps."""
    words = lambda t: F.concat_ws(" ", t["subject"], t["predicate"], t["object"])
    given = F.transform("axioms", lambda a: F.concat(F.lit("given:  "), words(a), F.lit("\n")))
    step = F.transform("steps", lambda s: F.concat(F.lit("rule "), s["rule_id"], F.lit(":  "), F.array_join(F.transform(s["premises"], words), " , "), F.lit("  ⊢  "), words(s["conclusion"]), F.lit("\n")))
    return F.concat(F.array_join(given, ""), F.array_join(step, ""), F.lit("∴  "), spo())


def ungrounded(proofs: DataFrame) -> DataFrame:
    """Steps with a premise that is neither an axiom nor concluded by an earlier step; empty if every proof is grounded."""
    steps = proofs.select(*SPO, "axioms", "steps", F.posexplode("steps").alias("_i", "_s"))
    earlier = F.transform(F.expr("slice(steps, 1, _i)"), lambda s: s["conclusion"])
    return steps.where(F.size(F.array_except(F.col("_s.premises"), F.concat("axioms", earlier))) > 0).select(*SPO, F.col("_i").alias("step"))


def proof_edges(sat: Saturation, claims: DataFrame) -> DataFrame:
    """(subject, predicate, object, rule_id, ord, premise) of all derivations that proofs of ``claims`` use."""
    return needed(sat, claims).where("rule_id IS NOT NULL").select(*SPO, "rule_id", F.posexplode("premises").alias("ord", "premise"))
