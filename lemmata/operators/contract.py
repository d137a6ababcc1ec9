"""The answer contract: reasoners, provability, pipelines, the reasoner router and its audit.

An answer is a row.  Its provability is computed from its trace in one place, the column
``provability()``, and is nowhere an input: a complete derivation is Proven, any other
trace is Heuristic, and no value is Abstained.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.compiler import CTX
from ..plans.fixpoint import Saturation, saturate, saturate_contexts
from ..plans.terms import Rule
from ..sources.tables import materialize
from ..sources.triples import SPO, TRIPLE
from .causal import CausalGraph
from .provenance import measures

QUERY = f"query_id string, subject string, predicate string, object string, context array<{TRIPLE}>"
ANSWER = f"query_id string, value {TRIPLE}, trace string, complete boolean, depth int, confidence double, why array<string>, provenance array<string>, leaves array<{TRIPLE}>"
CAUSALLY_AFFECTS, COUNTERFACTUALLY_AFFECTS = "causally_affects", "counterfactually_affects"


def provability() -> Column:
    """Of rows with value, trace and complete: the only place where it is decided."""
    return F.when(F.col("value").isNull() | (F.col("trace") == "none"), "Abstained").when((F.col("trace") == "derivation") & F.col("complete"), "Proven").otherwise("Heuristic")


def provability_min(column: str = "provability") -> Column:
    """Aggregate: the weakest of a group, Abstained for an empty one."""
    rank = F.when(F.col(column) == "Proven", 2).when(F.col(column) == "Heuristic", 1).otherwise(0)
    return F.element_at(F.array(F.lit("Abstained"), F.lit("Heuristic"), F.lit("Proven")), F.coalesce(F.min(rank), F.lit(0)) + 1)


@dataclass(frozen=True)
class Guarantee:
    sound: bool
    complete: bool
    probabilistic: bool = False


class Reasoner(ABC):
    """Answers all queries at once; queries without a row in the result are abstained from."""

    name: str = "reasoner"
    substrate: str = "Symbolic"
    guarantee = Guarantee(False, False)
    #: Goal predicates this reasoner takes; None: any; empty: none.
    envelope: Sequence[str] | None = None

    @abstractmethod
    def answer_all(self, queries: DataFrame) -> DataFrame:
        """ANSWER rows of QUERY rows."""

    def covers(self, goal_predicate: Column) -> Column:
        return F.lit(True) if self.envelope is None else goal_predicate.isin(*self.envelope) if self.envelope else F.lit(False)


def goal_value() -> Column:
    return F.struct(*SPO)


def evidence(rows: DataFrame, confidence: Column, why: Column, provenance: Column, value: Column | None = None) -> DataFrame:
    return rows.select(
        "query_id", (goal_value() if value is None else value).alias("value"), F.lit("evidence").alias("trace"), F.lit(False).alias("complete"), F.lit(0).alias("depth"), confidence.cast("double").alias("confidence"), why.alias("why"), provenance.alias("provenance"),
        F.expr(f"cast(array() as array<{TRIPLE}>)").alias("leaves"),
    )


class DeductiveReasoner(Reasoner):
    """Saturates its facts once, and what each distinct context adds to them, and proves the goals found there.

    An answer's trace is the whole proof: the rules from its leaves to the goal, its depth, its axioms as provenance and leaves.
    """

    name, guarantee = "deductive", Guarantee(True, True)

    def __init__(self, rules: Sequence[Rule], facts: DataFrame, envelope: Sequence[str] | None = None):
        self.rules, self.facts, self.envelope = rules, facts, envelope

    @cached_property
    def base(self) -> Saturation:
        return saturate(self.rules, self.facts.select(*SPO))

    def answer_all(self, queries: DataFrame) -> DataFrame:
        key = F.sha2(F.to_json(F.array_sort(F.array_distinct("context"))), 256)
        asked = materialize(queries.withColumn(CTX, F.when(F.size("context") > 0, key).otherwise("")), "asked")
        seeds = asked.groupBy(CTX).agg(F.first("context").alias("context")).select(CTX, F.explode("context").alias("t")).select(CTX, "t.*")
        sat = saturate_contexts(self.base, self.rules, seeds)
        proofs = measures(sat, asked, ("depth", "complete", "trace_rule_ids", "leaves", "axioms"))
        found = asked.select("query_id", CTX, *SPO).join(proofs, [CTX, *SPO])
        cites = F.transform("axioms", lambda t: F.concat(F.lit("axiom:("), F.concat_ws(" ", t["subject"], t["predicate"], t["object"]), F.lit(")")))
        why = F.when(F.size("trace_rule_ids") > 0, F.col("trace_rule_ids")).otherwise(F.array(F.lit("axiom")))
        return found.select("query_id", goal_value().alias("value"), F.lit("derivation").alias("trace"), "complete", "depth", F.lit(None).cast("double").alias("confidence"), why.alias("why"), cites.alias("provenance"), "leaves")


class CausalReasoner(Reasoner):
    """Goal (x, causally_affects, y): proven by the edges of a shortest path if the pair is identifiable."""

    name, guarantee, envelope = "causal", Guarantee(True, False), (CAUSALLY_AFFECTS,)

    def __init__(self, graph: CausalGraph):
        self.graph = graph

    def answer_all(self, queries: DataFrame) -> DataFrame:
        goals = queries.where(F.col("predicate") == CAUSALLY_AFFECTS)
        pairs = materialize(goals.select(F.col("subject").alias("x"), F.col("object").alias("y")).distinct(), "pairs")
        paths = self.graph.path_edges(self.graph.shortest_paths(pairs).where(F.size("path") > 1))
        ok = self.graph.identify(pairs).where("identifiable").select("x", "y", "criterion")
        found = goals.join(ok.join(paths, ["x", "y"]), (F.col("subject") == F.col("x")) & (F.col("object") == F.col("y")))
        rule = F.concat(F.lit("do-calculus:"), F.when(F.col("criterion") == "Backdoor", "backdoor").otherwise("direct-effect"))
        cites = F.transform("hops", lambda t: F.concat_ws(" ", F.lit("edge:"), t["subject"], t["predicate"], t["object"]))
        return found.select("query_id", goal_value().alias("value"), F.lit("derivation").alias("trace"), F.lit(True).alias("complete"), F.lit(1).alias("depth"), F.lit(None).cast("double").alias("confidence"), F.array(rule).alias("why"), cites.alias("provenance"), F.col("hops").alias("leaves"))


class CounterfactualReasoner(Reasoner):
    """Goal (x, counterfactually_affects, y): evidence with the confidence that the graph allows."""

    name, guarantee, envelope = "counterfactual", Guarantee(False, False, True), (COUNTERFACTUALLY_AFFECTS,)

    def __init__(self, graph: CausalGraph):
        self.graph = graph

    def answer_all(self, queries: DataFrame) -> DataFrame:
        goals = queries.where(F.col("predicate") == COUNTERFACTUALLY_AFFECTS)
        pairs = materialize(goals.select(F.col("subject").alias("x"), F.col("object").alias("y")).distinct(), "pairs")
        told = self.graph.counterfactual(pairs).where("status IN ('persists', 'absent')")
        found = goals.join(told, (F.col("subject") == F.col("x")) & (F.col("object") == F.col("y")))
        return evidence(found, F.col("confidence"), F.array(F.concat(F.lit("counterfactual: "), F.col("status"))), F.array(F.lit("counterfactual")))


class TableReasoner(Reasoner):
    """Wraps any function of the queries that gives ANSWER rows, e.g. one of the inductive, analogical, case-based, Bayesian or deontic operators."""

    def __init__(self, name: str, answer, envelope: Sequence[str] | None = None, substrate: str = "Symbolic", guarantee: Guarantee = Guarantee(False, False, True)):
        self.name, self._answer, self.envelope, self.substrate, self.guarantee = name, answer, envelope, substrate, guarantee

    def answer_all(self, queries: DataFrame) -> DataFrame:
        return self._answer(queries)


class Pipeline(Reasoner):
    """Stages on the same goals; what a stage answers joins the context of those behind it.

    The last stage decides; any evidence makes the whole evidence with the smallest confidence; else the proofs of earlier
    stages stand in for the leaves of the last that they prove, which adds to its depth.
    """

    def __init__(self, name: str, stages: Sequence[Reasoner]):
        self.name, self.stages = name, list(stages)
        kinds = {s.substrate for s in stages}
        self.substrate = kinds.pop() if len(kinds) == 1 else "Mixed"
        self.guarantee = Guarantee(all(s.guarantee.sound for s in stages), all(s.guarantee.complete for s in stages), any(s.guarantee.probabilistic for s in stages))
        self.envelope = stages[0].envelope if stages else ()

    def answer_all(self, queries: DataFrame) -> DataFrame:
        spark = queries.sparkSession
        if not self.stages:
            return spark.createDataFrame([], ANSWER)
        now, parts = queries, []
        for i, stage in enumerate(self.stages):
            own = materialize(stage.answer_all(now).where("value IS NOT NULL").select([c.split()[0] for c in ("query_id", "value", "trace", "complete", "depth", "confidence", "why", "provenance", "leaves")]), "stage")
            parts.append(own.withColumns({"stage": F.lit(i), "substrate": F.lit(stage.substrate)}))
            now = now.join(own.select("query_id", "value"), "query_id", "left").withColumn("context", F.when(F.col("value").isNotNull(), F.concat("context", F.array("value"))).otherwise(F.col("context"))).drop("value")
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        last = len(self.stages) - 1
        final = parts[last].select("query_id", *(F.col(c).alias(f"f_{c}") for c in ("value", "trace", "complete", "depth", "confidence", "why", "leaves")))
        told = F.when(F.col("trace") == "evidence", F.concat(F.lit("evidence (confidence "), F.col("confidence").cast("string"), F.lit(") — "), F.array_join("why", "; "))).otherwise(F.concat(F.lit("derivation (depth "), F.col("depth").cast("string"), F.lit(", "), F.when(F.col("complete"), "complete").otherwise("incomplete"), F.lit(")")))
        note = F.concat(F.lit("stage "), F.col("stage").cast("string"), F.lit(" ("), F.col("substrate"), F.lit("): "), told)
        by = every.groupBy("query_id").agg(
            F.bool_or(F.col("trace") == "evidence").alias("_any"), F.least(F.lit(1.0), F.min("confidence")).alias("_least"), F.transform(F.array_sort(F.collect_list(F.struct("stage", note.alias("n")))), lambda x: x["n"]).alias("_notes"),
            F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("stage", "provenance"))), lambda x: x["provenance"]))).alias("_cites"),
            F.array_sort(F.collect_list(F.when((F.col("stage") < last) & (F.col("trace") == "derivation"), F.struct("stage", "value", "depth", "complete", "leaves")))).alias("_earlier"),
        )
        joined = final.join(by, "query_id")
        # The first earlier proof of a leaf takes its place.
        graft = F.transform("f_leaves", lambda leaf: F.struct(leaf.alias("leaf"), F.get(F.filter("_earlier", lambda e: e["value"] == leaf), F.lit(0)).alias("by")))
        grafted = joined.withColumn("_g", graft)
        deeper = F.coalesce(F.array_max(F.transform("_g", lambda g: F.coalesce(g["by"]["depth"], F.lit(0)))), F.lit(0))
        leaves = F.flatten(F.transform("_g", lambda g: F.coalesce(g["by"]["leaves"], F.array(g["leaf"]))))
        whole = F.col("f_complete") & F.forall("_g", lambda g: F.coalesce(g["by"]["complete"], F.lit(True)))
        heads = F.array(F.lit(f"pipeline '{self.name}'"))
        return grafted.select(
            "query_id", F.col("f_value").alias("value"), F.when(F.col("_any"), "evidence").otherwise(F.col("f_trace")).alias("trace"), F.when(F.col("_any"), F.lit(False)).otherwise(whole).alias("complete"),
            F.when(F.col("_any"), F.lit(0)).otherwise(F.col("f_depth") + deeper).cast("int").alias("depth"), F.when(F.col("_any"), F.col("_least")).alias("confidence"), F.when(F.col("_any"), F.concat(heads, "_notes")).otherwise(F.col("f_why")).alias("why"),
            F.col("_cites").alias("provenance"), F.when(F.col("_any"), F.expr(f"cast(array() as array<{TRIPLE}>)")).otherwise(leaves).alias("leaves"),
        )


class ReasonerRouter:
    """Asks every reasoner that covers a goal and picks an answer: the first proof by order of registration, else the most confident evidence."""

    def __init__(self, reasoners: Sequence[Reasoner] = ()):
        self.reasoners = list(reasoners)

    def push(self, reasoner: Reasoner) -> ReasonerRouter:
        self.reasoners.append(reasoner)
        return self

    def __len__(self) -> int:
        return len(self.reasoners)

    def route(self, queries: DataFrame) -> DataFrame:
        """A row per query: answer columns, provability, class (Symbolic, Neural, CoVote or Abstained), reasoner, agreeing, consulted, reason."""
        parts = []
        consulted = F.lit(0)
        for i, r in enumerate(self.reasoners):
            covered = r.covers(F.col("predicate"))
            consulted = consulted + F.when(covered, 1).otherwise(0)
            own = r.answer_all(queries.where(covered)).where("value IS NOT NULL")
            parts.append(own.withColumns({"idx": F.lit(i), "reasoner": F.lit(r.name), "substrate": F.lit(r.substrate), "provability": provability()}))
        goals = queries.select("query_id", "predicate", consulted.cast("long").alias("consulted"))
        none = F.when(F.col("consulted") == 0, F.concat(F.lit("no reasoner covers predicate '"), F.col("predicate"), F.lit(f"' ({len(self.reasoners)} registered)"))).otherwise(F.concat(F.lit("all "), F.col("consulted").cast("string"), F.lit(" covering reasoners abstained")))
        if not parts:
            return goals.select("query_id", "consulted", F.lit("Abstained").alias("class"), none.alias("reason"))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        every = materialize(every, "routed")
        best = Window.partitionBy("query_id").orderBy(F.when(F.col("provability") == "Proven", 0).otherwise(1), F.when(F.col("provability") == "Proven", None).otherwise(F.when(F.col("trace") == "evidence", F.col("confidence"))).desc_nulls_last(), "idx")
        winner = every.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
        other = every.select("query_id", F.col("value").alias("_v"), F.col("idx").alias("_i"), F.col("substrate").alias("_s"))
        votes = winner.select("query_id", "value", "idx", "substrate").join(other, "query_id").where(F.col("value") == F.col("_v")).groupBy("query_id").agg(F.count("*").alias("agreeing"), F.bool_or((F.col("_i") != F.col("idx")) & (F.col("_s") != F.col("substrate"))).alias("_cross"))
        out = goals.join(winner, "query_id", "left").join(votes, "query_id", "left")
        kind = F.when(F.col("value").isNull(), "Abstained").when(F.col("_cross"), "CoVote").when(F.col("provability") == "Proven", "Symbolic").otherwise("Neural")
        return out.select("query_id", "value", "trace", "complete", "depth", "confidence", "why", "provenance", F.coalesce("provability", F.lit("Abstained")).alias("provability"), kind.alias("class"), "reasoner", F.coalesce("agreeing", F.lit(0)).alias("agreeing"), "consulted", F.when(F.col("value").isNull(), none).alias("reason"))


def audit(routed: DataFrame, expected: DataFrame) -> DataFrame:
    """One row of counts over routed queries and expected (query_id, provable): what should be proven and is, is missed, or is proven falsely."""
    j = expected.join(routed, "query_id", "left")
    proven = F.col("provability") == "Proven"
    counts = j.agg(
        F.count_if(F.col("provable") & proven).alias("proven_expected"), F.count_if(F.col("provable") & ~F.coalesce(proven, F.lit(False))).alias("missed"), F.count_if(~F.col("provable") & proven).alias("false_proofs"),
        F.count_if(~F.col("provable") & (F.col("provability") == "Heuristic")).alias("correctly_unproven"), F.count_if((F.col("provability") == "Abstained") & F.col("reason").isNull()).alias("silent_drops"),
    )
    return counts.withColumn("rate", F.coalesce(F.expr("try_divide(proven_expected, proven_expected + missed)"), F.lit(1.0)))
