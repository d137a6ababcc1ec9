"""The special reasoners behind the answer contract, each over all queries at once.

Only the deontic one proves; all others give evidence, so their answers are at best
heuristic whatever their confidence.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.terms import Rule, Triple
from ..sources.triples import SPO, TRIPLE
from . import abduction, bayes, deontic, induction
from .analogy import AnalogyConfig, analogical_answers
from .contract import Guarantee, Reasoner, ReasonerRouter, evidence, goal_value

UNSURE = Guarantee(False, False, True)


def facts_of(queries: DataFrame) -> DataFrame:
    """(query_id, subject, predicate, object) of all contexts."""
    return queries.select("query_id", F.explode("context").alias("_t")).select("query_id", "_t.*")


class DeonticReasoner(Reasoner):
    """Goal (action, compliant_with, artifact): proven if every obligation of the action from the artifact that applies in the context is met; else abstains."""

    name, guarantee, envelope = "deontic", Guarantee(True, False), (deontic.COMPLIANT_WITH,)

    def __init__(self, obligations: DataFrame):
        self.obligations = obligations

    def verdicts(self, queries: DataFrame) -> DataFrame:
        sets = deontic.context_sets(facts_of(queries).withColumnRenamed("query_id", "entity"))
        goals = queries.select(F.col("query_id").alias("entity"), F.col("subject").alias("action"), F.col("object").alias("artifact"))
        own = goals.join(self.obligations, ["action", "artifact"]).select("entity", "action", "modality", "condition", "artifact")
        active = sets.where("kind = 'active'").select("entity", F.col("item").alias("condition")).distinct()
        return deontic.judge(own.where("condition IS NULL").unionByName(own.join(active, ["entity", "condition"], "left_semi").select(own.columns)), sets)

    def answer_all(self, queries: DataFrame) -> DataFrame:
        """Each goal is judged where its context is; the obligations of an action and artifact come as one list."""
        goals = queries.where(F.col("predicate") == deontic.COMPLIANT_WITH)
        owed = deontic.owed(self.obligations).withColumnsRenamed({"action": "subject", "artifact": "object", "owed": "_owed"})
        held = F.array_sort(F.array_distinct(F.filter(F.coalesce("context", F.expr(f"cast(array() as array<{TRIPLE}>)")), lambda t: t["object"] == "true")))
        says = lambda kind, item: F.exists("leaves", lambda t: (t["predicate"] == kind) & (t["subject"] == item))
        judged = goals.join(F.broadcast(owed), ["subject", "object"]).withColumn("leaves", held).withColumns({"_present": says("proposed", F.col("subject")), "_documented": says("documented", F.col("subject"))})
        applied = judged.withColumn("_owed", F.filter("_owed", lambda o: o["condition"].isNull() | says("active", o["condition"]))).where(F.size("_owed") > 0)
        rules = F.array_sort(F.array_distinct(F.transform("_owed", lambda o: deontic.rule_of(o["modality"], F.col("_present"), F.col("_documented")))))
        found = applied.withColumn("why", rules).where(F.forall("why", lambda r: deontic.verdict_of(r) == "Compliant"))
        cites = F.array_sort(F.flatten(F.array(F.array(F.concat(F.lit("artifact:"), "object"), F.concat(F.lit("action:"), "subject")), F.transform("why", lambda r: F.concat(F.lit("rule:"), r)))))
        return found.select("query_id", goal_value().alias("value"), F.lit("derivation").alias("trace"), F.lit(True).alias("complete"), F.lit(1).alias("depth"), F.lit(None).cast("double").alias("confidence"), "why", cites.alias("provenance"), "leaves")


class BayesianReasoner(Reasoner):
    """Names the most probable hypothesis of one model as the subject of each goal, with its posterior as confidence; abstains without hypotheses."""

    name, guarantee = "bayesian", UNSURE

    def __init__(self, priors: DataFrame, observed: Sequence[str], likelihood: DataFrame, envelope: Sequence[str] | None = None):
        self.priors, self.observed, self.likelihood, self.envelope = priors, list(observed), likelihood, envelope

    def posterior(self) -> DataFrame:
        spark = self.priors.sparkSession
        steps = spark.createDataFrame([("model", k, e) for k, e in enumerate(self.observed)], "case string, step long, evidence string")
        return bayes.posterior(self.priors.select(F.lit("model").alias("case"), "h", "w"), steps, self.likelihood)

    def answer_all(self, queries: DataFrame) -> DataFrame:
        post = self.posterior()
        shown = lambda c: F.format_string("%.4f", c)
        ranked = F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("q"), "h")))
        one = post.groupBy("case").agg(ranked.alias("_r")).join(bayes.entropy_bits(post), "case").select("_r", "entropy")
        told = queries.crossJoin(F.broadcast(one))  # the model is one row
        best = F.get("_r", F.lit(0))
        why = F.array(
            F.concat(F.lit("MAP="), best["h"], F.lit(" p="), shown(-best["q"])), F.concat(F.lit("posterior: "), F.array_join(F.transform("_r", lambda x: F.concat(x["h"], F.lit("="), shown(-x["q"]))), ", ")),
            F.lit("evidence: " + ",".join(self.observed)), F.concat(F.lit("entropy_bits="), shown(F.col("entropy"))), F.lit("probabilistic: a calibrated confidence, not a proof"),
        )
        cites = F.array(*map(F.lit, self.observed)) if self.observed else F.expr("cast(array() as array<string>)")
        return evidence(told, -best["q"], why, cites, F.struct(best["h"].alias("subject"), "predicate", "object"))


class InductiveReasoner(Reasoner):
    """The strongest induced rule whose head is the goal and whose body the subject has in the context."""

    name, guarantee = "inductive", UNSURE

    def __init__(self, rules: DataFrame):
        self.rules = rules
        self.envelope = tuple(sorted(r["head_p"] for r in rules.select("head_p").distinct().collect()))

    @classmethod
    def of_instances(cls, facts: DataFrame, **limits) -> InductiveReasoner:
        return cls(induction.induce(facts, **limits))

    def answer_all(self, queries: DataFrame) -> DataFrame:
        found = induction.strongest_rule(self.rules, queries.select("query_id", *SPO), facts_of(queries))
        rule = F.concat(F.col("body_p"), F.lit("="), F.col("body_o"), F.lit("->"), F.col("predicate"), F.lit("="), F.col("object"))
        return evidence(found, F.col("confidence"), F.array(F.concat(F.lit("induced: "), rule, F.lit(" (support "), F.col("support").cast("string"), F.lit(")"))), F.array(F.concat(F.lit("induced-rule:"), rule)))


class CaseBasedReasoner(Reasoner):
    """The goal as the solution of the nearest case, with the similarity as confidence."""

    name, guarantee = "case-based", UNSURE

    def __init__(self, problems: DataFrame, solutions: DataFrame, min_similarity: float = 0.5):
        self.problems, self.solutions, self.least = problems, solutions, min_similarity
        self.envelope = tuple(sorted(r["predicate"] for r in solutions.select("predicate").distinct().collect()))

    def answer_all(self, queries: DataFrame) -> DataFrame:
        found = induction.case_based_answers(queries.select("query_id", *SPO), facts_of(queries), self.problems, self.solutions, self.least)
        return evidence(found, F.col("similarity"), F.array(F.concat(F.lit("nearest case: "), F.col("case"))), F.array(F.concat(F.lit("case:"), F.col("case"))))


class AnalogicalReasoner(Reasoner):
    """The goal carried over from the case that maps best onto the context."""

    name, guarantee = "analogical", UNSURE

    def __init__(self, cases: DataFrame, config: AnalogyConfig = AnalogyConfig()):
        self.cases, self.config = cases, config
        self.envelope = tuple(sorted(r["predicate"] for r in cases.select("predicate").distinct().collect()))

    def answer_all(self, queries: DataFrame) -> DataFrame:
        found = analogical_answers(queries, self.cases, self.config)
        return evidence(found, F.col("similarity"), F.array(F.concat(F.lit("mapped "), F.col("case"), F.lit(": "), F.col("mapping"))), F.array(F.concat(F.lit("case:"), F.col("case"))))


def hypotheses_for(queries: DataFrame, rules: Sequence[Rule], max_depth: int = 2) -> DataFrame:
    """The candidate explanations of all goals, a row each, found where the goals are; hyp_id begins with the goal's query_id."""
    names = [c.split()[0] for c in abduction.HYPOTHESIS.split(", ") if "<" not in c or c.startswith(("atoms", "chain"))]

    def run(frames):
        for f in frames:
            rows = []
            for q in f.itertuples(index=False):
                o = Triple(q.subject, q.predicate, q.object)
                for j, h in enumerate(abduction.candidates(rules, o, max_depth)):
                    g = h.ground()
                    atoms = None if g is None else [dict(zip(SPO, t, strict=True)) for t in g]
                    rows.append((f"{q.query_id}/{j:06d}", *o, atoms, len(h.atoms), ";".join("|".join(map(str, a)) for a in h.atoms), list(h.chain), h.substrate))
            yield pd.DataFrame(rows, columns=names)

    return queries.select("query_id", *SPO).mapInPandas(run, abduction.HYPOTHESIS)


class Abducer(Reasoner):
    """The best surviving explanation of each goal: its value is the goal, its reasons are what has to be assumed."""

    name, guarantee = "abductive", UNSURE

    def __init__(self, rules: Sequence[Rule], base: DataFrame, max_depth: int = 2, priors: DataFrame | None = None, bayesian: bool = False):
        self.rules, self.base, self.max_depth, self.priors, self.bayesian = list(rules), base, max_depth, priors, bayesian
        heads = [h.predicate for r in rules for h in r.rhs]
        self.envelope = None if any(p.is_var for p in heads) else tuple(sorted({p.name for p in heads}))

    def ranked(self, queries: DataFrame) -> DataFrame:
        goals = queries.select("query_id", *SPO).dropDuplicates(list(SPO))
        tested = abduction.test_all(hypotheses_for(goals, self.rules, self.max_depth), self.rules, self.base)
        return abduction.rank(tested.where("outcome = 'Survived'"), self.base, self.priors, bayesian=self.bayesian)

    def answer_all(self, queries: DataFrame) -> DataFrame:
        best = self.ranked(queries).where("place = 1").select(*SPO, "atom_text", "chain", "posterior", "prior")
        found = queries.select("query_id", *SPO).join(best, list(SPO))
        why = F.array(F.concat(F.lit("assume "), F.col("atom_text")), F.concat(F.lit("by "), F.array_join("chain", ">")))
        return evidence(found, F.coalesce("posterior", "prior"), why, F.transform("chain", lambda r: F.concat(F.lit("rule:"), r)))


def register_wave3(router: ReasonerRouter, inductive: InductiveReasoner, analogical: AnalogicalReasoner, case_based: CaseBasedReasoner) -> ReasonerRouter:
    """``router`` with the three reasoners by induction, analogy and cases, in this order."""
    for r in (inductive, analogical, case_based):
        router.push(r)
    return router
