"""Abduction: reverse rules into candidate explanations, test them, rank them.

Candidates come from the (small) rule set on the driver, per observation; the test stage
runs one fixpoint for all hypotheses at once, each in a context of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.compiler import CTX
from ..plans.fixpoint import Saturation, saturate, saturate_contexts
from ..plans.terms import Pattern, Rule, Substitution, Term, Triple, match_triple
from ..sources.triples import SPO, TRIPLE
from .provenance import measures

CONTRAINDICATES = "contraindicates"


@dataclass(frozen=True)
class Hypothesis:
    atoms: tuple[Pattern, ...]
    chain: tuple[str, ...]
    substrate: str = "Symbolic"

    def ground(self) -> tuple[Triple, ...] | None:
        found = [Substitution().ground(a) for a in self.atoms]
        return None if None in found else tuple(found)


def candidates(rules: Sequence[Rule], observation: Triple, max_depth: int = 2) -> list[Hypothesis]:
    """Explanations that reverse at least one rule, at most ``max_depth`` deep; only ground sub-goals are reversed further."""

    def reductions(goal: Pattern, depth: int) -> list[tuple[tuple[Pattern, ...], tuple[str, ...]]]:
        out = [((goal,), ())]
        if depth and goal.is_ground():
            fact = Substitution().ground(goal)
            for rule in rules:
                for head in rule.rhs:
                    s = match_triple(head, fact)
                    if s is not None:
                        options = [reductions(s.apply(p), depth - 1) for p in rule.lhs]
                        for picked in product(*options):
                            out.append((tuple(a for atoms, _ in picked for a in atoms), (*(r for _, chain in picked for r in chain), rule.id)))
        return out

    found = reductions(Pattern(*map(Term.con, observation)), max_depth)
    return [Hypothesis(a, c) for a, c in dict.fromkeys(found) if c]


def proposed(observation: Triple, proposer: Callable[[Triple], Iterable[Iterable[Triple]]], proposer_id: str) -> list[Hypothesis]:
    """Candidates of a pluggable proposer, marked as neural."""
    return [Hypothesis(tuple(Pattern(*map(Term.con, t)) for t in h), (f"neural:{proposer_id}",), "Neural") for h in proposer(observation)]


HYPOTHESIS = f"hyp_id string, subject string, predicate string, object string, atoms array<{TRIPLE}>, existential int, atom_text string, chain array<string>, substrate string"


def table_of(spark: SparkSession, asked: Iterable[tuple[Triple, Sequence[Hypothesis]]]) -> DataFrame:
    """A row per hypothesis; hyp_id orders them by observation and place."""
    rows = []
    for i, (o, hypotheses) in enumerate(asked):
        for j, h in enumerate(hypotheses):
            g = h.ground()
            rows.append((f"{i:06d}-{j:06d}", *o, [tuple(t) for t in g] if g is not None else None, len(h.atoms), ";".join("|".join(map(str, a)) for a in h.atoms), list(h.chain), h.substrate))
    return spark.createDataFrame(rows, HYPOTHESIS)


def test_all(hypotheses: DataFrame, rules: Sequence[Rule], base: DataFrame) -> DataFrame:
    """``hypotheses`` with outcome (Survived, NotGround, ExplainsNothing, Contraindicated) and the negative fact of the last.

    The base is saturated once; one more fixpoint finds what the atoms of each hypothesis add, in its context.  The observation
    must be derived, not given.
    """
    ground = hypotheses.where("atoms IS NOT NULL")
    assumed = ground.select(F.col("hyp_id").alias(CTX), F.explode("atoms").alias("t")).select(CTX, "t.*")
    known = saturate(rules, base.select(*SPO))
    sat = saturate_contexts(known, rules, assumed)
    own = ground.join(sat.derivations.withColumnRenamed(CTX, "hyp_id"), ["hyp_id", *SPO], "left_semi").select("hyp_id")
    given = ground.where(F.exists("atoms", lambda t: t == F.struct(*SPO))).select("hyp_id")
    anyway = ground.join(known.derivations, list(SPO), "left_semi").select("hyp_id").join(given, "hyp_id", "left_anti")
    reached = own.union(anyway).distinct().withColumn("_reached", F.lit(True))
    touched = assumed.select(CTX, F.col("subject").alias("object")).union(assumed.select(CTX, "object")).distinct()
    against = lambda s: s.rows.where(F.col("predicate") == CONTRAINDICATES)
    negatives = touched.join(against(sat), [CTX, "object"]).select(CTX, "round", *SPO).union(touched.join(against(known), "object").select(CTX, "round", *SPO))
    fired = negatives.groupBy(F.col(CTX).alias("hyp_id")).agg(F.min(F.struct("round", *SPO)).alias("_n"))
    out = hypotheses.join(reached, "hyp_id", "left").join(fired, "hyp_id", "left")
    outcome = F.when(F.col("atoms").isNull(), "NotGround").when(F.col("_reached").isNull(), "ExplainsNothing").when(F.col("_n").isNotNull(), "Contraindicated").otherwise("Survived")
    negative = F.when(outcome == "Contraindicated", F.concat_ws(" ", "_n.subject", "_n.predicate", "_n.object"))
    return out.select(*hypotheses.columns, outcome.alias("outcome"), negative.alias("negative"))


def build_trace(tested: DataFrame, rules: Sequence[Rule], base: DataFrame) -> DataFrame:
    """The surviving hypotheses with depth, trace_rule_ids, leaves and proof of their observation under their atoms."""
    survived = tested.where("outcome = 'Survived'")
    assumed = survived.select(F.col("hyp_id").alias(CTX), F.explode("atoms").alias("t")).select(CTX, "t.*")
    sat: Saturation = saturate_contexts(saturate(rules, base.select(*SPO)), rules, assumed)
    proofs = measures(sat, survived.select(F.col("hyp_id").alias(CTX), *SPO), ("depth", "complete", "trace_rule_ids", "leaves", "proof"))
    return survived.join(proofs.drop("round").withColumnRenamed(CTX, "hyp_id"), ["hyp_id", *SPO])


def rank(survivors: DataFrame, base: DataFrame, priors: DataFrame | None = None, default_prior: float = 0.5, bayesian: bool = False) -> DataFrame:
    """``survivors`` with assumed_count, prior, tiebreak, posterior and place (1 is best) within their observation.

    priors: (subject, predicate, object, prior).  Plain ranking is by fewest assumptions, then prior; Bayesian ranking by the
    posterior of mean prior times 2 to the minus assumptions.  An existential hypothesis assumes each of its atoms.
    """
    known = base.select(*SPO).distinct().withColumn("_base", F.lit(True))
    atoms = survivors.where("atoms IS NOT NULL").select("hyp_id", F.posexplode("atoms").alias("_i", "t")).select("hyp_id", "_i", "t.*").join(known, list(SPO), "left")
    if priors is not None:
        atoms = atoms.join(priors.select(*SPO, "prior"), list(SPO), "left")
    else:
        atoms = atoms.withColumn("prior", F.lit(None).cast("double"))
    new = F.col("_base").isNull()
    scored = atoms.groupBy("hyp_id").agg(F.count_if(new).alias("_n"), F.avg(F.when(new, F.coalesce("prior", F.lit(default_prior)))).alias("_p"))
    out = survivors.join(scored, "hyp_id", "left")
    out = out.withColumns({
        "assumed_count": F.coalesce("_n", F.col("existential").cast("long")),
        "prior": F.when(F.col("_n").isNull(), F.lit(default_prior)).otherwise(F.coalesce("_p", F.lit(1.0))),
        "tiebreak": F.array_join(F.concat(F.array("atom_text"), "chain"), ";"),
    }).drop("_n", "_p")
    own = Window.partitionBy(*SPO)
    w = F.col("prior") * F.pow(F.lit(2.0), -F.col("assumed_count"))
    total = F.sum(w).over(own)
    post = F.when(total > 0, w / total).otherwise(F.lit(1.0) / F.count("*").over(own))
    if bayesian:
        out = out.withColumn("posterior", post)
        order = (F.desc("posterior"), F.asc("tiebreak"), F.asc("hyp_id"))
    else:
        out = out.withColumn("posterior", F.lit(None).cast("double"))
        order = (F.asc("assumed_count"), F.desc("prior"), F.asc("tiebreak"), F.asc("hyp_id"))
    return out.withColumn("place", F.row_number().over(own.orderBy(*order)))


def revise_belief(ranked: DataFrame, incumbents: DataFrame) -> DataFrame:
    """(subject, predicate, object, decision, challenger) per observation: Keep, Adopt or Displace.

    incumbents: (subject, predicate, object, incumbent struct or null), one row per observation.
    """
    top = ranked.where("place = 1").select(*SPO, F.get("atoms", F.lit(0)).alias("challenger"))
    j = incumbents.join(top, list(SPO), "left")
    decision = F.when(F.col("challenger").isNull() | (F.col("incumbent") == F.col("challenger")), "Keep").when(F.col("incumbent").isNull(), "Adopt").otherwise("Displace")
    return j.select(*SPO, decision.alias("decision"), F.when(decision != "Keep", F.col("challenger")).alias("challenger"))


def explain(spark: SparkSession, rules: Sequence[Rule], base: DataFrame, observations: Sequence[Triple], max_depth: int = 2, priors: DataFrame | None = None, bayesian: bool = False, **options) -> DataFrame:
    """Generate, test and rank: the full ranked list of the surviving explanations of each observation."""
    hypotheses = table_of(spark, [(o, candidates(rules, o, max_depth)) for o in observations])
    return rank(test_all(hypotheses, rules, base).where("outcome = 'Survived'"), base, priors, bayesian=bayesian, **options)
