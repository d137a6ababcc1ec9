"""Decision graphs: trees of guarded actions, applied to all entities at once.

A plan is flattened on the driver to one row of guards per action; applying it is then
one projection over the entities and an explode.  The first guard on the way down that
isn't true decides: false prunes, unknown abstains.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cql import Entity, compile_expression


@dataclass(frozen=True)
class Action:
    id: str
    title: str
    code: tuple[str, str] | None = None
    do_not_perform: bool = False

    def with_code(self, system: str, code: str) -> Action:
        return replace(self, code=(system, code))

    def prohibited(self) -> Action:
        return replace(self, do_not_perform=True)


@dataclass(frozen=True)
class PlanAction:
    condition: str | None = None
    action: Action | None = None
    sub_actions: tuple[PlanAction, ...] = ()

    @classmethod
    def always(cls) -> PlanAction:
        return cls()

    @classmethod
    def when(cls, condition: str) -> PlanAction:
        return cls(condition)

    def recommend(self, action: Action) -> PlanAction:
        return replace(self, action=action)

    def with_sub(self, sub: PlanAction) -> PlanAction:
        return replace(self, sub_actions=(*self.sub_actions, sub))


@dataclass(frozen=True)
class PlanDefinition:
    id: str
    title: str
    actions: tuple[PlanAction, ...] = ()

    def with_action(self, action: PlanAction) -> PlanDefinition:
        return replace(self, actions=(*self.actions, action))


def guard_paths(plan: PlanDefinition) -> list[tuple[Action, tuple[str, ...]]]:
    """Each action with the guards from the root down to it."""
    out = []

    def walk(node: PlanAction, above: tuple[str, ...]) -> None:
        here = (*above, node.condition) if node.condition is not None else above
        if node.action is not None:
            out.append((node.action, here))
        for sub in node.sub_actions:
            walk(sub, here)

    for a in plan.actions:
        walk(a, ())
    return out


def apply_plan(plan: PlanDefinition, entity: Entity, key: str) -> DataFrame:
    """(key, action_id, title, outcome, evidence, reason): proposed, suppressed or abstained; pruned actions have no row."""
    rows = []
    guards = {g: compile_expression(g, entity) for _, path in guard_paths(plan) for g in path}
    names = {g: f"_g{i}" for i, g in enumerate(guards)}
    for action, path in guard_paths(plan):
        state = F.lit("suppressed" if action.do_not_perform else "proposed")
        reason = F.lit(None).cast("string")
        for g in reversed(path):
            c = F.col(names[g])
            state = F.when(c, state).when(c.isNull(), "abstained")
            reason = F.when(c, reason).when(c.isNull(), F.lit(g))
        rows.append(F.struct(F.lit(action.id).alias("action_id"), F.lit(action.title).alias("title"), state.alias("outcome"), (F.array(*map(F.lit, path)) if path else F.expr("cast(array() as array<string>)")).alias("evidence"), reason.alias("reason")))
    if not rows:
        return entity.frame.limit(0).selectExpr(f"`{key}`", "'' action_id", "'' title", "'' outcome", "array('') evidence", "'' reason")
    tested = entity.frame.select(F.col(key), *(c.alias(names[g]) for g, c in guards.items()))
    out = tested.select(key, F.explode(F.array(*rows)).alias("_r")).select(key, "_r.*").where("outcome IS NOT NULL")
    return out.withColumn("evidence", F.when(F.col("outcome") == "abstained", F.expr("cast(array() as array<string>)")).otherwise(F.col("evidence")))


def contraindication_triples(spark: SparkSession, plan: PlanDefinition) -> DataFrame:
    """(plan, contraindicates, action) and (action, contraindicatedWhen, guard) of every prohibited action."""
    rows = []
    for action, path in guard_paths(plan):
        if action.do_not_perform:
            rows.append((plan.id, "contraindicates", action.id))
            rows += [(action.id, "contraindicatedWhen", g) for g in path]
    return spark.createDataFrame(rows, "subject string, predicate string, object string")


# Fixed content of the shipped guideline: names, codes, conditions and titles.
GUIDELINE_ID = "jnc8-hypertension"
GUIDELINE_CITATION = "James PA et al. 2014 Evidence-Based Guideline for the Management of High Blood Pressure in Adults (JNC 8). JAMA. 2014;311(5):507-520."
SNOMED = "http://snomed.info/sct"
JNC8_VALUE_SETS = {
    "HypertensionVS": [(SNOMED, "38341003"), (SNOMED, "59621000")],
    "DiabetesVS": [(SNOMED, "46635009"), (SNOMED, "44054006")],
    "CKDVS": [(SNOMED, "709044004"), (SNOMED, "433146000")],
}


def hypertension_guideline() -> PlanDefinition:
    arms = [
        ("Patient.age < 60", "bp-target-140-90", "Treat to BP < 140/90 mmHg"),
        ("Patient.age >= 60", "bp-target-150-90", "Treat to BP < 150/90 mmHg"),
        ('Condition.code in "DiabetesVS" or Condition.code in "CKDVS"', "bp-target-140-90-comorbid", "Diabetes/CKD: treat to BP < 140/90 mmHg"),
        ('Condition.code in "CKDVS"', "init-acei-or-arb-ckd", "CKD: initial therapy should include an ACEI or ARB"),
        ('not (Patient.race = "black")', "init-first-line-general", "Initiate thiazide, CCB, ACEI, or ARB (general population)"),
    ]
    root = PlanAction('Condition.code in "HypertensionVS"', None, tuple(PlanAction(c, Action(i, t)) for c, i, t in arms))
    return PlanDefinition(GUIDELINE_ID, "JNC 8 hypertension management", (root,))
