"""Obligations and compliance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MUST, COULD, MUST_UNLESS_DOCUMENTED = "must", "could", "must-unless-documented"
COMPLIANT_WITH = "compliant_with"


def obligations(rows: DataFrame) -> DataFrame:
    """(action, modality, condition, artifact) of rows (action_id, required_behavior, do_not_perform, condition, source_artifact); a prohibition comes first."""
    modality = F.when(F.col("do_not_perform"), "DoNotPerform").when(F.col("required_behavior") == MUST, "Must").when(F.col("required_behavior") == MUST_UNLESS_DOCUMENTED, "MustUnlessDocumented").otherwise("Could")
    return rows.select(F.col("action_id").alias("action"), modality.alias("modality"), "condition", F.col("source_artifact").alias("artifact"))


def context_sets(context: DataFrame) -> DataFrame:
    """(entity, kind, item) of context facts whose object is "true": kind proposed, documented or active."""
    return context.where("object = 'true'").select("entity", F.col("predicate").alias("kind"), F.col("subject").alias("item"))


def rule_of(modality: Column, present: Column, documented: Column) -> Column:
    return (
        F.when(modality == "Must", F.when(present, "must:proposed").otherwise("must:absent")).when(modality == "Could", "could:permitted")
        .when(modality == "MustUnlessDocumented", F.when(present, "must-unless-documented:proposed").when(documented, "must-unless-documented:documented-exception").otherwise("must-unless-documented:absent-undocumented"))
        .otherwise(F.when(present, "do-not-perform:proposed").otherwise("do-not-perform:absent"))
    )


def verdict_of(rule: Column) -> Column:
    return F.when(rule.isin("must:absent", "do-not-perform:proposed"), "Violation").when(rule == "must-unless-documented:absent-undocumented", "NeedsDocumentation").otherwise("Compliant")


def gather(entities: DataFrame, sets: DataFrame) -> DataFrame:
    """(entity, proposed, documented, active), each entity once, of column entity of ``entities`` and ``sets`` (entity, kind, item): what is proposed, documented and active as lists."""
    kinds = ("proposed", "documented", "active")
    lists = sets.where(F.col("kind").isin(*kinds)).groupBy("entity").agg(*(F.collect_set(F.when(F.col("kind") == k, F.col("item"))).alias(k) for k in kinds))
    return entities.select("entity").distinct().join(lists, "entity", "left").select("entity", *(F.coalesce(k, F.expr("cast(array() as array<string>)")).alias(k) for k in kinds))


def check(obligations_: DataFrame, entities: DataFrame, sets: DataFrame) -> DataFrame:
    """A verdict and its evidence for each entity and each obligation that applies to it (no condition, or an active one).

    ``entities`` holds column entity; ``sets`` (entity, kind, item) says what is proposed, documented and active.
    """
    return check_held(obligations_, gather(entities, sets))


def check_held(obligations_: DataFrame, held: DataFrame) -> DataFrame:
    """``check`` of rows as ``gather`` makes them, each judged where it is."""
    applied = held.crossJoin(F.broadcast(obligations_)).where(F.col("condition").isNull() | F.array_contains("active", F.col("condition")))
    rule = rule_of(F.col("modality"), F.array_contains("proposed", F.col("action")), F.array_contains("documented", F.col("action")))
    return applied.select("entity", "action", "modality", "artifact", verdict_of(rule).alias("verdict"), rule.alias("rule"), evidence_of(rule).alias("evidence"))


def owed(obligations_: DataFrame) -> DataFrame:
    """(action, artifact, owed): the obligations of an action from an artifact as one list."""
    return obligations_.groupBy("action", "artifact").agg(F.collect_list(F.struct("modality", "condition")).alias("owed"))


def compliant_held(obligations_: DataFrame, held: DataFrame) -> DataFrame:
    """``compliant`` of rows as ``gather`` makes them, each judged where it is."""
    each = held.crossJoin(F.broadcast(owed(obligations_))).withColumn("_owed", F.filter("owed", lambda o: o["condition"].isNull() | F.array_contains("active", o["condition"])))
    met = lambda o: verdict_of(rule_of(o["modality"], F.array_contains("proposed", F.col("action")), F.array_contains("documented", F.col("action")))) == "Compliant"
    return each.where((F.size("_owed") > 0) & F.forall("_owed", met)).select("entity", "action", "artifact")


def rule_of(modality: Column, present: Column, documented: Column) -> Column:
    return (
        F.when(modality == "Must", F.when(present, "must:proposed").otherwise("must:absent")).when(modality == "Could", "could:permitted")
        .when(modality == "MustUnlessDocumented", F.when(present, "must-unless-documented:proposed").when(documented, "must-unless-documented:documented-exception").otherwise("must-unless-documented:absent-undocumented"))
        .otherwise(F.when(present, "do-not-perform:proposed").otherwise("do-not-perform:absent"))
    )


def verdict_of(rule: Column) -> Column:
    return F.when(rule.isin("must:absent", "do-not-perform:proposed"), "Violation").when(rule == "must-unless-documented:absent-undocumented", "NeedsDocumentation").otherwise("Compliant")


def check(obligations_: DataFrame, entities: DataFrame, sets: DataFrame) -> DataFrame:
    """A verdict and its evidence for each entity and each obligation that applies to it (no condition, or an active one).

    ``entities`` holds column entity; ``sets`` (entity, kind, item) says what is proposed, documented and active.
    """
    holds = lambda kind, name: sets.where(F.col("kind") == kind).select("entity", F.col("item").alias(name), F.lit(True).alias(f"_{kind}")).distinct()
    free = entities.select("entity").crossJoin(obligations_.where("condition IS NULL"))
    bound = holds("active", "condition").drop("_active").join(obligations_, "condition").join(entities.select("entity"), "entity", "left_semi")
    return judge(free.unionByName(bound.select(free.columns)), sets)


def evidence_of(rule: Column) -> Column:
    return F.array(F.concat(F.lit("artifact:"), F.col("artifact")), F.concat(F.lit("rule:"), rule), F.concat(F.lit("action:"), F.col("action")))


def judge(applied: DataFrame, sets: DataFrame) -> DataFrame:
    """A verdict and its evidence for rows (entity, action, modality, condition, artifact) of obligations that apply."""
    holds = lambda kind, name: sets.where(F.col("kind") == kind).select("entity", F.col("item").alias(name), F.lit(True).alias(f"_{kind}")).distinct()
    out = applied.join(holds("proposed", "action"), ["entity", "action"], "left").join(holds("documented", "action"), ["entity", "action"], "left")
    present, documented, m = F.col("_proposed").isNotNull(), F.col("_documented").isNotNull(), F.col("modality")
    rule = rule_of(m, present, documented)
    verdict = verdict_of(rule)
    return out.select("entity", "action", "modality", "artifact", verdict.alias("verdict"), rule.alias("rule"), evidence_of(rule).alias("evidence"))


def compliant(verdicts: DataFrame) -> DataFrame:
    """(entity, action, artifact) for which every applicable obligation is met: what the deontic reasoner answers; all others abstain."""
    return verdicts.groupBy("entity", "action", "artifact").agg(F.bool_and(F.col("verdict") == "Compliant").alias("_ok")).where("_ok").drop("_ok")
