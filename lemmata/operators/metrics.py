"""Batteries: answers against golds, as counts and ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.compiler import CTX
from ..plans.fixpoint import saturate
from ..plans.terms import Rule
from ..sources.tables import materialize
from ..sources.triples import SPO


def ratio(a: str, b: str, empty: float = 1.0) -> Column:
    return F.coalesce(F.expr(f"try_divide(cast({a} as double), cast({b} as double))"), F.lit(empty))


def derivation_metrics(derived: DataFrame, gold: DataFrame, forbidden: DataFrame | None = None) -> DataFrame:
    """precision, recall and false_provable of derived facts against gold ones; forbidden facts must not be derived."""
    d, g = derived.select(*SPO).distinct().withColumn("_d", F.lit(1)), gold.select(*SPO).distinct().withColumn("_g", F.lit(1))
    counts = d.join(g, list(SPO), "full").agg(F.count("_d").alias("derived"), F.count("_g").alias("gold"), F.count_if(F.col("_d").isNotNull() & F.col("_g").isNotNull()).alias("hit"))
    bad = (forbidden.select(*SPO).distinct().join(d, list(SPO), "left_semi") if forbidden is not None else d.limit(0)).agg(F.count("*").alias("false_provable"))
    return counts.crossJoin(bad).select("derived", "gold", "hit", ratio("hit", "derived").alias("precision"), ratio("hit", "gold").alias("recall"), "false_provable")


def percentile(rows: DataFrame, column: str, share: float, by: list[str] | None = None) -> DataFrame:
    """The value at place round((n - 1) * share) of the sorted ``column`` of each group; 0 for no rows at all.

    Equal values are counted first; the counts are dealt by ranges of groups and values, and only the range that holds the
    place is sorted, so neither a large group nor a frequent value meets in one task.
    """
    by = by or []
    counted = rows.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
    ranged = materialize(counted.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()), "percentile-counts")
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(*by, "_part").agg(F.sum("_c").alias("_sum"))
    # The place of a half is rounded up, as the counts aren't negative.
    at = (F.floor((F.sum("_sum").over(Window.partitionBy(*by)) - 1) * share + 0.5) + 1).alias("_at")
    placed = parts.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_part").alias("_of"), "_sum", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), at)
    holding = placed.where((F.col("_before") < F.col("_at")) & (F.col("_at") <= F.col("_before") + F.col("_sum")))
    same = F.col("_part") == F.col("_of")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    upto = F.sum("_c").over(Window.partitionBy(*by, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    reached = ranged.join(holding, same).withColumn("_upto", upto + F.col("_before")).where(F.col("_upto") >= F.col("_at"))
    found = reached.groupBy(*by).agg(F.min("_v").alias("value"))
    return found if by else found.select(F.coalesce("value", F.lit(0)).alias("value"))


def median(rows: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    return percentile(rows, column, 0.5, by)


def micro_metrics(cells: DataFrame, case: str = "case") -> DataFrame:
    """Micro precision and recall of proposals, and the shares of cases whose cells all match and whose abstentions all match, of cells (case, gold, got)."""
    gold, got = F.col("gold"), F.col("got")
    by = cells.groupBy(case).agg(
        F.count_if((gold == "proven") & (got == "proven")).alias("tp"), F.count_if((gold != "proven") & (got == "proven")).alias("fp"), F.count_if((gold == "proven") & (got != "proven")).alias("fn"),
        F.bool_and(gold == got).alias("exact"), F.bool_and((gold == "abstain") == (got == "abstain")).alias("abstains"),
    )
    sums = by.agg(F.count("*").alias("cases"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.count_if("exact").alias("exact"), F.count_if("abstains").alias("abstains"))
    return sums.select("cases", ratio("tp", "tp + fp").alias("precision"), ratio("tp", "tp + fn").alias("recall"), ratio("exact", "cases").alias("exact_match"), ratio("abstains", "cases").alias("abstain_match"))


def run_fixtures(fixtures: DataFrame, rules: Sequence[Rule], expected: DataFrame) -> DataFrame:
    """Each fixture run and judged: fixture, missing, forbidden and passed.

    fixtures: (fixture, subject, predicate, object), all in one fixpoint; expected: the same with ``wanted``, true for what must follow and
    false for what must not.
    """
    sat = saturate(rules, fixtures.select(F.col("fixture").alias(CTX), *SPO))
    derived = sat.derivations.select(F.col(CTX).alias("fixture"), *SPO, F.lit(True).alias("_d"))
    j = expected.join(derived, ["fixture", *SPO], "left")
    by = j.groupBy("fixture").agg(F.count_if(F.col("wanted") & F.col("_d").isNull()).alias("missing"), F.count_if(~F.col("wanted") & F.col("_d").isNotNull()).alias("forbidden"))
    return by.withColumn("passed", (F.col("missing") == 0) & (F.col("forbidden") == 0))


def abduction_battery(ranked: DataFrame, golds: DataFrame) -> DataFrame:
    """Counts over observations: golds (subject, predicate, object, gold: atom_text or null where nothing may survive) against ``ranked`` explanations."""
    places = ranked.groupBy(*SPO).agg(F.max(F.when(F.col("place") == 1, F.col("atom_text"))).alias("first"), F.collect_set("atom_text").alias("every"))
    j = golds.join(places, list(SPO), "left")
    hit = F.col("gold").isNotNull() & (F.col("first") == F.col("gold"))
    return j.agg(
        F.count("*").alias("cases"), F.count_if(hit).alias("top1"), F.count_if(F.col("gold").isNotNull() & F.coalesce(F.array_contains("every", F.col("gold")), F.lit(False))).alias("found"),
        F.count_if(F.col("gold").isNull() & F.col("first").isNull()).alias("rightly_abstained"), F.count_if(F.col("gold").isNull() & F.col("first").isNotNull()).alias("wrongly_answered"),
    )


def bayes_battery(posterior: DataFrame, golds: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Counts over golds (case, h, p): how many posteriors agree within ``tolerance``, and the largest gap."""
    j = golds.withColumnRenamed("p", "gold").join(posterior, ["case", "h"], "left")
    gap = F.abs(F.coalesce("p", F.lit(2.0)) - F.col("gold"))
    return j.agg(F.count("*").alias("cells"), F.count_if(gap <= tolerance).alias("agree"), F.max(gap).alias("largest_gap"))


def verdict_metrics(cells: DataFrame) -> DataFrame:
    """Coverage, false proofs, abstention precision and recall and accuracy of cells (gold, got), each proven, abstain or reject."""
    gold, got = F.col("gold"), F.col("got")
    counts = cells.agg(
        F.count("*").alias("cells"), F.count_if(gold == got).alias("right"), F.count_if(gold == "proven").alias("should_prove"), F.count_if((gold == "proven") & (got == "proven")).alias("proved"),
        F.count_if((gold != "proven") & (got == "proven")).alias("false_proofs"), F.count_if(got == "abstain").alias("abstained"), F.count_if((gold == "abstain") & (got == "abstain")).alias("rightly_abstained"), F.count_if(gold == "abstain").alias("should_abstain"),
    )
    return counts.select("cells", "false_proofs", ratio("proved", "should_prove").alias("coverage"), ratio("rightly_abstained", "abstained").alias("abstention_precision"), ratio("rightly_abstained", "should_abstain").alias("abstention_recall"), ratio("right", "cells").alias("accuracy"))
