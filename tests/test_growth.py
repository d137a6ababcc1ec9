"""No step makes more rows or asks more often than its result needs; told from what the plan's nodes have counted."""

import random

import pytest
from pyspark.sql import functions as F

from lemmata import queries
from lemmata.operators import analogy, contract, deontic, induction, reasoners
from lemmata.operators.causal import CausalGraph


def rows_made(df):
    """The rows of ``df``, and those of the node of its plan that gave the most."""
    out, most = df.collect(), 0
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            count = node.metrics().get("numOutputRows")
            most = max(most, count.get().value() if count.isDefined() else 0)
            todo += [node.children().apply(k) for k in range(node.children().size())]
    return out, most


def graph_of(spark, edges):
    return CausalGraph(spark.createDataFrame([(a, b, "causes") for a, b in edges], "source string, target string, predicate string"))


def test_frontdoor_doesnt_meet_all_below_a_wide_start(spark):
    edges = [("x", f"m{k % 3}") for k in range(3)] + [(f"m{k % 3}", f"y{k}") for k in range(600)]
    got, most = rows_made(graph_of(spark, edges).frontdoor(spark.createDataFrame([("x", f"y{k}") for k in range(600)], "x string, y string")))
    assert sorted(map(tuple, got)) == sorted(("x", f"y{k}", f"m{k % 3}") for k in range(600)) and most < 5000


def test_frontdoor_equals_its_definition(spark):
    rng = random.Random(5)
    nodes = [f"n{k}" for k in range(9)]
    for _ in range(1):
        edges = sorted({(a, b) for a, b in (rng.sample(nodes, 2) for _ in range(12))} | {("n0", "n0")})
        reach = set(edges)
        while more := {(a, d) for a, b in reach for c, d in edges if b == c} - reach:
            reach |= more
        asked = [(a, b) for a in nodes for b in nodes]
        want = []
        for x, y in asked:
            inner = {n for n in nodes if n not in (x, y) and (x, n) in reach and (n, y) in reach}
            if all((x, n) in edges for n in inner):
                want += [(x, y, n) for n in inner]
        assert sorted(map(tuple, graph_of(spark, edges).frontdoor(spark.createDataFrame(asked, "x string, y string")).collect())) == sorted(want)


def feature_rows(spark, n, features, name, seed, kinds=4):
    rng = random.Random(seed)
    own = {k: rng.sample(range(features), rng.randint(1, kinds)) for k in range(n)}
    return own, spark.createDataFrame([(k, f"f{f:03d}") for k, fs in own.items() for f in [*fs, fs[0]]], f"{name} long, f string")


@pytest.mark.parametrize("features", [6, 90])
def test_similar_and_nearest_cases_equal_their_definitions(spark, features):
    """With few features, compared as bits, and with many, through the inverted index."""
    cases, b = feature_rows(spark, 40, features, "b", 3)
    others, c = feature_rows(spark, 12, features, "a", 4)
    jac = lambda x, y: len({*x} & {*y}) / len({*x} | {*y})
    for targets, a, same in ((others, c, False), (cases, b.withColumnRenamed("b", "a"), True)):
        want = {(i, j): jac(x, y) for i, x in targets.items() for j, y in cases.items() if jac(x, y)}
        assert {(r["a"], r["b"]): r["similarity"] for r in induction.jaccard_pairs(a, b).collect()} == want
        near = {i: min((-s, j) for (k, j), s in want.items() if k == i and not (same and i == j)) for i in targets if any(k == i and not (same and i == j) for k, j in want)}
        got = {r["a"]: (-r["similarity"], r["b"]) for r in induction.nearest_case(a, b, others=same).collect()}
        assert got == {i: v for i, v in near.items() if -v[0] >= 0.5}


def test_similarities_are_rounded_as_spark_does(spark):
    _, b = feature_rows(spark, 30, 14, "b", 9, kinds=12)
    a = b.withColumnRenamed("b", "a")
    key = ["a", "b", "similarity"]
    want = induction.jaccard_pairs(a, b).withColumn("similarity", F.round("similarity", 6))
    assert sorted(map(tuple, induction.jaccard_pairs(a, b, digits=6).select(key).collect())) == sorted(map(tuple, want.select(key).collect()))


def test_pairs_of_cases_are_not_shuffled(spark):
    _, b = feature_rows(spark, 200, 8, "b", 1)
    a = b.withColumnRenamed("b", "a")
    near, most = rows_made(induction.nearest_case(a, b, others=True))
    assert len(near) == 200 and most < 5000
    pairs = induction.jaccard_pairs(a, b)
    pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "SortMergeJoin" not in plan


OWED = [("a", "Must", None, "p"), ("a", "MustUnlessDocumented", "c", "p"), ("a", "DoNotPerform", None, "q"), ("b", "Could", "c", "p"), ("b", "DoNotPerform", None, "p"), ("c", "Must", "d", "p")]


def owed_and_sets(spark):
    sets = [("1", "proposed", "a"), ("1", "active", "c"), ("2", "active", "c"), ("2", "documented", "a"), ("2", "proposed", "b"), ("3", "active", "c"), ("3", "proposed", "a"), ("3", "other", "a"), ("3", "proposed", "a")]
    return spark.createDataFrame(OWED, "action string, modality string, condition string, artifact string"), spark.createDataFrame([(k,) for k in "1234"], "entity string"), spark.createDataFrame(sets, "entity string, kind string, item string")


def test_verdicts_of_gathered_rows(spark):
    rules, entities, sets = owed_and_sets(spark)
    free = entities.crossJoin(rules.where("condition IS NULL"))
    bound = sets.where("kind = 'active'").select("entity", F.col("item").alias("condition")).join(rules, "condition").select(free.columns)
    want = deontic.judge(free.unionByName(bound), sets)
    assert sorted(map(str, deontic.check(rules, entities, sets).collect())) == sorted(map(str, want.collect()))
    got = deontic.compliant_held(rules, deontic.gather(entities, sets))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, deontic.compliant(want).collect())) and got.count()


def test_compliance_is_told_where_the_context_is(spark):
    rules, entities, sets = owed_and_sets(spark)
    context = F.collect_list(F.when(F.col("kind").isNotNull(), F.struct(F.col("item").alias("subject"), F.col("kind").alias("predicate"), F.lit("true").alias("object")))).alias("context")
    asked = entities.join(sets, "entity", "left").groupBy("entity").agg(context).crossJoin(rules.select("action", "artifact").distinct())
    asked = asked.select(F.concat_ws(" ", "entity", "action", "artifact").alias("query_id"), F.col("action").alias("subject"), F.lit(deontic.COMPLIANT_WITH).alias("predicate"), F.col("artifact").alias("object"), "context")
    rows = spark.createDataFrame(asked.collect(), contract.QUERY)
    reasoner = reasoners.DeonticReasoner(rules)
    answers = reasoner.answer_all(rows)
    told = reasoner.verdicts(rows).groupBy("entity").agg(F.bool_and(F.col("verdict") == "Compliant").alias("ok"), F.array_sort(F.collect_set("rule")).alias("why"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("provenance")).where("ok")
    assert sorted((r["query_id"], r["why"], r["provenance"]) for r in answers.collect()) == sorted((r["entity"], r["why"], r["provenance"]) for r in told.collect())
    plan = answers._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_questions_of_one_shape_are_searched_once(spark, monkeypatch):
    rng = random.Random(2)
    cases = {c: [(f"{c}{rng.randrange(3)}", rng.choice("pqr"), f"{c}{rng.randrange(3)}") for _ in range(3)] for c in "cde"}
    asked, cfg = [], analogy.AnalogyConfig(min_similarity=0.3, min_aligned_relations=1)
    for _ in range(60):
        names = [f"z{rng.randrange(900)}" for _ in range(3)]
        asked.append(((names[0], rng.choice("pqr"), rng.choice(names)), [(rng.choice(names), rng.choice("pqr"), rng.choice(names)) for _ in range(3)]))
    shapes = analogy.Shapes(cases, cfg)
    assert [shapes.best(g, c) for g, c in asked] == [analogy.best_case(cases, g, c, cfg) for g, c in asked]
    made, search = [], analogy.best_case
    monkeypatch.setattr(analogy, "best_case", lambda *x: made.append(1) or search(*x))
    again = analogy.Shapes(cases, cfg)
    for k in range(1000):
        again.best((f"n{k}", "p", "x"), [(f"n{k}", "q", "y")])
    assert len(made) == 1


def test_pairs_of_a_nation_are_dealt_evenly(spark):
    """The rows of each pair of customer and supplier are made by as many tasks as the customers are dealt to, and aren't shuffled after."""
    out = queries.conjunction_same_nation(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert f"RoundRobinPartitioning({queries.DEALT})" in plan and plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
