"""Golds of the expression language, decision graphs and the reasoners."""

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from lemmata.functions.cql import CqlTypeError, Entity, ParseError, compile_expression, evaluate, parse
from lemmata.operators import abduction, analogy, bayes, contract, deontic, induction, metrics
from lemmata.operators.causal import CausalGraph
from lemmata.operators.plandef import Action, PlanAction, PlanDefinition, apply_plan
from lemmata.plans.terms import Rule, Triple
from lemmata.sources.triples import of_rows


@pytest.fixture(scope="module")
def patient(spark):
    schema = "id int, age int, ratio double, name string, codes array<struct<system:string,code:string>>, one array<int>, dose struct<value:double,unit:string>, stay struct<low:double,high:double>, flag boolean"
    rows = [(1, 70, 0.5, "ann", [("s", "1"), ("s", "9")], [4], (5.0, "mg"), (10.0, 20.0), True), (2, None, None, None, [], [], None, None, None)]
    return Entity(spark.createDataFrame(rows, schema), {"V": [("s", "1")]}, {("s", "9"): [("s", "root")]})


GOLDS = [
    ("age >= 60", True, None), ("age < 60 or name = 'ann'", True, None), ("age < 60 and flag", False, None), ("not flag", False, None), ("null and false", False, False), ("null or true", True, True), ("3 in (1, null)", None, None), ("age in (70, null)", True, None),
    ("exists(age)", True, False), ("exists(codes)", True, False), ('codes in "V"', True, None), ('codes in "Unknown"', None, None), ("one = 4", True, None), ("one > 3", True, None), ("age = 70.0", True, None), ("age = 'x'", False, None), ("age != 'x'", True, None),
    ("dose = Quantity(5, 'mg')", True, None), ("dose = Quantity(5, 'g')", False, None), ("stay during Interval(5, 25)", True, None), ("stay before DateTime(30)", True, None), ("stay after 5", True, None), ("stay overlaps Interval(20, 30)", True, None), ("15 during stay", True, None),
    ("Code('s', 'root') subsumes Code('s', '9')", True, True), ("Code('s', '9') subsumes Code('s', 'root')", False, False), ("missing.path = 3", None, None), ("codes = (Code('s', '1'), Code('s', '9'))", True, None), ("(1, 2) = (1, 2)", True, True), ("name < 'b'", True, None), ("NOT (1 = 2)", True, True), ("(1, null) = (1, null)", False, False),
]


def test_cql_golds(patient):
    names = {f"g{k}": text for k, (text, _, _) in enumerate(GOLDS)}
    full, empty = evaluate(patient, **names).orderBy("id").collect()
    assert [(g[0], full[f"g{k}"], empty[f"g{k}"]) for k, g in enumerate(GOLDS)] == GOLDS


@pytest.mark.parametrize("text", ["", "a <", "'open", "a = b = c", "(a", "Code(x, 'y')", "a ; b", "exists a"])
def test_cql_parse_errors(text):
    with pytest.raises(ParseError):
        parse(text)


@pytest.mark.parametrize("text", ["not age", "age and flag", "age < 'x'", "x in (3)", "age in \"V\"", "age subsumes age", "name before 3", "flag < flag", "3 in age"])
def test_cql_type_errors(patient, text):
    with pytest.raises(CqlTypeError):
        compile_expression(text, patient)


def test_plan(spark, patient):
    plan = PlanDefinition("p", "t").with_action(
        PlanAction.when("exists(name)").with_sub(PlanAction.when("age > 60").recommend(Action("a", "A")).with_sub(PlanAction.always().recommend(Action("b", "B").prohibited()))).with_sub(PlanAction.when("age < 60").recommend(Action("c", "C")))
    ).with_action(PlanAction.when("flag").with_sub(PlanAction.when("age > 1").recommend(Action("d", "D"))))
    got = {(r["id"], r["action_id"]): (r["outcome"], r["evidence"], r["reason"]) for r in apply_plan(plan, patient, "id").collect()}
    assert got == {(1, "a"): ("proposed", ["exists(name)", "age > 60"], None), (1, "b"): ("suppressed", ["exists(name)", "age > 60"], None), (1, "d"): ("proposed", ["flag", "age > 1"], None), (2, "d"): ("abstained", [], "flag")}
    assert apply_plan(PlanDefinition("e", "t"), patient, "id").isEmpty()


def graph(spark, text):
    return CausalGraph.of_triples(of_rows(spark, [(e.split(">")[0], "causes", e.split(">")[1]) for e in text.split()]))


def pairs(spark, *xy):
    return spark.createDataFrame(list(xy), "x string, y string")


def test_causal_identification(spark):
    g = graph(spark, "Z>X Z>Y X>Y")
    row = g.identify(pairs(spark, ("X", "Y"), ("X", "Q"))).orderBy("y").collect()
    assert [(r["y"], r["identifiable"], r["criterion"], r["adjustment"]) for r in row] == [("Q", False, None, []), ("Y", True, "Backdoor", ["Z"])]
    g = graph(spark, "C>A C>B A>M M>B")
    assert [r["node"] for r in g.confounders(pairs(spark, ("A", "B"))).collect()] == ["C"]
    assert [r["node"] for r in graph(spark, "U>A U>B A>M M>B").frontdoor(pairs(spark, ("A", "B"))).collect()] == ["M"]
    noise = of_rows(spark, [("a", "causes", "b"), ("a", "likes", "c")])
    assert CausalGraph.of_triples(noise).counts().first().asDict() == {"nodes": 2, "edges": 1}


def test_causal_paths_and_cycles(spark):
    g = graph(spark, "a>b b>c c>a a>d d>c x>y")
    assert {r["node"] for r in g.ancestors("a").collect()} == {"a", "b", "c", "d"} and {r["node"] for r in g.descendants("x").collect()} == {"y"}
    got = {(r["x"], r["y"]): r["has_path"] for r in g.has_path(pairs(spark, ("a", "c"), ("c", "x"), ("q", "q"))).collect()}
    assert got == {("a", "c"): True, ("c", "x"): False, ("q", "q"): True}
    found = {(r["x"], r["y"]): r["path"] for r in g.shortest_paths(pairs(spark, ("a", "c"), ("a", "a"), ("a", "x"), ("b", "d"))).collect()}
    assert found == {("a", "c"): ["a", "b", "c"], ("a", "a"): ["a"], ("b", "d"): ["b", "c", "a", "d"]}
    assert g.mutilated("c").edges.count() == 4 and g.relevant("a", "b").edges.count() == 5
    assert g.reachability_matrix().count() == 17


def test_interventions(spark):
    g = graph(spark, "V>P1 P1>E P1>F E>E2 A>C B>C")
    rows = {(r["treatment"], r["role"], r["node"]) for r in g.intervention(spark.createDataFrame([("P1",), ("A",), ("E2",)], "treatment string")).collect()}
    assert {(t, r, n) for t, r, n in rows if t == "A"} == {("A", "direct", "C"), ("A", "transitive", "C")}
    assert {n for t, r, n in rows if t == "P1" and r == "blocked"} == {"E", "F", "E2"} and not any(t == "E2" for t, _, _ in rows)


def test_counterfactual(spark):
    g = graph(spark, "X>Y Z>Y W>X")
    got = {(r["x"], r["y"]): (r["status"], r["level"], r["confidence"], r["alternatives"]) for r in g.counterfactual(pairs(spark, ("X", "Y"), ("Y", "X"), ("W", "Y"))).collect()}
    # W counts as a confounder of X and Y, as every common ancestor that X doesn't reach.
    assert got == {("X", "Y"): ("persists", "Medium", 0.65, 1), ("Y", "X"): ("no_path", None, None, 1), ("W", "Y"): ("persists", "Medium", 0.65, 1)}


def test_deontic(spark):
    rows = spark.createDataFrame([("a", "must", False, None, "r1"), ("b", "must-unless-documented", False, None, "r2"), ("c", "must", True, None, "r3"), ("d", None, False, "cond", "r4")], "action_id string, required_behavior string, do_not_perform boolean, condition string, source_artifact string")
    sets = deontic.context_sets(spark.createDataFrame([("e1", "a", "proposed", "true"), ("e1", "c", "proposed", "true"), ("e1", "b", "documented", "true"), ("e2", "cond", "active", "true"), ("e2", "a", "proposed", "false")], "entity string, subject string, predicate string, object string"))
    who = spark.createDataFrame([("e1",), ("e2",)], "entity string")
    verdicts = deontic.check(deontic.obligations(rows), who, sets)
    assert {(r["entity"], r["action"]): r["verdict"] for r in verdicts.collect()} == {("e1", "a"): "Compliant", ("e1", "b"): "Compliant", ("e1", "c"): "Violation", ("e2", "a"): "Violation", ("e2", "b"): "NeedsDocumentation", ("e2", "c"): "Compliant", ("e2", "d"): "Compliant"}
    assert deontic.compliant(verdicts).count() == 4


def test_bayes(spark):
    priors = spark.createDataFrame([("one", "sick", 0.01), ("one", "well", 0.99), ("two", "sick", 0.01), ("two", "well", 0.99), ("dead", "a", 1.0), ("dead", "b", 1.0)], "case string, h string, w double")
    evidence = spark.createDataFrame([("one", 1, "pos"), ("two", 1, "pos"), ("two", 2, "pos"), ("dead", 1, "never"), ("dead", 2, "half")], "case string, step long, evidence string")
    like = spark.createDataFrame([("pos", "sick", 0.99), ("pos", "well", 0.05), ("never", "a", 0.0), ("never", "b", 0.0), ("half", "a", 0.5)], "evidence string, h string, l double")
    post = bayes.posterior(priors, evidence, like)
    got = {(r["case"], r["h"]): r["p"] for r in post.collect()}
    assert got["one", "sick"] == pytest.approx(1 / 6, abs=1e-3) and got["two", "sick"] == pytest.approx(0.798387, abs=1e-3) and got["dead", "a"] == pytest.approx(1 / 3)
    best = {r["case"]: r["h"] for r in bayes.map_hypothesis(post).collect()}
    assert best == {"one": "well", "two": "sick", "dead": "b"} and bayes.ranked(post).where("rank = 1").count() == 3
    assert {r["case"]: round(r["entropy"], 3) for r in bayes.entropy_bits(post).collect()}["dead"] == 0.918
    rows = spark.createDataFrame([("one", "sick", 0.99), ("one", "well", 0.05)], "case string, h string, l double")
    assert {r["h"]: round(r["p"], 4) for r in bayes.posterior_product(priors.where("case = 'one'"), rows).collect()} == {"sick": 0.1667, "well": 0.8333}
    for bad, kind in ((priors.limit(0), "Empty"), (priors.union(priors), "DuplicateHypothesis"), (priors.withColumn("w", F.lit(0.0)), "NonNormalizablePrior")):
        with pytest.raises(bayes.BayesError, match=kind):
            bayes.validate_priors(bad)
    bayes.validate_priors(priors)


def test_grade(spark):
    cases = {"c1": ("high", ["serious", "serious"], "low"), "c2": ("high", ["very-serious", "very-serious"], "very-low"), "c3": ("low", ["large-effect"], "moderate"), "c4": ("moderate", ["none"], "moderate"), "c5": ("odd", ["serious"], None)}
    rows = [(c, f"r{i}", r, i == 0) for c, (base, moves, _) in cases.items() for i, r in enumerate([base, *moves])]
    got = {r["case"]: r["level"] for r in bayes.aggregate_certainty(spark.createDataFrame(rows, "case string, id string, rating string, is_base boolean")).collect()}
    assert got == {c: want for c, (_, _, want) in cases.items()}
    certain = bayes.prior_from_certainty(spark.createDataFrame([("c", "a", "high", None), ("c", "b", "low", "moderate"), ("c", "d", "odd", None)], "case string, h string, level string, directness string"))
    assert {r["h"]: r["w"] for r in certain.collect()} == {"a": 1.0, "b": 0.375, "d": 0.0}


def test_induction(spark):
    facts = of_rows(spark, [(n, p, o) for n in ("tweety", "robin", "crow") for p, o in (("is_a", "bird"), ("can", "fly"))] + [("crow", "colour", "black")])
    rules = {(r["body_p"], r["head_p"]): (r["support"], r["positives"], r["confidence"]) for r in induction.induce(facts).collect()}
    assert rules == {("is_a", "can"): (3, 3, 1.0), ("can", "is_a"): (3, 3, 1.0)}
    half = of_rows(spark, [("a", "p", "1"), ("a", "q", "1"), ("b", "p", "1")])
    assert [r["confidence"] for r in induction.induce(half, min_support=2).collect()] == [0.5]


def test_analogy_equals_exhaustive_search():
    case = [("a", "r", "b"), ("b", "r", "c"), ("a", "s", "c")]
    known, targets = [("x", "r", "y"), ("x", "s", "z"), ("y", "r", "w")], ["w", "x", "y", "z"]
    best = None
    for images in permutations([*targets, None, None, None], 3):
        m = {k: v for k, v in zip("abc", images, strict=True) if v}
        score = sum(s in m and o in m and (m[s], p, m[o]) in known for s, p, o in case)
        key = (-score, sorted(m.items()))
        best = min(best, key) if best else key
    got = analogy.best_alignment(case, known, targets)
    assert (-got.supported, sorted(got.mapping.items())) == best
    assert analogy.best_alignment([(f"e{k}", "r", "z") for k in range(9)], known, targets) is None
    assert analogy.transfers(got, case, ("x", "q", "y")) is False


def test_abduction(spark):
    rules = [Rule.parse("rain", "?x rained_on yes => ?x wet yes"), Rule.parse("sprinkler", "?x sprinkled yes => ?x wet yes"), Rule.parse("storm", "?x in ?c, ?c stormy yes => ?x rained_on yes")]
    base = of_rows(spark, [("lawn", "in", "town")])
    goal = Triple("lawn", "wet", "yes")
    found = abduction.candidates(rules, goal)
    assert [h.chain for h in found] == [("rain",), ("storm", "rain"), ("sprinkler",)] and found[1].ground() is None and abduction.candidates(rules, goal, 0) == []
    priors = spark.createDataFrame([("lawn", "sprinkled", "yes", 0.9), ("lawn", "rained_on", "yes", 0.2)], "subject string, predicate string, object string, prior double")
    ranked = abduction.explain(spark, rules, base, [goal], priors=priors)
    assert [(r["chain"], r["place"]) for r in ranked.orderBy("place").collect()] == [(["sprinkler"], 1), (["rain"], 2)]
    bayesian = abduction.explain(spark, rules, base, [goal], priors=priors, bayesian=True).orderBy("place").collect()
    assert [round(r["posterior"], 4) for r in bayesian] == [0.8182, 0.1818]
    guess = abduction.proposed(goal, lambda o: [[("lawn", "sprinkled", "yes")]], "stub")
    assert guess[0].substrate == "Neural" and guess[0].chain == ("neural:stub",)
    seeded = abduction.test_all(abduction.table_of(spark, [(goal, [abduction.Hypothesis(found[0].atoms, ("x",))])]), [], base)
    assert seeded.first()["outcome"] == "ExplainsNothing"


def test_contract(spark):
    facts = of_rows(spark, [("a", "parent", "b"), ("b", "parent", "c")])
    rules = [Rule.parse("gp", "?x parent ?y, ?y parent ?z => ?x grandparent ?z"), Rule.parse("free", "=> sun is hot")]
    causal = contract.CausalReasoner(graph(spark, "Z>X Z>Y X>Y"))
    router = contract.ReasonerRouter([contract.DeductiveReasoner(rules, facts, ["grandparent", "is", "parent"]), causal, contract.CounterfactualReasoner(causal.graph)])
    asked = [("1", "a", "grandparent", "c", []), ("2", "c", "grandparent", "a", []), ("3", "sun", "is", "hot", []), ("4", "X", "causally_affects", "Y", []), ("5", "X", "counterfactually_affects", "Y", []), ("6", "a", "owns", "b", []), ("7", "b", "grandparent", "d", [("c", "parent", "d")])]
    got = {r["query_id"]: r for r in router.route(spark.createDataFrame(asked, contract.QUERY)).collect()}
    assert {k: r["provability"] for k, r in got.items()} == {"1": "Proven", "2": "Abstained", "3": "Heuristic", "4": "Proven", "5": "Heuristic", "6": "Abstained", "7": "Proven"}
    assert got["4"]["why"] == ["do-calculus:backdoor"] and got["6"]["reason"] == "no reasoner covers predicate 'owns' (3 registered)" and got["2"]["reason"] == "all 1 covering reasoners abstained"
    least = spark.createDataFrame([("Proven",), ("Heuristic",)], "provability string").agg(contract.provability_min().alias("m")).first()["m"]
    assert least == "Heuristic"
    gold = spark.createDataFrame([("1", True), ("2", False), ("5", False)], "query_id string, provable boolean")
    routed = spark.createDataFrame([(k, r["provability"], r["reason"]) for k, r in got.items()], "query_id string, provability string, reason string")
    assert contract.audit(routed, gold).first().asDict() == {"proven_expected": 1, "missed": 0, "false_proofs": 0, "correctly_unproven": 1, "silent_drops": 0, "rate": 1.0}


def test_metrics(spark):
    cells = spark.createDataFrame([("proven", "proven"), ("abstain", "abstain"), ("reject", "abstain"), ("reject", "reject")], "gold string, got string")
    m = metrics.verdict_metrics(cells).first()
    assert (m["cells"], m["false_proofs"], m["coverage"], m["abstention_precision"], m["abstention_recall"], m["accuracy"]) == (4, 0, 1.0, 0.5, 1.0, 0.75)
