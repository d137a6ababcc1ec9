"""Limits, increments, contexts and libraries that grow."""

import random

import pytest
from pyspark.sql import functions as F

from lemmata.operators import abduction, analogy, bayes, contract, metrics, provenance, reasoners
from lemmata.operators.causal import CausalGraph, NotIdentifiable
from lemmata.plans import fixpoint
from lemmata.plans.fixpoint import saturate, saturate_contexts, saturate_more
from lemmata.plans.terms import Rule, Triple, naive_closure
from lemmata.sources import tables
from lemmata.sources.triples import SPO, TRIPLE, of_rows

ANCESTOR = [Rule.parse("base", "?x parent ?y => ?x ancestor ?y"), Rule.parse("step", "?x parent ?y, ?y ancestor ?z => ?x ancestor ?z")]


def chain(n, name="n"):
    return [(f"{name}{k}", "parent", f"{name}{k + 1}") for k in range(n)]


def facts_of(sat):
    return {Triple(*r) for r in sat.facts.select(*SPO).collect()}


def test_a_limit_of_rounds_is_told(spark):
    facts = of_rows(spark, chain(6))
    cut, whole = saturate(ANCESTOR, facts, max_rounds=2), saturate(ANCESTOR, facts)
    assert not cut.complete and whole.complete and facts_of(cut) < facts_of(whole) == set(naive_closure(ANCESTOR, chain(6))[0])


def test_increments_share_the_files_before(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "MOST_PATHS", 3)
    edges = chain(6)
    sat = saturate(ANCESTOR, of_rows(spark, edges[:2]))
    for e in edges[2:]:
        before = sat
        sat = saturate_more(sat, ANCESTOR, of_rows(spark, [e, edges[0]]))
        assert len(sat.paths) <= 4 and (len(before.paths) >= 3 or sat.paths[: len(before.paths)] == before.paths)
    assert facts_of(sat) == set(naive_closure(ANCESTOR, edges)[0]) and sat.broken_premises().isEmpty()
    apart = spark.createDataFrame([("1", *edges[0]), ("2", *edges[1])], "ctx string, subject string, predicate string, object string")
    more = spark.createDataFrame([("1", *edges[1])], apart.schema)
    got = saturate_more(saturate(ANCESTOR, apart), ANCESTOR, more).derivations.collect()
    assert {(r["ctx"], r["subject"], r["object"]) for r in got} == {("1", "n0", "n1"), ("1", "n1", "n2"), ("1", "n0", "n2"), ("2", "n1", "n2")}


def test_contexts_share_a_base(spark):
    base = saturate(ANCESTOR, of_rows(spark, chain(3)))
    seeds = spark.createDataFrame([("a", "n3", "parent", "x"), ("b", "y", "parent", "n0"), ("b", "n3", "parent", "n0"), ("c", "n0", "parent", "n1")], "ctx string, subject string, predicate string, object string")
    sat = saturate_contexts(base, ANCESTOR, seeds)
    for c in "abc":
        own = [tuple(r)[1:] for r in seeds.where(F.col("ctx") == c).collect()]
        got = {Triple(*r) for r in sat.facts.where(F.col("ctx") == c).select(*SPO).collect()} if "ctx" in sat.facts.columns else {Triple(*r) for r in sat.rows.where(F.col("ctx") == c).select(*SPO).collect()}
        assert got | facts_of(base) == set(naive_closure(ANCESTOR, chain(3) + own)[0])
    claims = spark.createDataFrame([("b", "y", "ancestor", "n3"), ("a", "n0", "ancestor", "n2"), ("a", "y", "ancestor", "n3")], seeds.schema)
    proofs = {(r["ctx"], r["subject"]): r for r in provenance.measures(sat, claims).join(claims, claims.columns, "left_semi").collect()}
    assert set(proofs) == {("b", "y"), ("a", "n0")} and (proofs["b", "y"]["depth"], len(proofs["b", "y"]["axioms"]), proofs["b", "y"]["complete"]) == (4, 4, True)
    few = provenance.measures(sat, claims, ("depth",))
    assert few.columns == ["ctx", *SPO, "round", "depth"]


def test_deduction_cites_axioms_only(spark):
    rules = [Rule.parse("one", "?x e ?y => ?x r ?y"), Rule.parse("more", "?x e ?y, ?y r ?z => ?x r ?z"), Rule.parse("free", "=> sun is hot")]
    facts = of_rows(spark, [(f"n{k}", "e", f"n{k + 1}") for k in range(3)])
    rows = [("q", "n0", "r", "n3", []), ("given", "n0", "e", "n1", []), ("none", "n3", "r", "n0", []), ("ctx", "n0", "r", "m", [("n3", "e", "m")]), ("null", "n1", "r", "n3", None), ("free", "sun", "is", "hot", [])]
    got = {r["query_id"]: r for r in contract.DeductiveReasoner(rules, facts).answer_all(spark.createDataFrame(rows, contract.QUERY)).collect()}
    assert set(got) == {"q", "given", "ctx", "null", "free"} and not got["free"]["complete"]
    assert got["q"]["provenance"] == [f"axiom:(n{k} e n{k + 1})" for k in range(3)] and (got["q"]["why"], got["q"]["depth"]) == (["one", "more", "more"], 3)
    assert got["ctx"]["provenance"][-1] == "axiom:(n3 e m)" and got["given"]["why"] == ["axiom"] and [tuple(x) for x in got["given"]["leaves"]] == [("n0", "e", "n1")]


def test_causal_answers_keep_their_edges(spark):
    g = CausalGraph(spark.createDataFrame([("a", "b", "blocks"), ("a", "b", "causes"), ("b", "c", "depends_on")], "source string, target string, predicate string"))
    ask = spark.createDataFrame([("q", "a", contract.CAUSALLY_AFFECTS, "c", [])], contract.QUERY)
    (r,) = contract.CausalReasoner(g).answer_all(ask).collect()
    assert r["provenance"] == ["edge: a blocks b", "edge: b depends_on c"] and [x["predicate"] for x in r["leaves"]] == ["blocks", "depends_on"]
    assert g.with_node("z").has_node("z") and not g.has_node("z") and g.with_node("z").counts().first()["nodes"] == 4
    assert g.verify_and_refuse("a", "c")["identifiable"]
    with pytest.raises(NotIdentifiable):
        g.verify_and_refuse("a", "nowhere")


def test_posteriors_dont_underflow(spark):
    priors = spark.createDataFrame([(c, h, 0.5) for c in ("long", "odd") for h in ("x", "y")], "case string, h string, w double")
    steps = spark.createDataFrame([("long", k, "e") for k in range(5000)] + [("odd", 0, "only_y"), ("odd", 1, "nothing"), ("odd", 2, "e")], "case string, step long, evidence string")
    likelihood = spark.createDataFrame([("e", "x", 0.011), ("e", "y", 0.01), ("only_y", "x", 0.0), ("nothing", "x", 0.0), ("nothing", "y", 0.0)], "evidence string, h string, l double")
    got = {(r["case"], r["h"]): r["p"] for r in bayes.posterior(priors, steps, likelihood).collect()}
    assert got["long", "x"] == pytest.approx(1.0) and got["odd", "y"] == 1.0 and got["odd", "x"] == 0.0
    rows = spark.createDataFrame([("long", h, 0.01) for h in "xy" for _ in range(1000)], "case string, h string, l double")
    assert {r["p"] for r in bayes.posterior_product(priors.where("case = 'long'"), rows).collect()} == {0.5}


def test_a_large_library_gives_the_same_answers(spark, monkeypatch):
    cases = spark.createDataFrame([(f"c{k}", f"p{k}", p, o) for k in range(6) for p, o in (("has", "offer"), ("has_also", "acceptance"), ("is" if k % 2 else "was", "enforceable"))], "case string, subject string, predicate string, object string")
    queries = spark.createDataFrame([("q1", "b", "is", "enforceable", [("b", "has", "offer"), ("b", "has_also", "acceptance")]), ("q2", "c", "is", "enforceable", [("c", "has", "offer")]), ("q3", "b", "is", "void", None)], contract.QUERY)
    held = sorted(map(tuple, analogy.analogical_answers(queries, cases).collect()))
    monkeypatch.setattr(analogy, "MAX_LIBRARY", 5)
    assert sorted(map(tuple, analogy.analogical_answers(queries, cases).collect())) == held and [r[0] for r in held] == ["q1"]


def test_special_reasoners_only_give_evidence(spark):
    rules = [Rule.parse("burning", "?x on_fire yes => ?x emits smoke")]
    ask = spark.createDataFrame([("q", "barn", "emits", "smoke", []), ("r", "barn", "emits", "light", [])], contract.QUERY)
    told = reasoners.Abducer(rules, of_rows(spark, [("x", "y", "z")])).answer_all(ask).withColumn("p", contract.provability()).collect()
    assert [(r["query_id"], r["p"], r["why"]) for r in told] == [("q", "Heuristic", ["assume barn|on_fire|yes", "by burning"])]
    traced = abduction.build_trace(abduction.test_all(reasoners.hypotheses_for(ask, rules), rules, of_rows(spark, [("x", "y", "z")])), rules, of_rows(spark, [("x", "y", "z")]))
    assert [r["trace_rule_ids"] for r in traced.collect()] == [["burning"]]
    none = reasoners.BayesianReasoner(spark.createDataFrame([], "h string, w double"), ["e"], spark.createDataFrame([], "evidence string, h string, l double")).answer_all(ask)
    assert none.collect() == []


def test_deontic_answers(spark):
    from lemmata.operators import deontic

    rules = deontic.obligations(spark.createDataFrame([("treat", "must", False, None, "a"), ("treat", "must-unless-documented", False, "fever", "a"), ("wait", None, True, None, "a")], "action_id string, required_behavior string, do_not_perform boolean, condition string, source_artifact string"))
    said = lambda *kinds: [("fever" if k == "active" else "treat", k, "true") for k in kinds]
    rows = [("1", "treat", "compliant_with", "a", said("proposed", "active")), ("2", "treat", "compliant_with", "a", said("active")), ("3", "wait", "compliant_with", "a", []), ("4", "treat", "compliant_with", "b", said("proposed")), ("5", "treat", "other", "a", said("proposed"))]
    got = reasoners.DeonticReasoner(rules).answer_all(spark.createDataFrame(rows, contract.QUERY)).withColumn("p", contract.provability()).collect()
    assert sorted((r["query_id"], r["p"]) for r in got) == [("1", "Proven"), ("3", "Proven")]


def test_percentiles_and_batteries(spark):
    rows = spark.createDataFrame([(float(k),) for k in (5, 1, 4, 2, 3, 9)], "v double")
    assert metrics.median(rows, "v").first()["value"] == 4.0 and metrics.percentile(rows, "v", 0.95).first()["value"] == 9.0 and metrics.median(rows.limit(0), "v").first()["value"] == 0.0
    rng = random.Random(3)
    many = [(rng.choice(["a", "b", None]), rng.choice([7.0, 7.0, float(rng.randrange(50)), None])) for _ in range(400)]
    frame = spark.createDataFrame(many, "g string, v double").repartition(3)
    for share in (0.0, 0.37, 0.5, 1.0):
        want = {g: (own := sorted(v for h, v in many if h == g and v is not None))[int((len(own) - 1) * share + 0.5)] for g in ("a", "b", None)}
        assert {r["g"]: r["value"] for r in metrics.percentile(frame, "v", share, ["g"]).collect()} == want
    posterior = spark.createDataFrame([("c", "x", 0.25), ("c", "y", 0.75)], "case string, h string, p double")
    golds = spark.createDataFrame([("c", "x", 0.2505), ("c", "y", 0.5), ("d", "x", 1.0)], "case string, h string, p double")
    assert metrics.bayes_battery(posterior, golds).select("cells", "agree").first() == (3, 1)


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://somewhere:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        tables.shared_dir(Session())


def test_ancestors_by_join(spark):
    from lemmata.functions.cql import Entity, evaluate

    code = "struct<system:string,code:string>"
    rows = spark.createDataFrame([(1, ("s", "leaf")), (2, ("s", "other")), (3, None)], f"id int, kind {code}")
    up = spark.createDataFrame([(("s", "leaf"), ("s", "mid")), (("s", "leaf"), ("s", "top"))], f"code {code}, ancestor {code}")
    got = evaluate(Entity(rows).with_ancestors("kind", up), top="Code('s', 'top') subsumes kind", own="Code('s', 'other') subsumes kind").collect()
    assert {r["id"]: (r["top"], r["own"]) for r in got} == {1: (True, False), 2: (False, True), 3: (None, None)}
    assert TRIPLE.startswith("struct")
