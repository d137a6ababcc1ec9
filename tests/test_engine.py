"""The rule engine against a naive one over Python sets, and its proofs against their laws."""

import random

import pytest

from lemmata.operators import gate, provenance
from lemmata.plans import clauses
from lemmata.plans.compiler import conjunction, delta_conjunction, fire_rule
from lemmata.plans.fixpoint import saturate, saturate_more
from lemmata.plans.terms import Pattern, Rule, Substitution, Term, Triple, match_conjunction, naive_closure, unify
from lemmata.plans.terms import fire_rule as fire_naive
from lemmata.sources.triples import SPO, of_rows

ANCESTOR = [Rule.parse("base", "?x parent ?y => ?x ancestor ?y"), Rule.parse("step", "?x parent ?y, ?y ancestor ?z => ?x ancestor ?z")]


def facts_of(sat):
    return {Triple(*r[:3]): r[3] for r in sat.facts.select(*SPO, "round").collect()}


def random_facts(rng, n):
    return [Triple(f"e{rng.randrange(4)}", f"p{rng.randrange(3)}", f"e{rng.randrange(4)}") for _ in range(n)]


def random_pattern(rng):
    term = lambda kind, n: f"?{rng.choice('xyz')}" if rng.random() < 0.6 else f"{kind}{rng.randrange(n)}"
    return Pattern.parse(f"{term('e', 4)} {'?p' if rng.random() < 0.2 else f'p{rng.randrange(3)}'} {term('e', 4)}")


def test_unification():
    s = unify(Pattern.parse("?x p ?x"), Pattern.parse("a ?q ?y"))
    assert s.get_const("y") == "a" and s.get_const("q") == "p" and str(s.apply(Pattern.parse("?y r ?z"))) == "a r ?z"
    assert unify(Pattern.parse("?x p ?x"), Pattern.parse("a p b")) is None and Substitution().ground(Pattern.parse("a b ?c")) is None
    assert Term.parse("?x").is_var and Pattern.parse("?x ?p ?x").variables() == ["x", "p"] and Rule.parse("r", "?x a ?y => ?z b ?w").unsafe_head_vars() == ["w", "z"]


@pytest.mark.parametrize("seed", range(4))
def test_conjunctions(spark, seed):
    rng = random.Random(seed)
    facts, body = list(dict.fromkeys(random_facts(rng, 18))), [random_pattern(rng) for _ in range(1 + seed % 3)]
    names = sorted({v for p in body for v in p.variables()})
    want = sorted(tuple(s.get_const(v) for v in names) for s in match_conjunction(body, facts))
    df = of_rows(spark, facts)
    assert sorted(tuple(r[f"v_{v}"] for v in names) for r in conjunction([df] * len(body), body).collect()) == want
    late = df.where("predicate = 'p0'")
    got = {tuple(r[f"v_{v}"] for v in names) for r in delta_conjunction(df, late, body).collect()}
    assert got == {tuple(s.get_const(v) for v in names) for s in match_conjunction(body, facts) if any(s.ground(p).predicate == "p0" for p in body)}
    rule = Rule("r", tuple(body), (Pattern(Term.var(names[0]), Term.con("new"), Term.con("e1")),)) if names else Rule("r", tuple(body), (Pattern.parse("a new b"),))
    assert {Triple(*r) for r in fire_rule(rule, df).collect()} == set(fire_naive(rule, facts))


@pytest.mark.parametrize("seed", range(4))
def test_random_rule_sets(spark, seed):
    rng = random.Random(100 + seed)
    rules = []
    for k in range(1 + seed % 3):
        body = [random_pattern(rng) for _ in range(1 + rng.randrange(2))]
        names = [v for p in body for v in p.variables() if v != "p"] or ["q"]
        rules.append(Rule(f"r{k}", tuple(body), (Pattern(Term.var(rng.choice(names)), Term.con(f"p{rng.randrange(3)}"), Term.var(rng.choice(names))),)))
    seed_facts = random_facts(rng, 8)
    sat = saturate(rules, of_rows(spark, seed_facts))
    rounds, _ = naive_closure(rules, seed_facts)
    assert facts_of(sat) == rounds
    assert sat.broken_premises().isEmpty() and provenance.ungrounded(provenance.measures(sat)).isEmpty()
    split = saturate_more(saturate(rules, of_rows(spark, seed_facts[:4])), rules, of_rows(spark, seed_facts[4:]))
    assert set(facts_of(split)) == set(rounds)


def test_cycle_empty_body_unsafe_head_and_contexts(spark):
    cycle = of_rows(spark, [("a", "parent", "b"), ("b", "parent", "a")])
    assert set(facts_of(saturate(ANCESTOR, cycle))) == set(naive_closure(ANCESTOR, [("a", "parent", "b"), ("b", "parent", "a")])[0])
    odd = [Rule.parse("always", "=> sun is hot"), Rule.parse("loose", "?x parent ?y => ?x kin ?w")]
    sat = saturate(odd, cycle)
    got = {(r["subject"], r["premises"] is not None and len(r["premises"])) for r in sat.derivations.collect()}
    assert got == {("sun", 0)}
    assert [r["complete"] for r in provenance.measures(sat).where("subject = 'sun'").collect()] == [False]
    apart = spark.createDataFrame([("1", "a", "parent", "b"), ("2", "b", "parent", "c")], "ctx string, subject string, predicate string, object string")
    rows = saturate(ANCESTOR, apart).derivations.collect()
    assert {(r["ctx"], r["subject"], r["object"]) for r in rows} == {("1", "a", "b"), ("2", "b", "c")}
    assert saturate(ANCESTOR, cycle.limit(0)).rows.isEmpty()


def test_proofs_and_gate(spark):
    sat = saturate(ANCESTOR, of_rows(spark, [(x, "parent", y) for x, y in zip("abc", "bcd", strict=True)]))
    rows = {(r["subject"], r["object"]): r for r in provenance.measures(sat).where("predicate = 'ancestor'").collect()}
    assert len(rows) == 6
    r = rows["a", "d"]
    assert (r["depth"], r["node_count"], r["rule_ids"], r["trace_rule_ids"], len(r["leaves"])) == (3, 6, ["step", "step", "base"], ["base", "step", "step"], 3)
    assert r["proof"].split("\n")[:2] == ["a ancestor d  (by step)", "  [axiom] a parent b"]
    claims = of_rows(spark, [("a", "ancestor", "c"), ("a", "parent", "b"), ("d", "ancestor", "a")])
    shown = {r["subject"] + r["object"]: r for r in provenance.surface(sat, claims).collect()}
    assert shown["ac"]["provable"] and shown["ac"]["step_count"] == 2 and shown["ab"]["step_count"] == 0 and not shown["da"]["provable"]
    gated = gate.gate(sat, claims, with_proof=True).collect()
    assert sorted(r["verdict"] for r in gated) == ["PROVEN", "PROVEN", "UNPROVEN"]
    assert gate.summarize(gate.gate(sat, claims)).first().asDict() == {"proven": 2, "unproven": 1}
    assert provenance.proof_edges(sat, claims).count() == 3


def test_gold_cases(spark):
    """Rules and facts of three recommendation cases, with what must and mustn't follow."""
    rules = [
        Rule.parse("risk", "?p has_condition ?c, ?c increases_fall_risk true => ?p at_risk fall"), Rule.parse("assess", "?p at_risk fall, ?p age_band over_65 => ?p recommend fall_assessment"),
        Rule.parse("renal", "?p renal_function adequate => ?p recommend metformin"),
    ]
    seed = [("patient1", "has_condition", "osteoporosis"), ("patient2", "has_condition", "osteoporosis"), ("osteoporosis", "increases_fall_risk", "true"), ("patient1", "age_band", "over_65"), ("patient3", "renal_function", "impaired"), ("patient4", "renal_function", "adequate")]
    got = {tuple(r)[:3] for r in saturate(rules, of_rows(spark, seed)).derivations.select(*SPO).collect()}
    assert got == {("patient1", "at_risk", "fall"), ("patient2", "at_risk", "fall"), ("patient1", "recommend", "fall_assessment"), ("patient4", "recommend", "metformin")}


def test_route_and_clauses():
    assert gate.predicates_of_rules(ANCESTOR) == ({"parent", "ancestor"}, False)
    assert gate.predicates_of_rules([Rule.parse("any", "?x ?p ?y => ?y ?p ?x")])[1]
    for kind, args in (("EmptyId", (" ", ["a b c"], ["a b c"])), ("Empty", ("r", [], ["a b c"])), ("MalformedPattern", ("r", ["a b"], ["a b c"])), ("UnsafeHead", ("r", ["?x b c"], ["?y b c"]))):
        with pytest.raises(clauses.CompileError) as e:
            clauses.compile_rule(*args)
        assert e.value.kind == kind
    with pytest.raises(clauses.CompileError, match="InvalidCondition"):
        clauses.compile_plan("p", "t", "a <", "x", "y")
    rules, plans = clauses.compile_bundle([("r", ["?x p ?y"], ["?y q ?x"])], [("p", "t", "a < 3", "x", "y", True)])
    assert len(rules) == 1 and plans[0].actions[0].action.do_not_perform


def test_bundle_keeps_prohibitions():
    from lemmata.operators.plandef import hypertension_guideline
    from lemmata.queries import PLAN

    bundle = clauses.Bundle(tuple(ANCESTOR), (hypertension_guideline(), PLAN), (clauses.ValueSet("V", (("s", "1"), ("s", "2"))),))
    facts = clauses.reify(bundle)
    random.Random(1).shuffle(facts)
    assert clauses.dereify([*facts, Triple("x", "y", "z")]) == bundle
    with pytest.raises(clauses.DereifyError):
        clauses.dereify([f for f in facts if f.predicate != clauses.INDEX])


def test_streaming_maintenance(spark, tmp_path):
    from lemmata.streaming.incremental import Maintained

    of_rows(spark, [("b", "parent", "c")]).write.parquet(str(tmp_path / "in"))
    kept = Maintained(ANCESTOR, of_rows(spark, [("a", "parent", "b")]))
    q = kept.follow(spark.readStream.schema("subject string, predicate string, object string").parquet(str(tmp_path / "in")), str(tmp_path / "ck"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {(r["subject"], r["object"]) for r in kept.now.derivations.collect()} == {("a", "b"), ("b", "c"), ("a", "c")}


def test_tsv(spark, tmp_path):
    from lemmata.sources.tables import read_tsv, write_tsv

    write_tsv(of_rows(spark, [("a", "b", "c d")]), str(tmp_path / "t"))
    assert [tuple(r) for r in read_tsv(spark, str(tmp_path / "t"), list(SPO)).collect()] == [("a", "b", "c d")]


def test_rounds_and_triples(spark):
    sat = saturate(ANCESTOR, of_rows(spark, [("a", "parent", "b"), ("b", "parent", "c")]))
    listed = list(sat.triples())
    assert sat.size() == len(listed) == 5 and listed[:2] == [Triple("a", "parent", "b"), Triple("b", "parent", "c")]
    assert [tuple(r) for r in sat.of_round(2).collect()] == [("a", "ancestor", "c", 2)]
