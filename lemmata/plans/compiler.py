"""Compiles patterns and rules to DataFrame plans.

Facts may carry a column ``ctx``: then every join is within a context, so one run answers
for many seeds at once.  A binding is a row with one column per variable.  A pattern is a filter and a projection
over the facts; a body is a chain of equi-joins on shared variables, in an order in which
each atom shares a variable with those before it where that is possible, so that a cross
product appears only where the rule asks for one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.triples import SPO
from .terms import Pattern, Rule


CTX = "ctx"


def keys_of(facts: DataFrame) -> list[str]:
    """What tells facts apart: the triple, and the context if there is one."""
    return [CTX, *SPO] if CTX in facts.columns else list(SPO)


def var(name: str) -> str:
    return f"v_{name}" if name != CTX else "v_/ctx"


def scan(facts: DataFrame, p: Pattern, premise: str | None = None) -> DataFrame:
    """Bindings of one pattern; ``premise`` names a column that keeps the matched fact."""
    where, seen, columns = None, {}, []
    for column, term in zip(SPO, p, strict=True):
        if not term.is_var:
            test = F.col(column) == term.name
        elif term.name in seen:
            test = F.col(column) == F.col(seen[term.name])
        else:
            seen[term.name] = column
            columns.append(F.col(column).alias(var(term.name)))
            continue
        where = test if where is None else where & test
    if CTX in facts.columns:
        columns.append(F.col(CTX).alias(var(CTX)))
    rows = facts if where is None else facts.where(where)
    return rows.select(*columns, *([F.struct(*SPO).alias(premise)] if premise else []))


def join_order(body: Sequence[Pattern], first: int | None = None) -> list[int]:
    """Atom numbers, connected ones first; ``first`` starts."""
    left, order, bound = list(range(len(body))), [], set()
    while left:
        if not order and first is not None:
            pick = first
        else:
            score = lambda i: (len(bound & set(body[i].variables())), sum(not t.is_var for t in body[i]), -i)
            pick = max(left, key=score)
        left.remove(pick)
        order.append(pick)
        bound |= set(body[pick].variables())
    return order


def _meet(out: DataFrame, side: DataFrame) -> DataFrame:
    common = [c for c in side.columns if c in out.columns and c.startswith("v_")]
    return out.join(side, common) if common else out.crossJoin(side)


def conjunction(frames: Sequence[DataFrame], body: Sequence[Pattern], premises: bool = False, first: int | None = None, shared: DataFrame | None = None) -> DataFrame:
    """Solutions of ``body``, where atom i reads ``frames[i]``; a multiset.

    All atoms but the first also match the facts of ``shared``, which have no context and hold in each.
    """
    out = None
    for i in join_order(body, first):
        kept = f"p_{i}" if premises else None
        side = scan(frames[i], body[i], kept)
        if out is None:
            out = side
            continue
        both = _meet(out, side)
        if shared is not None:
            both = both.unionByName(_meet(out, scan(shared, body[i], kept)))
        out = both
    return out


def delta_conjunction(facts: DataFrame, delta: DataFrame, body: Sequence[Pattern]) -> DataFrame:
    """Solutions that use a fact of ``delta`` in some place; nothing for an empty body; not deduplicated."""
    parts = [conjunction([delta if j == i else facts for j in range(len(body))], body, first=i) for i in range(len(body))]
    if not parts:
        return facts.limit(0).select()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def heads(bindings: DataFrame, rule: Rule, ord_: int) -> DataFrame | None:
    """(subject, predicate, object, rule_ord, rule_id, premises) of the heads that the body binds; None if it binds none of them."""
    unsafe = set(rule.unsafe_head_vars())
    out = None
    premises = F.array(*(F.col(f"p_{i}") for i in range(len(rule.lhs)))) if rule.lhs else F.expr("cast(array() as array<struct<subject:string,predicate:string,object:string>>)")
    for head in rule.rhs:
        if unsafe & set(head.variables()):
            continue
        term = [F.col(var(t.name)) if t.is_var else F.lit(t.name) for t in head]
        context = [F.col(var(CTX)).alias(CTX)] if var(CTX) in bindings.columns else []
        part = bindings.select(*context, *(t.alias(c) for t, c in zip(term, SPO, strict=True)), F.lit(ord_).alias("rule_ord"), F.lit(rule.id).alias("rule_id"), premises.alias("premises"))
        out = part if out is None else out.unionByName(part)
    return out


def fire_rule(rule: Rule, facts: DataFrame) -> DataFrame:
    """The heads that one step of one rule adds to ``facts``, each once."""
    bindings = conjunction([facts] * len(rule.lhs), rule.lhs, premises=True) if rule.lhs else facts.sparkSession.range(1).select()
    found = heads(bindings, rule, 0)
    keys = keys_of(facts)
    return (facts.limit(0) if found is None else found).select(*keys).distinct().join(facts, keys, "left_anti")
