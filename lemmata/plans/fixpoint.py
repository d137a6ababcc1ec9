"""Rules to a fixpoint: semi-naive rounds over DataFrames, each written as a table.

Each round joins the facts of the last round with all facts so far, drops what is known
by an anti-join, and keeps one derivation per new fact: the smallest by rule order and
premises, found by an aggregate that combines before the shuffle.  A round is one
directory, ``round=N``, of one table, so lineage stays one round long and a lost executor
costs one round at most.  A fact's round is the same as under naive evaluation.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.tables import new_path
from ..sources.triples import SPO, TRIPLE
from .compiler import CTX, conjunction, heads, keys_of, var
from .terms import Rule, Triple

STORE = f"subject string, predicate string, object string, rule_id string, premises array<{TRIPLE}>, round int"
#: Increments share the files of the run before; after so many the store is written anew.
MOST_PATHS = 32


def _schema(keys: Sequence[str]) -> str:
    return f"ctx string, {STORE}" if CTX in keys else STORE


@dataclass(frozen=True)
class Saturation:
    """``rows`` of (subject, predicate, object, rule_id, premises, round); rule_id is null for given facts.

    ``complete`` is false if the run ended at its limit of rounds.  With ``base``, the rows are those that each context adds to
    the facts of ``base``, which hold in all contexts.
    """

    rows: DataFrame
    rounds: int
    paths: tuple[str, ...]
    complete: bool = True
    base: Saturation | None = None

    @property
    def facts(self) -> DataFrame:
        return self.rows.select(*SPO, "round")

    @property
    def derivations(self) -> DataFrame:
        return self.rows.where("rule_id IS NOT NULL")

    def of_round(self, n: int) -> DataFrame:
        """The facts that round ``n`` added; round 0 holds the given ones."""
        return self.facts.where(F.col("round") == n)

    def size(self) -> int:
        return self.rows.count()

    def triples(self) -> Iterator[Triple]:
        """All facts on the driver, by round and then in order, one partition held at a time; for small results and tests."""
        for r in self.facts.orderBy("round", *SPO).toLocalIterator():
            yield Triple(*(r[c] for c in SPO))

    def contains(self, claims: DataFrame) -> DataFrame:
        return claims.join(self.rows.select(*SPO), list(SPO), "left_semi")

    def derivation_of(self, claims: DataFrame) -> DataFrame:
        """The derivation of each claim that was derived."""
        return claims.select(*SPO).join(self.derivations, list(SPO))

    def derived_count(self) -> int:
        return self.derivations.count()

    def broken_premises(self) -> DataFrame:
        """Premises that are no facts of an earlier round; empty unless the store was damaged."""
        used = self.derivations.select("round", F.explode("premises").alias("p")).select("p.*", F.col("round").alias("_r"))
        known = self.rows.select(*SPO, F.col("round").alias("_k"))
        return used.join(known, list(SPO), "left").where("_k IS NULL OR _k >= _r").select(*SPO)


def _feeds(rule: Rule, made: set[str | None] | None, i: int) -> bool:
    """Whether atom i can match a fact whose predicate is in ``made`` (None: any)."""
    p = rule.lhs[i].predicate
    return made is None or None in made or p.is_var or p.name in made


def saturate(rules: Sequence[Rule], seed: DataFrame, max_rounds: int | None = None) -> Saturation:
    """All facts that follow from ``seed``, an axiom table of (subject, predicate, object); with a column ctx, those of each context from its own axioms.

    ``max_rounds`` ends the run early; the result then says that it isn't complete.
    """
    spark = seed.sparkSession
    path, keys = new_path(spark, "saturation"), keys_of(seed)
    _write(_given(seed.select(*keys).distinct()), path, 0)
    return _run(spark, rules, (), path, 0, True, max_rounds, keys)


def saturate_more(prior: Saturation, rules: Sequence[Rule], added: DataFrame, max_rounds: int | None = None) -> Saturation:
    """``prior`` and what follows from new axioms besides: the first delta is what is new among them.

    The rounds of ``prior`` are read where they are; only new rounds are written.  Rules with an empty body don't fire here;
    they have fired in the prior run.  A prior run with contexts takes axioms with a context.
    """
    spark, keys = added.sparkSession, keys_of(prior.rows)
    path, paths = new_path(spark, "saturation"), prior.paths
    if len(paths) >= MOST_PATHS:
        whole = new_path(spark, "saturation")
        prior.rows.write.partitionBy("round").parquet(whole)
        paths = (whole,)
    new = added.select(*keys).distinct().join(prior.rows.select(*keys), keys, "left_anti")
    _write(_given(new), path, prior.rounds + 1)
    return _run(spark, rules, paths, path, prior.rounds + 1, False, max_rounds, keys)


def saturate_contexts(base: Saturation, rules: Sequence[Rule], seeds: DataFrame, max_rounds: int | None = None) -> Saturation:
    """What each context of ``seeds`` (ctx, subject, predicate, object) adds to ``base``: one fixpoint of the contexts' own facts.

    The facts of ``base`` are joined as they are and never copied per context.
    """
    spark, keys = seeds.sparkSession, [CTX, *SPO]
    path = new_path(spark, "saturation")
    _write(_given(seeds.select(*keys).distinct().join(base.rows.select(*SPO), list(SPO), "left_anti")), path, base.rounds + 1)
    return _run(spark, rules, (), path, base.rounds + 1, False, max_rounds, keys, base)


def _given(facts: DataFrame) -> DataFrame:
    return facts.withColumns({"rule_id": F.lit(None).cast("string"), "premises": F.lit(None).cast(f"array<{TRIPLE}>")})


def _write(rows: DataFrame, path: str, n: int) -> int:
    """Write a round; how many rows it has."""
    seen = Observation()
    rows.drop("round").observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/round={n}")
    return seen.get["n"]


def _read(spark, schema: str, paths: Sequence[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, (spark.read.schema(schema).parquet(p) for p in paths))


def _run(spark, rules, before, path, begin, fire_empty, max_rounds, keys, base=None) -> Saturation:
    schema = _schema(keys)
    read = lambda: _read(spark, schema, (*before, path))
    shared = base.rows.select(*SPO) if base else None
    made: set[str | None] | None = None
    n, complete = begin, False
    while max_rounds is None or n - begin < max_rounds:
        facts = read().select(*keys)
        delta = spark.read.schema(schema).parquet(f"{path}/round={n}").select(*keys)
        parts, next_made = [], set()
        for k, rule in enumerate(rules):
            if not rule.lhs:
                if fire_empty and n == begin:
                    parts.append(heads(facts.select(F.col(CTX).alias(var(CTX))).distinct() if CTX in keys else spark.range(1).select(), rule, k))
                    next_made |= {h.predicate.as_const() for h in rule.rhs}
                continue
            for i in range(len(rule.lhs)):
                if not _feeds(rule, made, i):
                    continue
                bound = conjunction([delta if j == i else facts for j in range(len(rule.lhs))], rule.lhs, premises=True, first=i, shared=shared)
                parts.append(heads(bound, rule, k))
                next_made |= {h.predicate.as_const() for h in rule.rhs}
        parts = [p for p in parts if p is not None]
        if not parts:
            complete = True
            break
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        best = found.groupBy(*keys).agg(F.min(F.struct("rule_ord", "premises", "rule_id")).alias("_d")).select(*keys, "_d.rule_id", "_d.premises")
        new = best.join(facts, keys, "left_anti")
        if base:
            new = new.join(shared, list(SPO), "left_anti")
        if not _write(new, path, n + 1):
            complete = True
            break
        n += 1
        made = next_made
    return Saturation(read(), n, (*before, path), complete, base)
