"""Answers by analogy: the best structure-preserving map of a known case onto a query.

Finding the map is NP-hard, so cases keep to ``max_entities`` entities.  The search is a
branch and bound over the case's facts that returns what exhaustive search would: most
facts preserved, then the smallest sorted list of pairs.  Queries are spread over tasks;
a library of up to ``MAX_LIBRARY`` facts is held by every task, and a larger one is joined
with the queries on the goal's predicate, which a case must hold to be of use.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16
MAX_LIBRARY = 100_000
#: Kinds of questions that a task remembers the answers of.
MAX_SHAPES = 10_000
ANSWER = "query_id string, subject string, predicate string, object string, case string, similarity double, supported int, mapping string"


@dataclass(frozen=True)
class AnalogyConfig:
    max_entities: int = 8
    min_aligned_relations: int = 2
    min_similarity: float = 0.5


@dataclass(frozen=True)
class Alignment:
    mapping: dict[str, str]
    supported: int
    total: int

    @property
    def similarity(self) -> float:
        return self.supported / self.total if self.total else 0.0


def best_alignment(case: Sequence[tuple], known: Sequence[tuple], targets: Sequence[str], cfg: AnalogyConfig = AnalogyConfig()) -> Alignment | None:
    """The best injective partial map of the case's entities; None if the case has too many."""
    source = sorted({e for s, _, o in case for e in (s, o)})
    if len(source) > cfg.max_entities:
        return None
    facts, targets = set(known), sorted(set(targets))
    place = {e: i for i, e in enumerate(source)}
    ready: list[list[tuple]] = [[] for _ in source]
    for s, p, o in case:
        ready[max(place[s], place[o])].append((s, p, o))
    after = [sum(map(len, ready[i:])) for i in range(len(source) + 1)]
    best: list = [-1, None]

    def visit(i: int, mapping: dict[str, str], score: int) -> None:
        if score + after[i] < best[0]:
            return
        if i == len(source):
            pairs = sorted(mapping.items())
            if score > best[0] or (score == best[0] and pairs < best[1]):
                best[:] = [score, pairs]
            return
        visit(i + 1, mapping, score)
        used = set(mapping.values())
        for t in targets:
            if t not in used:
                trial = {**mapping, source[i]: t}
                gain = sum((trial[s], p, trial[o]) in facts for s, p, o in ready[i] if s in trial and o in trial)
                visit(i + 1, trial, score + gain)

    visit(0, {}, 0)
    return Alignment(dict(best[1]), best[0], len(case))


def transfers(alignment: Alignment, case: Sequence[tuple], goal: tuple) -> bool:
    """Whether the map can be extended, one to one, so that a fact of the case lands on the goal."""
    for s, p, o in case:
        trial, ok = dict(alignment.mapping), p == goal[1]
        for k, v in ((s, goal[0]), (o, goal[2])):
            if k in trial:
                ok = ok and trial[k] == v
            else:
                ok = ok and v not in trial.values()
                trial[k] = v
        if ok:
            return True
    return False


def best_case(cases: Mapping[str, Sequence[tuple]], goal: tuple, context: Sequence[tuple], cfg: AnalogyConfig) -> tuple[str, Alignment] | None:
    if goal in context:
        return None
    entities = {e for s, _, o in context for e in (s, o)} | {goal[0], goal[2]}
    found = []
    for name in sorted(cases):
        a = best_alignment(cases[name], context, entities, cfg)
        if a and a.supported >= cfg.min_aligned_relations and a.similarity + EPSILON >= cfg.min_similarity and transfers(a, cases[name], goal):
            found.append((-a.similarity, name, a))
    return min(found, key=lambda x: x[:2])[1:] if found else None


class Shapes:
    """``best_case`` over one library, searched once for questions that differ only in their entities' names.

    Entities are replaced by their places in order, so that ties among equal maps fall as they would by name.
    """

    def __init__(self, cases: Mapping[str, Sequence[tuple]], cfg: AnalogyConfig):
        self.cases, self.cfg, self.known = cases, cfg, {}

    def best(self, goal: tuple, context: Sequence[tuple]) -> tuple[str, Alignment] | None:
        names = sorted({e for s, _, o in (*context, goal) for e in (s, o)})
        place = {e: i for i, e in enumerate(names)}
        apart = lambda t: (place[t[0]], t[1], place[t[2]])
        key = apart(goal), frozenset(map(apart, context))
        if key not in self.known:
            if len(self.known) >= MAX_SHAPES:
                self.known.clear()
            self.known[key] = best_case(self.cases, key[0], list(key[1]), self.cfg)
        hit = self.known[key]
        return hit and (hit[0], Alignment({k: names[v] for k, v in hit[1].mapping.items()}, hit[1].supported, hit[1].total))


def analogical_answers(queries: DataFrame, cases: DataFrame, cfg: AnalogyConfig = AnalogyConfig()) -> DataFrame:
    """Answers to queries (query_id, subject, predicate, object, context array of triples) from cases (case, subject, predicate, object)."""
    held = cases.select("case", "subject", "predicate", "object").limit(MAX_LIBRARY + 1).collect()
    if len(held) > MAX_LIBRARY:
        return _from_large_library(queries, cases, cfg)
    library: dict[str, list[tuple]] = {}
    for name, *fact in held:
        library.setdefault(name, []).append(tuple(fact))

    def run(frames):
        shapes = Shapes(library, cfg)
        for f in frames:
            rows = []
            for q in f.itertuples(index=False):
                context = [(c["subject"], c["predicate"], c["object"]) for c in (q.context if q.context is not None else [])]
                hit = shapes.best((q.subject, q.predicate, q.object), context)
                if hit:
                    name, a = hit
                    rows.append((q.query_id, q.subject, q.predicate, q.object, name, a.similarity, a.supported, ",".join(f"{k}>{v}" for k, v in sorted(a.mapping.items()))))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWER.split(", ")])

    return queries.select("query_id", "subject", "predicate", "object", "context").mapInPandas(run, ANSWER)


def _from_large_library(queries: DataFrame, cases: DataFrame, cfg: AnalogyConfig) -> DataFrame:
    """The same answers where the library is too large to hold: only cases with a fact of the goal's predicate can transfer it, so these meet the query."""
    fact = F.struct("subject", "predicate", "object")
    whole = cases.groupBy("case").agg(F.array_sort(F.collect_set(fact)).alias("facts"))
    keyed = whole.select("case", "facts", F.explode(F.array_distinct(F.transform("facts", lambda f: f["predicate"]))).alias("predicate"))
    met = queries.select("query_id", "subject", "predicate", "object", "context").join(keyed, "predicate")
    triples = lambda x: [] if x is None else [(c["subject"], c["predicate"], c["object"]) for c in x]

    def run(frames):
        for f in frames:
            rows = []
            for q in f.itertuples(index=False):
                hit = best_case({q.case: triples(q.facts)}, (q.subject, q.predicate, q.object), triples(q.context), cfg)
                if hit:
                    name, a = hit
                    rows.append((q.query_id, q.subject, q.predicate, q.object, name, a.similarity, a.supported, ",".join(f"{k}>{v}" for k, v in sorted(a.mapping.items()))))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWER.split(", ")])

    best = F.min(F.struct((-F.col("similarity")).alias("s"), "case", "similarity", "supported", "mapping")).alias("_b")
    return met.mapInPandas(run, ANSWER).groupBy("query_id", "subject", "predicate", "object").agg(best).select("query_id", "subject", "predicate", "object", "_b.case", "_b.similarity", "_b.supported", "_b.mapping")
