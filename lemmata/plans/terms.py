"""Terms, patterns, rules and substitutions: the driver-side description of a rule set."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple


class Triple(NamedTuple):
    subject: str
    predicate: str
    object: str


@dataclass(frozen=True)
class Term:
    """A variable or a constant."""

    name: str
    is_var: bool = False

    @classmethod
    def parse(cls, text: str) -> Term:
        return cls(text[1:], True) if text.startswith("?") else cls(text)

    @classmethod
    def var(cls, name: str) -> Term:
        return cls(name, True)

    @classmethod
    def con(cls, name: str) -> Term:
        return cls(name)

    def as_const(self) -> str | None:
        return None if self.is_var else self.name

    def __str__(self) -> str:
        return f"?{self.name}" if self.is_var else self.name


@dataclass(frozen=True)
class Pattern:
    subject: Term
    predicate: Term
    object: Term

    @classmethod
    def parse(cls, text: str) -> Pattern:
        return cls(*map(Term.parse, text.split()))

    def __iter__(self) -> Iterator[Term]:
        return iter((self.subject, self.predicate, self.object))

    def variables(self) -> list[str]:
        """Names in subject, predicate, object order, each once."""
        return list(dict.fromkeys(t.name for t in self if t.is_var))

    def is_ground(self) -> bool:
        return not any(t.is_var for t in self)

    def __str__(self) -> str:
        return " ".join(map(str, self))


@dataclass(frozen=True)
class Rule:
    """``lhs`` (all of it) gives ``rhs`` (all of it)."""

    id: str
    lhs: tuple[Pattern, ...]
    rhs: tuple[Pattern, ...]

    @classmethod
    def parse(cls, id: str, text: str) -> Rule:
        """``a p b, b p c => a q c``; nothing before the arrow is an empty body."""
        body, head = text.split("=>")
        read = lambda part: tuple(Pattern.parse(x) for x in part.split(",") if x.strip())
        return cls(id, read(body), read(head))

    def unsafe_head_vars(self) -> list[str]:
        bound = {v for p in self.lhs for v in p.variables()}
        return sorted({v for p in self.rhs for v in p.variables()} - bound)


@dataclass
class Substitution:
    """Bindings of variables to terms; ``walk`` follows chains of variables."""

    bindings: dict[str, Term] = field(default_factory=dict)

    def __len__(self) -> int:
        return len(self.bindings)

    def walk(self, t: Term) -> Term:
        while t.is_var and t.name in self.bindings:
            t = self.bindings[t.name]
        return t

    def get_const(self, name: str) -> str | None:
        return self.walk(Term.var(name)).as_const()

    def apply(self, p: Pattern) -> Pattern:
        """``p`` with what is bound; free variables stay."""
        return Pattern(*map(self.walk, p))

    def ground(self, p: Pattern) -> Triple | None:
        q = self.apply(p)
        return Triple(*(t.name for t in q)) if q.is_ground() else None

    def extended(self, a: Term, b: Term) -> Substitution | None:
        a, b = self.walk(a), self.walk(b)
        if a == b:
            return self
        if not a.is_var:
            a, b = b, a
        return Substitution({**self.bindings, a.name: b}) if a.is_var else None


def unify(a: Pattern, b: Pattern, base: Substitution | None = None) -> Substitution | None:
    """The most general unifier of two flat patterns that extends ``base``."""
    s = base or Substitution()
    for x, y in zip(a, b, strict=True):
        s = s.extended(x, y)
        if s is None:
            return None
    return s


def match_triple(p: Pattern, fact: Triple, base: Substitution | None = None) -> Substitution | None:
    return unify(p, Pattern(*map(Term.con, fact)), base)


def match_pattern(p: Pattern, facts: Iterable[Triple], base: Substitution | None = None) -> list[Substitution]:
    return [s for f in facts if (s := match_triple(p, f, base)) is not None]


def match_conjunction(patterns: Iterable[Pattern], facts: Iterable[Triple]) -> list[Substitution]:
    """All solutions; one empty solution for no patterns."""
    facts, out = list(facts), [Substitution()]
    for p in patterns:
        out = [t for s in out for t in match_pattern(p, facts, s)]
    return out


def fire_rule(rule: Rule, facts: Iterable[Triple]) -> list[Triple]:
    """The heads that one step adds, each once."""
    facts = list(facts)
    heads = (s.ground(h) for s in match_conjunction(rule.lhs, facts) for h in rule.rhs)
    return list(dict.fromkeys(h for h in heads if h is not None and h not in set(facts)))


def naive_closure(rules: Iterable[Rule], seed: Iterable[Triple]) -> tuple[dict[Triple, int], dict[Triple, tuple[str, tuple[Triple, ...]]]]:
    """(round of each fact, a derivation of each derived fact) by naive rounds over Python sets: the slow reference for tests and small jobs."""
    rounds = dict.fromkeys(map(lambda t: Triple(*t), seed), 0)
    why: dict[Triple, tuple[str, tuple[Triple, ...]]] = {}
    n = 0
    while True:
        n += 1
        new: dict[Triple, tuple[str, tuple[Triple, ...]]] = {}
        for rule in rules:
            for s in match_conjunction(rule.lhs, rounds):
                for head in rule.rhs:
                    fact = s.ground(head)
                    if fact is not None and fact not in rounds and fact not in new:
                        new[fact] = (rule.id, tuple(s.ground(p) for p in rule.lhs))
        if not new:
            return rounds, why
        rounds |= dict.fromkeys(new, n)
        why |= new
