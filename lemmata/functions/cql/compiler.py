"""Compiles expressions to Columns over a wide table of entities.

Types are known from the table's schema, so a misfit raises when the expression is
compiled, not while rows are read.  A path is a column; an array column holds a path of
many values: no value is null, one is that value, more are a list.  Numbers, integers and
date-times compare as doubles with one machine epsilon of slack.  Logic is Kleene's,
which is what Spark's own ``and``, ``or`` and ``not`` do.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .parser import CqlTypeError, Items, Lit, Op, Path, parse

EPSILON = 2.220446049250313e-16
NUMERIC = {"integer", "decimal", "datetime"}


@dataclass
class Entity:
    """What paths mean: the columns of ``frame`` (dots in paths are underscores), value sets, and a column test for subsumption.

    ``kinds`` overrides the kind of a path, e.g. datetime for a long.  What a code is subsumed by is either listed in
    ``ancestors``, for small hierarchies, or stands in the column that ``lineage`` names for its path (``with_ancestors``).
    """

    frame: DataFrame
    value_sets: Mapping[str, Sequence[tuple[str, str]]] = field(default_factory=dict)
    ancestors: Mapping[tuple[str, str], Sequence[tuple[str, str]]] | None = None
    kinds: Mapping[str, str] = field(default_factory=dict)
    lineage: Mapping[str, str] = field(default_factory=dict)

    def with_ancestors(self, path: str, hierarchy: DataFrame) -> Entity:
        """The entity with the ancestors of the code under ``path``, joined from a closed ``hierarchy`` of rows (code, ancestor), both structs (system, code)."""
        column = path.replace(".", "_")
        name = f"_{column}_ancestors"
        up = hierarchy.groupBy(F.col("code").alias(f"_{column}_code")).agg(F.collect_set("ancestor").alias(name))
        joined = self.frame.join(up, F.col(column) == F.col(f"_{column}_code"), "left").drop(f"_{column}_code")
        return replace(self, frame=joined, lineage={**self.lineage, path: name})


@dataclass(frozen=True)
class Typed:
    """A compiled expression: its column, the kind of its scalar, and whether it is an array column of a path."""

    column: Column
    kind: str
    many: bool = False
    literal: Lit | None = None


def _kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return "integer"
    if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "decimal"
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.StructType):
        return {"system,code": "code", "low,high": "interval", "value,unit": "quantity"}.get(",".join(t.names), "struct")
    raise CqlTypeError(f"no kind for {t.simpleString()}")


def _literal(x: Lit) -> Typed:
    if x.kind == "code":
        c = F.struct(F.lit(x.value[0]).alias("system"), F.lit(x.value[1]).alias("code"))
    elif x.kind == "quantity":
        c = F.struct(F.lit(x.value[0]).alias("value"), F.lit(x.value[1]).alias("unit"))
    elif x.kind == "interval":
        low, high = (_literal(v) for v in x.value)
        if {low.kind, high.kind} - NUMERIC:
            raise CqlTypeError("an interval needs numbers or date-times")
        c = F.struct(low.column.cast("double").alias("low"), high.column.cast("double").alias("high"))
    else:
        c = F.lit(x.value)
    return Typed(c, x.kind, literal=x)


class _Compiler:
    def __init__(self, entity: Entity):
        self.entity = entity

    def of(self, e) -> Typed:
        if isinstance(e, Lit):
            return _literal(e)
        if isinstance(e, Path):
            return self.path(e.name)
        if isinstance(e, Items):
            raise CqlTypeError("a list stands only on the right of 'in' or of '='")
        return getattr(self, {"=": "equal", "!=": "unequal", "<": "order", "<=": "order", ">": "order", ">=": "order", "in": "member", "before": "temporal", "after": "temporal", "during": "temporal", "overlaps": "temporal"}.get(e.name, f"op_{e.name}"))(e)

    def path(self, name: str) -> Typed:
        column = name if name in self.entity.frame.columns else name.replace(".", "_")
        if column not in self.entity.frame.columns:
            return Typed(F.lit(None), "null")
        kind = self.entity.frame.schema[column].dataType
        if isinstance(kind, T.ArrayType):
            return Typed(F.col(f"`{column}`"), self.entity.kinds.get(name, _kind_of(kind.elementType)), True)
        return Typed(F.col(f"`{column}`"), self.entity.kinds.get(name, _kind_of(kind)))

    def scalar(self, x: Typed, what: str) -> Typed:
        """``x`` where it holds one value; a list of more raises when it is read."""
        if not x.many:
            return x
        one = F.when(F.size(x.column) == 1, x.column[0]).when(F.size(x.column) > 1, F.raise_error(F.lit(f"{what} of a list")))
        return Typed(one, x.kind)

    def truth(self, e) -> Column:
        x = self.of(e)
        if x.kind not in ("boolean", "null"):
            raise CqlTypeError(f"a {x.kind} is no truth value")
        return self.scalar(x, "truth").column.cast("boolean")

    def op_exists(self, e: Op) -> Typed:
        x = self.of(e.args[0])
        return Typed(F.coalesce(F.exists(x.column, lambda v: v.isNotNull()), F.lit(False)) if x.many else x.column.isNotNull(), "boolean")

    def op_not(self, e: Op) -> Typed:
        return Typed(~self.truth(e.args[0]), "boolean")

    def op_and(self, e: Op) -> Typed:
        return Typed(self.truth(e.args[0]) & self.truth(e.args[1]), "boolean")

    def op_or(self, e: Op) -> Typed:
        return Typed(self.truth(e.args[0]) | self.truth(e.args[1]), "boolean")

    def same(self, a: Typed, b: Typed) -> Column:
        """Equality of two scalars, null if either is."""
        null = a.column.isNull() | b.column.isNull()
        if "null" in (a.kind, b.kind):
            return F.lit(None).cast("boolean")
        if a.kind in NUMERIC and b.kind in NUMERIC:
            return F.abs(a.column.cast("double") - b.column.cast("double")) < EPSILON
        if a.kind != b.kind:
            return F.when(~null, F.lit(False))
        if a.kind == "quantity":
            near = F.abs(a.column["value"] - b.column["value"]) < EPSILON
            return F.when(~null, near & (a.column["unit"] == b.column["unit"]))
        if a.kind == "interval":
            return F.when(~null, (a.column["low"] == b.column["low"]) & (a.column["high"] == b.column["high"]))
        return a.column == b.column

    def listed(self, e) -> list[Typed] | None:
        return [self.of(m) for m in e.members] if isinstance(e, Items) else None

    def equal(self, e: Op) -> Typed:
        (x, y), (left, right) = e.args, map(self.listed, e.args)
        if left is None and right is None:
            a, b = self.of(x), self.of(y)
            if a.many and b.many:
                pair = lambda p, q: F.coalesce(self.same(Typed(p, a.kind), Typed(q, b.kind)), F.lit(False))
                whole = (F.size(a.column) == F.size(b.column)) & F.forall(F.zip_with(a.column, b.column, pair), lambda v: v)
                lone = self.same(Typed(a.column[0], a.kind), Typed(b.column[0], b.kind))
                empty = (F.size(a.column) <= 0) | (F.size(b.column) <= 0)
                return Typed(F.when(empty, F.lit(None).cast("boolean")).when((F.size(a.column) == 1) & (F.size(b.column) == 1), lone).otherwise(whole), "boolean")
            if a.many or b.many:
                m, s = (a, b) if a.many else (b, a)
                one = self.same(Typed(m.column[0], m.kind), s)
                return Typed(F.when((F.size(m.column) <= 0) | s.column.isNull(), F.lit(None).cast("boolean")).when(F.size(m.column) == 1, one).otherwise(False), "boolean")
            return Typed(self.same(a, b), "boolean")
        if left is not None and right is not None:
            if len(left) != len(right):
                return Typed(F.lit(False), "boolean")
            out = F.lit(True)
            for a, b in zip(left, right, strict=True):
                out = out & F.coalesce(self.same(self.scalar(a, "member"), self.scalar(b, "member")), F.lit(False))
            return Typed(out, "boolean")
        one, many = (self.of(y), left) if left is not None else (self.of(x), right)
        if not one.many:
            return Typed(F.when(one.column.isNotNull(), F.lit(False)), "boolean")
        out = F.size(one.column) == len(many)
        for i, m in enumerate(many):
            out = out & F.coalesce(self.same(Typed(F.get(one.column, F.lit(i)), one.kind), m), F.lit(False))
        return Typed(F.when(F.size(one.column) > 0, out), "boolean")

    def unequal(self, e: Op) -> Typed:
        return Typed(~self.equal(e).column, "boolean")

    def order(self, e: Op) -> Typed:
        a, b = (self.scalar(self.of(x), "ordering") for x in e.args)
        if "null" in (a.kind, b.kind):
            return Typed(F.lit(None).cast("boolean"), "boolean")
        if a.kind in NUMERIC and b.kind in NUMERIC:
            x, y = a.column.cast("double"), b.column.cast("double")
            ok = ~(F.isnan(x) | F.isnan(y))
        elif a.kind == b.kind == "string":
            x, y, ok = a.column, b.column, F.lit(True)
        else:
            raise CqlTypeError(f"no order between {a.kind} and {b.kind}")
        test = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[e.name]
        return Typed(F.when(ok, test), "boolean")

    def member(self, e: Op) -> Typed:
        members = self.listed(e.args[1])
        x = self.of(e.args[0])
        if members is None:
            y = self.of(e.args[1])
            if not y.many:
                raise CqlTypeError("'in' needs a list or the name of a value set")
            x = self.scalar(x, "membership")
            found = F.exists(y.column, lambda v: self.same(x, Typed(v, y.kind)))
            return Typed(F.when(x.column.isNotNull() & (F.size(y.column) > 0), found), "boolean")
        x = self.scalar(x, "membership")
        out = F.lit(False)
        for m in members:
            out = out | self.same(x, self.scalar(m, "member"))
        return Typed(F.when(x.column.isNotNull(), out), "boolean")

    def op_in_set(self, e: Op) -> Typed:
        x, codes = self.of(e.args[0]), self.entity.value_sets.get(e.args[1])
        if x.kind not in ("code", "null"):
            raise CqlTypeError(f"a {x.kind} is in no value set")
        if codes is None or x.kind == "null":
            return Typed(F.lit(None).cast("boolean"), "boolean")
        inside = lambda v: F.when(v.isNotNull(), F.concat_ws("|", v["system"], v["code"]).isin([f"{s}|{c}" for s, c in codes]))
        return Typed(F.when(F.size(x.column) > 0, F.exists(x.column, inside)) if x.many else inside(x.column), "boolean")

    def op_subsumes(self, e: Op) -> Typed:
        a, b = (self.scalar(self.of(x), "subsumption") for x in e.args)
        if {a.kind, b.kind} - {"code", "null"}:
            raise CqlTypeError("'subsumes' needs codes")
        column = self.entity.lineage.get(getattr(e.args[1], "name", None))
        if column and "null" not in (a.kind, b.kind):
            above = F.coalesce(F.exists(F.col(column), lambda v: v == a.column), F.lit(False))
            return Typed(F.when(b.column.isNotNull(), (a.column == b.column) | above), "boolean")
        if self.entity.ancestors is None or "null" in (a.kind, b.kind):
            return Typed(F.lit(None).cast("boolean"), "boolean")
        pairs = [f"{s}|{c}>{t}|{d}" for (t, d), up in self.entity.ancestors.items() for s, c in up]
        key = F.concat(a.column["system"], F.lit("|"), a.column["code"], F.lit(">"), b.column["system"], F.lit("|"), b.column["code"])
        return Typed((a.column == b.column) | key.isin(pairs), "boolean")

    def span(self, x: Typed) -> tuple[Column, Column, Column]:
        if x.kind in NUMERIC:
            c = x.column.cast("double")
            return c, c, c.isNotNull()
        if x.kind == "interval":
            return x.column["low"].cast("double"), x.column["high"].cast("double"), x.column.isNotNull()
        raise CqlTypeError(f"a {x.kind} has no place in time")

    def temporal(self, e: Op) -> Typed:
        a, b = (self.scalar(self.of(x), e.name) for x in e.args)
        if "null" in (a.kind, b.kind):
            return Typed(F.lit(None).cast("boolean"), "boolean")
        (al, ah, a_ok), (bl, bh, b_ok) = self.span(a), self.span(b)
        test = {"before": ah < bl, "after": al > bh, "during": (al >= bl) & (ah <= bh), "overlaps": (al <= bh) & (bl <= ah)}[e.name]
        return Typed(F.when(a_ok & b_ok, test), "boolean")


def compile_expression(text: str, entity: Entity) -> Column:
    """The column that an expression gives for each entity."""
    out = _Compiler(entity).of(parse(text))
    if out.many:
        return F.when(F.size(out.column) == 1, out.column[0]).when(F.size(out.column) > 1, F.raise_error(F.lit("a list is no scalar result")))
    return out.column


def evaluate(entity: Entity, **expressions: str) -> DataFrame:
    """The entities with a column for each named expression, all in one pass."""
    return entity.frame.withColumns({name: compile_expression(text, entity) for name, text in expressions.items()})
