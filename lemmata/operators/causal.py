"""Questions to a causal graph, answered for all asked pairs at once.

A graph is an edge table (source, target, predicate) and its nodes.  Reachability is a
closure table computed by path doubling in materialised rounds: deduplicated each round,
so cycles end it.  Everything else is joins of edges, closure and asked pairs; the
do-operator is a filter and never changes the graph.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Rounds, materialize

# Fixed list of the predicates that carry causal influence.
CAUSAL_PREDICATES = (
    "depends_on", "blocks", "implements", "spawns", "causes", "derived_from", "caused_by", "hyp:measuredBy", "expr:hypothesis", "expr:run_for", "paper:cites", "lit:references",
    "proves", "is_proved_by", "axiom_of", "follows_from", "entails", "derives", "precedes_in_proof", "concludes_proof", "is_definition_of", "defines",
)


def reach_closure(edges: DataFrame) -> DataFrame:
    """(src, dst): dst can be reached from src by one edge or more; (x, x) only on a cycle."""
    known = Rounds(edges.sparkSession, "reach")
    new = known.add(edges.select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct())
    # A shortest path of more than 2 ** k edges begins with one of just 2 ** k, which is among those found last.
    while not new.isEmpty():
        step = new.join(known.rows.select(F.col("src").alias("dst"), F.col("dst").alias("_to")), "dst").select("src", F.col("_to").alias("dst")).distinct()
        new = known.add(step.join(known.rows, ["src", "dst"], "left_anti"))
    return known.rows


def reach_from(edges: DataFrame, node: str, back: bool = False) -> DataFrame:
    """(node): what can be reached from ``node`` by one edge or more, or with ``back`` what reaches it; only the part of the graph around it is looked at."""
    here, there = ("target", "source") if back else ("source", "target")
    hop = edges.select(F.col(here).alias("at"), F.col(there).alias("node")).distinct()
    known = Rounds(edges.sparkSession, "reached")
    new = known.add(hop.where(F.col("at") == node).select("node"))
    while not new.isEmpty():
        new = known.add(new.select(F.col("node").alias("at")).join(hop, "at").select("node").distinct().join(known.rows, "node", "left_anti"))
    return known.rows


class NotIdentifiable(ValueError):
    """A causal effect that can't be told from the graph."""


@dataclass(frozen=True)
class CausalGraph:
    edges: DataFrame
    lone: DataFrame | None = None

    @classmethod
    def of_relations(cls, relations: DataFrame) -> CausalGraph:
        """From (source, target, predicate, deleted): causal predicates that aren't deleted."""
        kept = relations.where(~F.coalesce("deleted", F.lit(False)) & F.col("predicate").isin(*CAUSAL_PREDICATES))
        return cls(kept.select("source", "target", "predicate"))

    @classmethod
    def of_triples(cls, facts: DataFrame) -> CausalGraph:
        return cls(facts.where(F.col("predicate").isin(*CAUSAL_PREDICATES)).select(F.col("subject").alias("source"), F.col("object").alias("target"), "predicate"))

    @cached_property
    def nodes(self) -> DataFrame:
        ends = self.edges.select(F.col("source").alias("node")).union(self.edges.select("target"))
        return (ends if self.lone is None else ends.union(self.lone)).distinct()

    @cached_property
    def reach(self) -> DataFrame:
        return reach_closure(self.edges)

    def counts(self) -> DataFrame:
        n = self.nodes.agg(F.count("*").alias("nodes"))
        return n.crossJoin(self.edges.agg(F.count("*").alias("edges")))

    def mutilated(self, treatment: str) -> CausalGraph:
        """The graph without edges into ``treatment``; more calls cut more."""
        return CausalGraph(self.edges.where(F.col("target") != treatment), self.lone)

    def children(self, node: str) -> DataFrame:
        return self.edges.where(F.col("source") == node).select(F.col("target").alias("node"), "predicate")

    def parents(self, node: str) -> DataFrame:
        return self.edges.where(F.col("target") == node).select(F.col("source").alias("node"), "predicate")

    def descendants(self, node: str) -> DataFrame:
        return reach_from(self.edges, node)

    def ancestors(self, node: str) -> DataFrame:
        return reach_from(self.edges, node, back=True)

    def has_path(self, pairs: DataFrame) -> DataFrame:
        """(x, y, has_path); true where x = y, be it a node or not."""
        known = self.reach.select(F.col("src").alias("x"), F.col("dst").alias("y"), F.lit(True).alias("_r"))
        return pairs.select("x", "y").join(known, ["x", "y"], "left").select("x", "y", ((F.col("x") == F.col("y")) | F.coalesce("_r", F.lit(False))).alias("has_path"))

    def reachability_matrix(self) -> DataFrame:
        """(row, col) of the closure, nodes numbered by name.

        Numbers come from a range partitioning and the sizes of its partitions, so no task sorts all names.
        """
        parts = materialize(self.nodes.repartitionByRange("node").sortWithinPartitions("node").withColumn("_m", F.monotonically_increasing_id()), "numbered")
        size = parts.groupBy(F.shiftright("_m", 33).alias("_p")).agg(F.count("*").alias("_n")).collect()
        base, total = {}, 0
        for r in sorted(size, key=lambda r: r["_p"]):
            base[r["_p"]], total = total, total + r["_n"]
        offset = F.create_map(*(F.lit(v) for kv in base.items() for v in kv)) if base else F.lit(None)
        ids = parts.select("node", (offset[F.shiftright("_m", 33)] + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).alias("id")) if base else parts.select("node", F.lit(0).alias("id"))
        return self.reach.join(ids.select(F.col("node").alias("src"), F.col("id").alias("row")), "src").join(ids.select(F.col("node").alias("dst"), F.col("id").alias("col")), "dst").select("row", "col")

    def shortest_paths(self, pairs: DataFrame) -> DataFrame:
        """(x, y, path): a shortest path, the smallest node by node among equals; [x] where x = y; pairs without a path are left out."""
        asked = materialize(pairs.select("x", "y").distinct(), "asked")
        found = asked.where("x = y").select("x", "y", F.array("x").alias("path"))
        front = asked.where("x != y").select("x", F.array("x").alias("path"), F.col("x").alias("at")).distinct()
        seen = Rounds(asked.sparkSession, "seen")
        seen.add(front.select("x", "at"))
        goals = materialize(asked.where("x != y"), "goals")
        hop = self.edges.select(F.col("source").alias("at"), F.col("target").alias("to")).distinct()
        parts = [found]
        while True:
            step = front.join(hop, "at").groupBy("x", "to").agg(F.min(F.concat("path", F.array("to"))).alias("path")).withColumnRenamed("to", "at")
            front = materialize(step.join(seen.rows, ["x", "at"], "left_anti"), "front")
            if front.isEmpty():
                break
            seen.add(front.select("x", "at"))
            parts.append(front.join(goals.withColumnRenamed("y", "at"), ["x", "at"]).select("x", F.col("at").alias("y"), "path"))
            # Starts whose goals are all found go no further.
            goals = materialize(goals.join(front.select("x", F.col("at").alias("y")), ["x", "y"], "left_anti"), "goals")
            front = front.join(goals.select("x").distinct(), "x", "left_semi")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def path_edges(self, paths: DataFrame) -> DataFrame:
        """``paths`` (x, y, path) with hops, the edges of the path in order as triples; of edges between the same nodes the first predicate by name."""
        apart = paths.select("x", "y", "path", F.posexplode(F.expr("transform(sequence(0, size(path) - 2), i -> struct(path[i] AS source, path[i + 1] AS target))")).alias("_i", "_h")).select("x", "y", "path", "_i", "_h.*")
        told = apart.join(self.edges.groupBy("source", "target").agg(F.min("predicate").alias("predicate")), ["source", "target"])
        hop = F.struct(F.col("source").alias("subject"), "predicate", F.col("target").alias("object"))
        sorted_ = F.array_sort(F.collect_list(F.struct("_i", hop.alias("_t"))))
        return told.groupBy("x", "y", "path").agg(F.transform(sorted_, lambda h: h["_t"]).alias("hops"))

    def with_node(self, node: str) -> CausalGraph:
        """The graph with ``node``, be it on an edge or not."""
        extra = self.edges.sparkSession.createDataFrame([(node,)], "node string")
        return CausalGraph(self.edges, extra if self.lone is None else self.lone.union(extra))

    def has_node(self, node: str) -> bool:
        return not self.nodes.where(F.col("node") == node).isEmpty()

    def relevant(self, x: str, y: str) -> CausalGraph:
        """The graph induced by x, y, their ancestors and the nodes between them."""
        above = reach_from(self.edges, x, back=True), reach_from(self.edges, y, back=True)
        between = reach_from(self.edges, x).intersect(above[1])
        ends = self.nodes.where(F.col("node").isin(x, y))
        keep = between.union(above[0]).union(above[1]).union(ends).distinct()
        return CausalGraph(self.edges.join(keep.withColumnRenamed("node", "source"), "source", "left_semi").join(keep.withColumnRenamed("node", "target"), "target", "left_semi"))

    def confounders(self, pairs: DataFrame) -> DataFrame:
        """(x, y, node): common ancestors of x and y that x doesn't reach."""
        r = self.reach
        of_x = pairs.select("x", "y").join(r.select(F.col("dst").alias("x"), F.col("src").alias("node")), "x")
        both = of_x.join(r.select(F.col("dst").alias("y"), F.col("src").alias("node")), ["y", "node"], "left_semi")
        return both.join(r.select(F.col("src").alias("x"), F.col("dst").alias("node")), ["x", "node"], "left_anti").select("x", "y", "node").distinct()

    def identify(self, pairs: DataFrame) -> DataFrame:
        """(x, y, identifiable, criterion, adjustment, explanation); refused where a node is missing."""
        sets = self.confounders(pairs).groupBy("x", "y").agg(F.array_sort(F.collect_set("node")).alias("adjustment"))
        known = lambda c: self.nodes.select(F.col("node").alias(c), F.lit(True).alias(f"_{c}"))
        out = pairs.select("x", "y").distinct().join(known("x"), "x", "left").join(known("y"), "y", "left").join(sets, ["x", "y"], "left")
        ok = F.col("_x").isNotNull() & F.col("_y").isNotNull()
        adjustment = F.coalesce("adjustment", F.expr("cast(array() as array<string>)"))
        criterion = F.when(ok, F.when(F.size(adjustment) == 0, "DirectEffect").otherwise("Backdoor"))
        why = F.when(~ok, "node not found").when(F.size(adjustment) == 0, "no confounder: the effect is direct").otherwise(F.concat(F.lit("adjust for "), F.array_join(adjustment, ", ")))
        return out.select("x", "y", ok.alias("identifiable"), criterion.alias("criterion"), adjustment.alias("adjustment"), why.alias("explanation"))

    def verify_and_refuse(self, x: str, y: str) -> dict:
        """The row of ``identify`` for one pair; raises NotIdentifiable where it is refused."""
        row = self.identify(self.edges.sparkSession.createDataFrame([(x, y)], "x string, y string")).first().asDict()
        if not row["identifiable"]:
            raise NotIdentifiable(f"effect of {x} on {y}: {row['explanation']}")
        return row

    def between(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (x, y) with node: what x reaches and what reaches y, but for x and y; from the end of a pair that has fewer nodes on its side."""
        r = self.reach
        below, above = r.groupBy(F.col("src").alias("x")).agg(F.count("*").alias("_below")), r.groupBy(F.col("dst").alias("y")).agg(F.count("*").alias("_above"))
        sized = pairs.select("x", "y").join(below, "x").join(above, "y")
        of_x, of_y = r.select(F.col("src").alias("x"), F.col("dst").alias("node")), r.select(F.col("src").alias("node"), F.col("dst").alias("y"))
        inner = (F.col("node") != F.col("x")) & (F.col("node") != F.col("y"))
        up = sized.where("_above <= _below").select("x", "y").join(of_y, "y").where(inner).join(of_x, ["x", "node"], "left_semi")
        down = sized.where("_above > _below").select("x", "y").join(of_x, "x").where(inner).join(of_y, ["node", "y"], "left_semi")
        return up.select("x", "y", "node").unionByName(down.select("x", "y", "node"))

    def frontdoor(self, pairs: DataFrame) -> DataFrame:
        """(x, y, node): the children of x that reach y; none for a pair where another descendant of x reaches y too."""
        hop = self.edges.select(F.col("source").alias("x"), F.col("target").alias("node")).distinct()
        inner = self.between(pairs)
        others = inner.join(hop, ["x", "node"], "left_anti").select("x", "y").distinct()
        return inner.join(hop, ["x", "node"], "left_semi").join(others, ["x", "y"], "left_anti").select("x", "y", "node")

    def intervention(self, treatments: DataFrame, skip: bool = True) -> DataFrame:
        """(treatment, role, node) of skipping or reprioritising each treatment.

        Roles: direct, transitive, blocked (descendants all of whose parents are skipped or descendants; only if skipped) and confounder.
        """
        t = treatments.select("treatment").distinct()
        direct = t.join(self.edges.select(F.col("source").alias("treatment"), F.col("target").alias("node")), "treatment").distinct()
        below = t.join(self.reach.select(F.col("src").alias("treatment"), F.col("dst").alias("node")), "treatment")
        confounded = self.confounders(direct.select(F.col("treatment").alias("x"), F.col("node").alias("y"))).select(F.col("x").alias("treatment"), "node").distinct()
        role = lambda df, name: df.select("treatment", F.lit(name).alias("role"), "node")
        out = role(direct, "direct").union(role(below, "transitive")).union(role(confounded, "confounder"))
        if skip:
            gone = below.union(t.select("treatment", F.col("treatment").alias("node"))).distinct().select("treatment", F.col("node").alias("source"), F.lit(True).alias("_gone"))
            parents = below.join(self.edges.select(F.col("target").alias("node"), "source").distinct(), "node")
            judged = parents.join(gone, ["treatment", "source"], "left").groupBy("treatment", "node").agg(F.bool_and(F.coalesce("_gone", F.lit(False))).alias("_all"))
            out = out.union(role(judged.where("_all"), "blocked"))
        return out

    def counterfactual(self, pairs: DataFrame) -> DataFrame:
        """(x, y, status, level, confidence, alternatives): what not doing x would mean for y.

        status is no_path, not_certifiable, persists (other causes of y exist) or absent.
        """
        asked = self.has_path(pairs.distinct())
        deg = lambda end, name: self.edges.groupBy(F.col(end).alias(name))
        px = deg("target", "x").agg(F.count("*").alias("parents_x"))
        py = deg("target", "y").agg(F.count("*").alias("parents_y"))
        direct = self.edges.select(F.col("source").alias("x"), F.col("target").alias("y"), F.lit(True).alias("is_direct")).distinct()
        conf = self.confounders(pairs).groupBy("x", "y").agg(F.count("*").alias("confounders"))
        others = pairs.select("x", "y").distinct().join(self.edges.select(F.col("target").alias("y"), F.col("source").alias("node")).distinct(), "y").where("node != x")
        others = others.join(self.reach.select(F.col("src").alias("x"), F.col("dst").alias("node")), ["x", "node"], "left_anti").groupBy("x", "y").agg(F.count("*").alias("alternatives"))
        n = self.nodes.agg(F.count("*").alias("n"))
        out = asked.join(px, "x", "left").join(py, "y", "left").join(direct, ["x", "y"], "left").join(conf, ["x", "y"], "left").join(others, ["x", "y"], "left").crossJoin(n)
        zero = lambda c: F.coalesce(c, F.lit(0))
        level = confidence_level(F.col("n"), zero("confounders"), F.coalesce("is_direct", F.lit(False)), zero("parents_x"), zero("parents_y"))
        value = F.when(F.col("level") == "High", 0.9).when(F.col("level") == "Medium", 0.65).when(F.col("level") == "Low", 0.35).otherwise(0.1)
        status = F.when(~F.col("has_path"), "no_path").when(F.col("level") == "VeryLow", "not_certifiable").when(zero("alternatives") > 0, "persists").otherwise("absent")
        out = out.withColumn("level", F.when(F.col("has_path"), level))
        return out.select("x", "y", status.alias("status"), "level", F.when(F.col("has_path"), value).alias("confidence"), zero("alternatives").cast("long").alias("alternatives"))


def confidence_level(nodes: Column, confounders: Column, direct: Column, parents_x: Column, parents_y: Column) -> Column:
    ratio = confounders / nodes
    return F.when(nodes < 3, "Low").when((confounders == 0) & direct, "High").when((ratio < 0.3) & ((parents_x > 0) | (parents_y > 1)), "Medium").when(ratio < 0.5, "Low").otherwise("VeryLow")
