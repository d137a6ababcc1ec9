"""Bayesian updating and graded certainty, one group per case, no driver loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed content of the GRADE system: levels best first, and steps down (positive) or up.
GRADE_LEVELS = ("high", "moderate", "low", "very-low")
GRADE_STEPS = {"serious": 1, "very-serious": 2, "large-effect": -1, "very-large-effect": -2, "dose-response": -1}
DIRECTNESS = {"exact": 1.0, "high": 0.9, "moderate": 0.75, "low": 0.5}


class BayesError(ValueError):
    """Priors that can't be normalised; ``kind`` is Empty, NonNormalizablePrior or DuplicateHypothesis."""

    def __init__(self, kind: str):
        super().__init__(kind)
        self.kind = kind


def validate_priors(priors: DataFrame) -> None:
    """Raise for a case without hypotheses, with a repeated one, or whose weights have no positive finite sum."""
    by = priors.groupBy("case", "h").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.min("w").alias("least")).groupBy("case").agg(F.max("n").alias("n"), F.sum("w").alias("w"), F.min("least").alias("least"))
    worst = by.agg(F.count("*").alias("cases"), F.max("n").alias("n"), F.bool_or(F.isnan("w") | (F.col("w") <= 0) | (F.col("least") < 0) | (F.col("w") == float("inf"))).alias("bad")).first()
    if not worst["cases"]:
        raise BayesError("Empty")
    if worst["n"] > 1:
        raise BayesError("DuplicateHypothesis")
    if worst["bad"]:
        raise BayesError("NonNormalizablePrior")


def normalise(df: DataFrame, weight: str = "w", out: str = "p") -> DataFrame:
    return df.withColumn(out, F.col(weight) / F.sum(weight).over(Window.partitionBy("case")))


def posterior(priors: DataFrame, evidence: DataFrame, likelihood: DataFrame) -> DataFrame:
    """(case, h, p): priors (case, h, w) updated by evidence (case, step, evidence) in the order of step.

    likelihood (evidence, h, l): what is missing counts as 1.  A step that would leave no mass at all is passed over.  Cases
    none of whose steps rules out a hypothesis are summed up in logarithms, whatever the order, and combined before the
    shuffle; only for the others the order matters, and the fold over their steps runs inside one row per case.
    """
    counts = evidence.groupBy("case", "evidence").agg(F.count("*").alias("n"))
    zero = likelihood.where("l = 0").select("evidence").distinct()
    odd = counts.join(zero, "evidence", "left_semi").select("case").distinct()
    told = counts.join(likelihood.where("l > 0"), "evidence").groupBy("case", "h").agg(F.sum(F.col("n") * F.ln("l")).alias("ll"))
    plain = from_logs(priors.join(odd, "case", "left_anti"), told)
    return plain.unionByName(_folded(priors.join(odd, "case", "left_semi"), evidence.join(odd, "case", "left_semi"), likelihood))


def from_logs(priors: DataFrame, told: DataFrame) -> DataFrame:
    """(case, h, p) of priors (case, h, w) and summed log-likelihoods (case, h, ll), which are missing where they are 0; the largest is taken off first, so nothing underflows."""
    joined = priors.join(told, ["case", "h"], "left").withColumn("_l", F.when(F.col("w") > 0, F.ln("w") + F.coalesce("ll", F.lit(0.0))))
    top = F.max("_l").over(Window.partitionBy("case"))
    return normalise(joined.withColumn("_w", F.coalesce(F.exp(F.col("_l") - top), F.lit(0.0))), "_w").select("case", "h", "p")


def _folded(priors: DataFrame, evidence: DataFrame, likelihood: DataFrame) -> DataFrame:
    start = normalise(priors).groupBy("case").agg(F.array_sort(F.collect_list(F.struct("h", "p"))).alias("now"))
    told = evidence.join(likelihood, "evidence", "left").groupBy("case", "step", "evidence").agg(F.map_from_entries(F.collect_list(F.when(F.col("h").isNotNull(), F.struct("h", "l")))).alias("m"))
    steps = told.groupBy("case").agg(F.array_sort(F.collect_list(F.struct("step", F.map_entries("m").alias("m")))).alias("steps"))

    def step(now: Column, s: Column) -> Column:
        scaled = F.transform(now, lambda x: F.struct(x["h"].alias("h"), (x["p"] * F.coalesce(F.try_element_at(F.map_from_entries(s["m"]), x["h"]), F.lit(1.0))).alias("p")))
        total = F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x["p"])
        return F.when(total > 0, F.transform(scaled, lambda x: F.struct(x["h"].alias("h"), (x["p"] / total).alias("p")))).otherwise(now)

    folded = start.join(steps, "case", "left").withColumn("now", F.when(F.col("steps").isNull(), F.col("now")).otherwise(F.aggregate(F.coalesce("steps", F.expr("cast(array() as array<struct<step:bigint,m:array<struct<key:string,value:double>>>>)")), F.col("now"), step)))
    return folded.select("case", F.explode("now").alias("_x")).select("case", "_x.h", "_x.p")


def posterior_product(priors: DataFrame, likelihood_rows: DataFrame) -> DataFrame:
    """(case, h, p) where no step can leave a case without mass: one sum of logarithms per (case, h) of rows (case, h, l), combined before the shuffle."""
    told = likelihood_rows.groupBy("case", "h").agg(F.sum(F.when(F.col("l") > 0, F.ln("l")).otherwise(F.lit(float("-inf")))).alias("ll"))
    return from_logs(priors, told)


def map_hypothesis(post: DataFrame) -> DataFrame:
    """(case, h, p): the most probable hypothesis, the smaller id of equals."""
    return post.groupBy("case").agg(F.min(F.struct((-F.col("p")).alias("q"), "h")).alias("_b")).select("case", "_b.h", (-F.col("_b.q")).alias("p"))


def ranked(post: DataFrame) -> DataFrame:
    return post.withColumn("rank", F.row_number().over(Window.partitionBy("case").orderBy(F.desc("p"), "h")))


def entropy_bits(post: DataFrame) -> DataFrame:
    return post.groupBy("case").agg(F.coalesce(F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log2("p"))), F.lit(0.0)).alias("entropy"))


def _index(level: Column, levels: tuple[str, ...]) -> Column:
    at = F.array_position(F.array(*map(F.lit, levels)), level)
    return F.when(at > 0, at - 1)


def aggregate_certainty(ratings: DataFrame, levels: tuple[str, ...] = GRADE_LEVELS, steps: dict[str, int] | None = None) -> DataFrame:
    """(case, level, moved_by): the base level moved by the ratings of its case.

    ratings: (case, id, rating, is_base).  Unknown ratings move nothing; a case whose base is no level has a null level.
    """
    steps = GRADE_STEPS if steps is None else steps
    moves = F.lit(0)
    for name, n in steps.items():
        moves = F.when(F.col("rating") == name, n).otherwise(moves)
    by = ratings.groupBy("case").agg(
        F.max(F.when(F.col("is_base"), F.col("rating"))).alias("base"), F.sum(F.when(~F.col("is_base"), moves).otherwise(0)).alias("moved"),
        F.array_sort(F.collect_list(F.when(~F.col("is_base") & (moves != 0), F.col("id")))).alias("moved_by"),
    )
    at = F.least(F.greatest(_index(F.col("base"), levels) + F.col("moved"), F.lit(0)), F.lit(len(levels) - 1))
    return by.select("case", F.when(_index(F.col("base"), levels).isNotNull(), F.get(F.array(*map(F.lit, levels)), at.cast("int"))).alias("level"), "moved_by")


def aggregate_children(ratings: DataFrame, **options) -> DataFrame:
    """Like ``aggregate_certainty`` of rows (case, id, rating, parent): the first rating without a parent is the base, its direct children move it."""
    tops = ratings.where("parent IS NULL").groupBy("case").agg(F.min("id").alias("_top"))
    own = ratings.join(tops, "case").where((F.col("id") == F.col("_top")) | (F.col("parent") == F.col("_top")))
    return aggregate_certainty(own.select("case", "id", "rating", (F.col("id") == F.col("_top")).alias("is_base")), **options)


def weight(level: Column, levels: tuple[str, ...] = GRADE_LEVELS) -> Column:
    """1 for the best level, falling evenly to 1/n; 0 for an unknown one."""
    return F.coalesce((F.lit(len(levels)) - _index(level, levels)) / F.lit(float(len(levels))), F.lit(0.0))


def directness_factor(directness: Column) -> Column:
    out = F.lit(1.0)
    for name, f in DIRECTNESS.items():
        out = F.when(directness == name, f).otherwise(out)
    return out


def prior_from_certainty(rows: DataFrame) -> DataFrame:
    """(case, h, w, p) of rows (case, h, level, directness)."""
    return normalise(rows.withColumn("w", weight(F.col("level")) * directness_factor(F.col("directness")))).select("case", "h", "w", "p")
