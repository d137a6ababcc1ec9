"""Secret scans with corpus-wide ownership frequency, with DataFrame operations only.

Spans come from ``split`` and ``regexp_extract_all`` over the same pattern: the pieces
between matches and the matches themselves give every start by running lengths, in code
points, summed within runs of ``RUN`` matches and then over the runs, so the time goes
with the number of matches.  Every candidate value is hashed; over the whole corpus the hashes are counted by
distinct owners and repositories (partial aggregation before each shuffle, and values of
many rows are looked up in a broadcast table, so a value in a third of all rows is no hot
key).  A value of at most ``MAX_OWNERS`` owners and at most
``MAX_REPOS`` repositories is owner-specific and live-looking; one that more owners or
more repositories hold is a widely copied example.

The method adds spans of kind ``bare``: runs of 20 or more ``[A-Za-z0-9+/_-]`` that hold a
letter and a digit and overlap no base span, where their value is known elsewhere as the
value of an owner-specific base candidate, or where the run is itself owner-specific and
of 32 or more characters.

Nulls and edges: a null text has no span; a null owner or repository counts as one owner
or repository of its own; a failing match (a value too short) is passed over as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_spread, materialize, text_of

#: Fixed patterns of the base kinds, in the order in which ties are listed.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BARE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "bare")
MAX_OWNERS = 2
MAX_REPOS = 10
BARE_ALONE = 32
RUN = 128

SPAN = "struct<start:int,kind:int,stop:int,value:string>"


def _spans(text: Column, pattern: str, kind: int, value_group: int = 0, least: int = 0) -> Column:
    """Spans of all matches whose value has ``least`` characters or more; the empty array where there are none."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    begin = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    each = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("hit"))
    # The array of one element binds what is zipped, so that it is made once a text and not once a run.
    runs = F.flatten(F.transform(F.array(each), lambda z: F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / RUN).cast("int")), lambda k: F.aggregate(F.slice(z, k * RUN + 1, RUN), begin, lambda acc, x: _step(acc, x, kind, pattern, value_group)))))
    moved = F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array(none).alias("spans")), _shift)["spans"]
    placed = F.flatten(moved)
    if least:
        placed = F.filter(placed, lambda s: F.char_length(s["value"]) >= least)
    return F.when(text.rlike(pattern), placed).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def _step(acc: Column, x: Column, kind: int, pattern: str, group: int) -> Column:
    start = acc["at"] + F.char_length(x["gap"])
    stop = start + F.char_length(x["hit"])
    value = F.regexp_extract(x["hit"], pattern, group) if group else x["hit"]
    span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), value.alias("value"))
    return F.struct(stop.alias("at"), F.array_append(acc["spans"], span).alias("spans"))


def _shift(acc: Column, run: Column) -> Column:
    moved = F.transform(run["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["kind"].alias("kind"), (s["stop"] + acc["at"]).alias("stop"), s["value"].alias("value")))
    return F.struct((acc["at"] + run["at"]).alias("at"), F.array_append(acc["spans"], moved).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each, by start, then kind."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    t = text_of(text)
    bare = F.filter(_spans(t, BARE, 3), lambda s: s["value"].rlike("[A-Za-z]") & s["value"].rlike("[0-9]"))
    out = docs.withColumn("base", F.concat(_spans(t, ASSIGN, 0, 2, 6), _spans(t, ACCESS, 1), _spans(t, HEX, 2))).withColumn("bare", bare)
    free = F.expr("filter(bare, b -> not exists(base, s -> s.start < b.stop and b.start < s.stop))")
    return out.withColumn("bare", F.when(F.size("bare") > 0, free).otherwise(F.col("bare")))


def ownership(candidates: DataFrame) -> DataFrame:
    """(h, n_owners, n_repos, in_base, times) of rows (h, owner, repo, kind)."""
    pairs = candidates.groupBy("h", "owner", "repo").agg(F.max(F.col("kind") < 3).alias("in_base"), F.count("*").alias("times"))
    owners = pairs.groupBy("h", "owner").agg(F.count("*").alias("repos"), F.max("in_base").alias("in_base"), F.sum("times").alias("times"))
    return owners.groupBy("h").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.max("in_base").alias("in_base"), F.sum("times").alias("times"))


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "doc_id") -> DataFrame:
    """A row per document: counts, base and added spans, and how many of its values are live-looking or widely copied; most_owners and n_repos are the largest of its values.

    ``repo`` tells repositories apart and ``owner`` their owners; documents are their own repositories by default.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repo).cast("string").alias("repo"), F.col(text).alias("text"))
    found = materialize(base_spans(slim).drop("text").withColumn("_row", F.monotonically_increasing_id()), "secret-spans")
    some = found.where((F.size("base") > 0) | (F.size("bare") > 0))
    spans = some.select("_row", F.coalesce("owner", F.lit("\0")).alias("owner"), F.coalesce("repo", F.lit("\0")).alias("repo"), F.explode(F.concat("base", "bare")).alias("s"))
    keyed = spans.select("_row", "owner", "repo", F.col("s.kind").alias("kind"), "s", F.sha2("s.value", 256).alias("h"))
    judged = join_spread(keyed, materialize(ownership(keyed), "secret-owners"), ["h"], "times", F.col("_row"))
    live = (F.col("n_owners") <= MAX_OWNERS) & (F.col("n_repos") <= MAX_REPOS)
    added = (F.col("kind") == 3) & live & (F.col("in_base") | (F.char_length("s.value") >= BARE_ALONE))
    per_row = judged.groupBy("_row").agg(
        F.collect_list(F.when(added, F.col("s"))).alias("more"),
        F.count_if((F.col("kind") < 3) & live).alias("n_live"),
        F.count_if((F.col("kind") < 3) & ~live).alias("n_copied"),
        F.max("n_owners").alias("most_owners"),
        F.max("n_repos").alias("n_repos"),
    )
    out = found.join(per_row, "_row", "left")
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    more = F.coalesce("more", F.expr(f"cast(array() as array<{SPAN}>)"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", more)).alias("spans"), zero("n_live"), zero("n_copied"), zero("most_owners"), zero("n_repos")
    )
