"""Benchmark decontamination, with DataFrame operations only.

Documents and benchmark items are lower-cased words and their five-word shingles, as
64-bit hashes.  A window of w shingles can be 0.8 similar to an item of m only if at least
0.8 * (w + m) / 1.8 of its positions hold a shingle of the item.  So for each size m that
an item has, all windows of m shingles are taken in which so many positions hold a shingle
of any item of that size, from a sliding count: windows are left out without loss, in
whatever order the item's parts stand.  Which item a window may hold is found by
fingerprints alone.  Each window and each item has a SimHash of 64 bits over its weighted
shingles (weight: how often a shingle occurs).  Fingerprints are cut into ``BLOCKS``
blocks; within ``RADIUS`` bits some block differs in at most RADIUS div BLOCKS bits
(pigeonhole), so items are listed under every value of every block within that many bits,
and an equality join on (size, block, value) finds all pairs of a window and an item of
its size within the radius.  These are verified by exact weighted Jaccard similarity.

The radius prunes: fingerprints of unrelated texts differ in 32 of 64 bits, give or take
4, so one pair in 30,000 is within 16.  At a similarity of 0.8, the least one asked for, a
bit differs with probability 0.15, so two windows in a hundred are beyond 16 bits; at 0.9
it is one in 4,000.  Windows one word to the left or right are tried as well.

Benchmark shingles are broadcast if at most ``BROADCAST_ROWS`` of them are counted, else
the join shuffles; the same holds for the documents that take part.

Nulls and edges: null texts have no shingles; an item of fewer than five words counts as
one shingle of its own length, and one without words is never found; rows of equal
doc_id and text are one document; a document shorter than an item is one window; an
empty benchmark or table gives an empty result.  Other columns are passed through by
``remove_leaking``, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, spare, text_of, word_array

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 16
BLOCKS = 9
BROADCAST_ROWS = 200_000


def _widths() -> list[tuple[int, int]]:
    """(lowest bit, bits) of each block."""
    size, more = divmod(64, BLOCKS)
    sizes = [size + (i < more) for i in range(BLOCKS)]
    return [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]


def hashed_words(df: DataFrame, text: str, keep: list[str | Column]) -> DataFrame:
    return df.select(*keep, word_array(F.lower(text_of(text))).alias("_words")).withColumn("_words", F.transform("_words", lambda w: F.xxhash64(w)))


def shingles(width: int = SHINGLE) -> Column:
    """Hashes of all runs of ``width`` words of _words, in order."""
    parts = ", ".join(f"_words[i + {k}]" for k in range(width))
    return F.expr(f"CASE WHEN size(_words) >= {width} THEN transform(sequence(0, size(_words) - {width}), i -> xxhash64({parts})) ELSE cast(array() AS array<bigint>) END")


def item_shingles(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, width, pos, h): all shingles of all items; width is the number of words of a shingle."""
    hashed = hashed_words(items, text, [F.col(item_id).alias("item_id")]).where(F.size("_words") > 0)
    width = F.least(F.size("_words"), F.lit(SHINGLE))
    short = F.array(F.expr("CASE size(_words) WHEN 1 THEN xxhash64(_words[0]) WHEN 2 THEN xxhash64(_words[0], _words[1]) WHEN 3 THEN xxhash64(_words[0], _words[1], _words[2]) WHEN 4 THEN xxhash64(_words[0], _words[1], _words[2], _words[3]) END"))
    listed = hashed.select("item_id", width.alias("width"), F.when(F.size("_words") >= SHINGLE, shingles()).otherwise(short).alias("_all"))
    return listed.select("item_id", "width", F.posexplode_outer("_all").alias("pos", "h")).where("h IS NOT NULL")


def simhash(h: str, weight: str) -> Column:
    """Aggregate: the fingerprint of the hashes of a group."""
    bits = [F.when(F.sum(F.when(F.shiftright(h, b).bitwiseAND(F.lit(1)) == 1, F.col(weight)).otherwise(-F.col(weight))) > 0, F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)) for b in range(64)]
    while len(bits) > 1:
        bits = [x.bitwiseOR(y) for x, y in zip(bits[::2], bits[1::2], strict=True)]
    return bits[0]


def _block_values(fingerprint: Column) -> Column:
    return F.array(*(F.struct(F.lit(i).alias("block"), F.shiftright(fingerprint, low).bitwiseAND(F.lit((1 << n) - 1)).alias("value")) for i, (low, n) in enumerate(_widths())))


def _listed_under(block: int, own: Column):
    return lambda mask: F.struct(F.lit(block).alias("block"), own.bitwiseXOR(mask.cast("long")).alias("value"))


def _near_values(fingerprint: Column) -> Column:
    """All values of all blocks within the bits that the pigeonhole principle allows a block."""
    allowed, out = RADIUS // BLOCKS, []
    for i, (low, n) in enumerate(_widths()):
        masks = [sum(1 << b for b in c) for k in range(allowed + 1) for c in combinations(range(n), k)]
        own = F.shiftright(fingerprint, low).bitwiseAND(F.lit((1 << n) - 1))
        out.append(F.transform(F.array(*map(F.lit, masks)), _listed_under(i, own)))
    return F.concat(*out)


def window_starts(threshold: float) -> Column:
    """Every start whose window of m (or all _n) shingles has enough of the sorted shared positions _p, each once.

    A start belongs to the first shared position i at or after it; its window has to reach position i + k - 1.
    """
    need = f"cast(ceil({threshold}D * (m + least(m, _n)) / (1 + {threshold}D) - 1e-9D) AS int)"
    low = "greatest(coalesce(get(_p, i - 1) + 1, 0), _p[i + k - 1] - cast(m AS int) + 1)"
    high = "least(_p[i], greatest(0, _n - cast(m AS int)))"
    none = "cast(array() AS array<int>)"
    of_first = f"CASE WHEN {low} <= {high} THEN sequence({low}, {high}) ELSE {none} END"
    return F.expr(f"flatten(transform(array({need}), k -> CASE WHEN size(_p) >= k THEN flatten(transform(sequence(0, size(_p) - k), i -> {of_first})) ELSE {none} END))")


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, _text, item_id, start, hamming, similarity) of every window that holds an item."""
    wanted = materialize(item_shingles(items), "benchmark-shingles")
    n_wanted, widths = wanted.count(), [r["width"] for r in wanted.select("width").distinct().collect()]
    small = n_wanted <= BROADCAST_ROWS
    sized = wanted.groupBy("item_id", "width").agg(F.count("*").alias("m"))
    sought = wanted.select("item_id", "width", "h").join(sized, ["item_id", "width"]).select("width", "m", "h").distinct()
    identity = [F.col(doc_id).alias("doc_id"), F.xxhash64(text_of(text)).alias("_text")]

    hits = None
    for width in sorted(widths):
        listed = hashed_words(docs, text, identity).select("doc_id", "_text", shingles(width).alias("_all"))
        # The outer form: for the plain one the optimiser adds a test of the array's size below the projection, which computes it once per element.
        at = listed.select("doc_id", "_text", F.size("_all").alias("_n"), F.posexplode_outer("_all").alias("_pos", "h")).where("h IS NOT NULL")
        of_width = sought.where(F.col("width") == width).drop("width")
        found = at.join(F.broadcast(of_width) if small else of_width, "h").select("doc_id", "_text", "m", F.lit(width).alias("width"), "_n", "_pos")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        none = items.select("item_id").where("false").withColumns({"start": F.lit(0), "hamming": F.lit(0), "similarity": F.lit(0.0)})
        return docs.select(*identity).where("false").join(none, F.col("_text") == F.col("start")).select("doc_id", "_text", "item_id", "start", "hamming", "similarity")
    shared_at = hits.groupBy("doc_id", "_text", "m", "width", "_n").agg(F.array_sort(F.collect_set("_pos")).alias("_p"))
    starts = shared_at.select("doc_id", "_text", "m", "width", window_starts(threshold).alias("starts"))
    starts = materialize(starts.where(F.size("starts") > 0), "window-starts")

    asked = starts.groupBy("doc_id", "_text").agg(F.collect_list(F.struct("m", "width", "starts")).alias("_asked"))
    side = F.broadcast(asked) if starts.count() <= BROADCAST_ROWS else asked.hint("shuffle_hash")
    own = docs.withColumn("_text", F.xxhash64(text_of(text))).select(F.col(doc_id).alias("_id"), F.col("_text").alias("_t"), F.col(text).alias("text"))
    part = own.join(side, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_t") == F.col("_text")))
    worded = hashed_words(part, "text", ["doc_id", "_text", "_asked"]).dropDuplicates(["doc_id", "_text"])
    windows = None
    for width in sorted(widths):
        rows = worded.select("doc_id", "_text", shingles(width).alias("_all"), F.explode(F.expr(f"filter(_asked, a -> a.width = {width})")).alias("_a"))
        spread = rows.select("doc_id", "_text", "_all", "_a", F.explode("_a.starts").alias("start")).select("doc_id", "_text", F.lit(width).alias("width"), F.col("_a.m").alias("m"), "start", "_all")
        each = spread.select("doc_id", "_text", "width", "m", "start", F.explode_outer(F.expr("slice(_all, start + 1, m)")).alias("h")).where("h IS NOT NULL")
        windows = each if windows is None else windows.unionByName(each)
    weighed = materialize(windows.groupBy("doc_id", "_text", "width", "m", "start", "h").agg(F.count("*").alias("w")), "window-shingles")
    window = ["doc_id", "_text", "width", "m", "start"]
    window_prints = weighed.groupBy(*window).agg(simhash("h", "w").alias("print"), F.sum("w").alias("all_w"))
    item_weights = wanted.groupBy("item_id", "h").agg(F.count("*").alias("item_w"))
    item_prints = item_weights.join(sized, "item_id").groupBy("item_id", "width", "m").agg(simhash("h", "item_w").alias("item_print"))
    index = item_prints.select("item_id", "width", "m", "item_print", F.explode(_near_values(F.col("item_print"))).alias("_b")).select("item_id", "width", "m", "item_print", "_b.block", "_b.value")
    probes = window_prints.select(*window, "print", "all_w", F.explode(_block_values(F.col("print"))).alias("_b")).select(*window, "print", "all_w", "_b.block", "_b.value")
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    near = probes.join(index, ["width", "m", "block", "value"]).withColumn("hamming", distance).where(F.col("hamming") <= RADIUS).select(*window, "all_w", "item_id", "hamming").distinct()
    # Exact check: sum of minima over sum of maxima of the weights.
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a._text") == F.col("b._text")) & (F.col("a.width") == F.col("b.width")) & (F.col("a.m") == F.col("b.m")) & (F.col("a.start") == F.col("b.start"))
    told = near.alias("a").join(weighed.alias("b"), same).select("a.*", "b.h", "b.w")
    both = told.join(item_weights, ["item_id", "h"]).groupBy(*window, "all_w", "item_id", "hamming").agg(F.sum(F.least("w", "item_w")).alias("both"))
    similarity = (F.col("both") / (F.col("all_w") + F.col("m") - F.col("both"))).alias("similarity")
    return both.select("doc_id", "_text", "item_id", "start", "hamming", similarity).where(F.col("similarity") >= threshold)


def leak_report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, n_windows, start, similarity): the best window of each pair of a document and an item it holds."""
    best = F.struct(F.col("similarity"), (-F.col("start")).alias("s"))
    return leaks(docs, items, **options).groupBy("doc_id", "item_id").agg(F.count("*").alias("n_windows"), F.max(best).alias("_best")).select("doc_id", "item_id", "n_windows", (-F.col("_best.s")).cast("long").alias("start"), F.col("_best.similarity").alias("similarity"))


def remove_leaking(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows in which an item was found."""
    own_, id_, text_ = spare(docs, "_own", "_id", "_t")
    bad = leaks(docs.select("doc_id", "text"), items, **options).select(F.col("doc_id").alias(id_), F.col("_text").alias(text_)).distinct()
    own = docs.withColumn(own_, F.xxhash64(text_of("text")))
    return own.join(bad.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own_) == F.col(text_)), "left_anti").drop(own_)
