"""Mixing sources to target weights.

The words of each source form one stream: documents in pseudorandom order, cut into
blocks of ``BLOCK`` words.  The offset of a document in its stream is a two-level prefix
sum: documents are dealt by hash to shards, summed within
their shard, and the shards' sums are summed per source.  A source has as many shards as
a shard has documents (the root of its rows), so neither a shard nor the shards' sums of a
source with a third of all rows are a large task.

Each source has a quota of words.  For each output shard the driver draws multinomial
counts of block slots from what is left of the quotas (the last shards take the rest, so
quotas are met exactly), which needs one number per source and output shard.  A slot of
a source is a number 0, 1, 2, ...; slot i takes block perm(i mod blocks), where perm is a
Feistel permutation keyed by seed, source and pass i div blocks.  Slots and blocks meet
in a join on (source, block), which gives the mixed corpus: a row per slot with the
block's words.  Blocks are packed from slices of the documents' words.  The last slot of
a source is trimmed so that its words equal the quota.  What is taken of a document is
counted over the rows of the mixed corpus.

Targets: sources by code point, null last, weigh ``WEIGHTS`` in turn and share all words;
a target stops at ``CAP`` times its source's words and the excess is shared again by
weight.  The driver holds one row per source, and one per source and output shard.

Nulls and edges: a null or blank text has size 0 and is never taken; a null source is a
source of its own; sources without words get target 0; equal rows stand at different
places of their stream, so what is taken of them may differ; an empty table gives an empty
result; no source with words is ever dropped; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, materialize, text_of, word_array

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 256
OUTPUT_SHARDS = 64
#: Slots of a source and shard are numbered in runs of so many.
RUN = 1 << 16


def targets(sizes: Sequence[int], weights: Sequence[float], cap: float = CAP) -> list[float]:
    """Shares of the sum of ``sizes`` by weight, none above ``cap`` times its size."""
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if unit * weights[i] > cap * sizes[i]}
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        open_ -= over
    return out


def _keys(seed: int, source: int, turn: int) -> list[int]:
    raw = hashlib.blake2b(f"{seed}/{source}/{turn}".encode(), digest_size=32).digest()
    return [int.from_bytes(raw[8 * i : 8 * i + 8], "little") for i in range(4)]


def permute(i: np.ndarray, n: int, keys: Sequence[int], inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(n), applied to each of ``i``: a four-round Feistel network that walks on until it is back in range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = np.asarray(i, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> shift, x & mask
        for k in reversed(keys) if inverse else keys:
            part = (left if inverse else right) + np.uint64(k & (2**63 - 1))
            part = (part ^ (part >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            part = (part ^ (part >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            part = (part ^ (part >> np.uint64(32))) & mask
            left, right = (right ^ part, left) if inverse else (right, left ^ part)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Plan:
    """What the driver decides about one source: block count, slots and the words the last slot gives up."""

    index: int
    size: int
    target: float
    blocks: int
    slots: int
    trim: int


def plan_source(index: int, size: int, target: float, block: int, seed: int) -> Plan:
    quota = min(int(round(target)), CAP * size)
    if size <= 0 or quota <= 0:
        return Plan(index, size, target, 0, 0, 0)
    blocks = -(-size // block)
    turns, rest = divmod(quota, size)
    if not rest:
        return Plan(index, size, target, blocks, turns * blocks, 0)
    tail = size - (blocks - 1) * block
    place = int(permute(np.array([blocks - 1]), blocks, _keys(seed, index, turns), inverse=True)[0])
    given = lambda n: n * block - (block - tail if place < n else 0)
    n = -(-rest // block)
    n += given(n) < rest
    return Plan(index, size, target, blocks, turns * blocks + n, given(n) - rest)


def draw_counts(slots: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """Slots of each source (column) that each output shard (row) takes; columns sum to ``slots``."""
    rng, left = np.random.Generator(np.random.PCG64(seed)), np.array(slots, np.int64)
    per, out = -(-int(left.sum()) // shards) if left.sum() else 0, []
    for _ in range(shards):
        got, want = np.zeros_like(left), min(per, int(left.sum()))
        while want > 0:
            more = np.minimum(rng.multinomial(want, left / left.sum()), left)
            got, left, want = got + more, left - more, want - int(more.sum())
        out.append(got)
    return np.array(out).reshape(shards, len(slots))


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.expr(f"regexp_count(coalesce({text}, ''), r'{WORD_CLASS}')").cast("long").alias("size"), F.xxhash64(F.col(doc_id), text_of(text)).alias("_h"), F.xxhash64(text_of(text), F.col(doc_id)).alias("_h2"), F.col(text).alias("text"))


def packed(placed: DataFrame, slots: DataFrame, texts: DataFrame, block: int) -> DataFrame:
    """(_s, _block, parts): the words of each block that some slot takes as slices of documents, in order.

    Rows find their text by two hashes of doc_id and text; equal rows share one.
    """
    held = placed.where("size > 0").select("_s", "_shard", "_row", "doc_id", "_h", "_h2", "_from", "_to", F.explode(F.expr(f"sequence(_from div {block}L, (_to - 1) div {block}L)")).alias("_block"))
    wanted = held.join(slots.select("_s", "_block").distinct(), ["_s", "_block"]).groupBy("_s", "_shard", "_row", "doc_id", "_h", "_h2", "_from", "_to").agg(F.collect_list("_block").alias("_blocks"))
    one = texts.groupBy("_h", "_h2").agg(F.first("text").alias("text"))
    worded = wanted.join(one, ["_h", "_h2"])
    cut = lambda w: F.transform("_blocks", lambda b: _slice(w, b, block))
    # The array of one element binds the words, so that they are split once a document and not once a block.
    slices = worded.select("_s", "_shard", "_row", "doc_id", F.explode(F.flatten(F.transform(F.array(word_array(text_of("text"))), cut))).alias("_x"))
    parts = slices.select("_s", F.col("_x.block").alias("_block"), F.struct("_x.lo", "_x.n", "_shard", "_row", "doc_id", "_x.text").alias("part"))
    return parts.groupBy("_s", "_block").agg(F.sort_array(F.collect_list("part")).alias("parts"))


def _slice(words: Column, b: Column, block: int) -> Column:
    lo = F.greatest(F.col("_from"), b * block)
    n = F.least(F.col("_to"), (b + 1) * block) - lo
    text = F.array_join(F.slice(words, (lo - F.col("_from") + 1).cast("int"), n.cast("int")), " ")
    return F.struct(b.alias("block"), lo.alias("lo"), n.alias("n"), text.alias("text"))


def mixed_corpus(rows: DataFrame, weights: Sequence[float] = WEIGHTS, block: int = BLOCK, shards: int = OUTPUT_SHARDS, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(placed, mixed) of ``sized`` rows.

    placed: the rows with source_size, target and their place in their source's stream.  mixed, the mixed corpus: shard, source
    number and source, slot, block, n_words, the text and its pieces (_shard, _row, doc_id, n: so many words of that row).
    """
    spark, texts = rows.sparkSession, rows.select("_h", "_h2", "text")
    rows = materialize(rows.drop("text"), "mixing-sizes")
    sums = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    order = sorted(sums, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    sizes = [r["size"] or 0 for r in order]
    want = targets(sizes, [weights[i % len(weights)] for i in range(len(order))])
    plans = [plan_source(i, sizes[i], want[i], block, seed) for i in range(len(order))]
    counts = draw_counts([p.slots for p in plans], shards, seed)
    begin = np.cumsum(counts, axis=0) - counts

    info = spark.createDataFrame([(r["source"], p.index, p.size, float(p.target), 1 + isqrt(r["n"])) for r, p in zip(order, plans, strict=True)], "source string, _s int, source_size long, target double, _shards long")
    known = rows.join(F.broadcast(info), rows["source"].eqNullSafe(info["source"])).drop(info["source"])
    dealt = known.withColumn("_shard", F.pmod(F.xxhash64("_h", F.lit(seed)), F.col("_shards")).cast("int"))
    inner = Window.partitionBy("_s", "_shard").orderBy("_h", "doc_id", "size")
    placed = dealt.withColumns({"_end": F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)), "_row": F.row_number().over(inner)})
    shard_sums = dealt.groupBy("_s", "_shard").agg(F.sum("size").alias("_sum"))
    shard_base = shard_sums.withColumn("_base", F.sum("_sum").over(Window.partitionBy("_s").orderBy("_shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")).drop("_sum")
    placed = placed.join(shard_base, ["_s", "_shard"]).withColumn("_to", F.col("_base") + F.col("_end")).withColumn("_from", F.col("_to") - F.col("size"))
    placed = materialize(placed.select("doc_id", "source", "size", "source_size", "target", "_s", "_shard", "_row", "_h", "_h2", "_from", "_to"), "mixing-places")

    dealt_slots = [(k, p.index, int(begin[k, p.index]), int(counts[k, p.index]), p.blocks, p.slots, p.trim) for k in range(shards) for p in plans if counts[k, p.index]]
    drawn = spark.createDataFrame(dealt_slots, "shard int, _s int, first long, n long, blocks long, slots long, trim long")
    runs = drawn.select("shard", "_s", "blocks", "slots", "trim", (F.col("first") + F.col("n")).alias("stop"), F.explode(F.expr(f"sequence(first, first + n - 1, {RUN}L)")).alias("run"))
    numbered = runs.repartition("shard", "_s", "run").select("shard", "_s", "blocks", "slots", "trim", F.explode(F.expr(f"sequence(run, least(run + {RUN}L, stop) - 1)")).alias("slot"))
    length = "CASE WHEN slot = slots - 1 THEN trim ELSE 0 END AS trimmed"

    def blocks_of(frames):
        for f in frames:
            at = np.zeros(len(f), np.int64)
            turn = (f["slot"] // f["blocks"]).to_numpy()
            for (s, t, n), rows_ in f.groupby([f["_s"], turn, f["blocks"]]).indices.items():
                at[rows_] = permute(f["slot"].to_numpy()[rows_] % n, int(n), _keys(seed, int(s), int(t)))
            yield pd.DataFrame({"shard": f["shard"], "_s": f["_s"], "slot": f["slot"], "_block": at, "trimmed": f["trimmed"]})

    slots = numbered.selectExpr("shard", "_s", "slot", "blocks", length).mapInPandas(blocks_of, "shard int, _s int, slot long, _block long, trimmed long")
    slots = materialize(slots, "mixing-slots")
    joined = slots.join(packed(placed, slots, texts, block), ["_s", "_block"]).join(F.broadcast(info), "_s")
    # A trimmed slot gives up the last words of its block.
    stop = F.least((F.col("_block") + 1) * block, F.col("source_size")) - F.col("trimmed")
    given = F.transform("parts", lambda x: F.struct(x["_shard"].alias("_shard"), x["_row"].alias("_row"), x["doc_id"].alias("doc_id"), F.least(x["n"], F.greatest(F.lit(0), stop - x["lo"])).alias("n")))
    whole = F.array_join(F.transform("parts", lambda x: x["text"]), " ")
    n_words = stop - F.col("_block") * block
    text = F.when(F.col("trimmed") > 0, F.array_join(F.slice(F.split(whole, " "), 1, n_words.cast("int")), " ")).otherwise(whole)
    mixed = joined.select("shard", "_s", "source", "slot", F.col("_block").alias("block"), n_words.alias("n_words"), text.alias("text"), F.filter(given, lambda x: x["n"] > 0).alias("pieces"))
    return placed, mixed


def mix(rows: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(report, mixed): the rows with source_size, target and taken, which is counted over the mixed corpus, and that, written as a working table."""
    placed, mixed = mixed_corpus(rows, **options)
    mixed = materialize(mixed, "mixed-blocks")
    used = mixed.select("_s", F.explode("pieces").alias("_p")).groupBy("_s", "_p._shard", "_p._row").agg(F.sum("_p.n").alias("taken"))
    report = placed.join(used, ["_s", "_shard", "_row"], "left")
    return report.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")), mixed


def mixing_report(docs: DataFrame, **options) -> DataFrame:
    return mix(sized(docs), **options)[0]


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus of documents: shard, slot, source, block, n_words, text, and doc_ids, the documents that the words come from, in order."""
    mixed = mixed_corpus(sized(docs), **options)[1]
    return mixed.select("shard", "slot", "source", "block", "n_words", "text", F.transform("pieces", lambda p: p["doc_id"]).alias("doc_ids"))
