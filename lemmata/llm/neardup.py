"""MinHash near-duplicate detection by a multi-index Hamming join of b-bit signatures.

A document's set is its distinct five-word shingles as 64-bit hashes.  Documents with the
same set form one class, represented once.  A class has ``POSITIONS`` MinHash values of 16
bits; two sets of similarity s disagree in a position with probability 1 - s.  Signatures
are cut into chunks.  The radius follows from the least similarity asked for: at it, more
positions differ with probability ``MISSED`` at most (22 of 64 at 0.85, 27 at 0.8).  There
are so many chunks, ``CHUNKS`` at least, that of two signatures within the radius some
chunk differs in at most 1 position (pigeonhole).  Each chunk is listed once per position
with that position left out: two such chunks share a key for certain.  Links are confirmed on full sets.

Groups of copies are not expanded into pairs.  First every class is checked against the
smallest class among those it shares a key with, one pair a class; the confirmed links
give components.  Then only keys whose classes are still in different components are
looked at, and only pairs of different components within the radius are checked.  Keys of
more than ``SMALL`` classes are cut into tiles of ``TILE`` classes; a task holds two tiles,
checks their pairs in memory and returns only links that join components, which are fewer
than its classes, so no task gets an unbounded group and no pairs are written out.  No
pair is given up.

Nulls and edges: a null, empty or blank text has no shingles and is linked with nothing;
fewer than five words are one shingle; rows of one doc_id with different texts are
documents of their own; a null doc_id takes part, and its component is the smallest
doc_id that isn't null, or null; an empty table gives an empty result.  Classes are told
apart by 64 bits of the hash of their set.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import U64, batches_of, mix, text_buffer, words
from .common import join_spread, materialize, spare, text_of
from .graph import components

SHINGLE = 5
POSITIONS, CHUNKS, MISSED = 64, 12, 3e-5
SMALL, TILE = 48, 512
#: A tile holds about so many shingles, and sets are compared as bit rows up to so many bits in all.
TILE_SHINGLES, BITS = 2_000_000, 1 << 29
BROADCAST_ROWS = 1_000_000
_RNG = np.random.Generator(np.random.PCG64(8128))
_MULTIPLY = (_RNG.integers(1, 2**32, POSITIONS, dtype=np.uint64) | U64(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 2**32, POSITIONS, dtype=np.uint64).astype(np.uint32)


def radius_of(percent: int) -> int:
    """The least number of positions that more than differ with probability MISSED at most, at a similarity of ``percent``."""
    apart = 1 - percent / 100
    chance = [comb(POSITIONS, k) * apart**k * (1 - apart) ** (POSITIONS - k) for k in range(POSITIONS + 1)]
    return next(r for r in range(POSITIONS + 1) if sum(chance[r + 1 :]) <= MISSED)


def chunks_of(percent: int) -> int:
    """So many chunks that one of them has at most one differing position within the radius."""
    return max(CHUNKS, radius_of(percent) // 2 + 1)


def chunk_of_position(chunks: int) -> np.ndarray:
    return np.sort(np.arange(POSITIONS) % chunks)


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets): the sorted distinct shingle hashes of each text, one text behind the other."""
    data, offsets = text_buffer(texts)
    _, _, h, n = words(data, offsets)
    first = np.cumsum(n) - n
    if len(h) >= width:
        rolled = h[: len(h) - width + 1].copy()
        for k in range(1, width):
            rolled = rolled * U64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k]
        rolled = mix(rolled)
    parts, sizes = [], np.zeros(len(n), np.int64)
    for i in range(len(n)):
        if n[i] >= width:
            own = np.unique(rolled[first[i] : first[i] + n[i] - width + 1])
        elif n[i]:
            x = U64(n[i])
            with np.errstate(over="ignore"):
                for y in h[first[i] : first[i] + n[i]]:
                    x = x * U64(0x9E3779B97F4A7C15) + y
            own = mix(np.array([x], U64))
        else:
            continue
        parts.append(own)
        sizes[i] = len(own)
    return np.concatenate(parts) if parts else np.zeros(0, U64), np.concatenate([[0], np.cumsum(sizes)])


def class_hashes(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, -1 for an empty one."""
    size = np.diff(offsets)
    out = np.full(len(size), -1, np.int64)
    full = np.flatnonzero(size)
    if len(full):
        total = np.add.reduceat(mix(values + U64(0x2545F4914F6CDD1D)), offsets[full])
        out[full] = (mix(total + size[full].astype(U64)) >> U64(1)).astype(np.int64)
    return out


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of POSITIONS 16-bit values for each set; zeros for an empty one."""
    size = np.diff(offsets)
    out = np.zeros((len(size), POSITIONS), np.uint16)
    full = np.flatnonzero(size)
    if len(full):
        low = (values >> U64(32)).astype(np.uint32)
        for k in range(POSITIONS):
            least = np.minimum.reduceat(low * _MULTIPLY[k] + _ADD[k], offsets[full])
            out[full, k] = (mix(least.astype(U64) + U64(k << 40)) >> U64(48)).astype(np.uint16)
    return out


def chunk_keys(sig: np.ndarray, chunks: int) -> np.ndarray:
    """A key for each position: its chunk without that position."""
    chunk, n = chunk_of_position(chunks), len(sig)
    keys = np.empty((n, POSITIONS), U64)
    for c in range(chunks):
        own = np.flatnonzero(chunk == c)
        for left_out in own:
            x = np.full(n, int(left_out) + 1, U64)
            for p in own:
                if p != left_out:
                    x = mix(x * U64(0x100000001B3) + sig[:, p])
            keys[:, left_out] = x
    return keys.view(np.int64)


def describe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, n_shingles, node, sig) of each row; node is -1 for an empty set."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text_of(text)).alias("text_key"), F.col(text).alias("text"))

    def run(batches):
        for b in batches_of(batches, 1 << 20):
            values, offsets = shingle_sets(b.column("text"))
            sig = signatures(values, offsets)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(np.diff(offsets)), pa.array(class_hashes(values, offsets)), pa.array([x.tobytes() for x in sig], pa.binary())], names=["doc_id", "text_key", "n_shingles", "node", "sig"]
            )

    return slim.mapInArrow(run, "doc_id long, text_key long, n_shingles long, node long, sig binary")


def _keys_of(classes: DataFrame, chunks: int) -> DataFrame:
    def run(batches):
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(-1, POSITIONS)
            yield pa.RecordBatch.from_arrays([pa.array(chunk_keys(sig, chunks).ravel()), pa.array(np.repeat(b.column("node").to_numpy(), POSITIONS))], names=["key", "node"])

    return classes.select("node", "sig").mapInArrow(run, "key long, node long")


def _within_radius(pairs: DataFrame, classes: DataFrame, radius: int) -> DataFrame:
    """The pairs (a, b) whose signatures differ in at most ``radius`` positions."""
    left = classes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    right = classes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, POSITIONS) for c in ("sig_a", "sig_b"))
            near = (x != y).sum(axis=1) <= radius
            yield b.select(["a", "b"]).filter(pa.array(near))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough: 100 * intersection >= percent * union."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def run(batches):
        for b in batches:
            (xv, xo), (yv, yo) = shingle_sets(b.column("text_a")), shingle_sets(b.column("text_b"))
            ok = []
            for i in range(b.num_rows):
                x, y = xv[xo[i] : xo[i + 1]], yv[yo[i] : yo[i + 1]]
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    ok.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _overlaps(values: np.ndarray, offsets: np.ndarray):
    """A function (i, others) -> sizes of the intersections of set i with the others."""
    n, kinds = len(offsets) - 1, np.unique(values)
    if n * len(kinds) <= BITS:
        bits = np.zeros((n, -(-len(kinds) // 64) * 64), bool)
        bits[np.repeat(np.arange(n), np.diff(offsets)), np.searchsorted(kinds, values)] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        return lambda i, others: np.bitwise_count(packed[others] & packed[i]).sum(axis=1, dtype=np.int64)
    return lambda i, others: np.array([len(np.intersect1d(values[offsets[i] : offsets[i + 1]], values[offsets[j] : offsets[j + 1]], assume_unique=True)) for j in others], np.int64)


def tile_links(key: int, across: bool, node: np.ndarray, comp: np.ndarray, tile: np.ndarray, sig: np.ndarray, values: np.ndarray, offsets: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Confirmed links that join different components among the classes of one key, or across two tiles of it; no more than the classes.

    A pair that shares several keys is compared under the first of them only.
    """
    size, overlap, keys, radius = np.diff(offsets), _overlaps(values, offsets), chunk_keys(sig, chunks_of(percent)), radius_of(percent)
    place = int(np.flatnonzero(keys[0] == key)[0])
    names, group = np.unique(comp, return_inverse=True)
    parent = np.arange(len(names))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in range(len(node)):
        own = find(group[i])
        other = (node > node[i]) & (parent[group] != own)
        if across:
            other &= tile != tile[i]
        at = np.flatnonzero(other)
        at = at[(sig[at] != sig[i]).sum(axis=1) <= radius]
        at = at[~(keys[at, :place] == keys[i, :place]).any(axis=1)]
        if not len(at):
            continue
        both = overlap(i, at)
        for j in at[100 * both >= percent * (size[at] + size[i] - both)]:
            x, y = find(group[i]), find(group[j])
            if x != y:
                parent[y] = x
                out.append((int(node[i]), int(node[j])))
    return out


def _tile_links(members: DataFrame, percent: int) -> DataFrame:
    """``tile_links`` of rows (key, tiles, node, component, sig, text), a task for each pair of tiles of a key."""
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    dealt = members.withColumn("_t", own).select("key", "node", "component", "sig", "text", "_t", F.explode(F.expr("sequence(0, tiles - 1)")).alias("_o"))
    dealt = dealt.withColumns({"_lo": F.least("_t", "_o"), "_hi": F.greatest("_t", "_o")})

    def run(key, table):
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(-1, POSITIONS)
        values, offsets = shingle_sets(table["text"])
        node, comp, tile = (table[c].to_numpy() for c in ("node", "component", "_t"))
        links = tile_links(key[0].as_py(), key[1].as_py() != key[2].as_py(), node, comp, tile, sig, values, offsets, percent)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return dealt.groupBy("key", "_lo", "_hi").applyInArrow(run, "a long, b long")


def _grouped(docs: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    """The rows of ``describe`` without sig, with the component of those that have shingles and its smallest doc_id.

    Classes are named first, then rows by their class, so neither the classes of a component nor the copies of a class meet in one task.
    """
    rows = materialize(describe(docs, doc_id, text), "signatures")
    classes = materialize(rows.where("node >= 0").groupBy("node").agg(F.min("text_key").alias("text_key"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n")), "classes")
    keys = _keys_of(classes, chunks_of(percent))
    shared = keys.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("c")).where("c > 1")
    members = materialize(keys.join(shared, "key").select("key", "node", "leader", "c"), "members")

    taking_part = materialize(members.select("node").distinct().join(classes.select("node", "text_key"), "node"), "taking-part")
    side = F.broadcast(taking_part) if taking_part.count() <= BROADCAST_ROWS else taking_part
    found = docs.select(F.xxhash64(text_of(text)).alias("text_key"), F.col(text).alias("text")).join(side, "text_key")
    texts = materialize(found.groupBy("node").agg(F.first("text").alias("text")), "member-texts")

    first = members.where("node != leader").groupBy(F.col("node").alias("a")).agg(F.min("leader").alias("b"))
    tried = materialize(_within_radius(first, classes, radius_of(percent)), "first-pairs")
    links = materialize(_confirmed(tried, texts, percent), "first-links")
    merged = components(links)

    placed = members.select("key", "node", "c").join(merged, "node", "left").withColumn("component", F.coalesce("component", "node")).join(classes.select("node", "n"), "node")
    open_keys = placed.groupBy("key").agg(F.min("component").alias("_least"), F.max("component").alias("_most"), F.sum("n").alias("_sum"), F.count("*").alias("c")).where("_least != _most")
    tiles = F.greatest(F.ceil(F.col("c") / TILE), F.ceil(F.col("_sum") / TILE_SHINGLES)).cast("int").alias("tiles")
    todo = materialize(placed.drop("c", "n").join(open_keys.select("key", "c", tiles), "key"), "open-members")
    small = todo.where(F.col("c") <= SMALL)
    x, y = small.select("key", F.col("node").alias("a"), F.col("component").alias("_ca")), small.select("key", F.col("node").alias("b"), F.col("component").alias("_cb"))
    pairs = x.join(y, "key").where("a < b AND _ca != _cb").select("a", "b").distinct()
    seen = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = _confirmed(_within_radius(pairs.join(seen, ["a", "b"], "left_anti"), classes, radius_of(percent)), texts, percent)
    large = _tile_links(todo.where(F.col("c") > SMALL).join(classes.select("node", "sig"), "node").join(texts, "node"), percent)
    final = components(links.unionByName(more).unionByName(large))

    nodes = rows.where("node >= 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    placed = materialize(nodes.join(final, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed-classes")
    least = materialize(placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("classes")), "components")
    told = materialize(join_spread(placed.drop("least"), least, ["component"], "classes", F.col("node")), "named-classes")
    slim = rows.drop("sig")
    full = join_spread(slim.where("node >= 0"), told, ["node"], "n", F.xxhash64("doc_id", "text_key"))
    return full.unionByName(slim.where("node < 0").withColumns({"component": F.lit(None).cast("long"), "component_id": F.col("doc_id")}))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """A row per row of ``docs``: doc_id, text_key, n_shingles, component_id, kept."""
    named = _grouped(docs, doc_id, text, percent)
    return named.select("doc_id", "text_key", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, and all rows without shingles, which are linked with nothing.

    Of a group the row of the smallest doc_id (null last), then of the smallest text_key stays; of rows equal in both
    the smallest by all columns.  All columns are passed through, whatever their names.
    """
    own_, id_, key_, many_ = spare(docs, "_own", "_id", "_key", "_many")
    named = _grouped(docs, "doc_id", "text", percent)
    copies = materialize(named.groupBy("node", "component", "doc_id", "text_key").agg(F.count("*").alias("n")), "copies")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "n")
    chosen = copies.where("node >= 0").groupBy("component").agg(F.min(rank).alias("_k")).select("_k.doc_id", "_k.text_key", (F.col("_k.n") > 1).alias("many"))
    empty = copies.where("node < 0").select("doc_id", "text_key", F.lit(False).alias("many"))
    keys = chosen.unionByName(empty).select(F.col("doc_id").alias(id_), F.col("text_key").alias(key_), F.col("many").alias(many_))
    own = docs.withColumn(own_, F.xxhash64(text_of("text")))
    held = own.join(keys.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own_) == F.col(key_)))
    single = held.where(~F.col(many_)).select(*docs.columns)
    least = held.where(many_).groupBy(id_, key_).agg(F.min(F.struct(*docs.columns)).alias("_row")).select("_row.*")
    return single.unionByName(least)
