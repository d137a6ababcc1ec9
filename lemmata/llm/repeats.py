"""Removal of long repeated byte strings by a depth-limited radix sort of suffixes.

A byte goes if a window of ``LENGTH`` bytes that covers it starts anywhere else as well.
Only the first LENGTH bytes of a suffix count, so suffixes are ordered no further.  They
are split by digits, the most significant first; after each pass groups of one are
dropped; the groups that are left after the last digit are exactly the repeated windows.

* Pass 1, digit: the first ``GRAM`` bytes of the suffix.  Suffixes whose digit has a hash
  divisible by ``SAMPLE`` are counted over the whole table: the same ones wherever the
  digit stands, so all occurrences of a digit are counted or none.  A suffix whose first
  LENGTH bytes begin with or contain a digit that occurs once is itself alone and is
  dropped; runs of neighbouring suffixes live or die together and move as ranges.
* Pass 2, digit: the rest of the window, within the groups of pass 1 (the hash of both
  digits).  It is taken of every suffix that is left, and groups of one are dropped.

``exchange`` counts the digits, block by block, so no task sees a whole group, be it ever
so large: a digit is one entry a block.  Between the passes equal texts, known by a 64-bit
hash and their length, become one that counts as often as it stands in the table.  Digits
of pass 1 are compared by few bits, as a wrong match only leaves more to pass 2; those of
pass 2 by so many that one window in four thousand million meets another by chance.

Nulls and edges: a null text is the empty text; texts shorter than LENGTH lose nothing;
matches never cross texts; two equal rows make each other's windows repeated; an empty
table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import U64, between, mix, prefix, text_buffer
from .common import BROADCAST_ROWS, join_spread, materialize, text_of
from .exchange import Plan, exchange, frame, key_bits, pack, plan, unframe, unpack

LENGTH, GRAM, SAMPLE = 400, 64, 16
_PIECE = 1 << 20
FRACTION = 4
_RANGES = "text_key long, size long, ranges array<struct<lo:long,hi:long>>"
_CUT = "text_key long, size long, gone long, count long, sha string, times long"


def sampled(data: np.ndarray, offsets: np.ndarray, gram: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the digits of pass 1 that are counted; a digit never crosses texts."""
    places, hashes = [], []
    for begin in range(0, max(0, len(data) - gram + 1), _PIECE):
        part = data[begin : begin + _PIECE + gram - 1]
        start = np.arange(len(part) - gram + 1)
        h = mix(between(prefix(part), start, start + gram))
        hit = np.flatnonzero(h % U64(sample) == 0)
        places.append(hit + begin)
        hashes.append(h[hit])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at, h = np.concatenate(places), np.concatenate(hashes)
    inside = at + gram <= offsets[np.searchsorted(offsets, at, "right")]
    return at[inside], h[inside]


def left_over(sizes: np.ndarray, at: np.ndarray, text: np.ndarray, alone: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, lo, hi): ranges of suffixes that no lone digit kills; ``at`` are the places of digits in their ``text``."""
    n = len(sizes)
    # A wall stands before each text, at every lone digit, and behind the last digit that fits.
    which = np.concatenate([np.arange(n), text[alone], np.arange(n)])
    wall = np.concatenate([np.full(n, -1), at[alone], sizes - gram + 1])
    order = np.lexsort((wall, which))
    which, wall = which[order], wall[order]
    lo, hi = wall[:-1] + 1, wall[1:] - (length - gram)
    keep = (which[1:] == which[:-1]) & (hi > lo)
    return which[:-1][keep], lo[keep], hi[keep]


def surviving(docs: DataFrame, sizes: Plan, total: int, text: str, length: int, gram: int, sample: int) -> DataFrame:
    """Pass 1: (text_key, size, ranges) of each row with suffixes that are left."""
    slim = docs.select(F.xxhash64(text_of(text)).alias("text_key"), F.octet_length(text_of(text)).cast("long").alias("size"), F.col(text).alias("text")).where(F.col("size") >= length)
    bits = key_bits(total // sample, 8)

    def ask(t):
        data, offsets = text_buffer(t["text"])
        at, h = sampled(data, offsets, gram, sample)
        keys, place, n = np.unique(h >> U64(64 - bits), return_inverse=True, return_counts=True)
        own = [t["text_key"].to_numpy(), t["size"].to_numpy(), np.diff(np.searchsorted(at, offsets)).astype(np.uint32), np.diff(at, prepend=0).astype(np.uint32), place.astype(np.uint32)]
        return [(keys, np.minimum(n, 2))], frame([pack(x) for x in own])

    def walk(own, totals, told):
        key, size, n, at, place = map(unpack, unframe(own))
        repeated = totals[0][place] > 0
        which = np.repeat(np.arange(len(size)), n)
        within = np.cumsum(at.astype(np.int64)) - (np.cumsum(size) - size)[which]
        who, lo, hi = left_over(size, within, which, ~repeated, length, gram)
        names, begin = np.unique(who, return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(who)), pa.int32()), pa.StructArray.from_arrays([pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["lo", "hi"]))
        return pa.table({"text_key": key[names], "size": size[names], "ranges": lists})

    return exchange(slim, sizes, [bits], ask, walk, _RANGES, reply=_more_than_one)


def _more_than_one(totals: np.ndarray) -> np.ndarray:
    return (totals > 1).astype(np.uint8)


def _windows(t: pa.Table, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, key, times) of the suffixes of pass 2, in order; the key is the hash of both digits."""
    data, offsets = text_buffer(t["text"])
    ranges = t["ranges"].combine_chunks()
    n = ranges.value_lengths().to_numpy()
    flat = ranges.flatten()
    lo, hi = flat.field("lo").to_numpy(), flat.field("hi").to_numpy()
    row = np.repeat(np.repeat(np.arange(len(n)), n), hi - lo)
    start = np.arange(len(row)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
    at = start + offsets[row]
    sums = prefix(data)
    first, rest = mix(between(sums, at, at + gram)), between(sums, at + gram, at + length)
    return row, start, mix(first + mix(rest) * U64(0x9E3779B97F4A7C15)), t["times"].to_numpy()[row]


def repeated_windows(texts: DataFrame, sizes: Plan, total: int, length: int, gram: int) -> DataFrame:
    """Pass 2: (text_key, size, gone, count, sha, times) of each text: what its repeated windows cover, and a digest of the rest."""
    bits = key_bits(total, 32)

    def ask(t):
        _, _, key, times = _windows(t, length, gram)
        keys, place = np.unique(key >> U64(64 - bits), return_inverse=True)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(t)
        return [(keys, np.minimum(np.bincount(place, times, len(keys)), 2).astype(np.int64))], sink.getvalue().to_pybytes()

    def walk(own, totals, told):
        t = pa.ipc.open_stream(own).read_all().combine_chunks()
        row, start, key, _ = _windows(t, length, gram)
        place = np.unique(key >> U64(64 - bits), return_inverse=True)[1]
        hit = totals[0][place] > 0
        row, start = row[hit], start[hit]
        data, offsets = text_buffer(t["text"])
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] > start[:-1] + length)
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(row))[: len(begin)] - 1
        of, a, b = row[begin], start[begin], start[last] + length
        cut = np.searchsorted(of, np.arange(t.num_rows + 1))
        out = []
        for i in range(t.num_rows):
            view, at, kept, gone = memoryview(data[offsets[i] : offsets[i + 1]]), 0, hashlib.sha256(), 0
            for x, y in zip(a[cut[i] : cut[i + 1]].tolist(), b[cut[i] : cut[i + 1]].tolist(), strict=True):
                kept.update(view[at:x])
                at, gone = y, gone + y - x
            kept.update(view[at:])
            out.append((gone, int(cut[i + 1] - cut[i]), kept.hexdigest()))
        gone, count, sha = zip(*out, strict=True) if out else ([], [], [])
        return pa.table({"text_key": t["text_key"], "size": t["size"], "gone": pa.array(gone, pa.int64()), "count": pa.array(count, pa.int64()), "sha": pa.array(sha, pa.string()), "times": t["times"]})

    return exchange(texts, sizes, [bits], ask, walk, _CUT, reply=_more_than_one)


def removal_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, sample: int = SAMPLE, block_bytes: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Each distinct text is cut once; its copies join the result without their texts.
    """
    spark, whole = docs.sparkSession, text_of(text)
    total = docs.agg(F.sum(F.octet_length(whole))).first()[0] or 0
    left = materialize(surviving(docs, plan(spark, total, block_bytes), total, text, length, gram, sample), "suffix-ranges")
    asked = materialize(left.groupBy("text_key", "size").agg(F.first("ranges").alias("ranges"), F.count("*").alias("times")), "suffix-asked")
    n, bytes_left, windows = asked.agg(F.count("*"), F.sum("size"), F.sum(F.expr("aggregate(ranges, 0L, (a, r) -> a + r.hi - r.lo)"))).first()
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(whole).alias("text_key"), F.octet_length(whole).cast("long").alias("size"), whole.alias("text"))
    found = own.select("text_key", "size", "text").join(F.broadcast(asked) if n <= BROADCAST_ROWS else asked.hint("shuffle_hash"), ["text_key", "size"])
    once = found.groupBy("text_key", "size").agg(F.first("text").alias("text"), F.first("ranges").alias("ranges"), F.first("times").alias("times"))
    texts = materialize(once, "suffix-texts")
    # A block of pass 2 has up to a row a byte, so it is a fraction of one of pass 1.
    sizes = plan(spark, bytes_left or 0, block_bytes)
    sizes = Plan(max(1, sizes.block_bytes // FRACTION), sizes.buckets, sizes.tasks * FRACTION)
    cut = materialize(repeated_windows(texts, sizes, windows or 0, length, gram), "suffix-cut")
    rows = own.select("doc_id", "text_key", "size", F.sha2("text", 256).alias("_whole"))
    out = join_spread(rows, cut, ["text_key", "size"], "times", F.col("doc_id"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias
    return out.select("doc_id", F.col("size").alias("n_bytes"), zero("gone")("n_removed"), zero("count")("n_spans"), F.coalesce("sha", "_whole").alias("kept_sha256"))
