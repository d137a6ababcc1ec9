"""Counting hashed keys over a whole table, block by block.

Rows are read in blocks of about ``block_bytes`` of text.  A block sends its sorted
distinct keys with their counts to ``buckets`` buckets by hash range: a key that is a
third of all occurrences is one entry a block.  A bucket adds up the counts of all blocks
and answers each block with the totals of the keys it asked for, in its order.  The block
then goes on with what it kept and the totals.  No task sees all keys, nothing goes to
the driver, and every total covers the whole table.

Keys are stored as differences of sorted integers, byte planes apart, compressed; their
width follows from the number of keys of the table, so that a key meets another one by
chance with a probability that is chosen.  Blocks are numbered by partition and place, so
the rows must come from files: a task that is run again then makes the same blocks.

Scale: messages number blocks times buckets.  ``plan`` grows blocks from 8 to 64 MB and
buckets from one per 8 MB with the text, and keeps messages above about 500 bytes: 100 TB
make 1.6 million blocks of 64 MB and 131,072 buckets, each of which adds up about 1 GB.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytesops import U64, text_buffer

MESSAGE = "dest long, src long, kind int, bucket int, payload binary"
_NAMES = [x.split()[0] for x in MESSAGE.split(", ")]
_KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
KEYS, OWN, ANSWER = 0, 1, 2


@dataclass(frozen=True)
class Plan:
    block_bytes: int
    buckets: int
    tasks: int


def plan(spark, total_bytes: int, block_bytes: int | None = None, least: int = 8 << 20) -> Plan:
    """Sizes for ``total_bytes`` of text; blocks hold ``least`` bytes or more."""
    block = block_bytes or int(min(64 << 20, max(least, (8 << 20) * sqrt(total_bytes / (1 << 40)))))
    buckets = max(4, min(ceil(total_bytes / (8 << 20)), max(16, block // 512)))
    return Plan(block, buckets, max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(total_bytes / block)))


def key_bits(n_keys: int, spare: int) -> int:
    """Bits of a key, so that it meets one of ``n_keys`` others with probability 2 ** -spare."""
    return max(32, min(64, ceil(log2(max(2, n_keys))) + spare))


def pack(a: np.ndarray) -> bytes:
    """Compress an integer array, byte planes apart."""
    import zstandard

    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if len(a) else b""
    return struct.pack("<cBQ", a.dtype.char.encode(), a.itemsize, len(a)) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(raw: bytes) -> np.ndarray:
    import zstandard

    kind, size, n = struct.unpack("<cBQ", raw[:10])
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[10:]), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(np.dtype(kind.decode())).reshape(n)


def frame(parts: list[bytes]) -> bytes:
    return struct.pack(f"<I{len(parts)}Q", len(parts), *map(len, parts)) + b"".join(parts)


def unframe(raw: bytes) -> list[bytes]:
    (n,) = struct.unpack("<I", raw[:4])
    at, out = 4 + 8 * n, []
    for size in struct.unpack(f"<{n}Q", raw[4 : 4 + 8 * n]):
        out.append(raw[at : at + size])
        at += size
    return out


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Tables of about ``limit`` bytes of text each; one row at least."""
    held, size = [], 0
    for batch in batches:
        sizes = np.diff(text_buffer(batch.column("text"))[1])
        at = 0
        while at < len(sizes):
            room = np.cumsum(sizes[at:]) + size
            n = int(np.searchsorted(room, limit, "left")) + 1
            part = batch.slice(at, min(n, len(sizes) - at))
            held.append(part)
            size += int(sizes[at : at + part.num_rows].sum())
            at += part.num_rows
            if size >= limit:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in the smallest unsigned type that holds them."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _KINDS]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)


def _nothing(keys: list[np.ndarray], totals: list[np.ndarray]) -> np.ndarray:
    return np.zeros(0, np.int64)


def exchange(
    rows: DataFrame,
    sizes: Plan,
    bits: list[int],
    ask: Callable[[pa.Table], tuple[list[tuple[np.ndarray, np.ndarray]], bytes | None]],
    walk: Callable[[bytes, list[np.ndarray], np.ndarray], pa.Table],
    schema: str,
    reply: Callable[[np.ndarray], np.ndarray] = narrow,
    stats: Callable[[list[np.ndarray], list[np.ndarray]], np.ndarray] = _nothing,
    keep: Callable[[pa.Table], bytes] | None = None,
) -> DataFrame:
    """What ``walk`` makes of each block of ``rows``, which have a column text.

    ``ask`` gives a block's sorted distinct keys and counts, one pair for each entry of ``bits`` (the width of its keys), and
    what the block keeps.  ``walk`` gets that, the totals as ``reply`` coded them, in the order of the keys, and the sum over
    all buckets of ``stats``.  What a block keeps passes both shuffles; with ``keep``, which makes it from the rows alone, they
    are read once more for it, and it passes only the second one.
    """
    p, block_bytes = sizes.buckets, sizes.block_bytes

    def send(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        for i, t in enumerate(gathered(batches, block_bytes)):
            tables, own = ask(t)
            cuts = [np.searchsorted((k >> U64(b - 32)) * U64(p) >> U64(32), np.arange(p + 1)) for (k, _), b in zip(tables, bits, strict=True)]
            out = []
            for b in range(p):
                part = [(k[c[b] : c[b + 1]], n[c[b] : c[b + 1]]) for (k, n), c in zip(tables, cuts, strict=True)]
                out.append((b, base + i, KEYS, b, frame([x for k, n in part for x in (pack(np.diff(k, prepend=U64(0))), pack(narrow(n)))])))
            if own is not None:
                out.append(((base + i) % p, base + i, OWN, -1, own))
            yield _messages(out)

    def hold(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        for i, t in enumerate(gathered(batches, block_bytes)):
            yield _messages([(base + i, base + i, OWN, -1, keep(t))])

    def answer(key, table):
        out, asked = [], []
        for r in table.to_pylist():
            if r["kind"] == OWN:
                out.append((r["src"], r["src"], OWN, -1, r["payload"]))
            else:
                asked.append((r["src"], r["bucket"], [unpack(x) for x in unframe(r["payload"])]))
        if asked:
            keys, totals, places = [], [], []
            for j in range(len(bits)):
                own = [np.cumsum(x[2 * j], dtype=U64) for _, _, x in asked]
                values, place = np.unique(np.concatenate(own), return_inverse=True)
                keys.append(values)
                totals.append(np.bincount(place, np.concatenate([x[2 * j + 1] for _, _, x in asked]), len(values)).astype(np.int64))
                places.append(np.split(place, np.cumsum([len(x) for x in own])[:-1]))
            told = pack(stats(keys, totals))
            for i, (src, bucket, _) in enumerate(asked):
                out.append((src, src, ANSWER, bucket, frame([told, *(pack(reply(t[pl[i]])) for t, pl in zip(totals, places, strict=True))])))
        return pa.Table.from_batches([_messages(out)])

    def finish(got):
        (own,) = (r["payload"] for r in got if r["kind"] == OWN)
        answers = sorted((r for r in got if r["kind"] == ANSWER), key=lambda r: r["bucket"])
        if [r["bucket"] for r in answers] != list(range(p)):
            raise ValueError("a block did not get one answer from each bucket")
        parts = [[unpack(x) for x in unframe(r["payload"])] for r in answers]
        return walk(own, [np.concatenate([x[1 + j] for x in parts]) for j in range(len(bits))], sum(x[0] for x in parts))

    asked = rows.mapInArrow(send, MESSAGE).repartition(max(p, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "dest")
    answered = asked.groupBy("dest").applyInArrow(answer, MESSAGE).repartition(sizes.tasks, "dest").groupBy("dest")
    if keep is None:
        return answered.applyInArrow(lambda key, table: finish(table.to_pylist()), schema)
    # Blocks are numbered alike in both readings, as the rows come from the same files in the same order.
    held = rows.mapInArrow(hold, MESSAGE).repartition(sizes.tasks, "dest").groupBy("dest")
    return answered.cogroup(held).applyInArrow(lambda key, table, kept: finish(table.to_pylist() + kept.to_pylist()), schema)
