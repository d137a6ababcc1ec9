"""Media columns: interleaved sequences of text and media references, resolved by digest.

``interleave`` parses HTML into an ordered array of structs: runs of text, and media
references with their place, digest and caption.  ``store`` keeps payloads as lossless
8-bit greyscale PNG images of 64 samples a row, one per digest.  ``read_features`` decodes
the stored bytes and describes them.  ``resolve`` joins references to the stored media on
the digest; only descriptions travel with the references, never payloads, and a digest
that many references name is looked up in a broadcast table, so that it neither multiplies
its bytes nor meets in one task.  Positions and captions stay with their reference.  Media
named by another address than ``sha256:`` get their digest from a table of what was
fetched (``fetched``: src, digest).

Nulls and edges: null HTML gives an empty sequence, a null payload counts as empty; an
empty payload is padded to 64 zero bytes; a reference without stored media stays, with
``found`` false; unknown tags are dropped and their text stays; an unclosed tag ends with
the page, and of an unclosed script or style only the tag is dropped; a caption that isn't
closed ends with its figure or the page.  Other columns of the pages are passed through;
where one has the name of a result, the result's name gets a trailing underscore.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_spread, materialize, spare, text_of

SEQUENCE = "array<struct<position:int,kind:string,text:string,src:string,digest:string,caption:string>>"
WIDTH = 64
SCHEME = "sha256:"
_PNG = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def pad(raw: bytes) -> bytes:
    """``raw`` with zero bytes up to a positive multiple of the row width."""
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def encode_png(payload: bytes) -> bytes:
    """A greyscale image whose samples, row by row, are the payload."""
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    return _PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(stored: bytes) -> bytes:
    """The samples of an image that ``encode_png`` wrote; checks signature, checksums and shape."""
    if stored[:8] != _PNG:
        raise ValueError("not a PNG")
    at, body, width, rows = 8, [], 0, 0
    while at < len(stored):
        (n,), kind = struct.unpack(">I", stored[at : at + 4]), stored[at + 4 : at + 8]
        part = stored[at + 8 : at + 8 + n]
        if struct.unpack(">I", stored[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + part):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            width, rows = struct.unpack(">II", part[:8])
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(rows, width + 1)
    if lines[:, 0].any():
        raise ValueError("a row is filtered")
    return lines[:, 1:].tobytes()


def describe(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples and an 8 by 8 difference hash of their row means."""
    samples = np.frombuffer(payload, np.uint8)
    share = np.bincount(samples, minlength=256) / len(samples)
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    grid = samples.reshape(-1, WIDTH).astype(np.int64)
    bands = np.array_split(grid, 8) if len(grid) >= 8 else [grid] * 8
    means = np.array([[c.sum() * 1000 // max(1, c.size) for c in np.array_split(b.sum(axis=0) // max(1, len(b)), 9)] for b in bands])
    bits = (means[:, 1:] > means[:, :-1]).ravel()
    return f"mean={samples.mean():.4f};std={samples.std():.4f};entropy={entropy:.4f};dhash={int(np.packbits(bits).tobytes().hex(), 16):016x}"


def _without_open_scripts(html: str) -> str:
    """``html`` without the opening tags of scripts and styles that are never closed."""
    for tag in ("script", "style"):
        last = html.lower().rfind(f"</{tag}")
        head, tail = (html[:last], html[last:]) if last >= 0 else ("", html)
        if f"<{tag}" in tail.lower():
            html = head + re.sub(rf"<{tag}\b[^>]*>", " ", tail, flags=re.IGNORECASE)
    return html


def parse(html: str | None) -> list[dict]:
    """The ordered parts of a page; a figure's caption goes with the media in it, else the alternative text does."""
    from html.parser import HTMLParser

    html = _without_open_scripts(html or "")
    out: list[dict] = []
    figure: list[int] = []
    state = {"skip": 0, "caption": None}

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            if tag in ("script", "style"):
                state["skip"] += 1
            elif tag == "figure":
                figure.append(len(out))
            elif tag == "figcaption":
                state["caption"] = []
            elif tag in ("img", "audio", "video", "source") and (a.get("src") or ""):
                src = a["src"]
                out.append({"position": 0, "kind": "media", "text": None, "src": src, "digest": src.removeprefix(SCHEME) if src.startswith(SCHEME) else None, "caption": a.get("alt")})

        def handle_endtag(self, tag):
            if tag in ("script", "style"):
                state["skip"] = max(0, state["skip"] - 1)
            elif tag == "figcaption":
                end_caption()
            elif tag == "figure" and figure:
                end_caption()
                figure.pop()

        def handle_data(self, data):
            if state["skip"] or not data.strip():
                return
            if state["caption"] is not None:
                state["caption"].append(data)
            elif out and out[-1]["kind"] == "text":
                out[-1]["text"] += " " + " ".join(data.split())
            else:
                out.append({"position": 0, "kind": "text", "text": " ".join(data.split()), "src": None, "digest": None, "caption": None})

    def end_caption():
        if state["caption"] is not None:
            said, state["caption"] = " ".join(" ".join(state["caption"]).split()), None
            for part in out[figure[-1] if figure else len(out) :]:
                if part["kind"] == "media":
                    part["caption"] = said

    reader = Reader(convert_charrefs=True)
    reader.feed(html)
    reader.close()
    end_caption()
    for i, part in enumerate(out):
        part["position"] = i
    return out


def interleave(pages: DataFrame, html: str = "html", out: str = "sequence") -> DataFrame:
    """``pages`` with the array of ordered parts instead of the HTML."""
    own = [c for c in pages.columns if c != html]
    schema = T.StructType([*(pages.schema[c] for c in own), T.StructField(out, T._parse_datatype_string(SEQUENCE))])
    kind = pa.list_(pa.struct([("position", pa.int32()), *((n, pa.string()) for n in ("kind", "text", "src", "digest", "caption"))]))

    def run(batches):
        for b in batches:
            parts = pa.array([parse(x) for x in b.column(html).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), parts], names=[*own, out])

    return pages.mapInArrow(run, schema)


def store(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """(digest, n_bytes, media): each distinct payload once, as a PNG; copies within a batch are encoded once."""

    def run(batches):
        for b in batches:
            seen: dict[str, tuple[int, bytes]] = {}
            for x in b.column(payload):
                raw = x.as_py() or b""
                digest = hashlib.sha256(raw).hexdigest()
                if digest not in seen:
                    seen[digest] = (len(raw), encode_png(pad(raw)))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.binary())], names=["digest", "n_bytes", "media"])

    encoded = payloads.select(F.col(payload).cast("binary").alias(payload)).mapInArrow(run, "digest string, n_bytes long, media binary")
    return encoded.dropDuplicates(["digest"])


FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_features(media: DataFrame) -> DataFrame:
    """What the stored bytes of each digest hold, read back from them."""

    def run(batches):
        for b in batches:
            rows = []
            for digest, n, stored in zip(b.column("digest").to_pylist(), b.column("n_bytes").to_pylist(), b.column("media"), strict=True):
                raw = stored.as_py()
                payload = decode_png(raw)
                rows.append((digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(raw), hashlib.sha256(raw).hexdigest(), describe(payload)))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in FEATURES.split(", ")])

    return media.mapInArrow(run, FEATURES)


REFERENCE = ("position", "caption", "src", "digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "found")


def resolve(sequences: DataFrame, features: DataFrame, sequence: str = "sequence", fetched: DataFrame | None = None) -> DataFrame:
    """A row for each media reference: the columns of its page, then REFERENCE: what it says, what is stored under its digest, and found."""
    own = [c for c in sequences.columns if c != sequence]
    names = dict(zip(REFERENCE, spare(sequences.select(*own), *REFERENCE), strict=True))
    refs = sequences.select(F.struct(*own).alias("page"), F.explode(F.expr(f"filter(`{sequence}`, x -> x.kind = 'media')")).alias("_r")).select("page", "_r.position", "_r.caption", "_r.src", "_r.digest")
    refs = materialize(refs, "media-references")
    if fetched is not None:
        asked = refs.groupBy("src").agg(F.count("*").alias("times")).join(fetched.select("src", F.col("digest").alias("known")).dropDuplicates(["src"]), "src")
        refs = join_spread(refs, materialize(asked, "media-fetched"), ["src"], "times", F.xxhash64("page", "position")).withColumn("digest", F.coalesce("digest", "known")).drop("known")
    times = refs.groupBy("digest").agg(F.count("*").alias("times"))
    known = materialize(features.withColumn("found", F.lit(True)).join(times, "digest"), "media-known")
    joined = join_spread(refs, known, ["digest"], "times", F.xxhash64("page", "position")).withColumn("found", F.coalesce("found", F.lit(False)))
    return joined.select("page.*", *(F.col(c).alias(names[c]) for c in REFERENCE))


def page_of(text: Column) -> Column:
    """A page that shows a text line by line, its own bytes as a figure behind the first line, which is the caption."""
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    first, lines = F.substring_index(safe, "\n", 1), F.split(safe, "\n", -1)
    figure = F.concat(F.lit(f'<figure><img src="{SCHEME}'), F.sha2(text.cast("binary"), 256), F.lit('"><figcaption>'), first, F.lit("</figcaption></figure>"))
    return F.concat(F.lit("<h1>"), first, F.lit("</h1>"), figure, F.lit("<p>"), F.array_join(F.slice(lines, 2, F.greatest(F.lit(0), F.size(lines) - 1)), "</p><p>"), F.lit("</p>"))


def document_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document as a page of its text and its own bytes, resolved against the stored media; n_parts counts the page's parts."""
    whole = text_of(text)
    pages = docs.select(F.col(doc_id).alias("doc_id"), page_of(whole).alias("html"))
    features = read_features(store(docs.select(whole.cast("binary").alias("payload"))))
    parts = interleave(pages).withColumn("n_parts", F.size("sequence"))
    return resolve(parts, features).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_parts", "position", "caption", "digest")
