"""The pipeline's stages against their contracts, each on its own input."""

import hashlib
from collections import defaultdict

import corpus_pipeline
from lemmata.llm import langid, mixing, neardup

from . import brute

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
        out = corpus_pipeline.materialize(stage(spark, docs, SMALL), name)
        seen[name] = (before, out.collect())
        if name != "source_mix":
            assert out.columns == columns
        docs = out
    texts = lambda name: [r[:2] for r in seen[name][0]]
    _, out = seen["language_id"]
    fitted = langid.fit_dictionaries(spark.read.parquet(f"{SMALL}/documents.parquet").where("NOT coalesce(crc32(cast(doc_id AS string)) % 5 = 0, false)"))
    told = {i: brute.language(t, fitted) for i, t in texts("language_id")}
    assert {r["doc_id"] for r in out} == {i for i, (k, margin) in told.items() if k != "und" and margin >= langid.MIN_MARGIN} and len(out) > 0.9 * len(told)
    _, out = seen["line_dedup"]
    kept = {i: sha for i, _, _, sha in brute.lines(texts("line_dedup"))}
    assert {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in out} == kept and all(r["n_chars"] == len(r["text"]) for r in out if r["text"])
    _, out = seen["near_dedup"]
    assert {r["doc_id"] for r in out} == {r[0] for r in brute.near_duplicates(texts("near_dedup"), 80) if r[3] or not r[1]}
    before, out = seen["decontamination"]
    bad = {i for i, _ in brute.leaks(texts("decontamination"), items)}
    assert bad and {r["doc_id"] for r in out} == {i for i, _, _ in before} - bad
    before, out = seen["source_mix"]
    size, words = defaultdict(int), {i: brute.WORD.findall(t or "") for i, t, _ in before}
    for i, _, s in before:
        size[s] += len(words[i])
    order = sorted(size, key=lambda s: (s is None, s))
    want = mixing.targets([size[s] for s in order], [mixing.WEIGHTS[k % 3] for k in range(len(order))])
    got = defaultdict(int)
    for r in out:
        got[r["source"]] += r["n_words"]
        assert len(r["text"].split(" ")) == r["n_words"] and set(r["text"].split(" ")) <= {w for i in r["doc_ids"] for w in words[i]}
    assert all(abs(got[s] - w) <= 1 for s, w in zip(order, want, strict=True))


def test_near_dedup_takes_four_fifths(spark):
    """Of a text and a copy with scattered edits, 0.80 to 0.85 similar, one stays."""
    words = [f"w{k}" for k in range(400)]
    edited = ["edit" if k % 50 == 25 else w for k, w in enumerate(words)]
    rows = [(1, " ".join(words), "en", "s", 0), (2, " ".join(edited), "en", "s", 0)]
    a, b = (brute.shingles(r[1]) for r in rows)
    assert 0.8 <= len(a & b) / len(a | b) < 0.85
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.dedup_documents(spark, docs, SMALL).collect()] == [1]


def test_radius_follows_the_similarity():
    assert (neardup.radius_of(85), neardup.chunks_of(85)) == (22, 12)
    assert neardup.radius_of(80) == 27 and neardup.radius_of(80) // neardup.chunks_of(80) == 1
