"""Language identification by compression.

For each language a raw-content zstandard dictionary is cut from a bounded sample of its
labelled texts.  A text, lower-cased and with all but letters folded to single spaces, is
compressed whole, ``PIECE`` bytes at a time, once per dictionary; the language whose
dictionary gives the smallest sum wins, and the prediction is rejected where the
runner-up is nearly as small.

Parameters that bound the sample: ``per_lang`` texts of each language, those whose id and
text have the smallest hash, and ``dict_bytes`` bytes of them, an equal share of each text
really sampled.  The labels' counts give a bound on the hash below which twice as many
texts are expected as are wanted; only those are ranked, so a label's rows never meet in
one task, and repeated rows are one.  A text longer than its share gives up to ``pieces``
pieces, one at a hashed place in each equal part of it, of ``least_piece`` letters or more.
The driver holds one count and one dictionary per language label, and no other texts.

Nulls and edges: a null text or one without a letter is ``und`` with score 0 and
rejected; where the two smallest sums tie, a slower
compressor over the same dictionaries decides; rows with a null label are never learned from; with no learned language at all
every row is ``und``; equal sizes go to the label that sorts first, with margin 0.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import is_held_out, spare

UNDETERMINED = "und"
#: Bytes compressed at once, so that the dictionary counts as much at the end of a long text as at its start.
PIECE = 4096
#: Predictions whose runner-up is not larger by this share are rejected.
MIN_MARGIN = 0.005
RESULTS = ("lang_pred", "score", "rejected")


def letters_only(text: str) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"\P{L}+", " "))


def _compressor(dictionary: bytes, strong: bool = False):
    """The usual compressor, or a slower one that tells apart what the usual one ties on."""
    import zstandard

    if strong:
        return zstandard.ZstdCompressor(level=12, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False)

    shape = zstandard.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=16, search_log=3, min_match=4, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False)
    prepared = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    prepared.precompute_compress(compression_params=shape)
    return zstandard.ZstdCompressor(compression_params=shape, dict_data=prepared)


def fit_dictionaries(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = 400, dict_bytes: int = 32_000, pieces: int = 8, least_piece: int = 40) -> dict[str, bytes]:
    """A dictionary for each label, from at most ``per_lang`` texts and ``dict_bytes`` bytes.

    Each text gives an equal share, from all over it, so that one very long document or a common beginning doesn't fill a dictionary alone.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.xxhash64(F.col(doc_id), F.col(text)).alias("h"), F.col(text).alias("text"))
    counts = [(r["lang"], min(1 << 62, int(2 * per_lang / r["n"] * (1 << 62)))) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    bounds = spark.createDataFrame(counts, "lang string, bound long")
    few = rows.join(F.broadcast(bounds), "lang").where(F.shiftrightunsigned("h", 2) < F.col("bound")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    own = Window.partitionBy("lang")
    chosen = few.withColumn("n", F.row_number().over(own.orderBy("h"))).where(F.col("n") <= per_lang).withColumn("share", F.expr(f"cast(greatest(1, {dict_bytes} div count(*) OVER (PARTITION BY lang)) AS int)"))
    cut = chosen.select("lang", "h", "share", letters_only("text").alias("text"))
    cut = cut.withColumns({"_n": F.char_length("text"), "_k": F.expr(f"cast(least({pieces}, greatest(1, share div {least_piece})) AS int)")})
    place = "(i * (_n div _k) + pmod(xxhash64(h, i), _n div _k - share div _k + 1) + 1)"
    spread = F.expr(f"array_join(transform(sequence(0, _k - 1), i -> substring(text, cast({place} AS int), cast(share div _k AS int))), ' ')")
    sample = cut.select("lang", "h", "share", F.when(F.col("_n") <= F.col("share"), F.col("text")).otherwise(spread).alias("text"))
    texts = defaultdict(list)
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["h"])):
        texts[r["lang"]].append(r["text"].encode()[: r["share"]].decode(errors="ignore").encode())
    return {k: b"\n".join(v)[:dict_bytes] for k, v in sorted(texts.items())}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` with lang_pred, score (relative margin over the runner-up, 0 to 1) and rejected.

    Where ``docs`` has a column of such a name, the result's name gets a trailing underscore.
    """
    names, blobs, own = list(dictionaries), list(dictionaries.values()), list(docs.columns)
    lang_, score_, rejected_, letters_ = spare(docs, *RESULTS, "_letters")
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_, T.StringType()), T.StructField(score_, T.DoubleType()), T.StructField(rejected_, T.BooleanType())])
    marked = docs.withColumn(letters_, letters_only(text))

    def run(batches):
        kinds, strong = [_compressor(b) for b in blobs], [_compressor(b, True) for b in blobs]

        def sizes_of(compressors, raw):
            return sorted((sum(len(c.compress(raw[at : at + PIECE])) for at in range(0, len(raw), PIECE)), i) for i, c in enumerate(compressors))

        for batch in batches:
            langs, scores, rejected = [], [], []
            for letters in batch.column(letters_):
                raw = letters.as_buffer()
                if not raw or not raw.size or not kinds:
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                raw = memoryview(raw)
                sizes = sizes_of(kinds, raw)
                if len(sizes) > 1 and sizes[0][0] == sizes[1][0]:
                    sizes = sizes_of(strong, raw)
                margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0
                langs.append(names[sizes[0][1]])
                scores.append(margin)
                rejected.append(margin < min_margin)
            columns = [batch.column(c) for c in own]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*own, lang_, score_, rejected_])

    return marked.mapInArrow(run, schema)


def language_report(docs: DataFrame, modulus: int = 5, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected; learns from rows that aren't held out."""
    held = is_held_out("doc_id", modulus, 0)
    fitted = fit_dictionaries(docs.where(~held), **options)
    slim = docs.select("doc_id", F.col("text"), held.alias("held_out"))
    return identify(slim, fitted).drop("text")


def keep_identified(docs: DataFrame, modulus: int = 5, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows whose language is told with a sufficient margin, with their own columns."""
    fitted = fit_dictionaries(docs.where(~is_held_out("doc_id", modulus, 0)))
    return identify(docs, fitted, min_margin=min_margin).where(~F.col(spare(docs, *RESULTS)[2])).select(*docs.columns)


