"""Chat formatting by quotation linking, with DataFrame operations only.

Lines that start with ``>`` are quotes; the number of leading ``>`` (spaces between them
allowed) is the quote level.  Consecutive lines of a level form a passage.  Passages and
the unquoted lines and whole unquoted texts of messages are normalised (lower case,
everything but letters and digits folded to single spaces) and hashed; a quoted passage,
or else each of its lines, links to the latest earlier message of its conversation that
holds it unquoted.  A message replies to the message that its outermost quotes link to
most often (the latest of equals), or else to the message before it.  Roots and depths
follow by pointer doubling over (conversation, turn), so a conversation of any length
takes a logarithmic number of joins.  The latest earlier message (of all, or of those that
hold a passage) is found within stretches of ``STRETCH`` turns by a running maximum, and
before a stretch by one over the maxima of the stretches, so neither a conversation nor a
passage that its messages repeat is gathered in one task, and no pairs of messages are made.

Nulls and edges: a null text is empty and quotes nothing; messages with a null
conversation or turn are kept, unlinked, as their own roots; rows of equal conversation and turn are kept
and share one reply target; quotes without a letter or digit are not
linked; an unmatched quote is dropped from the text all the same and counted; columns but
conv_id, turn, role and text are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_spread, materialize, text_of

MARK = r"^(\s{0,3}>)+ ?"
STRETCH = 4096


def normalised(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, row, level, pos, line, run): the lines of every message; run numbers the passages of a message."""
    split = messages.select("conv_id", "turn", "row", F.posexplode(F.split(text_of("text"), "\n", -1)).alias("pos", "raw"))
    prefix = F.regexp_extract("raw", MARK, 0)
    lines = split.select("conv_id", "turn", "row", "pos", (F.char_length(prefix) - F.char_length(F.replace(prefix, F.lit(">"), F.lit("")))).alias("level"), F.regexp_replace("raw", MARK, "").alias("line"))
    order = Window.partitionBy("row").orderBy("pos")
    change = (F.col("level") != F.lag("level").over(order)) | F.lag("level").over(order).isNull()
    return lines.withColumn("_new", change.cast("int")).withColumn("run", F.sum("_new").over(order)).drop("_new")


def link_conversations(conversations: DataFrame) -> DataFrame:
    """A row per message: conv_id, turn, role, body (text without quotes), reply_to, root, depth, n_quotes, n_linked, quoted_levels."""
    messages = materialize(conversations.select(F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text")).withColumn("row", F.monotonically_increasing_id()), "messages")
    quoting = messages.where(text_of("text").rlike(r"(^|\n)\s{0,3}>"))
    parts = materialize(passages(quoting), "quote-lines")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    runs = parts.groupBy("conv_id", "turn", "row", "run", "level").agg(joined.alias("passage"))
    quotes = runs.where("level > 0").select("conv_id", "turn", "row", "run", "level", normalised(F.col("passage")).alias("whole"))
    quote_lines = parts.where("level > 0").select("conv_id", "turn", "row", "run", "level", normalised(F.col("line")).alias("whole"))
    asked = quotes.withColumn("part", F.lit(0)).unionByName(quote_lines.withColumn("part", F.lit(1))).where("whole != ''").select("conv_id", "turn", "row", "run", "level", "part", F.xxhash64("whole").alias("h"))

    plain = messages.where(~text_of("text").rlike(r"(^|\n)\s{0,3}>")).select("conv_id", "turn", "row", F.lit(1).alias("run"), text_of("text").alias("passage"))
    own = runs.where("level = 0").select("conv_id", "turn", "row", "run", "passage").unionByName(plain.withColumn("run", F.col("run").cast("long")))
    pieces = own.select("conv_id", "turn", F.explode(F.array_distinct(F.concat(F.array("passage"), F.split("passage", "\n", -1)))).alias("_p"))
    held = pieces.select("conv_id", "turn", normalised(F.col("_p")).alias("_n")).where("_n != ''").select("conv_id", F.col("turn").alias("origin"), F.xxhash64("_n").alias("h"))
    questions = asked.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "h", "turn").distinct()
    wanted = held.join(questions.select("conv_id", "h").distinct(), ["conv_id", "h"], "left_semi").distinct()
    both = questions.withColumn("origin", F.lit(None).cast(questions.schema["turn"].dataType)).unionByName(wanted.select("conv_id", "h", F.col("origin").alias("turn"), "origin"))
    answers = latest_before(both, ["conv_id", "h"], "turn", "origin").where("origin IS NULL AND before IS NOT NULL").select("conv_id", "h", "turn", F.col("before").alias("origin"))
    matched = asked.join(answers, ["conv_id", "h", "turn"]).select("row", "run", "level", "part", "h", "origin").distinct()
    whole_hit = matched.groupBy("row", "run", "level").agg(F.min("part").alias("best"))
    chosen = matched.join(whole_hit, ["row", "run", "level"]).where(F.col("part") == F.col("best"))
    votes = chosen.groupBy("row", "level", "origin").agg(F.count("*").alias("votes"))
    outer = votes.groupBy("row").agg(F.max(F.struct((-F.col("level")).alias("l"), "votes", "origin")).alias("_b")).select("row", F.col("_b.origin").alias("quoted"))
    counted = runs.groupBy("row").agg(F.count_if(F.col("level") > 0).alias("n_quotes"), F.max("level").alias("levels"))
    linked = chosen.select("row", "run").distinct().groupBy("row").agg(F.count("*").alias("n_linked"))
    unquoted = runs.where("level = 0").groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "passage"))), lambda x: x["passage"]), "\n").alias("_body"))

    turns = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn").distinct()
    previous = latest_before(turns.withColumn("_at", F.col("turn")), ["conv_id"], "turn", "_at").drop("_at")
    told = messages.join(outer, "row").where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.max("quoted").alias("quoted"))
    parents = previous.join(told, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("quoted", "before").alias("parent"))
    roots = _follow(materialize(parents, "reply-parents"))

    out = messages.join(roots, ["conv_id", "turn"], "left").join(counted, "row", "left").join(linked, "row", "left").join(unquoted, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    body = F.when(F.col("n_quotes").isNull(), text_of("text")).otherwise(F.btrim(F.coalesce("_body", F.lit("")), F.lit("\n")))
    return out.select("conv_id", "turn", "role", body.alias("body"), F.col("parent").alias("reply_to"), F.coalesce("root", "turn").alias("root"), zero("depth").alias("depth"), zero("n_quotes").alias("n_quotes"), zero("n_linked").alias("n_linked"), zero("levels").alias("quoted_levels"))


def latest_before(rows: DataFrame, keys: list[str], turn: str, value: str) -> DataFrame:
    """``rows`` with before, the largest ``value`` of rows with equal keys and a smaller ``turn``; ``value`` is null or the row's turn."""
    cut = rows.withColumn("_stretch", F.floor(F.col(turn) / STRETCH))
    inner = Window.partitionBy(*keys, "_stretch").orderBy(turn).rangeBetween(Window.unboundedPreceding, -1)
    tops = cut.groupBy(*keys, "_stretch").agg(F.max(value).alias("_top"))
    above = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.withColumn("_carried", F.max("_top").over(above)).drop("_top")
    return cut.withColumn("_own", F.max(value).over(inner)).join(carried, [*keys, "_stretch"], "left").withColumn("before", F.coalesce("_own", "_carried")).drop("_own", "_carried", "_stretch")


def _follow(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, root, depth) of rows (conv_id, turn, parent), by pointer doubling.

    Rows that have reached their root take no part in later rounds.  A message that many others have come to, such as the first
    of a long conversation, is looked up in a broadcast table, so they don't meet in one task.
    """
    first = parents.select("conv_id", "turn", "parent", F.coalesce("parent", "turn").alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("parent").isNotNull().alias("_moved"))
    now = materialize(first, "reply-roots")
    while not now.where("_moved").isEmpty():
        moved = now.where("_moved")
        asked = moved.groupBy("conv_id", "root").agg(F.count("*").alias("_times"))
        up = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        wanted = materialize(up.join(asked, ["conv_id", "root"]), "reply-targets")
        step = join_spread(moved, wanted, ["conv_id", "root"], "_times", F.col("turn")).select("conv_id", "turn", "parent", F.coalesce("_root", "root").alias("root"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), (F.coalesce("_depth", F.lit(0)) > 0).alias("_moved"))
        now = materialize(now.where("NOT _moved").unionByName(step), "reply-roots")
    return now.drop("_moved")


def chat_report(conversations: DataFrame) -> DataFrame:
    """Digest of ``link_conversations``: the body as its SHA-256."""
    return link_conversations(conversations).withColumn("body_sha256", F.sha2("body", 256)).drop("body")
