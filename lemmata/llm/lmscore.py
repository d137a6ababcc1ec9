"""Language-model scoring with a weighted backoff automaton.

The model is an interpolated n-gram model of order ``order`` (3 by default) over
whole-corpus counts, with Dirichlet smoothing: p(w) = (c(w) + 1) / (N + V + 1) and
p(w | h) = (c(hw) + k p(w | h')) / (c(h) + k), where h' is h without its first word and k
the mass of the order.  It is run as an automaton.  States are the known histories of up
to order - 1 words (the start of a text counts as a word) and the root, the empty history;
an arc leads from a history over each known n-gram to the longest known history that ends
it; a failure arc leads to the state of h' with weight log10(k / (c(h) + k)); the root has
an arc for every word.  A text is read once from left to right: the state is carried,
failure arcs are taken while an arc is missing, log-probabilities add up.

Distribution: ``exchange`` adds up the n-gram counts of all blocks over the whole corpus.
A block then holds the part of the automaton that its own documents can reach, which its
size bounds, and walks it.  Words are compared by 64-bit hashes, longer n-grams by as many
bits as the size of the corpus asks for (one in 250,000 meets another by chance).

Nulls and edges: a null text is the empty text (one token, the end); a null id is
never held out and learns; repeated rows each count; an empty table gives an empty
result; with no training rows every probability is that of an unknown token; a text of
any length is read whole (in lockstep segments that begin in the state that the words
before them lead to).  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesops import U64, mix, text_buffer, words
from .common import is_held_out, text_of
from .exchange import exchange, frame, key_bits, pack, plan, unframe, unpack

#: Smoothing mass of histories of one word, two words and so on; the last one holds for longer ones.  Chosen by ``compare_masses``.
MASS = (6000.0, 15.0)
ORDER = 3
SEGMENT = 2048
BLOCK_BYTES = 10 << 20
END, START = 0x5851F42D4C957F2D, 0x14057B7EF767814F
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, train_types long, base_score double, score double"


class Block:
    """The documents of a block as local n-gram numbers.

    ``ids[k]`` numbers, for each token, the n-gram of k words that ends there (0 words: none; the start of a text counts as a
    word).  Where the text is too short, the number is that of no n-gram, ``size[k]``.
    """

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, types: np.ndarray, order: int):
        self.lengths, self.types, self.order = lengths, types, order
        self.first = np.cumsum(lengths) - lengths
        self.start = len(types)  # number of the start of a text, behind all words
        place = np.arange(len(ids)) - np.repeat(self.first, lengths)
        hashes = mix(np.append(types, U64(START))) | U64(1)
        self.ids, self.size = {1: ids}, {1: self.start + 1}
        self.hash = {1: hashes}
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[self.first] = self.start
        for k in range(2, order + 1):
            full = place >= k - 2
            code = before[full].astype(np.int64) * (self.start + 1) + ids[full]
            kinds, number = np.unique(code, return_inverse=True)
            own = np.full(len(ids), len(kinds), np.int32)
            own[full] = number
            self.ids[k], self.size[k] = own, len(kinds)
            of, to = kinds // (self.start + 1), kinds % (self.start + 1)
            self.hash[k] = mix(self.hash[k - 1][of] * U64(31) + mix(hashes[to] + U64(k)))
            if k == 2:
                self.of_two = of
            before = np.empty_like(own)
            before[1:] = own[:-1]
            before[self.first] = 0

    @classmethod
    def read(cls, texts: pa.Array, order: int) -> Block:
        data, offsets = text_buffer(texts)
        h, n = words(data, offsets)[2:]
        lengths = n + 1
        stream = np.empty(int(lengths.sum()), U64)
        ends = np.cumsum(lengths) - 1
        inside = np.ones(len(stream), bool)
        inside[ends] = False
        stream[inside] = h
        stream[ends] = U64(END)
        del h, inside
        types, ids = np.unique(stream, return_inverse=True)
        del stream
        return cls(ids.astype(np.int32), lengths, types, order)

    def keys(self, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Sorted distinct keys of words and of longer n-grams, and for each n-gram the place of its key."""
        longer = np.concatenate([np.zeros(0, U64), *(self.hash[k] for k in range(2, self.order + 1))]) >> U64(64 - bits)
        pairs = [np.unique(x, return_inverse=True) for x in (self.hash[1], longer)]
        return [x for x, _ in pairs], [y for _, y in pairs]

    def train_counts(self, train: np.ndarray) -> list[np.ndarray]:
        """Counts of words (and of the start) and of longer n-grams over the texts marked in ``train``."""
        of_token = np.repeat(train, self.lengths)
        one = np.bincount(self.ids[1][of_token], minlength=self.size[1])
        one[self.start] = train.sum()
        more = [np.bincount(self.ids[k][of_token], minlength=self.size[k] + 1)[: self.size[k]] for k in range(2, self.order + 1)]
        return [one, np.concatenate([np.zeros(0, np.int64), *more])]


class Automaton:
    """The states and arcs that a block can reach; a state is told by its level, the number of its words."""

    def __init__(self, block: Block, one: np.ndarray, longer: np.ndarray, n: int, v: int, mass: Sequence[float]):
        self.block = block
        cut = np.cumsum([block.size[k] for k in range(2, block.order + 1)])[:-1] if block.order > 1 else []
        # The last entry of each table stands for no n-gram.
        self.count = {1: np.append(one, 0), **{k: np.append(c, 0) for k, c in zip(range(2, block.order + 1), np.split(longer, cut), strict=False)}}
        known = one[: block.start]
        self.single = np.log10((known + 1) / (n + v + 1))
        self.weight, self.failure = {}, {}
        lower = np.append((known + 1) / (n + v + 1), [1.0])
        for k in range(2, block.order + 1):
            m = mass[min(k - 2, len(mass) - 1)]
            # Of each n-gram: the number of its history and of its tail, taken from a place where it stands.
            at = np.zeros(block.size[k] + 1, np.int64)
            at[block.ids[k]] = np.arange(len(block.ids[k]))
            at = at[:-1]
            history = block.of_two if k == 2 else block.ids[k - 1][at - 1]
            context = self.count[k - 1].astype(np.float64)
            p = (self.count[k][:-1] + m * lower[block.ids[k - 1][at]]) / (context[history] + m)
            p = np.where(context[history] > 0, p, lower[block.ids[k - 1][at]])
            self.weight[k] = np.append(np.log10(p), 0.0)
            self.failure[k - 1] = np.where(context > 0, np.log10(m / (context + m)), 0.0)
            lower = np.append(p, 1.0)

    def level_of(self, at: np.ndarray) -> np.ndarray:
        """Levels of the states that the words up to the tokens ``at`` lead to."""
        out = np.zeros(len(at), np.int64)
        for k in range(1, self.block.order):
            out[self.count[k][self.block.ids[k][at]] > 0] = k
        return out

    def scores(self) -> np.ndarray:
        """log10 probability of each text."""
        b, order = self.block, self.block.order
        parts = -(-b.lengths // SEGMENT)
        text = np.repeat(np.arange(len(b.lengths)), parts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = b.first[text] + nth * SEGMENT
        size = np.minimum(SEGMENT, b.first[text] + b.lengths[text] - begin)
        fresh = min(1, order - 1) if self.count[1][b.start] > 0 else 0
        level = np.where(nth > 0, self.level_of(np.maximum(begin - 1, 0)), fresh)
        order_ = np.argsort(-size, kind="stable")
        begin, size, level, text = begin[order_], size[order_], level[order_], text[order_]
        head = (nth == 0)[order_]
        total, left = np.zeros(len(text)), np.searchsorted(-size, -np.arange(1, SEGMENT + 1), "right")
        for t in range(int(size[0]) if len(size) else 0):
            n = left[t]
            pos, state = begin[:n] + t, level[:n]
            step, open_ = np.zeros(n), np.ones(n, bool)
            for k in range(order - 1, 0, -1):
                here = open_ & (state == k)
                arc = b.ids[k + 1][pos]
                hit = here & (self.count[k + 1][arc] > 0)
                step[hit] += self.weight[k + 1][arc[hit]]
                fail = here & ~hit
                own = b.ids[k][pos[fail] - 1]
                if k == 1 and t == 0:
                    own = np.where(head[:n][fail], b.start, own)
                step[fail] += self.failure[k][own]
                state[fail] = k - 1
                state[hit] = min(k + 1, order - 1)
                open_ &= ~hit
            token = b.ids[1][pos[open_]]
            step[open_] += self.single[token]
            state[open_] = np.minimum(self.count[1][token] > 0, order - 1)
            total[:n] += step
        return np.bincount(text, total, len(b.lengths))


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", mass: Sequence[float] = MASS, order: int = ORDER, block_bytes: int | None = None) -> DataFrame:
    """Scores of all texts under the model that the rows which aren't held out give."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), held_out.alias("held_out"))
    total = docs.agg(F.sum(F.octet_length(text_of(text)))).first()[0] or 0
    bits = key_bits(order * total // 4, 18)

    def ask(t):
        block, held = Block.read(t["text"], order), t["held_out"].to_numpy(zero_copy_only=False).astype(bool)
        keys, places = block.keys(bits)
        counts = [np.bincount(p, c, len(k)).astype(np.int64) for k, p, c in zip(keys, places, block.train_counts(~held), strict=True)]
        return list(zip(keys, counts, strict=True)), None

    def keep(t):
        block, held = Block.read(t["text"], 1), t["held_out"].to_numpy(zero_copy_only=False).astype(np.uint8)
        ids = t["doc_id"].combine_chunks()
        known = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
        own = [block.ids[1].astype(np.uint32), block.lengths.astype(np.uint32), np.diff(block.types, prepend=U64(0)), ids.fill_null(0).to_numpy(zero_copy_only=False), known, held]
        return frame([pack(x) for x in own])

    def stats(keys, totals):
        word = keys[0] != (mix(np.array([START], U64)) | U64(1))[0]
        return np.array([totals[0][word].sum(), (totals[0][word] > 0).sum()])

    def walk(own, totals, told):
        ids, lengths, types, doc, known, held = map(unpack, unframe(own))
        block = Block(ids.astype(np.int32), lengths.astype(np.int64), np.cumsum(types, dtype=U64), order)
        one, longer = (t.astype(np.int64)[place] for t, place in zip(totals, block.keys(bits)[1], strict=True))
        n, v = (int(x) for x in told)
        auto = Automaton(block, one, longer, n, v, mass)
        per_text = lambda x: np.add.reduceat(x, block.first) if len(x) else x
        columns = [
            pa.array(doc.astype(np.int64), mask=known == 0), pa.array(held.astype(bool)), pa.array(block.lengths), pa.array(per_text((auto.count[1][block.ids[1]] > 0).astype(np.int64))),
            pa.array(np.full(len(doc), n)), pa.array(np.full(len(doc), v)), pa.array(per_text(auto.single[block.ids[1]])), pa.array(auto.scores()),
        ]
        return pa.Table.from_arrays(columns, names=[x.split()[0] for x in SCORES.split(", ")])

    return exchange(slim, plan(docs.sparkSession, total, block_bytes, BLOCK_BYTES), [64, bits], ask, walk, SCORES, stats=stats, keep=keep)


def lm_report(docs: DataFrame, modulus: int = 7, remainder: int = 2, **options) -> DataFrame:
    return score(docs, is_held_out("doc_id", modulus, remainder), **options)


def compare_masses(docs: DataFrame, masses: Sequence[Sequence[float]], modulus: int = 7, remainder: int = 2, tune: int = 3, **options) -> dict[tuple[float, ...], float]:
    """The log10 likelihood a token that each setting of the masses gives to a part of the training texts.

    The rows that ``lm_report`` holds out are left out altogether.  Of the others, those with remainder ``tune`` are scored by
    a model of the rest; texts that occur more than once are not counted, as a model that has seen a copy knows them.
    """
    training = docs.where(~is_held_out("doc_id", modulus, remainder))
    tuned = is_held_out("doc_id", modulus, tune)
    once = training.groupBy(F.sha2(text_of(), 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1").select("doc_id")
    out = {}
    for mass in masses:
        scored = score(training, tuned, mass=mass, **options).where("held_out").join(once, "doc_id", "left_semi")
        out[tuple(mass)] = scored.agg(F.sum("score") / F.sum("n_tokens")).first()[0]
    return out
