"""Scores of texts by a hidden Markov language model.

Texts are lower-cased (A-Z only) and cut into words at ASCII blanks; a text
ends with an end token.  Latent states follow one another by a transition
table, and each emits tokens: ``(1 - mix)`` of a state's probability are its
own expected counts, ``mix`` is the add-one unigram, which also gives unseen
words their share.  Words that are less than ``own_share`` of all tokens share
a class per octave of their count: the state emits the class, the unigram picks
the word in it.  So each state's
probabilities sum to one over the vocabulary, one unseen word and the end.

Training is Baum-Welch: in each round every learning text is run forwards and
backwards, its expected counts are summed over all partitions, and the sums are
the next round's tables.  A text's score is the exact log10 probability of its
tokens by the scaled forward recursion.

How it runs.  Texts become *blocks* of some million tokens, each with a
dictionary of its own words, so that tokens travel as small numbers and what is
joined with the corpus are only the distinct words of a block.  One shuffle
counts the words over all blocks and brings the counts back; nothing of the
vocabulary is sent to the driver, broadcast or capped, and it grows with the
input.  The blocks are written as a table bucketed by block: each round brings
the states' counts of the blocks' frequent words to them without moving a
block.  The driver holds what is bounded by parameters alone: the transitions,
the classes of rare words, totals.  A word that very many blocks have is one
row per block, combined before it moves.  Inside a block, texts are sorted by
length and advanced one token at a time all together.

Defined results: a null or empty text has the end token alone.  A null
``doc_id`` is not held out.  Repeated rows are scored, and learned, each.
Without learning texts nothing is known, and both scores are those of the
unigram (log10 of 1).  Words of over 64 bytes are told apart by their SHA-256.
Tables of counts are keyed by 64-bit hashes; two frequent words with an equal
hash would share the states' counts, no count of ``base_score`` is affected.
An empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import discard, partitions, written
from tillroll.session import scratch_dir

STATES = 4
ROUNDS = 3
MIX = 0.2
OWN_SHARE = 2e-5
STAY = 0.97
BLOCK_TOKENS = 1 << 20
WAVE_TOKENS = 1 << 15
STEP_COST = 200
FOLDS, HELD_FOLD = 7, 2


def octave(n: np.ndarray) -> np.ndarray:
    """Number of binary digits of counts."""
    return np.frexp(np.asarray(n, float))[1]


def held_out(key: int | None) -> bool:
    return key is not None and zlib.crc32(str(key).encode()) % FOLDS == HELD_FOLD


# ---------------------------------------------------------------- blocks ---

def pack(tokens: np.ndarray) -> bytes:
    """Numbers with their equal-valued bytes together, which compress well."""
    return tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int32)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, lower-cased, and their number in each text."""
    kind = pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string()
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, b"").view(kind)))
    words = parts.flatten()
    full = pc.greater(pc.binary_length(words), 0)  # not before a first blank, after a last one, in an empty text
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(full.to_numpy(zero_copy_only=False))))[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
    return words.filter(full).view(texts.type), np.diff(ends)


def _row(block: int, docs: list[pa.Array], words: list[pa.Array], sizes: list[np.ndarray]) -> pa.RecordBatch:
    """A block: its texts' ids, flags and sizes, its tokens, its words and how often they are learned."""
    docs, sizes, coded = pa.concat_arrays(docs), np.concatenate(sizes), pa.concat_arrays(words).dictionary_encode()
    train = np.array([not held_out(k) for k in docs.to_pylist()], bool)
    tokens, words = coded.indices.to_numpy(), coded.dictionary.cast(pa.binary())
    learned = np.bincount(tokens[np.repeat(train, sizes)], minlength=len(words))
    long = pc.greater(pc.binary_length(words), 64)
    digests = [b" " + hashlib.sha256(w).hexdigest().encode() for w in words.filter(long).to_pylist()]
    words = pc.replace_with_mask(words, long, pa.array(digests, pa.binary()))
    lists = {"docs": docs, "train": train, "sizes": sizes, "words": words, "learned": learned}
    column = lambda f: pa.ListArray.from_arrays([0, len(lists[f.name])], pa.array(lists[f.name], f.type.value_type))
    row = {"block": pa.array([block]), "tokens": pa.array([pack(tokens)])} | {f.name: column(f) for f in _BLOCKS if f.name in lists}
    return pa.RecordBatch.from_arrays([row[f.name].cast(f.type) for f in _BLOCKS], schema=_BLOCKS)


_BLOCKS = pa.schema([("block", pa.int64()), ("docs", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())),
                     ("tokens", pa.binary()), ("words", pa.list_(pa.binary())), ("learned", pa.list_(pa.int64()))])
_BLOCK_TYPES = "block long, docs array<long>, train array<boolean>, sizes array<int>, tokens binary, words array<binary>, learned array<long>"


def blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches):
        from pyspark import TaskContext

        number, held, room = TaskContext.get().partitionId() << 32, [], block_tokens
        for batch in batches:
            words, sizes = split(batch.column(1))
            ends, i = np.cumsum(sizes), 0
            while i < len(sizes):
                before = int(ends[i] - sizes[i])
                j = min(len(sizes), int(np.searchsorted(ends, before + room)) + 1)  # up to the text that fills the block
                n = int(ends[j - 1]) - before
                held.append((batch.column(0).slice(i, j - i), words.slice(before, n), sizes[i:j]))
                i, room = j, room - n
                if room <= 0:
                    yield _row(number, *map(list, zip(*held, strict=True)))
                    number, held, room = number + 1, [], block_tokens
                    pa.default_memory_pool().release_unused()
        if held:
            yield _row(number, *map(list, zip(*held, strict=True)))
        words = held = None
        pa.default_memory_pool().release_unused()  # else the worker holds it beside later stages

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").cast("binary")).mapInArrow(run, _BLOCK_TYPES)


class Model:
    """What the driver and every task hold; bounded by the parameters."""

    def __init__(self, states: int, mix: float, own: int, docs: int, total: int, distinct: int, classes: dict[int, int]):
        """``docs`` learning texts with ``total`` tokens (ends too), ``distinct``
        of them; ``classes`` has for each octave the sum of count + 1 over its
        words that are seen less than ``own`` times."""
        self.states, self.mix, self.own, self.docs = states, mix, own, docs
        self.total, self.norm = total, total + distinct + 1
        share = np.array([classes.get(c, 0) for c in range(int(own - 1).bit_length() + 1)], float) / self.norm
        share[0] = 1 / self.norm
        self.class_share = share
        self.init = np.full(states, 1 / states)
        self.move = np.full((states, states), (1 - STAY) / max(1, states - 1)) + np.eye(states) * (STAY - (1 - STAY) / max(1, states - 1))
        if states == 1:
            self.move[:] = 1
        self.mass = None  # expected tokens of each state; None before the first round
        self.classes = np.repeat(share[:, None], states, 1)
        self.end = np.full(states, self.unigram(docs))

    def unigram(self, n):
        return (n + 1) / self.norm

    def smooth(self, counts: np.ndarray, prior: np.ndarray) -> np.ndarray:
        return (1 - self.mix) * counts / self.mass + self.mix * prior

    def learn(self, sums: dict[tuple[int, int], np.ndarray]) -> None:
        k, zero = self.states, np.zeros(self.states)
        init, move = sums[INIT, 0], np.array([sums.get((MOVE, i), zero) for i in range(k)])
        self.mass = np.maximum(init + move.sum(0), 1e-300)
        self.init = (init + 1 / k) / (init.sum() + 1)
        self.move = (move + 1 / k) / (move.sum(1, keepdims=True) + 1)
        self.classes = self.smooth(np.array([sums.get((CLASS, c), zero) for c in range(len(self.class_share))]), self.class_share[:, None])
        self.end = self.smooth(sums[END, 0], np.array(self.unigram(self.docs)))

    def emissions(self, n: np.ndarray, ids: np.ndarray, place: np.ndarray, sums: np.ndarray | None) -> np.ndarray:
        """A row per word of a block, and one for the end.  ``n`` are the words'
        counts, ``ids`` and ``place`` those of frequent ones, ``sums`` their
        expected counts by state in the order of ``place``."""
        out, prior = np.empty((len(n) + 1, self.states)), self.unigram(n)
        rare = n < self.own
        c = octave(n[rare])
        out[:-1][rare] = self.classes[c] * (prior[rare] / self.class_share[c])[:, None]
        if self.mass is None:
            out[place] = prior[place][:, None] * start_weights(ids, self.states)
        else:
            out[place] = self.smooth(sums, prior[place][:, None])
        out[-1] = self.end
        return out


WORD, INIT, MOVE, CLASS, END = range(5)


def start_weights(ids: np.ndarray, states: int) -> np.ndarray:
    """Weights of mean 1 that tell the states apart before the first round:
    exponential variates from the words' hashes."""
    x = ids.astype(np.uint64)[:, None] + np.arange(1, states + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return -np.log(((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53) + 2.0 ** -54)


class Sequences:
    """Sequences of tokens in the order of the tokens' places: all first
    tokens, all second ones, ...; sequences are sorted by length, longest first."""

    def __init__(self, whole: np.ndarray, first: np.ndarray, length: np.ndarray):
        self.order = np.argsort(-length, kind="stable")
        rank = np.empty_like(self.order)
        rank[self.order] = np.arange(len(length))
        most = int(length.max(initial=0))
        self.active = len(length) - np.searchsorted(np.sort(length), np.arange(most), side="right")
        self.at = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.active)))
        self.tokens = np.empty(int(length.sum()), np.int32)
        t = np.arange(len(self.tokens)) - np.repeat(np.cumsum(length) - length, length)
        self.tokens[self.at[t] + np.repeat(rank, length)] = whole[np.repeat(first, length) + t]

    def emitted(self, e: np.ndarray, back: bool = False) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first, last, emissions by state) of each step; ``e`` by state."""
        steps, at = len(self.active), self.at.tolist()
        cuts = np.unique(np.append(np.searchsorted(self.at, np.arange(0, at[-1], WAVE_TOKENS)), steps)).tolist()
        turn = reversed if back else iter
        for low, high in turn(list(zip(cuts[:-1], cuts[1:], strict=True))):
            x = e.take(self.tokens[at[low]:at[high]], axis=1)
            for s in turn(range(low, high)):
                yield at[s], at[s + 1], x[:, at[s] - at[low]:at[s + 1] - at[low]]


class Steps(Sequences):
    """The texts of a block, each with its end, cut into pieces that advance
    side by side."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, end: int, wanted: np.ndarray | None = None, piece: int | None = None):
        sizes = sizes.astype(np.int64)
        if wanted is not None:
            tokens, sizes = tokens[np.repeat(wanted, sizes)], sizes[wanted]
        n = sizes + 1
        self.whole = np.insert(tokens, np.cumsum(sizes), end)
        piece = piece or piece_tokens(n)
        self.pieces = -(-n // piece)
        self.text = np.repeat(np.arange(len(n)), self.pieces)
        self.nth = np.arange(len(self.text)) - np.repeat(np.cumsum(self.pieces) - self.pieces, self.pieces)
        self.first = np.repeat(np.cumsum(n) - n, self.pieces) + self.nth * piece
        self.length = np.minimum(piece, n[self.text] - self.nth * piece)
        super().__init__(self.whole, self.first, self.length)

    def part(self, which: np.ndarray) -> Sequences:
        return Sequences(self.whole, self.first[which], self.length[which])


def piece_tokens(n: np.ndarray) -> int:
    """Length of pieces: a step costs about as much as ``STEP_COST`` tokens, a
    token of a later piece is advanced from every state."""
    most = int(n.max(initial=1))
    costs = {most: 2 * STEP_COST * most}
    for piece in (1 << b for b in range(8, most.bit_length()) if 1 << b < most):
        costs[piece] = 3 * STEP_COST * piece + STATES * int(np.maximum(n - piece, 0).sum())
    return min(costs, key=costs.get)


def advanced(model: Model, e: np.ndarray, steps: Sequences, start: np.ndarray) -> np.ndarray:
    """Start, state, sequence: states' shares after each whole sequence from each
    row of ``start``, to a factor for each sequence."""
    out, a = np.empty((*start.shape, len(steps.order))), None
    for i, j, x in steps.emitted(e):
        m = j - i
        if a is None:
            a = start[:, :, None] * x
        else:
            out[:, :, m:a.shape[2]] = a[:, :, m:]
            a = (model.move.T @ a[:, :, :m]) * x
        a /= a.sum((0, 1))
    out[:, :, :a.shape[2]] = a
    by_sequence = np.empty_like(out)
    by_sequence[:, :, steps.order] = out
    return by_sequence


def joints(model: Model, e: np.ndarray, steps: Steps, back: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What pieces of a text pass on, by state and piece: probabilities of its
    first state, those of the state before it (0 for first pieces), and, if
    ``back``, how likely the rest of the text is after it."""
    k, pieces = model.states, len(steps.text)
    begin, before, rest = np.repeat(model.init[:, None], pieces, 1), np.zeros((k, pieces)), np.ones((k, pieces))
    more = steps.pieces[steps.text] - steps.nth - 1
    heads, inner = np.flatnonzero((steps.nth == 0) & (more > 0)), np.flatnonzero((steps.nth > 0) & (back | (more > 0)))
    if not len(heads):
        return begin, before, rest
    maps = np.empty((k, k, pieces)) if len(inner) else None
    if len(inner):
        maps[:, :, inner] = advanced(model, e, steps.part(inner), np.eye(k))
    a, last = advanced(model, e, steps.part(heads), model.init[None])[0], int(steps.nth.max())
    rows = [heads]
    while len(rows) <= last:
        rows.append(rows[-1][more[rows[-1]] > 0] + 1)
    for before_at, at in zip(rows[:-1], rows[1:], strict=True):
        a = a[:, more[before_at] > 0]
        a /= a.sum(0)
        before[:, at], begin[:, at] = a, model.move.T @ a
        if maps is not None:
            a = (maps[:, :, at] * begin[:, None, at]).sum(0)
    if back:
        for at in reversed(rows[1:]):
            b = model.move @ (maps[:, :, at] * rest[:, at]).sum(1)
            rest[:, at - 1] = b / (b * before[:, at]).sum(0)
    return begin, before, rest


def _forward(model: Model, e: np.ndarray, steps: Steps, begin: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    a = None
    for i, j, x in steps.emitted(e):
        a = (begin[:, steps.order] if a is None else model.move.T @ a[:, :j - i]) * x
        scale = a.sum(0)
        a /= scale
        yield i, j, a, scale


def forward(model: Model, e: np.ndarray, steps: Steps) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, states' probabilities given the tokens so far, probability
    of the token) of each step."""
    e = np.ascontiguousarray(e.T)
    return _forward(model, e, steps, joints(model, e, steps, False)[0])


def expected(model: Model, e: np.ndarray, steps: Steps) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected first states, moves, and counts of tokens by state."""
    k, n, e = model.states, len(steps.tokens), np.ascontiguousarray(e.T)
    begin, before, rest = joints(model, e, steps, True)
    before, rest, starts = before[:, steps.order], rest[:, steps.order], steps.nth[steps.order] == 0
    alpha, scales = np.empty((k, n), np.float32), np.empty(n)
    for i, j, a, scale in _forward(model, e, steps, begin):
        alpha[:, i:j], scales[i:j] = a, scale
    move, after, later = np.zeros((k, k)), np.empty((k, 0)), 0
    for i, j, x in steps.emitted(e, back=True):
        if later:
            move += alpha[:, i:i + later] @ after.T
        beta = np.concatenate((model.move @ after, rest[:, later:j - i]), 1)
        after, later = x * beta / scales[i:j], j - i
        alpha[:, i:j] *= beta
    move += before @ after.T
    counts = np.stack([np.bincount(steps.tokens, alpha[s], e.shape[1]) for s in range(k)], 1)
    return alpha[:, :later][:, starts].sum(1, dtype=float), move * model.move, counts


def _block_rows(batches, model: Model) -> Iterator[tuple]:
    """Texts' ids, learning flags, sizes, tokens, counts and emissions of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            c = {name: batch.column(name).slice(i, 1) for name in batch.schema.names}
            flat = lambda name: c[name].flatten().to_numpy(zero_copy_only=False)
            n, place, ids = flat("n"), flat("place"), flat("id")
            sums = None
            if "sums" in c and model.mass is not None:
                got = c["sums"].flatten()
                at = got.field("place").to_numpy(zero_copy_only=False)
                sums = np.stack([got.field(f"v{s}").to_numpy(zero_copy_only=False) for s in range(model.states)], 1)[np.argsort(at)]
            e = model.emissions(n, ids, place, sums)
            yield c["docs"].flatten(), flat("train").astype(bool), flat("sizes"), unpack(c["tokens"][0].as_py()), n, e


def _expectations(df: DataFrame, model: Model) -> DataFrame:
    """``kind, id, v0...``: expected counts of each block, to be summed."""
    k, classes = model.states, len(model.class_share)
    schema = pa.schema([("kind", pa.int32()), ("id", pa.int64()), *((f"v{s}", pa.float64()) for s in range(k))])

    def run(batches):
        for batch in batches:
            ids = [batch.column("id").slice(i, 1).flatten().to_numpy(zero_copy_only=False) for i in range(batch.num_rows)]
            places = [batch.column("place").slice(i, 1).flatten().to_numpy(zero_copy_only=False) for i in range(batch.num_rows)]
            for (_, train, sizes, tokens, n, e), own, place in zip(_block_rows([batch], model), ids, places, strict=True):
                first, move, counts = expected(model, e, Steps(tokens, sizes, len(n), train))
                rare = n < model.own
                by_class = np.stack([np.bincount(octave(n[rare]), counts[:-1][rare, s], classes) for s in range(k)], 1)
                values = np.concatenate((first[None], move, by_class, counts[-1:], counts[place]))
                kind = np.repeat([INIT, MOVE, CLASS, END, WORD], [1, k, classes, 1, len(own)]).astype(np.int32)
                key = np.concatenate(([0], np.arange(k), np.arange(classes), [0], own)).astype(np.int64)
                for i in range(0, len(key), 50_000):
                    part = slice(i, i + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(kind[part]), pa.array(key[part]), *(pa.array(values[part, s].copy()) for s in range(k))], schema=schema)

    made = df.mapInArrow(run, "kind int, id long, " + ", ".join(f"v{s} double" for s in range(k)))
    return made.groupBy("kind", "id").agg(*[F.sum(f"v{s}").alias(f"v{s}") for s in range(k)])


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
                     ("base_score", pa.float64()), ("score", pa.float64())])


def _scores(df: DataFrame, model: Model) -> DataFrame:
    def run(batches):
        for docs, train, sizes, tokens, n, e in _block_rows(batches, model):
            steps = Steps(tokens, sizes, len(n))
            score = np.zeros(len(steps.order))
            for *_, scale in forward(model, e, steps):
                score[:len(scale)] += np.log10(scale)
            by_text = np.bincount(steps.text[steps.order], score, len(sizes))
            ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)))
            known = np.concatenate((np.zeros(1, np.int64), np.cumsum(n[tokens] > 0)))
            logs = np.log10(model.unigram(n))[tokens]
            base = np.array([logs[i:j].sum() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]) + np.log10(model.unigram(model.docs))
            yield pa.RecordBatch.from_arrays([
                docs, pa.array(~train), pa.array(sizes.astype(np.int64) + 1), pa.array(known[ends[1:]] - known[ends[:-1]] + (model.docs > 0)),
                pa.array(np.full(len(sizes), model.total)), pa.array(base), pa.array(by_text)], schema=_SCORES)

    return df.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


class Corpus:
    """The blocks with their words' counts over all learning texts, as a table
    bucketed by block, and the sizes of the corpus."""

    def __init__(self, docs: DataFrame, own_share: float, block_tokens: int, id_col: str, text_col: str):
        spark = docs.sparkSession
        raw = written(blocks(docs, block_tokens, id_col, text_col), "blocks")
        by_word = Window.partitionBy("word")
        here = F.struct("block", "place")
        words = (raw.select("block", F.posexplode(F.arrays_zip("words", "learned")).alias("place", "x"))
                 .select("block", "place", F.col("x.words").alias("word"), F.col("x.learned").alias("c")))
        counted = written(words.select("block", "place", F.xxhash64("word").alias("id"), F.sum("c").over(by_word).alias("n"),
                                       (F.min(here).over(by_word) == here).alias("first")), "block_words")
        once = counted.where(F.col("first") & (F.col("n") > 0))
        self.n_words, self.distinct = once.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        self.docs = raw.agg(F.coalesce(F.sum(F.size(F.filter("train", lambda x: x))), F.lit(0))).first()[0]
        self.own = own = max(2, math.ceil(own_share * (self.n_words + self.docs)))
        by_octave = once.where(F.col("n") < own).groupBy(F.length(F.bin("n")).alias("c")).agg(F.sum(F.col("n") + 1).alias("s"))
        self.classes = {r.c: r.s for r in by_octave.collect()}  # 63 rows at most
        per_block = counted.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "n", F.when(F.col("n") >= own, F.col("id")).alias("id")))).alias("w"))  # a block's words
        frequent = F.filter("w", lambda x: x["n"] >= own)
        self.path, self.name = scratch_dir(spark, "bucketed_blocks"), f"tillroll_blocks_{uuid.uuid4().hex}"
        (raw.drop("words", "learned").join(per_block, "block", "left")
         .select("block", "docs", "train", "sizes", "tokens", F.coalesce("w.n", F.array().cast("array<long>")).alias("n"),
                 F.coalesce(F.transform(frequent, lambda x: x["place"]), F.array().cast("array<int>")).alias("place"),
                 F.coalesce(F.transform(frequent, lambda x: x["id"]), F.array().cast("array<long>")).alias("id"))
         .write.format("parquet").option("path", self.path).bucketBy(partitions(docs), "block").saveAsTable(self.name))
        self.blocks = spark.table(self.name)
        self.blocks._written_at = self.path
        discard(raw, counted)

    def model(self, states: int, mix: float) -> Model:
        return Model(states, mix, self.own, self.docs, self.n_words + self.docs, self.distinct + (self.docs > 0), self.classes)

    def with_sums(self, sums: DataFrame | None, states: int) -> DataFrame:
        """The blocks with the sums of their frequent words."""
        if sums is None:
            return self.blocks
        wanted = (self.blocks.select("block", F.explode(F.arrays_zip("place", "id")).alias("x"))
                  .select("block", F.col("x.place").alias("place"), F.col("x.id").alias("id")))
        v = [f"v{s}" for s in range(states)]
        found = (wanted.join(sums.where(F.col("kind") == WORD).select("id", *v), "id")
                 .groupBy("block").agg(F.collect_list(F.struct("place", *v)).alias("sums")))
        none = F.array().cast("array<struct<place:int," + ",".join(f"{x}:double" for x in v) + ">>")
        return self.blocks.join(found, "block", "left").withColumn("sums", F.coalesce("sums", none))

    def drop(self) -> None:
        self.blocks.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")
        discard(self.blocks)


def language_model_scores(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, mix: float = MIX, own_share: float = OWN_SHARE,
                          block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per text: numbers of tokens and of known ones, the unigram's and
    the model's log10 probability.  Texts of the fold ``HELD_FOLD`` of
    ``FOLDS`` (by the crc32 of the id as text) aren't learned from."""
    corpus = Corpus(docs, own_share, block_tokens, id_col, text_col)
    model, sums = corpus.model(states, mix), None
    for _ in range(rounds if corpus.docs else 0):
        new = written(_expectations(corpus.with_sums(sums, states), model), "expected_counts")
        if sums is not None:
            discard(sums)
        sums = new
        small = sums.where(F.col("kind") != WORD).collect()  # 66 + states rows at most
        model.learn({(r.kind, r.id): np.array(r[2:], float) for r in small})
    out = written(_scores(corpus.with_sums(sums, states), model), "text_scores")
    corpus.drop()
    if sums is not None:
        discard(sums)
    return out
