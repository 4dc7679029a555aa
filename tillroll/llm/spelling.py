"""Spelling variants of words by a relational trie frontier.

The words' trie is a table of edges (node, symbol, child), one for words read
forwards and one for words read backwards; a word ends with an end symbol.  A
frontier of states (word, position, node, edits) is joined with the edges of
one depth after another.  A state without an edit stands on the word's own
path and may replace its next symbol (take an edge with another) or skip it;
a state with one edit follows the word's symbols.  States that take the end
symbol after one edit are neighbours.

What keeps the frontier small, and loses no pair:

* An edit stands in one half of a word.  Edits of the second half are made
  forwards, those of the first half backwards, so the frontier starts at the
  middle of each word, where nodes have few children, and not at the root.
* Inserting is the other word's skipping, and of two words that differ by a
  replacement the one with the smaller symbol finds the other; pairs are
  turned round at the end.
* An edge knows which lengths, next symbols and next two symbols its subtree
  has, as 64-bit masks; a state that can't reach a word isn't made.

Nodes are 64-bit hashes of a prefix; a found word is looked up in the word
table itself, so equal hashes of different prefixes can add no neighbour.
Both sides of each join are plain exchanges, so Spark splits a node that very
many words share.  Words of more than ``MAX_LEVELS`` code points (no
language's, but possible) meet by equal hashes of their one-deletion variants,
verified by their edit distance, as a level for each of their symbols would
never end.

Defined results: null and empty texts have no words.  A null ``doc_id`` deletes
no code point.  Repeated rows count again.  Ties of a form go to the smallest
word in code-point order.  An empty table gives an empty result; only the named
columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import Out, discard, rows, written

MIN_LENGTH = 7
MIN_COUNT = 2
FORM_RATIO = 10
MAX_LEVELS = 40
TYPO_EVERY = 31
_RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_HELD = 200_000
END = 0
WORDS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def runs(key: int | None, text: str) -> Counter:
    """A document's runs of letters with their counts; of one whose hash with
    the id is divisible by ``TYPO_EVERY``, a code point is left out."""
    found = Counter(_RUN.findall(text.translate(_LOWER)))
    if key is None:
        return found
    start, out = zlib.crc32(f"{key}:".encode()), Counter()
    for run, n in found.items():
        h = zlib.crc32(run.encode(), start)
        if h % TYPO_EVERY == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1:]
        out[run] += n
    return out


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` of all words with at least ``min_length`` code points and
    ``min_count`` occurrences."""

    def run(batches):
        out, held = Out(WORDS, 50_000), Counter()

        def flush():
            for word, n in held.items():
                out.add((word, n), len(word))
                if out.full():
                    yield out.batch()
            held.clear()

        for key, text in rows(batches):
            for word, n in runs(key, text or "").items():
                if len(word) >= min_length:
                    held[word] += n
            if len(held) > _HELD:
                yield from flush()
        yield from flush()
        yield out.batch()

    return (docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))


def _bit(x: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (x % 64).cast("int"))


def _at(d: Column) -> Column:
    """Symbol of ``s`` at 0-based place ``d``; the end symbol behind it."""
    return F.when(d < F.col("len"), F.ascii(F.substring("s", d + 1, F.lit(1)))).otherwise(END)


def _has(mask: str, x: Column) -> Column:
    return F.col(mask).bitwiseAND(_bit(x)) != 0


def _pair(a: Column, b: Column) -> Column:
    return F.pmod(a * 31 + b, F.lit(64))


def _paths(words: DataFrame) -> DataFrame:
    """Each word forwards and backwards, with the first place of its half."""
    n = F.length("word")
    half = F.floor(n / 2).cast("int")
    ways = F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("word").alias("s"), half.alias("start")),
                             F.struct(F.lit(1).alias("way"), F.reverse("word").alias("s"), (n - half).alias("start"))))
    return words.select("word", n.alias("len"), ways.alias("w")).select("word", "len", "w.*")


def _node(d: Column) -> Column:
    return F.xxhash64("way", F.substring(F.col("s"), F.lit(1), d))


def trie_edges(words: DataFrame, first: int) -> DataFrame:
    """``depth, node, ch, child`` and what lies below the child: ``lens``, the
    numbers of symbols to a word's end, ``nxt``, the next symbols, and
    ``pairs``, the next two, as masks.  Edges above depth ``first``, the least
    half of a word, are on no state's way."""
    d = F.col("depth")
    at = (_paths(words).where(F.col("len") >= first).withColumn("depth", F.explode(F.sequence(F.lit(first), F.col("len"))))
          .select("depth", _node(d).alias("node"), _at(d).alias("ch"), _node(d + 1).alias("child"), (F.col("len") - d).alias("left"),
                  _at(d + 1).alias("a"), _at(d + 2).alias("b")))
    return (at.groupBy("depth", "node", "ch").agg(
        F.first("child").alias("child"), F.bit_or(_bit(F.col("left"))).alias("lens"), F.bit_or(_bit(F.col("a"))).alias("nxt"),
        F.bit_or(_bit(_pair(F.col("a"), F.col("b")))).alias("pairs")))


def _neighbours(words: DataFrame, first: int, last: int) -> DataFrame:
    """``word, other`` of the words of at most ``MAX_LEVELS`` code points: other
    is a word with one code point less or a larger one in one place."""
    spark = words.sparkSession
    paths = _paths(words)
    edges = written(trie_edges(words, first), "trie")
    states = "word string, way int, s string, len int, pos int, node long, at int, ch int"
    fronts, front = [], spark.createDataFrame([], states)
    for depth in range(first, last + 1):
        d = F.lit(depth)
        # the states without an edit are prefixes of the words; at is -1
        own = paths.where((F.col("start") <= d) & (d < F.col("len"))).select(
            "word", "way", "s", "len", d.alias("pos"), _node(d).alias("node"), F.lit(-1).alias("at"), F.lit(END).alias("ch"))
        here = front.unionByName(own).select("*", *[_at(F.col("pos") + i).alias(f"x{i}") for i in range(4)])
        below = edges.where(F.col("depth") == depth).select("node", F.col("ch").alias("e"), "child", "lens", "nxt", "pairs")

        def leads(ahead: int) -> Column:
            """The subtree has what the word has after its next ``ahead`` symbols."""
            x, y = F.col(f"x{ahead}"), F.col(f"x{ahead + 1}")
            left = F.col("len") - F.col("pos") - (ahead - 1)
            return _has("lens", left) & ((left <= 0) | (_has("nxt", x) & _has("pairs", _pair(x, y))))

        follow = (F.col("at") >= 0) & (F.col("e") == F.col("x0")) & leads(1)
        replace = (F.col("at") < 0) & (F.col("e") > F.col("x0")) & leads(1)
        skip = (F.col("at") < 0) & (F.col("e") == F.col("x1")) & (F.col("x0") != F.col("x1")) & leads(2)
        made = here.join(below, "node").where(follow | replace | skip)
        # an edge can be both replacement and skip, when it is the symbol after the next
        step = F.explode(F.filter(F.array(
            F.when(follow, F.struct((F.col("pos") + 1).alias("pos"), F.col("at").alias("at"), F.col("ch").alias("ch"))),
            F.when(replace, F.struct((F.col("pos") + 1).alias("pos"), F.col("pos").alias("at"), F.col("e").alias("ch"))),
            F.when(skip, F.struct((F.col("pos") + 2).alias("pos"), F.col("pos").alias("at"), F.lit(END).alias("ch")))), lambda x: x.isNotNull()))
        fronts.append(written(made.select("word", "way", "s", "len", F.col("child").alias("node"), step.alias("t")).select(
            "word", "way", "s", "len", "node", "t.*"), "frontier"))
        front = fronts[-1].where(F.col("pos") <= F.col("len"))
    left, right = F.substring("s", F.lit(1), F.col("at")), F.substring(F.col("s"), F.col("at") + 2, F.col("len"))
    other = F.concat(left, F.when(F.col("ch") == END, "").otherwise(F.char("ch")), right)
    out = spark.createDataFrame([], "word string, other string")
    for f in fronts:
        out = out.unionByName(f.where(F.col("pos") > F.col("len")).select(
            "word", F.when(F.col("way") == 0, other).otherwise(F.reverse(other)).alias("other")))
    out = written(out.distinct(), "pairs")
    discard(edges, *fronts)
    return out


VARIANTS = pa.schema([("v", pa.int64()), ("word", pa.string())])
_BASE, _WRAP = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _variants(word: str) -> np.ndarray:
    """Hashes of a word and of its one-deletion variants."""
    code = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(code), _BASE, np.uint64))))
    head = np.concatenate((np.zeros(1, np.uint64), np.cumsum(code * power[:-1])))
    inverse = np.uint64(pow(_BASE, -1, 1 << 64))
    return np.unique(np.concatenate((head[:-1] + (head[-1] - head[1:]) * inverse, head[-1:]))).view(np.int64)


def _long_neighbours(words: DataFrame) -> DataFrame:
    """``word, other`` at edit distance 1 of words too long for a level each."""

    def run(batches):
        out = Out(VARIANTS)
        for (word,) in rows(batches):
            for v in _variants(word).tolist():
                out.add((v, word), len(word))
                if out.full():
                    yield out.batch()
        yield out.batch()

    v = written(words.select("word").mapInArrow(run, "v long, word string"), "long_variants")
    pairs = v.alias("x").join(v.alias("y"), "v").where("x.word < y.word").select(F.col("x.word").alias("word"), F.col("y.word").alias("other")).distinct()
    return pairs.where(F.levenshtein("word", "other", 1) == 1)


def near_words(words: DataFrame) -> DataFrame:
    """``word, other``, both ways, of all words that differ by exactly one
    inserted, deleted or replaced code point.  ``words`` should be written."""
    size = words.agg(F.min(F.length("word")).alias("least"), F.max(F.length("word")).alias("most")).first()
    if size.least is None:
        return words.select("word", F.col("word").alias("other")).limit(0)
    first = max(0, size.least // 2)
    short = words.where(F.length("word") <= MAX_LEVELS)
    found = _neighbours(short, first, min(size.most, MAX_LEVELS))
    if size.most >= MAX_LEVELS:
        found = found.unionByName(_long_neighbours(words.where(F.length("word") >= MAX_LEVELS)))
    found = found.join(words.select(F.col("word").alias("other")), "other", "left_semi").select("word", "other")
    return found.unionByName(found.select(F.col("other").alias("word"), F.col("word").alias("other"))).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where following ``word, form`` ends.  A form is at least
    ``FORM_RATIO`` times as frequent, so a way has at most as many steps as a
    long has digits; each join doubles the steps taken."""
    old, reached = None, forms.select("word", F.col("form").alias("root"))
    for _ in range(6):
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        new = written(reached.join(on, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        moved = new.where("moved").limit(1).count()
        if old is not None:
            discard(old)
        old, reached = new, new.drop("moved")
        if not moved:
            break
    return reached


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = FORM_RATIO,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per word: its more frequent form, the last of the forms that follow
    (root), its count and its number of near words."""
    words = written(word_counts(docs, min_length, min_count, id_col, text_col), "words")
    near = (near_words(words).join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
            .groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other"))).alias("best")))
    found = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.n") >= ratio * F.col("n"), F.col("best")).alias("best")), "forms")
    ends = roots(found.where("best is not null").select("word", F.col("best.other").alias("form")))
    return found.join(ends, "word", "left").select(
        "word", F.col("best.other").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", (-F.col("best.n")).alias("form_n"))
