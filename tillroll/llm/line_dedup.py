"""Near-duplicate lines by a deletion-neighbourhood join.

Two lines are near if the edit distance of their normal forms (lower case,
blanks collapsed) is 1 at most.  Every such pair has a common variant: the
string with one character deleted, or the shorter string itself.  Variants are
emitted as 64-bit keys, equal keys joined, and each pair verified by its edit
distance.  An occurrence of a line goes if an earlier one (by ``doc_id``, then
line number) of the same or a near line exists, whether or not that one stays.

Long lines have many variants, and most lines have no near line at all.  So
the lines' *thirds* are compared first: one edit changes one third, thus near
lines agree on what stands before and after some third.  Lines that agree with
no other line so emit nothing; the others emit only deletions within the third
in question.  This loses no pair.  The keys are range-partitioned by key and
line, and equal neighbours are found in one streaming pass that holds one row,
so a key shared by very many lines is spread over tasks.

A variant's group is bounded: distinct lines with a common variant differ by
one inserted character.  Exact copies count once in all this, and meet their
line's decision in a join of two written tables, which Spark can split.

Defined results: null and empty texts have no lines; lines under ``min_chars``
characters have no near lines, and under ``exact_chars`` (by default the same)
they are left alone, blank ones always.  Null ids rank first, rows with an
equal id by a hash of their text.  Rows with an equal id (or none) and an equal
text count as one document: what goes from one goes from all of them.  An empty
table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import Out, discard, partitions, rows, written
from tillroll.llm.units import lines, normal, text_key, without_spans

MIN_CHARS = 30
PARTS = 3
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def thirds(n: int) -> list[tuple[int, int]]:
    """Segments of a string of ``n`` characters."""
    cuts = [n * k // PARTS for k in range(PARTS + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def segment_keys(line: str) -> list[int]:
    """Keys of what stands around each third, first for a partner that isn't
    shorter, then (the thirds of one character less) for one that is."""
    m = len(line)
    return [_hash(f"{n}.{k}.{line[:p]}\0{line[m - n + q:]}") for n in (m, m - 1) for k, (p, q) in enumerate(thirds(n))]


def deletions(line: str, kinds: list[int]) -> np.ndarray:
    """64-bit keys of the line's variants in the thirds named by positions in
    ``segment_keys``: the line itself and its deletions there."""
    code = np.frombuffer(line.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    m = len(code)
    at: set[int] = set()
    for k in kinds:
        p, q = thirds(m if k < PARTS else m - 1)[k % PARTS]
        at.update(range(p, min(q + (k >= PARTS), m)))
    if m >= len(_POWERS[0]):
        _POWERS[0] = _powers(2 * m)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((code + np.uint64(1)) * _POWERS[0][:m])))
    p = np.fromiter(at, np.int64, len(at))
    variant = total[p] + (total[m] - total[p + 1]) * np.uint64(_BASE_INVERSE)
    found = np.concatenate((variant, total[m:])) if min(kinds) < PARTS else variant
    return np.unique(found).view(np.int64)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POWERS = [_powers(1 << 12)]

LINES = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("line", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("h", pa.int64()), ("keys", pa.list_(pa.int64()))])
_LINES = "doc_id long, text_key long, line long, start long, end long, h long, keys array<long>"


def _lines(docs: DataFrame, min_chars: int, exact_chars: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        out = Out(LINES)
        for key, text, own in rows(batches):
            for i, (start, end, line) in enumerate(lines(text or "")):
                if end - start >= exact_chars and len(x := normal(line)) >= exact_chars:
                    out.add((key, own, i, start, end, _hash(x), segment_keys(x) if len(x) >= min_chars else []))
                    if out.full():
                        yield out.batch()
        yield out.batch()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), text_key(text_col)).mapInArrow(run, _LINES)


def _agreeing(batches):
    """Of rows sorted by (key, h): those that share their key with another h.
    The first and last group of a task may go on elsewhere and count as shared."""
    schema = pa.schema([("h", pa.int64()), ("kind", pa.int32())])
    out = Out(schema)
    held, shared = None, True
    for row in rows(batches):  # key, h, kind
        if held is not None:
            same = row[0] == held[0]
            if same or shared:
                out.add((held[1], held[2]))
            shared = same
        held = row
        if out.full():
            yield out.batch()
    if held is not None:
        out.add((held[1], held[2]))
    yield out.batch()


VARIANTS = pa.schema([("v", pa.int64()), ("h", pa.int64()), ("text", pa.string())])


def _removed(docs: DataFrame, min_chars: int, id_col: str, text_col: str, exact_chars: int | None) -> DataFrame:
    """``removed_lines`` with the ``text_key`` of the row that loses the line."""
    exact_chars = min_chars if exact_chars is None else exact_chars
    found = written(_lines(docs, min_chars, max(1, exact_chars), id_col, text_col), "lines")
    place = F.struct("doc_id", "text_key", "line", "start", "end")
    distinct = written(found.groupBy("h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), F.first("keys").alias("keys")), "distinct_lines")

    n = partitions(docs)
    around = (distinct.select("h", F.posexplode("keys").alias("kind", "key")).select("key", "h", "kind")
              .repartitionByRange(n, "key", "h").sortWithinPartitions("key", "h"))
    kinds = around.mapInArrow(_agreeing, "h long, kind int").groupBy("h").agg(F.collect_set("kind").alias("kinds"))  # 2 x PARTS at most
    todo = (kinds.join(distinct.select("h", "first"), "h")
            .groupBy(F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key")).agg(F.collect_list(F.struct("first.line", "h", "kinds")).alias("todo")))  # a document's lines at most

    def variants(batches):
        out = Out(VARIANTS, 50_000)
        for text, todo_rows in rows(batches):
            own = {x["line"]: x for x in todo_rows}
            for i, (_, _, line) in enumerate(lines(text or "")):
                if (x := own.get(i)) is None:
                    continue
                line = normal(line)
                if _hash(line) != x["h"]:
                    continue  # another text with this id and key
                out.add((None, x["h"], line), len(line))
                for v in deletions(line, x["kinds"]).tolist():
                    out.add((v, x["h"], None))
                if out.full():
                    yield out.batch()
        yield out.batch()

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), text_key(text_col).alias("key"))
    made = written(texts.join(todo, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))).select("text", "todo")
                   .mapInArrow(variants, "v long, h long, text string"), "variants")
    v = made.where("v is not null").select("v", "h")
    pairs = v.alias("x").join(v.alias("y"), "v").where("x.h < y.h").select(F.col("x.h").alias("h"), F.col("y.h").alias("g")).distinct()
    text = made.where("text is not null").select("h", "text").dropDuplicates(["h"])
    near = (pairs.join(text, "h").join(text.select(F.col("h").alias("g"), F.col("text").alias("other")), "g")
            .where(F.levenshtein("text", "other", 1).between(0, 1)).select("h", "g"))
    near = written(near.unionByName(near.select(F.col("g").alias("h"), F.col("h").alias("g"))), "near_lines")
    nearest = (near.join(distinct.select(F.col("h").alias("g"), "first"), "g").groupBy("h").agg(F.min("first").alias("near")))
    best = written(distinct.select("h", "first", "n").join(nearest, "h", "left")
                   .where((F.col("n") > 1) | F.col("near").isNotNull())
                   .select("h", F.least("first", F.coalesce("near", "first")).alias("best")), "earliest_lines")
    discard(distinct, made, near)
    return (found.drop("keys").join(best, "h").where(F.col("best") < place)
            .select("doc_id", "text_key", "line", "start", "end", F.col("best.doc_id").alias("kept_doc_id"), F.col("best.line").alias("kept_line"),
                    F.col("best.start").alias("kept_start")))


def removed_lines(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", exact_chars: int | None = None) -> DataFrame:
    """A row per removed line: its place and that of the earliest line near it.
    Lines of ``exact_chars`` (``min_chars`` unless given) up to ``min_chars``
    characters are near their exact copies only."""
    return _removed(docs, min_chars, id_col, text_col, exact_chars).drop("text_key")


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", exact_chars: int | None = None) -> DataFrame:
    """``docs`` without the removed lines, all columns kept; a document that
    loses all its text goes."""
    return without_spans(docs, _removed(docs, min_chars, id_col, text_col, exact_chars), id_col, text_col)
