"""Lines and sentences of texts with their places, shared by the line operators."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import Out, rows


def lines(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, line) of each line, without its line feed."""
    start = 0
    for line in text.split("\n"):
        yield start, start + len(line), line
        start += len(line) + 1


_SENTENCE = re.compile(r"[^.!?]*[.!?]+[ \t]*|[^.!?]+")


def sentences(start: int, line: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, sentence) of a line's sentences with the blanks after them;
    together they are the whole line."""
    for m in _SENTENCE.finditer(line):
        yield start + m.start(), start + m.end(), m[0]


def normal(line: str) -> str:
    """Lower case, blanks collapsed and trimmed."""
    return " ".join(line.lower().split())


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, each a whole line or a sentence of one.  A
    line that is left blank by them goes with its line feed."""
    gone: dict[int, list[int]] = {}
    for s, e in sorted(spans):
        gone.setdefault(s, []).append(e)
    out = []
    for start, end, line in lines(text):
        if end in gone.get(start, ()):
            continue
        left = "".join(x for s, e, x in sentences(start, line) if e not in gone.get(s, ()))
        if left != line:
            left = left.rstrip(" \t")
            if not left:
                continue
        out.append(left)
    return "\n".join(out)


def text_key(text_col: str) -> Column:
    """With the id, what tells rows apart: 64 bits of the text's hash."""
    return F.xxhash64(F.col(text_col).cast("string"))


def without_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans ``(doc_id, text_key, start, end)`` of whole lines
    or of sentences taken out of their texts, all columns kept.  Documents that
    lose all their text go; others, empty ones too, stay.  A row's spans are
    found by its id, null or not, and its text's key, so rows that share an id
    but not the text don't meet; a row's spans are bounded by its length."""
    per_doc = (spans.groupBy(F.col("doc_id").alias("_cut_doc_id"), F.col("text_key").alias("_cut_key"))
               .agg(F.collect_set(F.struct("start", "end")).alias("_cut_spans")))
    schema = docs.schema
    k, t = docs.columns.index(text_col), len(docs.columns)

    def run(batches):
        for batch in batches:
            texts, keep = [], []
            for text, gone in zip(batch.column(k), batch.column(t), strict=True):
                x, g = text.as_py(), [(s["start"], s["end"]) for s in gone.as_py() or ()]
                left = cut(x, g) if g and x is not None else x
                texts.append(left)
                keep.append(not (g and not (left or "").strip()))
            cols = [pa.array(texts, pa.string()) if i == k else batch.column(i) for i in range(t)]
            yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(t)]).filter(pa.array(keep, pa.bool_()))

    names = [f"c{i}" for i in range(t)]
    types = ", ".join(f"{n} {f.dataType.simpleString() if f.name != text_col else 'string'}" for n, f in zip(names, schema, strict=True))
    same_row = F.col(id_col).cast("long").eqNullSafe(F.col("_cut_doc_id")) & (text_key(text_col) == F.col("_cut_key"))
    joined = docs.join(per_doc, same_row, "left").drop("_cut_doc_id", "_cut_key")
    return joined.mapInArrow(run, types).toDF(*docs.columns)


UNITS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("line", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("whole", pa.bool_()),
                   ("a", pa.int64()), ("b", pa.int64())])
_UNITS = "doc_id long, text_key long, line long, start long, end long, whole boolean, a long, b long"


def digests(docs: DataFrame, min_words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per line, and per sentence of a line with several, of at least
    ``min_words`` words: place and the two halves of the MD5 of its normal form."""

    def run(batches):
        out = Out(UNITS)
        for key, text, own in rows(batches):
            for i, (start, end, line) in enumerate(lines(text or "")):
                words = line.lower().split()
                if len(words) < min_words:
                    continue
                parts = [(start, end, True, words)]
                inner = list(sentences(start, line))
                if len(inner) > 1:
                    parts += [(s, e, False, w) for s, e, x in inner if len(w := x.lower().split()) >= min_words]
                for s, e, whole, w in parts:
                    h = hashlib.md5(" ".join(w).encode("utf-8", "replace")).digest()
                    out.add((key, own, i, s, e, whole, int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)))
            if out.full():
                yield out.batch()
        yield out.batch()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), text_key(text_col)).mapInArrow(run, _UNITS)
