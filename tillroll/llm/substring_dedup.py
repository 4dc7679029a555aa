"""Substring dedup by line hashing.

Units are lines, and the sentences of lines that have several: a repeated
passage is found whether it stands on lines of its own or inside one.  Units of
at least ``min_words`` words are normalised (lower case, blanks collapsed) and
their digests grouped over the whole corpus.  The occurrence ranked first
(smallest ``doc_id``, then smallest place) is kept; every other one is removed,
with its character offsets in the original text.  Of a line that goes as a
whole, its sentences aren't listed.

Plan: one narrow row per unit (no text); a digest's first place is a minimum,
combined before the shuffle; the join that brings it back to the units is
between two written tables, so Spark can split a digest that a third of all
units share.

Defined results: null and empty texts have no units.  Null ids rank first, rows
with an equal id by a hash of their text.  Rows with an equal id (or none) and an
equal text count as one document: what goes from one goes from all of them.
An empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import written
from tillroll.llm.units import digests, without_spans

MIN_WORDS = 8


def _removed(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """``removed_spans`` with the ``text_key`` of the row that loses the unit."""
    found = written(digests(docs, min_words, id_col, text_col), "units")
    place = F.struct("doc_id", "text_key", "start", "end")
    first = written(found.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                    .where(F.col("first") != F.col("last")).drop("last"), "first_units")
    same = F.col("first").eqNullSafe(place)
    gone = found.join(first, ["a", "b"]).where(~same).select(
        "doc_id", "text_key", "line", "start", "end", "whole", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"),
        F.col("first.end").alias("kept_end"))
    # a line's removed units meet: all of them, or the line alone if it goes
    unit = F.struct("start", "end", "whole", "kept_doc_id", "kept_start", "kept_end")
    per_line = gone.groupBy("doc_id", "text_key", "line").agg(F.collect_set(unit).alias("units"), F.max("whole").alias("goes"))
    alone = F.filter("units", lambda u: u["whole"] | ~F.col("goes"))
    return per_line.select("doc_id", "text_key", "line", F.explode(alone).alias("u")).select("doc_id", "text_key", "line", "u.*").drop("whole")


def removed_spans(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per removed unit: its line and offsets, and the place of the kept
    occurrence."""
    return _removed(docs, min_words, id_col, text_col).drop("text_key")


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the removed units, all columns kept; a document that
    loses all its text goes."""
    return without_spans(docs, _removed(docs, min_words, id_col, text_col), id_col, text_col)
