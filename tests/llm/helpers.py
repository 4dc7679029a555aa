"""Small tables with awkward rows."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def docs(spark: SparkSession, rows: list[tuple], extra: dict[str, object] | None = None) -> DataFrame:
    """Documents from (doc_id, text[, lang]); ``extra`` adds constant columns."""
    from pyspark.sql import functions as F

    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    for name, value in (extra or {}).items():
        df = df.withColumn(name, F.lit(value))
    return df


#: Names that operators use inside.
CLASHES = {"line": 1, "start": 2, "end": 3, "h": 4, "x": "x", "t": 5, "c": 6, "n": 7, "u": 8, "v": 9, "id": 10, "component": 11, "first": 12, "best": 13,
           "k": 14, "p": 15, "node": 16, "q": 17, "d": 18, "new": True, "ids": 19, "piece": 20, "bin": 21, "length": 22, "score": 0.5, "lang_pred": "zz", "_id": 23}


def words(rng: random.Random, n: int, alphabet: str = "abcdefghij") -> str:
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


def awkward(rng: random.Random) -> list[tuple]:
    """Null, empty and blank texts, no letters, null and repeated ids, long texts."""
    long = words(rng, 6000)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "123 !! 456"), (None, "no id here at all, really none"), (5, long), (5, long), (6, "x" * 20_000),
            (7, "one"), (8, "one"), (9, "é" * 4000 + "\n" + "中文字" * 300), (10, "a\n\n\nb\n"), (11, "\x00\x01 \x1c odd   blanks here")]
