"""Language identification by sparse multinomial logistic regression.

Features: lower-cased letters, anything else as one blank; character 1-, 2- and
3-grams hashed into ``DIM`` buckets; weights ``log(1 + tf) * idf``, scaled to
length 1.  Inverse document frequencies count every learning document of the
table.  Weights are learned by follow-the-regularised-leader (FTRL-proximal)
with an elastic net (``l1`` makes them sparse, ``l2`` keeps them small) on a
bounded sample of at most ``sample_per_label`` documents of each label, chosen
by a hash of the id; a quarter of it is held back to fit the temperature that
divides the logits.

Defined results: null text, or a text without a letter, is ``und`` with score
0; so is every text if nothing could be learned.  Rows with a null id or label
are predicted but never learned from.  Whole texts are read.  Only the named
columns are used for learning, and only the text for predicting.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.llm.common import rows

BITS = 15
DIM = 1 << BITS
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.frombuffer(bytes(unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), np.bool_)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - BITS)


def grams(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text; None without a letter."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a run of others becomes one blank
    c = np.where(letter, code, np.uint32(32))[keep]
    c = np.concatenate((np.array([32], np.uint32), c)) * np.uint32(0x9E3779B1)
    found = [_mix(c[1:] ^ np.uint32(1))]
    two = c[:-1] * np.uint32(3) + c[1:]
    found.append(_mix(two ^ np.uint32(0x55555555)))
    if len(c) > 2:
        found.append(_mix(two[:-1] * np.uint32(5) + c[2:]))
    return np.bincount(np.concatenate(found), minlength=DIM)


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray      # DIM
    weights: np.ndarray  # labels x (DIM + 1); the last is the intercept
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = grams(text)
        if counts is None or not self.labels:
            return UNKNOWN, 0.0
        at, x = features(counts, self.idf)
        p = _softmax((self.weights[:, at] @ x + self.weights[:, DIM]) / self.temperature)
        k = int(p.argmax())
        return self.labels[k], float(p[k])


def features(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]) * idf[at]
    return at, x / max(float(np.sqrt(x @ x)), 1e-12)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(xs: list[tuple[np.ndarray, np.ndarray]], ys: list[int], n_labels: int, alpha: float = 0.5, beta: float = 1.0,
         l1: float = 1e-3, l2: float = 1e-3, epochs: int = 4) -> np.ndarray:
    """FTRL-proximal with per-coordinate rates for softmax regression."""
    z, n = np.zeros((n_labels, DIM + 1)), np.zeros((n_labels, DIM + 1))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(xs)):
            at = np.append(xs[i][0], DIM)
            x = np.append(xs[i][1], 1.0)
            zs, ns = z[:, at], n[:, at]
            w = weights(zs, ns)
            p = _softmax(w @ x)
            p[ys[i]] -= 1
            g = p[:, None] * x
            z[:, at] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha * w
            n[:, at] = ns + g * g
    return weights(z, n)


def temperature(logits: np.ndarray, ys: np.ndarray) -> float:
    """The temperature of the least log loss, by golden section on its log."""
    def loss(t: float) -> float:
        p = _softmax(logits / np.exp(t))[np.arange(len(ys)), ys]
        return -float(np.log(np.maximum(p, 1e-12)).mean())

    a, b, r = np.log(0.05), np.log(20.0), (5 ** 0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(learn: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
        sample_per_label: int = 600, max_labels: int = 1000, **net) -> Model:
    """Learn from the rows of ``learn``; rows without id, label or text are left
    out, and so are labels beyond the ``max_labels`` most common, which bounds
    the model."""
    learn = learn.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                         F.col(label_col).cast("string").alias("label")).dropna()
    learn = learn.withColumn("key", F.xxhash64("id", "text"))  # repeated rows are one to the sample

    def frequencies(batches):
        df, n = np.zeros(DIM, np.int64), 0
        for (text,) in rows(batches):
            counts = grams(text)
            if counts is not None:
                df += counts > 0
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["bucket", "df"])

    counted = (learn.select("text").mapInArrow(frequencies, "bucket long, df long")
               .groupBy("bucket").agg(F.sum("df").alias("df")).collect())  # at most DIM + 1 rows
    df = np.zeros(DIM + 1)
    for r in counted:
        df[r.bucket] += r.df  # bucket -1: documents
    idf = np.log((1 + df[DIM]) / (1 + df[:DIM])) + 1

    # rows of a label below a hash bound that leaves a few times the sample, then the smallest hashes
    labels = F.broadcast(learn.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("key").alias("m"))
                         .orderBy(F.desc("n"), "label").limit(max_labels))
    few = (learn.select("label", "key").join(labels, "label")
           .where((F.col("key").bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)) < 4.0 * sample_per_label / F.col("m"))
           .select("label", "key").distinct()
           .withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("key")))
           .where(F.col("k") <= sample_per_label).select("label", "key"))

    def sparse(batches):
        for key, text, label in rows(batches):
            counts = grams(text)
            if counts is not None:
                at, x = features(counts, idf)
                yield pa.RecordBatch.from_pydict({"id": [key], "label": [label], "at": [at.astype("<i4").tobytes()], "x": [x.astype("<f4").tobytes()]})

    # the sample is bounded in rows, so its keys may be broadcast and its features collected
    sample = learn.join(F.broadcast(few), ["label", "key"]).dropDuplicates(["label", "key"]).select("id", "text", "label").mapInArrow(sparse, "id long, label string, at binary, x binary").collect()
    sample.sort(key=lambda r: (r.id, r.label, r.at, r.x))
    names = sorted({r.label for r in sample})
    xs = [(np.frombuffer(r.at, "<i4"), np.frombuffer(r.x, "<f4").astype(float)) for r in sample]
    ys = [names.index(r.label) for r in sample]
    hold = [i for i in range(len(xs)) if i % 4 == 3]
    rest = [i for i in range(len(xs)) if i % 4 != 3]
    if not names:
        return Model([], idf, np.zeros((0, DIM + 1)), 1.0)
    w = ftrl([xs[i] for i in rest], [ys[i] for i in rest], len(names), **net)
    logits = np.array([w[:, xs[i][0]] @ xs[i][1] + w[:, DIM] for i in hold]).reshape(len(hold), len(names))
    t = temperature(logits, np.array([ys[i] for i in hold], int)) if hold else 1.0
    return Model(names, idf, w, t)


def predicted(model: Model, text: Column) -> Column:
    """Struct of ``lang_pred`` and ``score`` of a text column."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict(text)


def held_out(doc_id: Column) -> Column:
    """Never learned from: a third of the ids, by their CRC-32 as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """Learn from the documents that are not held out, predict all of them."""
    model = fit(docs.where(~held_out(F.col(id_col))), id_col, text_col, label_col)
    p = predicted(model, F.col(text_col).cast("string"))
    return (docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), p.alias("p"))
            .select("doc_id", "held_out", "p.lang_pred", "p.score"))


def keep_identified(docs: DataFrame, min_score: float = 0.4, text_col: str = "text") -> DataFrame:
    """The documents whose language is found with a score of at least
    ``min_score``, all columns kept; the others are rejected."""
    model = fit(docs.where(~held_out(F.col("doc_id"))), text_col=text_col)
    p = predicted(model, F.col(text_col).cast("string"))
    return docs.where((p["lang_pred"] != UNKNOWN) & (p["score"] >= min_score))
