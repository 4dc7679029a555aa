"""Parts of the operators: components, bitmaps, streaming passes."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tillroll.llm import line_dedup, ngram_join
from tillroll.llm.graph import components


def brute(edges):
    group: dict = {}
    for u, v in edges:
        a, b = group.setdefault(u, u), group.setdefault(v, v)
        if a != b:
            new, old = min(a, b), max(a, b)
            group.update({k: new for k, g in group.items() if g == old})
    return group


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(60)],                                   # a chain
    [(1000, i) for i in range(200)] + [(2000, i) for i in range(300, 400)],  # hubs with large names
    [(random.Random(1).randrange(-90, 90), random.Random(i).randrange(-90, 90)) for i in range(60)],
    [(5, 5), (7, 8), (8, 7), (7, 8)],
])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in components(df).collect()}
    want = brute([e for e in edges if e[0] != e[1]])
    assert got == want


def test_no_links(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def split(rng, rows, schema):
    out, at = [], 0
    while at < len(rows):
        n = rng.randint(0, 5)
        part = rows[at:at + n]
        out.append(pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], f.type) for i, f in enumerate(schema)], schema=schema))
        at += n
    return out


def test_postings_that_met_another():
    rng = random.Random(2)
    for _ in range(300):
        rows = sorted((rng.choice([-5, -4, -3, -2, 7]), rng.randint(0, 3)) for _ in range(rng.randint(0, 14)))
        full = [(t, c, c + 1, 9) for t, c in rows]
        got = [tuple(r.values()) for b in ngram_join._met(split(rng, full, ngram_join.POSTS)) for r in b.to_pylist()]
        want = [(t, c, c + 1, 9) for t, c in sorted(set(rows)) if t > 0 or len({y for x, y in rows if x == t}) > 1]
        assert got == want


def test_keys_that_agree():
    rng = random.Random(3)
    schema = pa.schema([("key", pa.int64()), ("h", pa.int64()), ("kind", pa.int32())])
    for _ in range(300):
        rows = sorted((rng.randint(0, 6), rng.randint(0, 9), 0) for _ in range(rng.randint(0, 14)))
        got = [(r["h"], r["kind"]) for b in line_dedup._agreeing(split(rng, rows, schema)) for r in b.to_pylist()]
        keys = [r[0] for r in rows]
        must = [(r[1], 0) for r in rows if keys.count(r[0]) > 1]
        assert all(got.count(x) >= must.count(x) for x in must)
        assert len(got) <= len(must) + 2  # the ends of a task count as shared


@pytest.mark.parametrize("least", [1, 3])
def test_bitmap(spark, least):
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 32, 300, dtype=np.uint64).astype(np.uint32)
    blobs, count = [], {}
    for _ in range(5):
        values = np.sort(rng.choice(pool, 250))
        for v in values.tolist():
            count[v] = count.get(v, 0) + 1
        blobs += [(k, bytearray(b)) for k, b in ngram_join._blobs(values, 64)]
    bitmap = ngram_join.fixed_bitmap(spark.createDataFrame(blobs, "bucket int, blob binary"), 64, least)
    assert bitmap.nbytes == 1 << (ngram_join.MAP_BITS - 3)
    wide = pool.astype(np.uint64) << np.uint64(32)
    want = np.array([count.get(v, 0) >= least for v in pool.tolist()])
    got = ngram_join._bit(bitmap, wide)
    assert (got >= want).all() and (got & ~want).sum() <= 2  # another value of the same bit
    assert int(np.unpackbits(bitmap).sum()) <= len({v >> (32 - ngram_join.MAP_BITS) for v, n in count.items() if n >= least})
