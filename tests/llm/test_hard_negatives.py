"""Hard negatives against brute force, and the parts of the search."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import hard_negatives as hn

TYPES = "vec_id long, embedding array<double>, label int"


def table(seed=3, n=500, dim=9):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((6, dim))
    rows = []
    for i in range(n):
        k = int(rng.integers(6))
        rows.append((i, (centre[k] + 0.5 * rng.standard_normal(dim)).tolist(), int(k // 2 + (rng.random() < 0.2))))
    rows += [(i, rows[7][1], 1) for i in range(n, n + 120)]  # copies
    for i in range(300, 340):
        rows[i] = (i, rows[i][1], 3)
    rows += [(800, None, 1), (900, rows[0][1], None), (1000, [float("nan")] + [1.0] * (dim - 1), 1), (1001, [float("inf")] * dim, 1), (1002, [None] + [0.5] * (dim - 1), 2),
             (None, rows[1][1], 2), (1100, [0.0] * dim, 0), (1101, [0.25, -0.5], 1), (1200, [1.5, 2.0], 1), (1202, [2.0, 1.0], 0), (1300, [], 1), (1301, [], 1), (1302, [], 2),
             (1400, rows[4][1], 77)]
    random.Random(seed).shuffle(rows)
    return rows


def brute(rows, every=50, scale=256):
    good = [(i, l, [math.floor(scale * c) for c in v]) for i, v, l in rows
            if i is not None and l is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = set()
    for a, label, x in {i: (i, l, q) for i, l, q in sorted(good, reverse=True)}.values():
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), i, l) for i, l, y in good if i != a and len(y) == len(x))
        for s, p in [(-s, i) for s, i, l in scored if l == label][:5]:
            fits = [(-t, i) for t, i, l in scored if l != label and 80 * s <= -100 * t <= 100 * s]
            out |= {(a, p, r + 1, i, s, t) for r, (t, i) in enumerate(fits[:5])}
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, TYPES)
    for name in ("id", "x", "dim", "place", "v", "n", "ids", "block", "chunk", "anchor", "rank", "score", "salt", "low", "high", "partner"):
        df = df.withColumn(name, F.lit(1))
    return df


@pytest.mark.parametrize("size", [16, 256])
def test_equal_brute_force(spark, size):
    rows = table()
    got = hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0, F.col("label"), block_rows=size)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got, want = [tuple(r) for r in got.collect()], brute(rows)
    assert len(want) > 100 and len(got) == len(set(got)) and set(got) == want


def test_huge_components_are_exact(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([1e3, 1e15]) * rng.uniform(0.5, 2) * (1 if d else 1e-9) for d in range(3)], i % 2) for i in range(60)]
    got = {tuple(r) for r in hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0, F.col("label"), scale=1).collect()}
    cut = lambda s: max(-2 ** 63, min(2 ** 63 - 1, s))
    assert {r[0] for r in got} <= {0, 50} and all(r[4] == cut(r[4]) and r[5] <= r[4] for r in got)
    small = [(i, [c / 1e9 for c in v], l) for i, v, l in rows]
    assert {tuple(r) for r in hn.hard_negatives(frame(spark, small), F.col("vec_id") % 50 == 0, F.col("label")).collect()} == brute(small)
    assert hn.integers(np.array([[1e308, 0.5, -1.25]]), 256).tolist() == [[256 * int(1e308), 128, -320]]


def test_empty_table_and_no_anchors(spark):
    assert hn.hard_negatives(spark.createDataFrame([], TYPES), F.col("vec_id") % 50 == 0, F.col("label")).collect() == []
    assert hn.hard_negatives(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)]), F.col("vec_id") % 50 == 0, F.col("label")).collect() == []


def test_hilbert_curve_moves_one_cell_at_a_time():
    for dims, bits in ((2, 4), (3, 2), (5, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        place = hn.hilbert(cells, bits)
        assert sorted(place.tolist()) == list(range(len(cells)))
        way = cells[np.argsort(place)]
        assert (np.abs(np.diff(way, axis=0)).sum(1) == 1).all()


def test_bounds_hold_for_every_row():
    rng = np.random.default_rng(5)
    v, block = rng.integers(-300, 300, (20, 7)), rng.integers(-300, 300, (40, 7))
    upper, lower = hn._bounds(v, np.stack([block.min(0), block.max(0)])[None])
    scores = hn.product(v, block)
    assert (scores <= upper).all() and (scores >= lower).all()


def test_blocks_out_of_reach_are_not_read(spark):
    """Clusters far apart: an anchor's windows reach into few blocks."""
    rng = np.random.default_rng(2)
    rows = [(i, (np.eye(8)[i % 8] * 4 + 0.1 * rng.standard_normal(8)).tolist(), i % 3) for i in range(1600)]
    valid = hn._valid(spark.createDataFrame(rows, TYPES), "vec_id", "embedding", F.col("label"), F.col("vec_id") % 50 == 0)
    keyed = hn.written(hn._keyed(valid, 256), "curve")
    blocks = hn.written(hn._blocks(keyed, 25), "blocks")
    chunks = hn.written(hn._blocks(keyed.where("anchor"), 256).select(F.col("block").alias("chunk"), "dim", "ids", "labels", "v"), "anchors")
    places = chunks.select("chunk", F.posexplode("ids").alias("anchor", "a"))
    windows = places.select("chunk", "anchor", F.lit(0).cast("long").alias("partner"), F.lit(500_000).cast("long").alias("low"), F.lit(2 ** 62).alias("high"))
    picks = hn._wanted(hn._windows(chunks, windows), hn._zones(blocks), False)
    assert 0 < picks.count() < 0.5 * places.count() * blocks.count()
