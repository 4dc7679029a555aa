"""Near-duplicate vectors and nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import ann, embedding_dedup, nn_graph


def vectors(seed: int = 1, n: int = 700, dim: int = 24) -> list[tuple]:
    """Random vectors, near copies, a large group, equal vectors and bad ones."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for i in range(0, 200, 4):
        x[i + 1] = x[i] + 0.05 * rng.standard_normal(dim)
    x[300:360] = x[300] + 0.04 * rng.standard_normal((60, dim))
    x[400:420] = x[400]
    x[421] = 2 * x[400]
    rows = [(i, [float(c) for c in v.astype(np.float32)]) for i, v in enumerate(x)]
    rng.shuffle(rows)
    bad = [(n, None), (n + 1, [0.0] * dim), (n + 2, [float("nan")] + [1.0] * (dim - 1)), (n + 3, [float("inf")] * dim), (n + 4, []),
           (n + 5, [None] + [1.0] * (dim - 1)), (n + 6, [1.0, 2.0])]
    rows = [(int(i), v) for i, v in rows]
    return rows + bad + rows[:3]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for name in ("id", "x", "n", "u", "v", "d", "q", "node", "new", "component", "label", "dim", "cell", "p", "k"):
        df = df.withColumn(name, F.lit(1))
    return df


def good(rows):
    keep = [(i, v) for i, v in dict(rows).items() if v and len(v) > 2 and None not in v and np.isfinite(v).all() and any(v)]
    return np.array([i for i, _ in keep]), np.array([v for _, v in keep], np.float32).astype(np.float64)


def test_near_duplicates_equal_brute_force(spark):
    rows = vectors()
    ids, x = good(rows)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = ids.copy()
    while True:
        new = np.array([min(label[i], *label[near[i]]) if near[i].any() else label[i] for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    want = {int(i): (int(near[k].sum()), int(label[k])) for k, i in enumerate(ids)}
    got = embedding_dedup.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id) == want.get(r.vec_id, (0, r.vec_id)), r
        assert r.kept == (r.vec_id == r.component_id)


def brute_links(ids, x):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = ids.copy()
    while True:
        new = np.array([min(label[i], *label[near[i]]) if near[i].any() else label[i] for i in range(len(ids))])
        if (new == label).all():
            return {int(i): (int(near[k].sum()), int(label[k])) for k, i in enumerate(ids)}
        label = new


def dense_families(dim: int = 24) -> list[tuple]:
    """Families of 200 that fill their own lists: two whose centres are at cosine
    0.97, one far from them."""
    rng = np.random.default_rng(8)
    a, b, far = np.linalg.qr(rng.standard_normal((dim, 3)))[0].T
    centres = [a, 0.97 * a + np.sqrt(1 - 0.97 ** 2) * b, far]
    x = np.concatenate([c + 0.01 * rng.standard_normal((200, dim)) for c in centres])
    rows = [(i, [float(c) for c in v.astype(np.float32)]) for i, v in enumerate(x)]
    rng.shuffle(rows)
    return [(int(i), v) for i, v in rows]


def test_links_between_dense_families(spark):
    rows = dense_families()
    want = brute_links(*good(rows))
    assert len({c for _, c in want.values()}) == 2 and max(n for n, _ in want.values()) > 300
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()} == want


def test_exact_if_the_descent_finds_nothing(spark, monkeypatch):
    descend = nn_graph.descend
    monkeypatch.setattr(nn_graph, "descend", lambda *a, **b: descend(*a, **b).where("false"))
    rows = vectors(3, n=430)
    with pytest.warns(UserWarning, match="recall"):
        got = embedding_dedup.near_duplicates(frame(spark, rows))
    want = brute_links(*good(rows))
    for r in got.collect():
        assert (r.n_links, r.component_id) == want.get(r.vec_id, (0, r.vec_id)), r


def test_rare_links_that_the_descent_misses_are_noticed(spark, monkeypatch):
    """Two links in 600 vectors; a sample of nodes that sees neither would pass."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((600, 24))
    x[7], x[500] = x[8] + 0.05 * x[7], x[90] + 0.05 * x[500]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    descend = nn_graph.descend
    monkeypatch.setattr(nn_graph, "descend", lambda *a, **b: descend(*a, **b).where("d > 0.2"))
    monkeypatch.setattr(embedding_dedup, "audit", lambda *a, **b: 1.0)
    with pytest.warns(UserWarning, match="recall"):
        got = embedding_dedup.near_duplicates(df)
    assert {(r.vec_id, r.component_id) for r in got.where("n_links > 0").collect()} == {(7, 7), (8, 7), (90, 90), (500, 90)}


def test_planted_partners(spark):
    nodes = spark.createDataFrame([(i, np.eye(8)[i % 8].astype("<f8").tobytes()) for i in range(20)], "id long, x binary")
    pairs = embedding_dedup.partners(nodes, "<f8", 0.95, 5)
    for p, s, y in pairs:
        assert p >= 20 and 0.95 < np.frombuffer(y, "<f8") @ np.eye(8)[s % 8] < 0.96
    table = spark.createDataFrame([(p, s) for p, s, _ in pairs], "p long, s long")
    lists = spark.createDataFrame([(pairs[0][0], pairs[0][1]), (pairs[1][1], pairs[1][0])], "u long, v long")
    full = spark.createDataFrame([(pairs[2][1],)], "node long")
    assert embedding_dedup.planted_recall(lists, full, table) == 0.6
    for last in ((1 << 63) - 1, 5):
        ends = nodes.select((F.col("id") - 10 if last == 5 else F.lit(last) - F.col("id")).alias("id"), "x")
        assert len(embedding_dedup.partners(ends, "<f8", 0.95, 5)) == 5
    assert embedding_dedup.partners(nodes.where("false"), "<f8", 0.95) == []


def test_audit_counts_nodes_and_not_links(spark):
    """All links of a dense group are measured, none of the single pairs is found."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 24))
    x[:200] = x[0] + 0.01 * x[:200]
    x[201::2] = x[200::2] + 0.01 * rng.standard_normal((100, 24))
    nodes = spark.createDataFrame([(i, v.astype("<f8").tobytes(), 1) for i, v in enumerate(x)], "id long, x binary, n long")
    settled = spark.createDataFrame([(i, 0) for i in range(200)], "node long, component long")
    pairs = [(i, i + 1) for i in range(200, 400, 2)]
    recall = [embedding_dedup.audit(nodes, spark.createDataFrame(p, "u long, v long"), settled, "<f8", 0.95) for p in ([], pairs[:50], pairs)]
    assert recall == [0.0, 0.5, 1.0]


def test_recall_of_near_duplicates_and_no_false_links(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((4000, 64))
    x[1::8] = x[::8] + 0.2 * rng.standard_normal((500, 64))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    ids, x = good(rows)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = near.sum(axis=1)
    assert all(got[int(i)] <= want[k] for k, i in enumerate(ids))
    assert sum(got.values()) >= 0.98 * want.sum()


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(empty).count() == 0
    assert ann.nearest_neighbours(empty, F.col("vec_id") % 100 == 0).count() == 0
    bad = spark.createDataFrame([(None, [1.0, 2.0]), (1, None), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(bad).collect()}
    assert got == {None: (0, None, False), 1: (0, 1, True), 2: (0, 2, True)}


def test_repeated_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False), (3, 0, 3, True)]


def brute_nearest(rows, queries, k):
    ids, x = good(rows)
    at = {int(i): n for n, i in enumerate(ids)}
    out = {}
    for q in queries:
        if q in at:
            d = np.sqrt(np.cumsum((x - x[at[q]]) ** 2, axis=1)[:, -1])
            out[q] = [(int(ids[j]), float(d[j])) for j in np.lexsort((ids, d)) if ids[j] != q][:k]
    return out


def test_nearest_neighbours_of_a_small_table(spark):
    rows = vectors(2)
    want = brute_nearest(rows, [i for i, _ in rows if i % 20 == 0], 10)
    got: dict = {}
    for r in ann.nearest_neighbours(frame(spark, rows), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append((r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.98 * sum(map(len, want.values()))
    for q, found in got.items():  # exact measure, nearest first, ties by id
        assert found == sorted(found, key=lambda v: (v[1], v[0])) and len(found) == 10
    assert got[400] == want[400]  # equal vectors: the smallest ids


def test_fewer_candidates_than_asked_for(spark):
    df = spark.createDataFrame([(0, [0.0, 1.0]), (100, [1.0, 0.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.nearest_neighbours(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7, 1.0), (0, 2, 100, 2.0 ** 0.5), (100, 1, 7, 1.0), (100, 2, 0, 2.0 ** 0.5)]


@pytest.mark.parametrize("n", [3000])
def test_recall_of_the_search(spark, n):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((n, 32)))]
    want = brute_nearest(rows, range(0, n, 100), 10)
    got = ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect()
    hits = sum((r.vec_id in {v for v, _ in want[r.query_id]}) for r in got)
    assert hits >= 0.95 * 10 * len(want)


def test_exact_if_the_search_finds_little(spark, monkeypatch):
    monkeypatch.setattr(ann, "MAX_STEPS", 0)
    monkeypatch.setattr(ann, "ENTRIES", 12)
    rows = vectors(5, n=430)
    want = brute_nearest(rows, [i for i, _ in rows if i % 20 == 0], 10)
    with pytest.warns(UserWarning, match="recall"):
        found = ann.nearest_neighbours(frame(spark, rows), F.col("vec_id") % 20 == 0)
    got: dict = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == want


def test_lists_hold_the_nearest(spark):
    rows = vectors(4)
    nodes, _ = nn_graph.classes(nn_graph.usable(frame(spark, rows), "vec_id", "embedding"))
    lists = nn_graph.descend(nn_graph.bytes_of(nodes, "<f4", unit=False), 10, 4).collect()
    per: dict = {}
    for r in lists:
        per.setdefault(r.u, set()).add(r.v)
    assert all(len(v) <= 10 for v in per.values())
