"""Radix selection against sorting."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillroll.operators import binning, dimensions, radix


def scans(monkeypatch):
    """Counts the scans that selection makes."""
    seen, real = [], radix._counts
    monkeypatch.setattr(radix, "_counts", lambda *a: seen.append(a[1]) or real(*a))
    return seen


def check(spark, values, kind, ranks=None):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    known = sorted((v for v in values if v is not None), key=lambda v: (v != v, v))
    n = len(known)
    ranks = ranks or sorted({r for r in (0, 1, n // 5, n // 4, n // 3, n // 2, n - 2, n - 1) if 0 <= r < n})
    got = radix.select_ranks(df, {"x": lambda m: ranks})["x"]
    assert got.n == n and set(got.at) == set(ranks)
    same = lambda a, b: a == b or (a != a and b != b)
    for r in ranks:
        assert same(got.at[r].value, known[r]), (r, got.at[r], known[r])
        assert got.at[r].below == next(i for i, v in enumerate(known) if same(v, known[r]))
    assert same(got.least, known[0]) and same(got.greatest, known[-1])
    assert got.digits <= len({repr(v + 0) for v in known})


def test_awkward_doubles(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 1e308, -1e308, 5e-324, -5e-324, 1e-300, float("inf"), float("-inf"), float("nan"), float("nan"), None, None]
    values += [rng.choice([1, -1]) * rng.random() * 10.0 ** rng.randint(-300, 300) for _ in range(300)]
    values += [math.nextafter(1.0, 2.0), 1.0, math.nextafter(1.0, 0.0), 3.0] + [2.5] * 40
    rng.shuffle(values)
    check(spark, values, "double", list(range(len(values) - 2)))


def test_longs_beyond_doubles_are_exact(spark):
    rng = random.Random(2)
    values = [rng.randint(-(2 ** 62), 2 ** 62) for _ in range(200)] + [2 ** 62 + i for i in range(50)] + [2 ** 63 - 1, -(2 ** 63) + 1, 0, None, 7, 7]
    check(spark, values, "bigint", list(range(len(values) - 1)))


def test_neighbouring_doubles_are_told_apart(spark):
    x, values = 1.0, []
    for _ in range(400):
        values.append(x)
        x = math.nextafter(x, 2.0)
    check(spark, values, "double")


def test_two_scans_for_all_columns(spark, monkeypatch):
    seen = scans(monkeypatch)
    df = spark.range(200_000).select((F.hash("id") % 90 + 95).cast("int").alias("qty"), (F.pmod(F.hash("id", F.lit(1)), F.lit(900)) / 100).alias("price"),
                                     F.col("id").alias("customer"))
    probs = [0.25, 0.5, 0.75]
    got = radix.quantiles(df, {"qty": probs, "price": probs, "customer": probs})
    want = df.agg(*[F.percentile(c, F.array(*map(F.lit, probs))).alias(c) for c in ("qty", "price", "customer")]).first()
    assert got["qty"] == list(want.qty) and got["customer"] == list(want.customer)
    assert got["price"] == pytest.approx(list(want.price), rel=1e-12)
    assert len([s for s in seen if len(s) > 1]) <= 2 and len(seen) <= 4  # ids up to 200,000 need finer digits


def test_no_row_is_shuffled(spark):
    """What moves are counts per digit: one row per task and digit."""
    df = spark.range(100_000).select((F.rand(3) * 50).alias("x"))
    x = F.col("x")
    one = df.select(F.struct(F.lit(0).alias("part"), radix._first_digit(x).alias("digit"), x.alias("d")).alias("x")).select("x.*")
    plan = one.groupBy("part", "digit").agg(F.count(F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "rangepartitioning" not in plan


def test_empty_and_all_null(spark):
    df = spark.createDataFrame([(None, 1)], "x double, y int")
    assert radix.quantiles(df, {"x": [0.5], "y": [0.5]}) == {"x": [None], "y": [1.0]}
    assert radix.quantiles(df.where("false"), {"x": [0.0, 1.0]}) == {"x": [None, None]}


def test_bins_by_rank_equal_a_window(spark):
    rng = random.Random(4)
    for n in (1, 2, 4, 5, 6, 37, 400):
        rows = [(i + 2 ** 60, rng.choice([1, 1, 1, 2, 3, rng.randint(1, 40)])) for i in range(n)]
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "key long, x long")
        w = Window.partitionBy(F.lit(1)).orderBy("x", "key")
        r, m = F.row_number().over(w) - 1, F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
        k = F.sequence(F.lit(1), F.lit(4))
        want = df.withColumn("r", r).withColumn("m", m).withColumn("want", F.lit(1) + F.size(F.filter(k, lambda k: F.col("r") * 5 > k * (F.col("m") - 1))))
        got = binning.qcut_by_rank(want, "x", "key", 5, "got")
        assert got.where("got != want or got is null").count() == 0


def test_bins_by_rank_of_no_rows(spark):
    assert binning.qcut_by_rank(spark.createDataFrame([], "key long, x long"), "x", "key").collect() == []


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 1.0])
def test_top_share_with_ties_and_products_without_revenue(spark, share):
    rng = random.Random(5)
    units = [rng.choice([None, 0, 10, 10, 10, rng.randrange(10 ** 9)]) for _ in range(997)]
    g = spark.createDataFrame([(u,) for u in units], f"{dimensions.REV_UNITS} long")
    row = dimensions._pareto(g, share).first()
    k = math.floor(len(units) * share)
    best = sorted((u or 0 for u in units), reverse=True)[:k]
    assert (row.total_products, row.top_n) == (len(units), k)
    assert row.top_revenue == sum(best) / 10_000 and row.total_revenue == sum(u or 0 for u in units) / 10_000


def test_top_share_of_nothing(spark):
    row = dimensions._pareto(spark.createDataFrame([], f"{dimensions.REV_UNITS} long"), 0.2).first()
    assert (row.total_products, row.top_n, row.top_revenue, row.top_share_pct) == (0, 0, 0.0, None)
