"""Hand-made edge rows where the reference's pandas behavior differs from a
naive Spark translation (see FIXTURES.md §4)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tillroll import functions as tf
from tillroll.operators import basket, binning, cleaning, cohort, dimensions as dims, forecast, rfm
from tillroll.operators.ranking import exact_quantiles

LINE_SCHEMA = ("InvoiceNo string, StockCode string, Description string, Quantity bigint, "
               "InvoiceDate timestamp_ntz, UnitPrice double, CustomerID double, Country string")


def lines(spark, rows):
    return spark.createDataFrame(rows, LINE_SCHEMA)


def ts(s):
    return dt.datetime.fromisoformat(s)


def test_cancelled_prefix_null_and_lowercase_kept(spark):
    df = lines(spark, [("C1", "A", "x", 1, ts("2020-01-01 10:00"), 1.0, 1.0, "UK"),
                       (None, "A", "x", 1, ts("2020-01-01 10:00"), 1.0, 1.0, "UK"),
                       ("c123", "A", "x", 1, ts("2020-01-01 10:00"), 1.0, 1.0, "UK"),
                       ("123", "A", "x", 1, ts("2020-01-01 10:00"), 1.0, 1.0, "UK")])
    kept = [r.InvoiceNo for r in cleaning.drop_cancelled(df).collect()]
    assert sorted(kept, key=str) == sorted([None, "c123", "123"], key=str)


def test_nan_and_nonpositive_prices_dropped(spark):
    df = lines(spark, [("1", "A", "x", 1, ts("2020-01-01 10:00"), float("nan"), 1.0, "UK"),
                       ("2", "A", "x", 1, ts("2020-01-01 10:00"), 0.0, 1.0, "UK"),
                       ("3", "A", "x", 0, ts("2020-01-01 10:00"), 2.0, 1.0, "UK"),
                       ("4", "A", "x", 2, ts("2020-01-01 10:00"), 2.0, 1.0, "UK")])
    assert [r.InvoiceNo for r in cleaning.positive_amounts(df).collect()] == ["4"]


def test_value_on_fence_is_kept(spark):
    # Q1 = 2, Q3 = 4 -> fences [-1, 7]; 7 is exactly on the upper fence.
    df = spark.createDataFrame([(v,) for v in [1, 2, 2, 2, 4, 4, 4, 7, 100]], "Quantity bigint")
    q = exact_quantiles(df, "Quantity", [0.25, 0.75]).first()[0]
    assert q == [2.0, 4.0]
    kept = sorted(r.Quantity for r in cleaning.iqr_filter(df, "Quantity").collect())
    assert kept == [1, 2, 2, 2, 4, 4, 4, 7]


def test_description_cleaning_keeps_trailing_blank(spark):
    df = spark.createDataFrame([(' café "tea" no.1! ',), ("TEA!",)], "d string")
    got = [r[0] for r in df.select(tf.clean_description("d")).collect()]
    assert got == ["CAFÉ TEA NO 1 ", "TEA "]


def test_category_order_and_substring(spark):
    df = spark.createDataFrame([("CHRISTMAS LIGHT",), ("CUPBOARD CABBAGE",), ("PLAIN",)], "d string")
    got = [r[0] for r in df.select(tf.categorize("d")).collect()]
    assert got == ["Home Decor", "Bags & Accessories", "Other"]


def test_title_case_restarts_after_non_letters(spark):
    df = spark.createDataFrame([("guinea-bissau o'brien USA 3rd x_y",), (" united kingdom ",)], "c string")
    got = [r[0] for r in df.select(tf.title_case("c")).collect()]
    assert got == ["Guinea-Bissau O'Brien Usa 3Rd X_Y", "United Kingdom"]


def test_elapsed_days_counts_whole_24h_blocks(spark):
    df = spark.createDataFrame([(ts("2020-01-01 23:00"), ts("2020-01-02 01:00")),
                                (ts("2020-01-01 01:00"), ts("2020-01-03 00:59"))], "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(tf.elapsed_days("a", "b")).collect()] == [0, 1]


def test_half_even_rounding_on_exact_money(spark):
    # 0.125 -> 0.12, 2.675 -> 2.68, 1.005 -> 1.00 (ties to even on the decimal value)
    df = spark.createDataFrame([(1250,), (26750,), (10050,)], "u bigint")
    got = [r[0] for r in df.select(tf.money_round2("u")).collect()]
    assert got == [0.12, 2.68, 1.0]


def test_ratio_without_customers_is_null(spark):
    df = spark.createDataFrame([(5.0, 0)], "a double, b bigint")
    assert df.select(tf.safe_ratio("a", "b")).first()[0] is None


def test_repeated_edges_strict_raises(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 2, 2, 3, 4, 5, 9]], "x double")
    with pytest.raises(Exception, match="Bin edges must be unique"):
        binning.qcut_strict(df, "x", 5, "b").collect()


def test_repeated_edges_dropped(spark):
    vals = [1, 1, 1, 1, 2, 2, 3, 4, 5, 9]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "i int, x double")
    got = [r.s for r in binning.score_dashboard(df, "x", 5, "s").orderBy("i").collect()]
    assert got == [1, 1, 1, 1, 2, 2, 3, 3, 4, 4]


def test_equal_width_bins_when_few_distinct(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 1, 2, 7, 7])], "i int, x double")
    got = [r.s for r in binning.score_dashboard(df, "x", 5, "s").orderBy("i").collect()]
    assert got == [1, 1, 1, 3, 3]


def test_rank_quintiles_match_interpolated_edges(spark):
    # ranks 1..n binned like quantile bins of the ranks themselves
    n = 23
    df = spark.createDataFrame([(r, n) for r in range(1, n + 1)], "r bigint, n bigint")
    got = [x.b for x in binning.qcut_rank(df, "r", "n", 5, "b").orderBy("r").collect()]
    edges = [1 + (n - 1) * k / 5 for k in range(1, 5)]
    want = [1 + sum(r > e for e in edges) for r in range(1, n + 1)]
    assert got == want


def test_shadowed_segment_code(spark):
    df = spark.createDataFrame([("155",), ("245",), ("999",)], "c string")
    got = [r[0] for r in df.select(tf.segment_by_score_code("c")).collect()]
    assert got == ["At Risk", "Cannot Lose Them", "Others"]


def test_weekday_without_sales_is_null_row(spark):
    df = spark.createDataFrame([("Monday", "1", 10.0), ("Friday", "2", 5.0)],
                               "DayName string, InvoiceNo string, TotalAmount double")
    rows = {r.DayName: r for r in dims.dow_sales(df).collect()}
    assert len(rows) == 7 and rows["Saturday"].TotalAmount is None and rows["Monday"].TotalAmount == 10.0


def _basket_lines(spark, baskets):
    rows = []
    for i, items in enumerate(baskets):
        for it in items:
            rows.append((f"I{i}", it, 1, True, 1))
    return spark.createDataFrame(rows, "InvoiceNo string, Description string, Quantity bigint, "
                                       "HasCustomerID boolean, CustomerID bigint")


def test_no_pair_over_threshold_gives_empty_table(spark):
    df = _basket_lines(spark, [["a", "b"], ["c"], ["a"], ["b"]])
    out = basket.basket_pairs(df, min_lift=100.0)
    assert out.count() == 0 and "Lift" in out.columns


def test_repeated_item_counted_once(spark):
    df = _basket_lines(spark, [["a", "a", "b"], ["a"]])
    sup = {r.item: r.invoices for r in basket.item_support(df, min_support=0.0).collect()}
    assert sup == {"a": 2, "b": 1}


def test_multi_item_consequent_rules(spark):
    df = _basket_lines(spark, [["a", "b", "c"]] * 3 + [["a"]])
    sets = basket.frequent_itemsets(df, min_support=0.5)
    rules = basket.association_rules(sets, min_threshold=0.0)
    abc = rules.where(F.length("antecedents") + F.length("consequents") == 5).collect()
    assert len(abc) == 6
    assert any(r.antecedents == "a" and r.consequents == "b, c" for r in abc)


def test_pairs_brute_force(spark):
    baskets = [["a", "b"], ["a", "b", "c"], ["a", "c"], ["b"], ["a", "b"], ["c", "d"]]
    df = _basket_lines(spark, baskets)
    got = {(r.Item_A, r.Item_B): r.Lift for r in
           basket.basket_pairs(df, min_item_support=0.0, min_lift=-1, min_pair_support=0.0).collect()}
    n = len(baskets)
    sup = {i: sum(i in b for b in baskets) / n for i in "abcd"}
    order = sorted(sup, key=lambda i: (-sup[i], i))
    for x in range(len(order)):
        for y in range(x + 1, len(order)):
            a, b = order[x], order[y]
            sab = sum(a in bk and b in bk for bk in baskets) / n
            if sab == 0:
                assert (a, b) not in got
            else:
                assert math.isclose(got[(a, b)], sab / (sup[a] * sup[b]))


def test_forecast_month_without_history_is_null(spark):
    rows = [("1", ts("2020-01-15 10:00"), 1, 2020, 100.0), ("2", ts("2020-02-15 10:00"), 2, 2020, 120.0),
            ("3", ts("2020-03-15 10:00"), 3, 2020, 90.0)]
    df = spark.createDataFrame(rows, "InvoiceNo string, InvoiceDate timestamp_ntz, Month int, Year int, TotalAmount double")
    out = {r.Month: r.ForecastRevenue for r in forecast.forecast(df).collect()}
    assert set(out) == {4, 5, 6, 7, 8, 9} and all(v is None for v in out.values())


def test_empty_input_keeps_schema(spark):
    df = lines(spark, [])
    cl = cleaning.clean_sales(df)
    assert cl.count() == 0 and len(cl.columns) == 24
    assert dims.monthly_sales(cl).count() == 0
    assert cohort.cohort_retention(cl).count() == 0
    seg = rfm.attach_segments(cl)
    assert seg.count() == 0 and "Customer_Segment" in seg.columns


def test_strip_matches_python_whitespace(spark):
    s = " 　x y\t\x1c\x85"
    got = spark.createDataFrame([(s,)], "s string").select(tf.strip_ws("s")).first()[0]
    assert got == s.strip()
