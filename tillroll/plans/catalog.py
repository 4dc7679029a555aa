"""Registered queries: name -> (Spark plan builder, DuckDB oracle SQL).

Each builder takes ``(spark, sf_dir)``, reads the driver tables through the
raw adapter and returns a lazy DataFrame.  The oracle SQL (``None`` where the
operator is not SQL-expressible) re-computes the same result independently.
Parameters chosen here (filters, item columns, thresholds) are the test
configuration of each operator; the operators themselves default to the
reference's values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators import cleaning, dimensions as dims
from tillroll.plans.layout import ROUNDS, KeyedTable
from tillroll.plans.materialize import drop_written, is_written, once
from tillroll.plans.oracle import (CLEANED_COLS, U, clean_desc_sql, money, msum, title_sql, with_cleaned,
                                   with_raw)
from tillroll.sources.retail import TPCH_TABLES, read_table, retail_raw

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw invoice lines derived from ``sf_dir``, written once per session:
    the stand-in for the raw export file, so the cleaning passes (fences,
    main pass) scan columnar data instead of re-running the derivation."""
    from tillroll.plans.materialize import partitions_for, written_table
    with partitions_for(spark, read_table(spark, sf_dir, "lineitem").count()):
        return written_table(spark, f"raw:{sf_dir}", lambda: retail_raw(spark, sf_dir), sources=_inputs(sf_dir))


def cleaned_by_customer(spark: SparkSession, sf_dir: str) -> KeyedTable:
    """Cleaned lines of ``sf_dir``, stored by customer: the cleaning job's output
    table, written once per session (the boundary every analysis starts from).
    Raw lines that were written for it alone are deleted."""
    raw = dict(key=f"raw:{sf_dir}", sources=_inputs(sf_dir))

    def build() -> KeyedTable:
        asked_for = is_written(spark, **raw)
        stored = cleaning.write_clean_sales(raw_lines(spark, sf_dir), "CustomerID", "cleaned-lines", ROUNDS)
        if not asked_for:
            drop_written(spark, **raw)
        return stored

    return once(spark, f"cleaned:{sf_dir}", build, sources=_inputs(sf_dir))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of ``cleaned_by_customer``."""
    return cleaned_by_customer(spark, sf_dir).lines


def _inputs(sf_dir: str) -> list[str]:
    """The tables that the raw lines come from."""
    return [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in TPCH_TABLES]


def half_even_sql(units: str, divisor: str) -> str:
    """SQL twin of functions.half_even_div (exact, ties to even)."""
    r = f"((({units}) % ({divisor}) + ({divisor})) % ({divisor}))"
    q = f"((({units}) - {r}) // ({divisor}))"
    return (f"(CASE WHEN 2 * {r} > ({divisor}) THEN {q} + 1 WHEN 2 * {r} < ({divisor}) THEN {q} "
            f"ELSE {q} + ((({q}) % 2 + 2) % 2) END)")


def round2_sql(units: str, count: str = "1") -> str:
    return f"(CAST({half_even_sql(units, f'100 * ({count})')} AS DOUBLE) / 100.0)"


def label_sql(x: str, n: int, ellipsis: bool = True) -> str:
    if not ellipsis:
        return f"left({x}, {n})"
    return f"CASE WHEN length({x}) > {n} THEN left({x}, {n}) || '...' ELSE {x} END"


# ================================================================ cleaning ===

@register("cleaned_sales", with_cleaned(f"SELECT {CLEANED_COLS} FROM cleaned"))
def q_cleaned_sales(spark, sf):
    from tillroll.sources.schemas import CLEANED_COLUMNS
    return cleaned(spark, sf).select(*CLEANED_COLUMNS)


# ============================================================== dimensions ===

@register("monthly_sales", with_cleaned(f"""
SELECT Year, Month, {msum()} AS TotalAmount, count(DISTINCT InvoiceNo) AS Transactions,
       count(DISTINCT CustomerID) AS UniqueCustomers, make_date(Year, Month, 1) AS Date
FROM cleaned GROUP BY Year, Month"""))
def q_monthly_sales(spark, sf):
    return dims.monthly_sales(cleaned(spark, sf))


@register("monthly_insights", with_cleaned(f"""
SELECT {money('sum(u)')} AS total_revenue,
       CAST(sum(u) AS DOUBLE) / count(*) / 10000 AS avg_monthly_revenue,
       count(*) AS months,
       (SELECT Year FROM m ORDER BY u DESC, Year, Month LIMIT 1) AS peak_year,
       (SELECT Month FROM m ORDER BY u DESC, Year, Month LIMIT 1) AS peak_month,
       {money('max(u)')} AS peak_revenue
FROM m""", f"m AS (SELECT Year, Month, sum({U}) AS u FROM cleaned GROUP BY Year, Month)"))
def q_monthly_insights(spark, sf):
    return dims.monthly_insights(cleaned(spark, sf))


@register("daily_revenue", with_cleaned(f"""
SELECT CAST(InvoiceDate AS DATE) AS Date, {msum()} AS Value FROM cleaned GROUP BY 1"""))
def q_daily_revenue(spark, sf):
    return dims.daily_revenue(cleaned(spark, sf))


@register("season_sales", with_cleaned(f"""
SELECT Season, {msum()} AS TotalAmount, count(DISTINCT InvoiceNo) AS Transactions,
       count(DISTINCT CustomerID) AS UniqueCustomers
FROM cleaned GROUP BY Season"""))
def q_season_sales(spark, sf):
    return dims.season_sales(cleaned(spark, sf))


@register("dow_sales", with_cleaned("""
SELECT CAST(d.DayIndex AS INTEGER) AS DayIndex, d.DayName, g.TotalAmount, g.Transactions
FROM d LEFT JOIN g ON d.DayName = g.DayName""",
    "d AS (SELECT * FROM (VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'), "
    "(4, 'Friday'), (5, 'Saturday'), (6, 'Sunday')) t(DayIndex, DayName))",
    f"g AS (SELECT DayName, {msum()} AS TotalAmount, count(DISTINCT InvoiceNo) AS Transactions "
    "FROM cleaned GROUP BY DayName)"))
def q_dow_sales(spark, sf):
    return dims.dow_sales(cleaned(spark, sf))


@register("hourly_sales", with_cleaned(f"""
SELECT Hour, {msum()} AS TotalAmount, count(DISTINCT InvoiceNo) AS Transactions FROM cleaned GROUP BY Hour"""))
def q_hourly_sales(spark, sf):
    return dims.hourly_sales(cleaned(spark, sf))


@register("period_sales", with_cleaned(f"""
SELECT BusinessPeriod, {msum()} AS TotalAmount, count(DISTINCT InvoiceNo) AS Transactions
FROM cleaned GROUP BY BusinessPeriod"""))
def q_period_sales(spark, sf):
    return dims.period_sales(cleaned(spark, sf))


@register("temporal_peaks", with_cleaned(f"""
SELECT (SELECT Season FROM (SELECT Season, sum({U}) AS u FROM cleaned GROUP BY Season) ORDER BY u DESC, Season LIMIT 1) AS best_season,
       (SELECT DayName FROM (SELECT DayOfWeek, DayName, sum({U}) AS u FROM cleaned GROUP BY DayOfWeek, DayName) ORDER BY u DESC, DayOfWeek LIMIT 1) AS best_day,
       (SELECT Hour FROM (SELECT Hour, sum({U}) AS u FROM cleaned GROUP BY Hour) ORDER BY u DESC, Hour LIMIT 1) AS peak_hour,
       (SELECT BusinessPeriod FROM (SELECT BusinessPeriod, sum({U}) AS u FROM cleaned GROUP BY BusinessPeriod) ORDER BY u DESC, BusinessPeriod LIMIT 1) AS best_period"""))
def q_temporal_peaks(spark, sf):
    return dims.temporal_peaks(cleaned(spark, sf))


PRODUCT_METRICS_CTE = f"""pm AS (
  SELECT StockCode, Description, CAST(sum(Quantity) AS BIGINT) AS Quantity, {msum()} AS TotalAmount,
         count(DISTINCT InvoiceNo) AS TransactionCount, count(DISTINCT CustomerID) AS UniqueCustomers
  FROM cleaned WHERE StockCode IS NOT NULL AND Description IS NOT NULL GROUP BY StockCode, Description)"""
PM_COLS = ("StockCode, Description, Quantity, TotalAmount, TransactionCount, UniqueCustomers, "
           "TotalAmount / TransactionCount AS AvgOrderValue, Quantity / TransactionCount AS AvgQuantityPerOrder")


@register("product_metrics", with_cleaned(f"SELECT {PM_COLS} FROM pm", PRODUCT_METRICS_CTE))
def q_product_metrics(spark, sf):
    return dims.product_metrics(cleaned(spark, sf))


@register("top_products_revenue", with_cleaned(
    f"SELECT {PM_COLS} FROM pm ORDER BY TotalAmount DESC, StockCode, Description LIMIT 20", PRODUCT_METRICS_CTE))
def q_top_products_revenue(spark, sf):
    return dims.top_products(cleaned(spark, sf), "TotalAmount", 20)


@register("top_products_quantity", with_cleaned(
    f"SELECT {PM_COLS} FROM pm ORDER BY Quantity DESC, StockCode, Description LIMIT 20", PRODUCT_METRICS_CTE))
def q_top_products_quantity(spark, sf):
    return dims.top_products(cleaned(spark, sf), "Quantity", 20)


@register("sample_products", with_cleaned(
    f"SELECT {PM_COLS} FROM pm ORDER BY md5(concat_ws('|', '0', StockCode, Description)), StockCode, Description "
    "LIMIT 500", PRODUCT_METRICS_CTE))
def q_sample_products(spark, sf):
    return dims.sample_products(dims.product_metrics(cleaned(spark, sf)), 500, "0")


@register("category_performance", with_cleaned(f"""
SELECT ProductCategory, {msum()} AS TotalAmount, CAST(sum(Quantity) AS BIGINT) AS Quantity,
       count(DISTINCT InvoiceNo) AS Transactions, count(DISTINCT CustomerID) AS UniqueCustomers,
       {msum()} / count(DISTINCT InvoiceNo) AS AvgOrderValue
FROM cleaned GROUP BY ProductCategory"""))
def q_category_performance(spark, sf):
    return dims.category_performance(cleaned(spark, sf))


PARETO_SQL_CTES = (
    f"g AS (SELECT StockCode, Description, sum({U}) AS u FROM cleaned "
    "WHERE StockCode IS NOT NULL AND Description IS NOT NULL GROUP BY StockCode, Description)",
    "r AS (SELECT *, row_number() OVER (ORDER BY u DESC, StockCode, Description) AS rn FROM g)",
    "s AS (SELECT count(*) AS n, CAST(floor(count(*) * 0.2) AS BIGINT) AS k, sum(u) AS tot FROM g)",
    "t AS (SELECT coalesce(sum(u), 0) AS top FROM r, s WHERE rn <= k)",
)


@register("pareto_share", with_cleaned(f"""
SELECT n AS total_products, k AS top_n, {money('top')} AS top_revenue, {money('tot')} AS total_revenue,
       CAST(top AS DOUBLE) / CAST(tot AS DOUBLE) * 100 AS top_share_pct
FROM s, t""", *PARETO_SQL_CTES))
def q_pareto_share(spark, sf):
    return dims.pareto_share(cleaned(spark, sf))


@register("product_insights", with_cleaned(f"""
SELECT n AS total_products, CAST(top AS DOUBLE) / CAST(tot AS DOUBLE) * 100 AS top_share_pct,
  (SELECT ProductCategory FROM (SELECT ProductCategory, sum({U}) AS u FROM cleaned GROUP BY 1) ORDER BY u DESC, ProductCategory LIMIT 1) AS top_category,
  (SELECT left(Description, 50) FROM g ORDER BY u DESC, StockCode, Description LIMIT 1) AS top_product
FROM s, t""", *PARETO_SQL_CTES))
def q_product_insights(spark, sf):
    return dims.product_insights(cleaned(spark, sf))


@register("top_products", with_cleaned(f"""
SELECT Description, {money('u')} AS TotalAmount, {label_sql('Description', 40)} AS Label
FROM (SELECT Description, sum({U}) AS u FROM cleaned GROUP BY Description) ORDER BY u DESC, Description LIMIT 15"""))
def q_top_products(spark, sf):
    return dims.top_products_by_description(cleaned(spark, sf), 15, 40)


@register("category_revenue", with_cleaned(f"""
SELECT ProductCategory, {msum()} AS TotalAmount FROM cleaned GROUP BY ProductCategory"""))
def q_category_revenue(spark, sf):
    return dims.category_revenue(cleaned(spark, sf))


@register("country_metrics", with_cleaned(f"""
SELECT Country, {msum()} AS TotalAmount, count(DISTINCT InvoiceNo) AS Transactions,
       count(DISTINCT CustomerID) AS UniqueCustomers, CAST(sum(Quantity) AS BIGINT) AS Quantity,
       {msum()} / count(DISTINCT InvoiceNo) AS AvgOrderValue,
       {msum()} / NULLIF(count(DISTINCT CustomerID), 0) AS RevenuePerCustomer
FROM cleaned WHERE Country IS NOT NULL GROUP BY Country"""))
def q_country_metrics(spark, sf):
    return dims.country_metrics(cleaned(spark, sf))


@register("top_countries", with_cleaned(f"""
SELECT Country, {money('u')} AS TotalAmount
FROM (SELECT Country, sum({U}) AS u FROM cleaned WHERE Country IS NOT NULL GROUP BY Country) ORDER BY u DESC, Country LIMIT 10"""))
def q_top_countries(spark, sf):
    return dims.top_countries(cleaned(spark, sf), 10)


@register("country_summary", with_cleaned(f"""
SELECT Country, {round2_sql('u')} AS Total_Revenue, {round2_sql('u', 'n')} AS Avg_Order_Value,
       Transaction_Count, Customer_Count
FROM (SELECT Country, sum({U}) AS u, count(*) AS n, count(DISTINCT InvoiceNo) AS Transaction_Count,
             count(DISTINCT CASE WHEN HasCustomerID THEN CustomerID END) AS Customer_Count
      FROM cleaned WHERE Country IS NOT NULL GROUP BY Country)"""))
def q_country_summary(spark, sf):
    return dims.country_summary(cleaned(spark, sf))


@register("season_summary", with_cleaned(f"""
SELECT Season, {round2_sql('u')} AS Total_Revenue, {round2_sql('u', 'n')} AS Avg_Revenue, Transaction_Count
FROM (SELECT Season, sum({U}) AS u, count(*) AS n, count(DISTINCT InvoiceNo) AS Transaction_Count
      FROM cleaned GROUP BY Season)"""))
def q_season_summary(spark, sf):
    return dims.season_summary(cleaned(spark, sf))


@register("home_market_share", with_cleaned(f"""
SELECT count(*) AS countries,
       {money("coalesce(sum(CASE WHEN Country = 'United Kingdom' THEN u END), 0)")} AS home_revenue,
       coalesce(CAST(coalesce(sum(CASE WHEN Country = 'United Kingdom' THEN u END), 0) * 100 AS DOUBLE) / NULLIF(sum(u), 0), 0.0) AS home_share_pct,
       count(*) FILTER (WHERE Country <> 'United Kingdom') AS other_countries,
       100.0 - coalesce(CAST(coalesce(sum(CASE WHEN Country = 'United Kingdom' THEN u END), 0) * 100 AS DOUBLE) / NULLIF(sum(u), 0), 0.0) AS other_share_pct,
       (SELECT Country FROM g WHERE Country <> 'United Kingdom' ORDER BY u DESC, Country LIMIT 1) AS top_other_country,
       (SELECT Country FROM g ORDER BY CAST(u AS DOUBLE) / inv DESC, Country LIMIT 1) AS top_aov_country,
       (SELECT Country FROM g ORDER BY cust DESC, Country LIMIT 1) AS most_customers_country
FROM g""", f"g AS (SELECT Country, sum({U}) AS u, count(DISTINCT InvoiceNo) AS inv, "
           "count(DISTINCT CustomerID) AS cust FROM cleaned WHERE Country IS NOT NULL GROUP BY Country)"))
def q_home_market_share(spark, sf):
    return dims.home_market_share(cleaned(spark, sf))


# ============================================================ rfm + segments ===

from tillroll import functions as tf  # noqa: E402
from tillroll.operators import clv as clv_ops, cohort, forecast as fc, rfm  # noqa: E402

IDENT = "HasCustomerID AND CustomerID IS NOT NULL"
QPROBS = "[0.0, 0.2, 0.4, 0.6000000000000001, 0.8, 1.0]"


def round_sig_sql(x: str, digits: int) -> str:
    """SQL twin of functions.round_sig."""
    k = f"({digits - 1} - CAST(floor(log10(abs({x}))) AS INTEGER))"
    return (f"(CASE WHEN ({x}) IS NULL OR ({x}) = 0 OR isnan({x}) THEN ({x}) "
            f"WHEN {k} >= 0 THEN round(({x}) * pow(10.0, {k})) / pow(10.0, {k}) "
            f"ELSE round(({x}) / pow(10.0, -{k})) * pow(10.0, -{k}) END)")


def rfm_cte(scope: str = "identified") -> str:
    snap_where = f"WHERE {IDENT}" if scope == "identified" else ""
    return (f"snap AS (SELECT max(InvoiceDate) + INTERVAL 1 DAY AS s FROM cleaned {snap_where}),\n"
            f"rfm AS (SELECT CustomerID, date_sub('day', max(InvoiceDate), (SELECT s FROM snap)) AS Recency,\n"
            f"  count(DISTINCT InvoiceNo) AS Frequency, {msum()} AS Monetary\n"
            f"  FROM cleaned WHERE {IDENT} GROUP BY CustomerID)")


# The segment rules written out, independently of functions/columns.py.
SCORE_LIST_SQL = """CASE
  WHEN RFM_Score IN ('555', '554', '544', '545', '454', '455', '445') THEN 'Champions'
  WHEN RFM_Score IN ('543', '444', '435', '355', '354', '345', '344', '335') THEN 'Loyal Customers'
  WHEN RFM_Score IN ('553', '551', '552', '541', '542', '533', '532', '531', '452', '451') THEN 'Potential Loyalists'
  WHEN RFM_Score IN ('512', '511', '422', '421', '412', '411', '311') THEN 'New Customers'
  WHEN RFM_Score IN ('155', '154', '144', '214', '215', '115', '114') THEN 'At Risk'
  WHEN RFM_Score IN ('245', '155', '154', '144', '135', '125', '124') THEN 'Cannot Lose Them'
  ELSE 'Others' END"""
SCORE_RULES_SQL = """CASE
  WHEN R_Score >= 4 AND F_Score >= 4 AND M_Score >= 4 THEN 'Champions'
  WHEN R_Score >= 4 AND F_Score >= 3 AND M_Score >= 3 THEN 'Loyal Customers'
  WHEN R_Score >= 4 AND F_Score >= 1 AND M_Score >= 1 THEN 'New Customers'
  WHEN R_Score <= 2 AND F_Score >= 3 AND M_Score >= 3 THEN 'At Risk'
  WHEN R_Score <= 2 AND F_Score <= 2 AND M_Score <= 2 THEN 'Churned/Lost'
  WHEN R_Score >= 3 AND F_Score >= 2 AND M_Score >= 2 THEN 'Potentially Loyal'
  ELSE 'Others' END"""


RFM_QUINTILE_CTES = (
    rfm_cte("identified"),
    "nn AS (SELECT count(*) AS n FROM rfm)",
    "fr AS (SELECT *, row_number() OVER (ORDER BY Frequency, CustomerID) AS frank FROM rfm)",
    f"er AS (SELECT quantile_cont(Recency, {QPROBS}) AS e FROM rfm)",
    f"em AS (SELECT quantile_cont(Monetary, {QPROBS}) AS e FROM rfm)",
    """sc AS (SELECT fr.CustomerID, Recency, Frequency, Monetary,
      CAST(6 - (1 + len(list_filter(er.e[2:5], lambda x: Recency > x))) AS INTEGER) AS R_Score,
      CAST(1 + len(list_filter([1, 2, 3, 4], lambda k: (frank - 1) * 5 > k * (n - 1))) AS INTEGER) AS F_Score,
      CAST(1 + len(list_filter(em.e[2:5], lambda x: Monetary > x)) AS INTEGER) AS M_Score
    FROM fr, er, em, nn)""",
    "sc2 AS (SELECT *, CAST(R_Score AS VARCHAR) || CAST(F_Score AS VARCHAR) || CAST(M_Score AS VARCHAR) AS RFM_Score FROM sc)",
    f"seg AS (SELECT *, {SCORE_LIST_SQL} AS Segment FROM sc2)",
)


@register("rfm_metrics", with_cleaned("SELECT * FROM rfm", rfm_cte("identified")))
def q_rfm_metrics(spark, sf):
    return rfm.rfm_metrics(cleaned(spark, sf))


@register("rfm_scores_quintile", with_cleaned("SELECT * FROM seg", *RFM_QUINTILE_CTES))
def q_rfm_scores_quintile(spark, sf):
    return rfm.rfm_scores_quintile(rfm_table(spark, sf))


@register("rfm_segment_profile", with_cleaned(f"""
SELECT Segment, count(*) AS Count, avg(Recency) AS AvgRecency, avg(Frequency) AS AvgFrequency,
       CAST(sum(CAST(round(Monetary * 10000) AS BIGINT)) AS DOUBLE) / count(*) / 10000 AS AvgMonetary,
       CAST(count(*) * 100 AS DOUBLE) / sum(count(*)) OVER () AS Share
FROM seg GROUP BY Segment""", *RFM_QUINTILE_CTES))
def q_rfm_segment_profile(spark, sf):
    return rfm.rfm_segment_profile(rfm.rfm_scores_quintile(rfm_table(spark, sf)))


def dash_score_sql(x: str) -> str:
    st = f"st_{x}"
    w_inner = (f"(CASE WHEN {st}.k > 1 THEN list_transform(range(1, {st}.k), "
               f"lambda i: i * (({st}.mx - {st}.mn) / {st}.k) + {st}.mn) ELSE [] END)")
    ue = f"list_sort(list_distinct({st}.e))"
    q_inner = f"{ue}[2:len({ue}) - 1]"
    return (f"(CASE WHEN {st}.k < 5 THEN 1 + len(list_filter({w_inner}, lambda v: {x} > v)) "
            f"ELSE 1 + len(list_filter({q_inner}, lambda v: {x} > v)) END)")


RFM_DEDUP_CTES = (
    rfm_cte("all"),
    *[f"st_{x} AS (SELECT quantile_cont({x}, {QPROBS}) AS e, count(DISTINCT {x}) AS k, "
      f"min({x}) AS mn, max({x}) AS mx FROM rfm)" for x in ("Recency", "Frequency", "Monetary")],
    f"""ds AS (SELECT CustomerID, Recency, Frequency, Monetary,
      CAST(6 - {dash_score_sql('Recency')} AS INTEGER) AS R_Score,
      CAST({dash_score_sql('Frequency')} AS INTEGER) AS F_Score,
      CAST({dash_score_sql('Monetary')} AS INTEGER) AS M_Score
    FROM rfm, st_Recency, st_Frequency, st_Monetary)""",
    f"""dseg AS (SELECT *, CAST(R_Score AS VARCHAR) || CAST(F_Score AS VARCHAR) || CAST(M_Score AS VARCHAR) AS RFM_Segment,
      {SCORE_RULES_SQL} AS Customer_Segment FROM ds)""",
    f"""segmented AS (SELECT {', '.join('c.' + c.strip() for c in CLEANED_COLS.split(','))},
      d.RFM_Segment, d.Customer_Segment FROM cleaned c LEFT JOIN dseg d ON c.CustomerID = d.CustomerID)""",
)


@register("rfm_scores_dedup", with_cleaned("SELECT * FROM dseg", *RFM_DEDUP_CTES))
def q_rfm_scores_dedup(spark, sf):
    return rfm.rfm_scores_dedup(rfm_table(spark, sf, "all"))


def segmented(spark, sf) -> DataFrame:
    """Dashboard lines with RFM segments attached (written once per session,
    as the dashboard caches its loaded frame)."""
    from tillroll.plans.materialize import written_table
    return written_table(spark, f"segmented:{sf}", lambda: with_segments(spark, sf), sources=_inputs(sf))


def with_segments(spark, sf) -> DataFrame:
    """The same lines, read as they are stored by customer."""
    from tillroll.sources.schemas import CLEANED_COLUMNS, SEGMENT_COLUMNS
    return rfm.attach_segments(cleaned_by_customer(spark, sf), metrics=rfm_table(spark, sf, "all")).select(*CLEANED_COLUMNS, *SEGMENT_COLUMNS)


def rfm_table(spark, sf, scope: str = "identified") -> DataFrame:
    """Per-customer RFM metrics (one row per customer), written once."""
    from tillroll.plans.materialize import written_table
    return written_table(spark, f"rfm-{scope}:{sf}",
                         lambda: rfm.rfm_metrics(cleaned(spark, sf), snapshot_scope=scope), sources=_inputs(sf))


@register("attach_segments", with_cleaned("SELECT * FROM segmented", *RFM_DEDUP_CTES))
def q_attach_segments(spark, sf):
    return segmented(spark, sf)


@register("segment_distribution", with_cleaned(f"""
SELECT Customer_Segment, count(DISTINCT CustomerID) AS Count,
       CAST(count(DISTINCT CustomerID) * 100 AS DOUBLE) / sum(count(DISTINCT CustomerID)) OVER () AS Percentage
FROM segmented WHERE {IDENT} AND Customer_Segment IS NOT NULL GROUP BY Customer_Segment""", *RFM_DEDUP_CTES))
def q_segment_distribution(spark, sf):
    return rfm.segment_distribution(segmented(spark, sf))


# ================================================================== cohort ===

def cohort_ctes(src: str = "cleaned") -> tuple[str, ...]:
    return (
        f"cm AS (SELECT DISTINCT CustomerID, CAST(date_trunc('month', InvoiceDate) AS DATE) AS Period "
        f"FROM {src} WHERE {IDENT})",
        "cg AS (SELECT *, min(Period) OVER (PARTITION BY CustomerID) AS CohortGroup FROM cm)",
        "cp AS (SELECT CohortGroup, CAST((year(Period) - year(CohortGroup)) * 12 + month(Period) "
        "- month(CohortGroup) AS INTEGER) AS PeriodNumber, count(*) AS Customers FROM cg GROUP BY 1, 2)",
        "cr AS (SELECT *, max(CASE WHEN PeriodNumber = 0 THEN Customers END) OVER (PARTITION BY CohortGroup) "
        "AS CohortSize FROM cp)",
        "ret AS (SELECT CohortGroup, PeriodNumber, Customers, CohortSize, Customers / CohortSize AS RetentionRate FROM cr)",
    )


@register("cohort_retention", with_cleaned("SELECT * FROM ret", *cohort_ctes()))
def q_cohort_retention(spark, sf):
    return cohort.cohort_retention(cleaned(spark, sf))


@register("cohort_avg_retention", with_cleaned(f"""
SELECT PeriodNumber, {round_sig_sql('avg(RetentionRate)', 12)} AS AvgRetention, count(*) AS Cohorts
FROM ret GROUP BY PeriodNumber""", *cohort_ctes()))
def q_cohort_avg_retention(spark, sf):
    return cohort.cohort_avg_retention(cleaned(spark, sf))


COHORT_PERIODS = 84  # columns of the matrix: seven years of months


@register("cohort_matrix", with_cleaned(
    "SELECT CohortGroup, " + ", ".join(f'max(CASE WHEN PeriodNumber = {i} THEN RetentionRate END) AS "{i}"' for i in range(COHORT_PERIODS))
    + " FROM ret GROUP BY CohortGroup", *cohort_ctes()))
def q_cohort_matrix(spark, sf):
    return cohort.cohort_matrix(cohort.cohort_retention(cleaned(spark, sf)), list(range(COHORT_PERIODS)))


# Dashboard filter used by the filtered-view queries (test configuration).
VIEW_FILTER = dict(date_from="1997-01-01", date_to="1999-12-31",
                   countries=("United Kingdom", "Nation_1", "Nation_2", "Nation_3", "Nation_7"),
                   categories=("Home Decor", "Seasonal", "Other", "Bags & Accessories"))
VIEW_WHERE = ("InvoiceDate >= TIMESTAMP '1997-01-01' AND InvoiceDate < TIMESTAMP '2000-01-01' "
              "AND Country IN ('United Kingdom', 'Nation_1', 'Nation_2', 'Nation_3', 'Nation_7') "
              "AND ProductCategory IN ('Home Decor', 'Seasonal', 'Other', 'Bags & Accessories')")


@register("cohort_retention_filtered", with_cleaned(
    "SELECT * FROM ret", f"fv AS (SELECT * FROM cleaned WHERE {VIEW_WHERE})", *cohort_ctes("fv")))
def q_cohort_retention_filtered(spark, sf):
    from tillroll.operators.view import filter_sales
    return cohort.cohort_retention(filter_sales(cleaned(spark, sf), **VIEW_FILTER))


# ===================================================================== clv ===

CLV_CTES = (
    f"per AS (SELECT CustomerID, sum({U}) AS u, count(*) AS n, count(DISTINCT InvoiceNo) AS Frequency, "
    f"min(InvoiceDate) AS FirstPurchase, max(InvoiceDate) AS LastPurchase FROM cleaned WHERE {IDENT} GROUP BY CustomerID)",
    f"b AS (SELECT CustomerID, {round2_sql('u')} AS TotalRevenue, {round2_sql('u', 'n')} AS AvgOrderValue, "
    "Frequency, FirstPurchase, LastPurchase, coalesce(date_sub('day', FirstPurchase, LastPurchase), 0) AS LifespanDays FROM per)",
    "b2 AS (SELECT *, Frequency / (LifespanDays + 1) AS PurchaseFrequency FROM b)",
    "al AS (SELECT CAST(sum(CASE WHEN LifespanDays > 0 THEN LifespanDays END) AS DOUBLE) "
    "/ count(*) FILTER (WHERE LifespanDays > 0) AS a FROM b2)",
    "c AS (SELECT b2.*, CASE WHEN LifespanDays = 0 THEN a ELSE CAST(LifespanDays AS DOUBLE) END AS PredictedLifespan FROM b2, al)",
    "c2 AS (SELECT *, AvgOrderValue * PurchaseFrequency * PredictedLifespan AS CLV FROM c)",
    f"ce AS (SELECT quantile_cont(CLV, {QPROBS}) AS e FROM c2)",
    "clv AS (SELECT c2.*, ['Low Value', 'Medium-Low', 'Medium', 'Medium-High', 'High Value']"
    "[1 + len(list_filter(e[2:5], lambda x: CLV > x))] AS ValueSegment FROM c2, ce)",
)


def clv_table(spark, sf) -> DataFrame:
    """Per-customer CLV table (one row per customer), written once."""
    from tillroll.plans.materialize import written_table
    return written_table(spark, f"clv:{sf}", lambda: clv_ops.clv(cleaned(spark, sf)), sources=_inputs(sf))


@register("clv", with_cleaned("SELECT * FROM clv", *CLV_CTES))
def q_clv(spark, sf):
    return clv_table(spark, sf)


@register("clv_insights", with_cleaned(f"""
SELECT {round_sig_sql('avg(CLV)', 12)} AS avg_clv, {round_sig_sql('quantile_cont(CLV, 0.5)', 12)} AS median_clv,
       {round_sig_sql('quantile_cont(CLV, 0.9)', 12)} AS p90_clv,
       count(*) FILTER (WHERE ValueSegment = 'High Value') AS high_value_customers, count(*) AS customers
FROM clv""", *CLV_CTES))
def q_clv_insights(spark, sf):
    return clv_ops.clv_insights(clv_table(spark, sf))


@register("clv_segment_counts", with_cleaned(
    "SELECT ValueSegment, count(*) AS Customers FROM clv GROUP BY ValueSegment", *CLV_CTES))
def q_clv_segment_counts(spark, sf):
    return clv_ops.clv_segment_counts(clv_table(spark, sf))


# ================================================================ forecast ===

FC_CTES = (
    f"mm AS (SELECT Year, Month, sum({U}) AS u, count(DISTINCT InvoiceNo) AS Transactions FROM cleaned GROUP BY Year, Month)",
    "ms AS (SELECT *, make_date(Year, Month, 1) AS Date, CAST(row_number() OVER (ORDER BY Year, Month) - 1 AS INTEGER) "
    "AS MonthNumber, CAST(u AS DOUBLE) / 10000.0 AS Revenue FROM mm)",
    f"si AS (SELECT Month, {money('sum(' + U + ')')} AS Revenue, sum({U}) AS su FROM cleaned GROUP BY Month)",
    "sidx AS (SELECT Month, Revenue, CAST(su * count(*) OVER () AS DOUBLE) / CAST(sum(su) OVER () AS DOUBLE) "
    "AS SeasonalIndex FROM si)",
    "fit AS (SELECT regr_slope(Revenue, MonthNumber) AS slope, regr_intercept(Revenue, MonthNumber) AS icpt, "
    "max(MonthNumber) AS last_n, arg_max(Month, MonthNumber) AS last_m, max(Date) AS last_d FROM ms)",
    "steps AS (SELECT fit.*, i FROM fit, range(1, 7) t(i))",
    "fut AS (SELECT CAST(last_n + i AS INTEGER) AS MonthNumber, CAST(((last_m + i - 1) % 12) + 1 AS INTEGER) AS Month, "
    "slope * (last_n + i) + icpt AS trend, last_day(last_d + to_months(CAST(i AS INTEGER))) AS ForecastDate FROM steps)",
)


@register("sales_trend_fit", with_cleaned(f"""
SELECT {round_sig_sql('regr_slope(Revenue, MonthNumber)', 10)} AS slope,
       {round_sig_sql('regr_intercept(Revenue, MonthNumber)', 10)} AS intercept,
       {round_sig_sql('regr_r2(Revenue, MonthNumber)', 10)} AS r2, count(*) AS months FROM ms""", *FC_CTES))
def q_sales_trend_fit(spark, sf):
    return fc.sales_trend_fit(cleaned(spark, sf))


@register("seasonal_index", with_cleaned("SELECT Month, Revenue, SeasonalIndex FROM sidx", *FC_CTES))
def q_seasonal_index(spark, sf):
    return fc.seasonal_index(cleaned(spark, sf))


@register("forecast", with_cleaned(f"""
SELECT fut.MonthNumber, fut.Month, ForecastDate, {round_sig_sql('trend * SeasonalIndex', 10)} AS ForecastRevenue
FROM fut LEFT JOIN sidx ON fut.Month = sidx.Month""", *FC_CTES))
def q_forecast(spark, sf):
    return fc.forecast(cleaned(spark, sf))


# ================================================================== basket ===

from tillroll.operators import basket  # noqa: E402


def items_cte(item: str, src: str = "cleaned") -> str:
    return (f"ii AS (SELECT InvoiceNo, {item} AS item FROM {src} WHERE {item} IS NOT NULL AND InvoiceNo IS NOT NULL "
            f"GROUP BY InvoiceNo, {item} HAVING sum(Quantity) > 0),\n"
            f"bn AS (SELECT count(DISTINCT InvoiceNo) AS n FROM {src} WHERE {item} IS NOT NULL AND InvoiceNo IS NOT NULL)")


@register("item_support", with_cleaned("""
SELECT item, count(*) AS invoices, count(*) / n AS support FROM ii, bn GROUP BY item, n HAVING count(*) / n >= 0.01""",
    items_cte("Description")))
def q_item_support(spark, sf):
    return basket.item_support(cleaned(spark, sf), "Description", 0.01)


# Pairs on Brand with lift > 1.0, next to the Description pairs below.
PAIR_ARGS = dict(item_col="Brand", top_n=20, min_item_support=0.01, min_lift=1.0,
                 min_pair_support=0.005, label_len=30)


@register("basket_pairs", with_cleaned("""
SELECT left(a.item, 30) AS Item_A, left(b.item, 30) AS Item_B, p.cab / bn.n AS Support_AB,
       (p.cab / bn.n) / a.support AS Confidence_A_to_B, (p.cab / bn.n) / b.support AS Confidence_B_to_A,
       (p.cab / bn.n) / (a.support * b.support) AS Lift
FROM pr p JOIN tr a ON p.ia = a.item JOIN tr b ON p.ib = b.item, bn
WHERE (p.cab / bn.n) / (a.support * b.support) > 1.0 AND p.cab / bn.n >= 0.005""",
    items_cte("Brand"),
    "cnt AS (SELECT item, count(*) AS c FROM ii GROUP BY item)",
    "tr AS (SELECT item, c / n AS support, row_number() OVER (ORDER BY c / n DESC, item) AS rk "
    "FROM cnt, bn WHERE c / n >= 0.01 ORDER BY c / n DESC, item LIMIT 20)",
    "pr AS (SELECT a.item AS ia, b.item AS ib, count(*) AS cab FROM ii x JOIN tr a ON x.item = a.item "
    "JOIN ii y ON x.InvoiceNo = y.InvoiceNo JOIN tr b ON y.item = b.item WHERE a.rk < b.rk GROUP BY 1, 2)"))
def q_basket_pairs(spark, sf):
    return basket.basket_pairs(cleaned(spark, sf), **PAIR_ARGS)


# Itemsets on PType (6 product types): every length is exercised.
ITEMSET_CTES = (
    f"tx AS (SELECT InvoiceNo, list_sort(list_distinct(list(PType))) AS items FROM cleaned "
    f"WHERE {IDENT} AND PType IS NOT NULL AND InvoiceNo IS NOT NULL GROUP BY InvoiceNo)",
    "tn AS (SELECT count(*) AS n FROM tx)",
    "sub AS (SELECT list_filter(items, lambda x, i: ((m >> (i - 1)) & 1) = 1) AS s "
    "FROM (SELECT items, unnest(range(1, CAST(1 AS BIGINT) << len(items))) AS m FROM tx))",
    "fi AS (SELECT s AS items, count(*) AS freq, count(*) / n AS support FROM sub, tn GROUP BY s, n "
    "HAVING count(*) / n >= 0.01)",
)


@register("frequent_itemsets", with_cleaned(
    "SELECT array_to_string(items, ', ') AS itemset, CAST(len(items) AS INTEGER) AS length, freq, support FROM fi",
    *ITEMSET_CTES))
def q_frequent_itemsets(spark, sf):
    return basket.frequent_itemsets(cleaned(spark, sf), "PType", 0.01).drop("items")


@register("association_rules", with_cleaned("""
SELECT array_to_string(ante, ', ') AS antecedents, array_to_string(cons, ', ') AS consequents,
       antecedent_support, consequent_support, support, support / antecedent_support AS confidence,
       (support / antecedent_support) / consequent_support AS lift,
       support - antecedent_support * consequent_support AS leverage,
       CASE WHEN support / antecedent_support < 1
            THEN (1 - consequent_support) / (1 - support / antecedent_support) END AS conviction
FROM rr WHERE (support / antecedent_support) / consequent_support >= 0.5""",
    *ITEMSET_CTES,
    "sp AS (SELECT items, support, unnest(range(1, (CAST(1 AS BIGINT) << len(items)) - 1)) AS m FROM fi WHERE len(items) >= 2)",
    "sp2 AS (SELECT list_filter(items, lambda x, i: ((m >> (i - 1)) & 1) = 1) AS ante, "
    "list_filter(items, lambda x, i: ((m >> (i - 1)) & 1) = 0) AS cons, support FROM sp)",
    "rr AS (SELECT sp2.*, a.support AS antecedent_support, c.support AS consequent_support "
    "FROM sp2 JOIN fi a ON sp2.ante = a.items JOIN fi c ON sp2.cons = c.items)"))
def q_association_rules(spark, sf):
    sets = basket.frequent_itemsets(cleaned(spark, sf), "PType", 0.01)
    return basket.association_rules(sets, metric="lift", min_threshold=0.5)


# ================================================================= profile ===

from tillroll.operators import profile  # noqa: E402
from tillroll.sources.schemas import RAW_COLUMNS  # noqa: E402


def raw8(spark, sf) -> DataFrame:
    return raw_lines(spark, sf).select(*RAW_COLUMNS)


def _per_column_sql(cols, expr: str, alias: str, src: str = "raw") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {expr.format(c=c)} AS {alias} FROM {src}" for c in cols)


@register("profile_nulls", with_raw(
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
                       f"CAST(count(*) FILTER (WHERE {c} IS NULL) * 100 AS DOUBLE) / count(*) AS null_pct FROM raw"
                       for c in RAW_COLUMNS)))
def q_profile_nulls(spark, sf):
    return profile.profile_nulls(raw8(spark, sf))


@register("profile_distinct", with_raw(_per_column_sql(RAW_COLUMNS, "count(DISTINCT {c})", "distinct_count")))
def q_profile_distinct(spark, sf):
    return profile.profile_distinct(raw8(spark, sf))


NUMERIC_COLS = ("Quantity", "UnitPrice", "CustomerID")


@register("profile_numeric", with_raw(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS count, {round_sig_sql(f'avg(CAST({c} AS DOUBLE))', 12)} AS mean, "
    f"{round_sig_sql(f'stddev_samp(CAST({c} AS DOUBLE))', 12)} AS std, min(CAST({c} AS DOUBLE)) AS min, "
    f"{round_sig_sql(f'quantile_cont(CAST({c} AS DOUBLE), 0.25)', 12)} AS q25, "
    f"{round_sig_sql(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)', 12)} AS q50, "
    f"{round_sig_sql(f'quantile_cont(CAST({c} AS DOUBLE), 0.75)', 12)} AS q75, max(CAST({c} AS DOUBLE)) AS max FROM raw"
    for c in NUMERIC_COLS)))
def q_profile_numeric(spark, sf):
    return profile.profile_numeric(raw8(spark, sf), list(NUMERIC_COLS))


RAW8 = ", ".join(RAW_COLUMNS)


@register("duplicate_count", with_raw(
    f"SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicates FROM (SELECT {RAW8}, count(*) AS c FROM raw GROUP BY ALL)"))
def q_duplicate_count(spark, sf):
    return profile.duplicate_count(raw8(spark, sf))


@register("profile_date_range", with_raw("SELECT min(InvoiceDate) AS date_min, max(InvoiceDate) AS date_max FROM raw"))
def q_profile_date_range(spark, sf):
    return profile.profile_date_range(raw8(spark, sf))


def cleaned24(spark, sf) -> DataFrame:
    from tillroll.sources.schemas import CLEANED_COLUMNS
    return cleaned(spark, sf).select(*CLEANED_COLUMNS)


@register("profile_shape", with_cleaned("""
SELECT i AS initial_rows, CAST(8 AS INTEGER) AS initial_columns, f AS final_rows, CAST(24 AS INTEGER) AS final_columns,
       i - f AS rows_removed, CAST(f * 100 AS DOUBLE) / i AS retention_pct
FROM (SELECT count(*) AS i FROM raw), (SELECT count(*) AS f FROM cleaned)"""))
def q_profile_shape(spark, sf):
    return profile.profile_shape(raw8(spark, sf), cleaned24(spark, sf))


CANCEL = "coalesce(starts_with(InvoiceNo, 'C'), false)"


@register("cleaning_step_counts", with_cleaned(f"""
SELECT raw_rows, cancelled, missing_description, nonpositive_quantity, nonpositive_price, outliers_removed,
       missing_customer_id, customers_left, final_rows, CAST(cancelled * 100 AS DOUBLE) / raw_rows AS cancelled_pct
FROM (SELECT
  (SELECT count(*) FROM raw) AS raw_rows,
  (SELECT count(*) FROM raw WHERE {CANCEL}) AS cancelled,
  (SELECT count(*) FROM raw WHERE NOT {CANCEL} AND Description IS NULL) AS missing_description,
  (SELECT count(*) FROM f1 WHERE NOT (Quantity > 0)) AS nonpositive_quantity,
  (SELECT count(*) FROM f1 WHERE Quantity > 0 AND NOT (UnitPrice > 0 AND NOT isnan(UnitPrice))) AS nonpositive_price,
  (SELECT count(*) FROM f2) - (SELECT count(*) FROM f4) AS outliers_removed,
  (SELECT count(*) FROM f4 WHERE CustomerID IS NULL) AS missing_customer_id,
  (SELECT count(DISTINCT CustomerID) FROM f4) AS customers_left,
  (SELECT count(*) FROM f4) AS final_rows)"""))
def q_cleaning_step_counts(spark, sf):
    return profile.cleaning_step_counts(raw8(spark, sf))


CLEANED_LIST = [c.strip() for c in CLEANED_COLS.split(",")]


@register("quality_report", with_cleaned(f"""
SELECT i AS initial_rows, CAST(8 AS INTEGER) AS initial_columns, f AS final_rows, CAST(24 AS INTEGER) AS final_columns,
       i - f AS rows_removed, CAST(f * 100 AS DOUBLE) / i AS retention_pct, missing_values, duplicates,
       unique_customers, unique_products, countries, date_min, date_max
FROM (SELECT count(*) AS i FROM raw),
     (SELECT count(*) AS f, CAST({' + '.join(f'count(*) FILTER (WHERE {c} IS NULL)' for c in CLEANED_LIST)} AS BIGINT) AS missing_values,
             count(DISTINCT CustomerID) AS unique_customers, count(DISTINCT StockCode) AS unique_products,
             count(DISTINCT Country) AS countries, min(InvoiceDate) AS date_min, max(InvoiceDate) AS date_max FROM cleaned),
     (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicates FROM (SELECT {CLEANED_COLS}, count(*) AS c FROM cleaned GROUP BY ALL))"""))
def q_quality_report(spark, sf):
    return profile.quality_report(raw8(spark, sf), cleaned24(spark, sf))


@register("histogram", with_cleaned("""
SELECT bin, mn + (bin - 1) * ((mx - mn) / 50) AS bin_start, mn + bin * ((mx - mn) / 50) AS bin_end, count(*) AS count
FROM (SELECT CASE WHEN mx = mn THEN 1 ELSE least(CAST(floor((TotalAmount - mn) / (mx - mn) * 50) AS INTEGER) + 1, 50) END AS bin,
             mn, mx FROM pm, (SELECT min(TotalAmount) AS mn, max(TotalAmount) AS mx FROM pm))
GROUP BY bin, mn, mx""", PRODUCT_METRICS_CTE))
def q_histogram(spark, sf):
    from tillroll.operators.binning import equal_width_histogram
    return equal_width_histogram(dims.product_metrics(cleaned(spark, sf)), "TotalAmount", 50)


@register("recency_histogram", with_cleaned("""
SELECT bin, mn + (bin - 1) * ((mx - mn) / 50) AS bin_start, mn + bin * ((mx - mn) / 50) AS bin_end, count(*) AS count
FROM (SELECT CASE WHEN mx = mn THEN 1 ELSE least(CAST(floor((r - mn) / (mx - mn) * 50) AS INTEGER) + 1, 50) END AS bin, mn, mx
      FROM (SELECT CAST(Recency AS DOUBLE) AS r FROM rfm),
           (SELECT min(CAST(Recency AS DOUBLE)) AS mn, max(CAST(Recency AS DOUBLE)) AS mx FROM rfm))
GROUP BY bin, mn, mx""", rfm_cte("identified")))
def q_recency_histogram(spark, sf):
    from tillroll.operators.binning import equal_width_histogram
    return equal_width_histogram(rfm_table(spark, sf), "Recency", 50)


@register("clv_histogram", with_cleaned("""
SELECT bin, mn + (bin - 1) * ((mx - mn) / 50) AS bin_start, mn + bin * ((mx - mn) / 50) AS bin_end, count(*) AS count
FROM (SELECT CASE WHEN mx = mn THEN 1 ELSE least(CAST(floor((CLV - mn) / (mx - mn) * 50) AS INTEGER) + 1, 50) END AS bin,
             mn, mx FROM clv, (SELECT min(CLV) AS mn, max(CLV) AS mx FROM clv) WHERE CLV IS NOT NULL)
GROUP BY bin, mn, mx""", *CLV_CTES))
def q_clv_histogram(spark, sf):
    from tillroll.operators.binning import equal_width_histogram
    return equal_width_histogram(clv_table(spark, sf), "CLV", 50)


# ==================================================================== view ===

from tillroll.operators import view  # noqa: E402


@register("filter_sales", with_cleaned(f"SELECT {CLEANED_COLS} FROM cleaned WHERE {VIEW_WHERE}"))
def q_filter_sales(spark, sf):
    return view.filter_sales(cleaned24(spark, sf), **VIEW_FILTER)


def kpi_sql(where: str = "TRUE", sfx: str = "") -> str:
    """KPI expressions over rows satisfying ``where`` (aggregate context)."""
    units = f"coalesce(sum({U}) FILTER (WHERE {where}), 0)"
    rev = money(units)
    trans = f"count(DISTINCT InvoiceNo) FILTER (WHERE {where})"
    cust = f"count(DISTINCT CASE WHEN {IDENT} THEN CustomerID END) FILTER (WHERE {where})"
    prod = f"count(DISTINCT StockCode) FILTER (WHERE {where})"
    ctx = f"count(*) FILTER (WHERE ({where}) AND {IDENT})"
    return (f"{rev} AS total_revenue{sfx}, {trans} AS total_transactions{sfx}, {cust} AS total_customers{sfx}, "
            f"{prod} AS total_products{sfx}, coalesce({rev} / NULLIF({trans}, 0), 0.0) AS avg_order_value{sfx}, "
            f"coalesce({rev} / NULLIF({cust}, 0), 0.0) AS revenue_per_customer{sfx}, "
            f"{ctx} AS customer_transactions{sfx}, "
            f"coalesce(CAST({ctx} AS DOUBLE) / NULLIF({cust}, 0), 0.0) AS avg_orders_per_customer{sfx}")


@register("kpis", with_cleaned(f"SELECT {kpi_sql()} FROM cleaned"))
def q_kpis(spark, sf):
    return view.kpis(cleaned(spark, sf))


DELTA_SEGMENT = "Champions"


@register("kpi_deltas", with_cleaned(f"""
SELECT total_revenue_f, total_transactions_f, total_customers_f, avg_order_value_f, total_products_f,
       CASE WHEN total_revenue > 0 THEN (total_revenue_f / total_revenue - 1) * 100 ELSE 0.0 END AS revenue_change_pct,
       total_transactions_f - total_transactions AS transactions_change,
       total_customers_f - total_customers AS customers_change,
       CASE WHEN avg_order_value > 0 THEN (avg_order_value_f / avg_order_value - 1) * 100 ELSE 0.0 END AS aov_change_pct,
       total_products_f - total_products AS products_change
FROM (SELECT {kpi_sql()}, {kpi_sql(VIEW_WHERE + f" AND Customer_Segment = '{DELTA_SEGMENT}'", '_f')} FROM segmented)""",
    *RFM_DEDUP_CTES))
def q_kpi_deltas(spark, sf):
    seg = segmented(spark, sf)
    pred = view.sales_predicate(**VIEW_FILTER, segment=DELTA_SEGMENT, columns=seg.columns)
    return view.kpi_deltas(seg, pred)


@register("filter_domains", with_cleaned("""
SELECT domain, value FROM (
  SELECT DISTINCT 'Country' AS domain, Country AS value FROM segmented WHERE Country IS NOT NULL
  UNION SELECT DISTINCT 'ProductCategory', ProductCategory FROM segmented WHERE ProductCategory IS NOT NULL
  UNION SELECT DISTINCT 'Customer_Segment', Customer_Segment FROM segmented WHERE Customer_Segment IS NOT NULL
  UNION ALL SELECT 'min_date', strftime(min(CAST(InvoiceDate AS DATE)), '%Y-%m-%d') FROM segmented
  UNION ALL SELECT 'max_date', strftime(max(CAST(InvoiceDate AS DATE)), '%Y-%m-%d') FROM segmented)""",
    *RFM_DEDUP_CTES))
def q_filter_domains(spark, sf):
    return view.filter_domains(segmented(spark, sf))


@register("kpi_summary_report", with_cleaned(f"""
SELECT * FROM (
  SELECT 1 AS Position, 'Total Revenue' AS Metric, '£' || format('{{:,.2f}}', total_revenue) AS Value FROM k
  UNION ALL SELECT 2, 'Total Transactions', format('{{:,}}', total_transactions) FROM k
  UNION ALL SELECT 3, 'Unique Customers', format('{{:,}}', total_customers) FROM k
  UNION ALL SELECT 4, 'Avg Order Value', '£' || printf('%.2f', avg_order_value) FROM k
  UNION ALL SELECT 5, 'Products Sold', format('{{:,}}', total_products) FROM k)""",
    f"k AS (SELECT {kpi_sql()} FROM cleaned WHERE {VIEW_WHERE})"))
def q_kpi_summary_report(spark, sf):
    return view.kpi_summary_report(view.filter_sales(cleaned(spark, sf), **VIEW_FILTER))


@register("sample_rows", with_cleaned(
    f"SELECT {CLEANED_COLS} FROM cleaned WHERE {VIEW_WHERE} "
    "ORDER BY InvoiceNo NULLS FIRST, StockCode NULLS FIRST, Quantity, UnitPrice, InvoiceDate LIMIT 100"))
def q_sample_rows(spark, sf):
    return view.sample_rows(view.filter_sales(cleaned24(spark, sf), **VIEW_FILTER), 100)


@register("export_filtered", with_cleaned(f"SELECT {CLEANED_COLS} FROM cleaned WHERE {VIEW_WHERE}"))
def q_export_filtered(spark, sf):
    from tillroll.session import scratch_dir
    filtered = view.filter_sales(cleaned24(spark, sf), **VIEW_FILTER)
    path = scratch_dir(spark, "export")
    view.export_csv(filtered, path)
    return view.read_export_csv(spark, path, filtered.schema)


# ========================================================= cleaning steps ===

RAW_SEL = ", ".join(RAW_COLUMNS)


@register("drop_cancelled", with_raw(f"SELECT {RAW_SEL} FROM raw WHERE NOT {CANCEL}"))
def q_drop_cancelled(spark, sf):
    return cleaning.drop_cancelled(raw8(spark, sf))


@register("drop_missing_description", with_raw(f"SELECT {RAW_SEL} FROM raw WHERE Description IS NOT NULL"))
def q_drop_missing_description(spark, sf):
    return cleaning.drop_missing_description(raw8(spark, sf))


POSITIVE = "Quantity > 0 AND UnitPrice > 0 AND NOT isnan(UnitPrice)"


@register("positive_amounts", with_raw(f"SELECT {RAW_SEL} FROM raw WHERE {POSITIVE}"))
def q_positive_amounts(spark, sf):
    return cleaning.positive_amounts(raw8(spark, sf))


@register("iqr_filter", with_raw(
    f"SELECT {RAW_SEL} FROM p2, pq2 WHERE UnitPrice >= q1 - 1.5 * (q3 - q1) AND UnitPrice <= q3 + 1.5 * (q3 - q1)",
    f"p0 AS (SELECT * FROM raw WHERE {POSITIVE})",
    "pq1 AS (SELECT quantile_cont(Quantity, 0.25) AS q1, quantile_cont(Quantity, 0.75) AS q3 FROM p0)",
    "p2 AS (SELECT p0.* FROM p0, pq1 WHERE Quantity >= q1 - 1.5 * (q3 - q1) AND Quantity <= q3 + 1.5 * (q3 - q1))",
    "pq2 AS (SELECT quantile_cont(UnitPrice, 0.25) AS q1, quantile_cont(UnitPrice, 0.75) AS q3 FROM p2)"))
def q_iqr_filter(spark, sf):
    return cleaning.sequential_iqr(cleaning.positive_amounts(raw8(spark, sf)), ("Quantity", "UnitPrice"))


@register("clean_description", with_raw(
    f"SELECT DISTINCT Description, {clean_desc_sql('Description')} "
    "AS CleanDescription FROM raw WHERE Description IS NOT NULL"))
def q_clean_description(spark, sf):
    return (raw8(spark, sf).where(F.col("Description").isNotNull())
            .select("Description", tf.clean_description("Description").alias("CleanDescription")).distinct())


@register("categorize_product", with_cleaned("SELECT DISTINCT Description, ProductCategory FROM cleaned"))
def q_categorize_product(spark, sf):
    return cleaned(spark, sf).select("Description", "ProductCategory").distinct()


@register("clean_country", with_raw(
    f"SELECT DISTINCT Country, {title_sql('Country')} "
    "AS CleanCountry FROM raw"))
def q_clean_country(spark, sf):
    return raw8(spark, sf).select("Country", tf.title_case("Country").alias("CleanCountry")).distinct()


TIME_COLS = ["InvoiceDate", "Year", "Month", "Day", "Hour", "DayOfWeek", "DayName", "MonthName",
             "IsWeekend", "Season", "BusinessPeriod"]


@register("time_features", with_cleaned(f"SELECT DISTINCT {', '.join(TIME_COLS)} FROM cleaned"))
def q_time_features(spark, sf):
    return cleaned(spark, sf).select(*TIME_COLS).distinct()


INV_COLS = ["InvoiceNo", "TransactionValue", "ItemsPerTransaction", "UniqueProductsPerTransaction"]


@register("invoice_features", with_cleaned(f"SELECT DISTINCT {', '.join(INV_COLS)} FROM cleaned"))
def q_invoice_features(spark, sf):
    return cleaned(spark, sf).select(*INV_COLS).distinct()


# ========================================================= sources / sinks ===

@register("scan_raw_csv", with_raw(f"SELECT {RAW_SEL} FROM raw"))
def q_scan_raw_csv(spark, sf):
    from tillroll.session import scratch_dir
    from tillroll.sources.retail import scan_raw_csv, write_raw_csv
    path = scratch_dir(spark, "raw-csv")
    write_raw_csv(raw8(spark, sf), path)
    return scan_raw_csv(spark, path)


@register("sink_roundtrip", with_cleaned(f"SELECT {CLEANED_COLS} FROM cleaned"))
def q_sink_roundtrip(spark, sf):
    from tillroll.session import scratch_dir
    from tillroll.sources.retail import scan_cleaned, write_cleaned
    from tillroll.sources.schemas import CLEANED_COLUMNS
    path = scratch_dir(spark, "cleaned")
    write_cleaned(cleaned(spark, sf), path)
    return scan_cleaned(spark, path).select(*CLEANED_COLUMNS)


@register("forecast_total", with_cleaned(f"""
SELECT {round_sig_sql('sum(' + round_sig_sql('trend * SeasonalIndex', 10) + ')', 10)} AS ForecastTotal
FROM fut LEFT JOIN sidx ON fut.Month = sidx.Month""", *FC_CTES))
def q_forecast_total(spark, sf):
    return fc.forecast_total(cleaned(spark, sf))


@register("rfm_score_histogram", with_cleaned("""
SELECT score_type, score, count(*) AS customers FROM (
  SELECT 'R' AS score_type, R_Score AS score FROM seg
  UNION ALL SELECT 'F', F_Score FROM seg
  UNION ALL SELECT 'M', M_Score FROM seg) GROUP BY score_type, score""", *RFM_QUINTILE_CTES))
def q_rfm_score_histogram(spark, sf):
    return rfm.score_histogram(rfm.rfm_scores_quintile(rfm_table(spark, sf)))


@register("sample_customers", with_cleaned(
    "SELECT * FROM clv ORDER BY md5(concat_ws('|', '0', CAST(CustomerID AS VARCHAR))), CustomerID LIMIT 1000",
    *CLV_CTES))
def q_sample_customers(spark, sf):
    return clv_ops.sample_customers(clv_table(spark, sf), 1000, "0")


# The reference configuration of the basket operators (Description items and
# the original thresholds), next to the Brand / PType test configurations.

@register("basket_pairs_description", with_cleaned("""
SELECT left(a.item, 30) AS Item_A, left(b.item, 30) AS Item_B, p.cab / bn.n AS Support_AB,
       (p.cab / bn.n) / a.support AS Confidence_A_to_B, (p.cab / bn.n) / b.support AS Confidence_B_to_A,
       (p.cab / bn.n) / (a.support * b.support) AS Lift
FROM pr p JOIN tr a ON p.ia = a.item JOIN tr b ON p.ib = b.item, bn
WHERE (p.cab / bn.n) / (a.support * b.support) > 1.2 AND p.cab / bn.n >= 0.005""",
    items_cte("Description"),
    "cnt AS (SELECT item, count(*) AS c FROM ii GROUP BY item)",
    "tr AS (SELECT item, c / n AS support, row_number() OVER (ORDER BY c / n DESC, item) AS rk "
    "FROM cnt, bn WHERE c / n >= 0.01 ORDER BY c / n DESC, item LIMIT 20)",
    "pr AS (SELECT a.item AS ia, b.item AS ib, count(*) AS cab FROM ii x JOIN tr a ON x.item = a.item "
    "JOIN ii y ON x.InvoiceNo = y.InvoiceNo JOIN tr b ON y.item = b.item WHERE a.rk < b.rk GROUP BY 1, 2)"))
def q_basket_pairs_description(spark, sf):
    return basket.basket_pairs(cleaned(spark, sf))


DESC_ITEMSET_CTES = tuple(c.replace("PType", "Description") for c in ITEMSET_CTES)


@register("frequent_itemsets_description", with_cleaned(
    "SELECT array_to_string(items, ', ') AS itemset, CAST(len(items) AS INTEGER) AS length, freq, support FROM fi",
    *DESC_ITEMSET_CTES))
def q_frequent_itemsets_description(spark, sf):
    return basket.frequent_itemsets(cleaned(spark, sf)).drop("items")


@register("association_rules_description", ORACLE["association_rules"].replace(
    ITEMSET_CTES[0], DESC_ITEMSET_CTES[0]))
def q_association_rules_description(spark, sf):
    return basket.association_rules(basket.frequent_itemsets(cleaned(spark, sf)))


# ================================================================== cube ===

from tillroll.operators import cube as cube_ops  # noqa: E402


def cube_table(spark, sf) -> cube_ops.SalesCube:
    """The dashboard cube over the segmented lines, written once per session.  It
    reads a few of their columns a few times, so they aren't written for it."""
    return once(spark, f"cube:{sf}", lambda: cube_ops.write_cube(with_segments(spark, sf)), sources=_inputs(sf))


CUBE_FILTER = dict(VIEW_FILTER, segment=DELTA_SEGMENT)
CUBE_CTES = (*RFM_DEDUP_CTES, f"fv AS (SELECT * FROM segmented WHERE {VIEW_WHERE} AND Customer_Segment = '{DELTA_SEGMENT}')",
             f"vv AS (SELECT * FROM segmented WHERE {VIEW_WHERE})")


def cube_view(spark, sf, segment: str = DELTA_SEGMENT) -> cube_ops.SalesCube:
    """What the test configuration's filter leaves of the cube."""
    cube = cube_table(spark, sf)
    return cube.where(view.sales_predicate(**VIEW_FILTER, segment=segment, columns=cube.cells.columns))


@register("cube_kpis", with_cleaned(f"SELECT {kpi_sql()} FROM fv", *CUBE_CTES))
def q_cube_kpis(spark, sf):
    return cube_ops.kpis(cube_view(spark, sf))


@register("cube_kpi_deltas", ORACLE["kpi_deltas"])
def q_cube_kpi_deltas(spark, sf):
    cube = cube_table(spark, sf)
    return cube_ops.kpi_deltas(cube, view.sales_predicate(**CUBE_FILTER, columns=cube.cells.columns))


@register("cube_filter_domains", ORACLE["filter_domains"])
def q_cube_filter_domains(spark, sf):
    return view.filter_domains(cube_table(spark, sf).cells)


@register("cube_daily_revenue", with_cleaned(
    f"SELECT CAST(InvoiceDate AS DATE) AS Date, {msum()} AS Value FROM fv GROUP BY 1", *CUBE_CTES))
def q_cube_daily_revenue(spark, sf):
    return cube_ops.daily_revenue(cube_view(spark, sf))


@register("cube_season_summary", with_cleaned(f"""
SELECT Season, {round2_sql('u')} AS Total_Revenue, {round2_sql('u', 'n')} AS Avg_Revenue, Transaction_Count
FROM (SELECT Season, sum({U}) AS u, count(*) AS n, count(DISTINCT InvoiceNo) AS Transaction_Count
      FROM fv GROUP BY Season)""", *CUBE_CTES))
def q_cube_season_summary(spark, sf):
    return cube_ops.season_summary(cube_view(spark, sf))


@register("cube_hourly_sales", with_cleaned(f"""
SELECT Hour, {msum()} AS TotalAmount, count(DISTINCT InvoiceNo) AS Transactions FROM vv WHERE Hour IS NOT NULL GROUP BY Hour""", *CUBE_CTES))
def q_cube_hourly_sales(spark, sf):
    return cube_ops.hourly_sales(cube_view(spark, sf, "All"))


@register("cube_country_summary", with_cleaned(f"""
SELECT Country, {round2_sql('u')} AS Total_Revenue, {round2_sql('u', 'n')} AS Avg_Order_Value,
       Transaction_Count, Customer_Count
FROM (SELECT Country, sum({U}) AS u, count(*) AS n, count(DISTINCT InvoiceNo) AS Transaction_Count,
             count(DISTINCT CASE WHEN HasCustomerID THEN CustomerID END) AS Customer_Count
      FROM vv WHERE Country IS NOT NULL GROUP BY Country)""", *CUBE_CTES))
def q_cube_country_summary(spark, sf):
    return cube_ops.country_summary(cube_view(spark, sf, "All"))


@register("cube_segment_distribution", with_cleaned(f"""
SELECT Customer_Segment, count(DISTINCT CustomerID) AS Count,
       CAST(count(DISTINCT CustomerID) * 100 AS DOUBLE) / sum(count(DISTINCT CustomerID)) OVER () AS Percentage
FROM vv WHERE {IDENT} AND Customer_Segment IS NOT NULL GROUP BY Customer_Segment""", *CUBE_CTES))
def q_cube_segment_distribution(spark, sf):
    return cube_ops.segment_distribution(cube_view(spark, sf, "All"))


@register("cube_home_market_share", ORACLE["home_market_share"])
def q_cube_home_market_share(spark, sf):
    return cube_ops.home_market_share(cube_table(spark, sf))


@register("cube_temporal_peaks", ORACLE["temporal_peaks"])
def q_cube_temporal_peaks(spark, sf):
    return cube_ops.temporal_peaks(cube_table(spark, sf))


# ================================================================== jobs ===

#: Tables of the composite jobs and the query whose SQL says the same.
ANALYSIS_TABLES = {
    "monthly_trends": "monthly_sales", "monthly_insights": "monthly_insights", "rfm_analysis": "rfm_scores_quintile",
    "rfm_segment_profile": "rfm_segment_profile", "recency_histogram": "recency_histogram", "product_metrics": "product_metrics",
    "category_performance": "category_performance", "product_insights": "product_insights", "seasonal_data": "season_sales",
    "dow_data": "dow_sales", "hourly_data": "hourly_sales", "period_data": "period_sales", "temporal_peaks": "temporal_peaks",
    "country_metrics": "country_metrics", "geographic_insights": "home_market_share", "executive_summary": "kpis"}
BUSINESS_TABLES = {
    "cohort_analysis": "cohort_retention", "cohort_avg_retention": "cohort_avg_retention", "market_basket": "basket_pairs_description",
    "clv_analysis": "clv", "clv_insights": "clv_insights", "sales_forecast": "forecast", "trend_fit": "sales_trend_fit"}


def _job_sql(tables: dict[str, str]) -> str:
    return "\nUNION ALL ".join(f"SELECT '{t}' AS job_table, count(*) AS row_count FROM ({ORACLE[q]})" for t, q in tables.items())


def _job_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """A row per table of a job: its name and number of rows."""
    from functools import reduce
    return reduce(DataFrame.unionByName, [t.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("job_table"), "row_count")
                                          for name, t in tables.items()])


@register("analysis_job", _job_sql(ANALYSIS_TABLES))
def q_analysis_job(spark, sf):
    from tillroll.plans import reports
    return _job_rows(reports.analysis_report(cleaned(spark, sf)))


@register("business_job", _job_sql(BUSINESS_TABLES))
def q_business_job(spark, sf):
    from tillroll.plans import reports
    return _job_rows(reports.business_report(cleaned(spark, sf)))
