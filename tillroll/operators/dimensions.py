"""Sales by month, day, weekday, hour, season, period, country, product and
category (A1-A16, A32-A39), top-k and Pareto share.

All revenue sums go through exact integer money units (``money_sum``), so a
result does not depend on partitioning or summation order.  Group keys that
may be null are filtered first: pandas drops null group keys.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll import functions as tf
from tillroll.operators.radix import select_ranks
from tillroll.operators.scalars import attach_one_row
from tillroll.plans.materialize import cut, partitions_for

REV_UNITS = "_rev_units"


def _rev_units() -> F.Column:
    return F.sum(tf.money_units("TotalAmount")).alias(REV_UNITS)


def _money(units: str = REV_UNITS, name: str = "TotalAmount") -> F.Column:
    return tf.units_to_money(units).alias(name)


# ----------------------------------------------------------------- time ---

def monthly_sales(df: DataFrame) -> DataFrame:
    """A1: revenue, distinct invoices and customers by (Year, Month) + Date."""
    g = (df.groupBy("Year", "Month")
           .agg(_rev_units(), F.count_distinct("InvoiceNo").alias("Transactions"),
                F.count_distinct("CustomerID").alias("UniqueCustomers")))
    return g.select("Year", "Month", _money(), "Transactions", "UniqueCustomers",
                    F.make_date("Year", "Month", F.lit(1)).alias("Date"))


def monthly_insights(df: DataFrame) -> DataFrame:
    """A2: total revenue, mean monthly revenue and the peak month (earliest
    month among equal peaks)."""
    m = df.groupBy("Year", "Month").agg(_rev_units())
    peak_key = F.struct((-F.col(REV_UNITS)).alias("neg"), "Year", "Month")
    return m.agg(
        tf.units_to_money(F.sum(REV_UNITS)).alias("total_revenue"),
        (F.sum(REV_UNITS) / F.count(F.lit(1)) / tf.MONEY_SCALE).alias("avg_monthly_revenue"),
        F.count(F.lit(1)).alias("months"),
        F.min_by(F.col("Year"), peak_key).alias("peak_year"),
        F.min_by(F.col("Month"), peak_key).alias("peak_month"),
        tf.units_to_money(F.max(REV_UNITS)).alias("peak_revenue"),
    )


def daily_revenue(df: DataFrame, date_col: str = "InvoiceDate", value_col: str = "TotalAmount") -> DataFrame:
    """Revenue per calendar date."""
    return (df.groupBy(F.to_date(date_col).alias("Date"))
              .agg(tf.money_sum(value_col).alias("Value")))


def _by_key_rev_invoices(df: DataFrame, key: str, customers: bool = False) -> DataFrame:
    aggs = [_rev_units(), F.count_distinct("InvoiceNo").alias("Transactions")]
    if customers:
        aggs.append(F.count_distinct("CustomerID").alias("UniqueCustomers"))
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)
    cols = [key, _money(), "Transactions"] + (["UniqueCustomers"] if customers else [])
    return g.select(*cols)


def season_sales(df: DataFrame) -> DataFrame:
    """A9."""
    return _by_key_rev_invoices(df, "Season", customers=True)


def hourly_sales(df: DataFrame) -> DataFrame:
    """A11."""
    return _by_key_rev_invoices(df, "Hour")


def period_sales(df: DataFrame) -> DataFrame:
    """A12."""
    return _by_key_rev_invoices(df, "BusinessPeriod")


def weekday_dim(spark: SparkSession) -> DataFrame:
    """Fixed 7-row Monday..Sunday dimension."""
    return spark.createDataFrame([(i, d) for i, d in enumerate(tf.WEEKDAYS)],
                                 "DayIndex int, DayName string")


def dow_sales(df: DataFrame) -> DataFrame:
    """A10 + J3: weekday revenue reindexed Monday..Sunday; a day without
    sales is a row with null values."""
    g = _by_key_rev_invoices(df, "DayName")
    return (F.broadcast(weekday_dim(df.sparkSession))
             .join(g, "DayName", "left")
             .select("DayIndex", "DayName", "TotalAmount", "Transactions"))


def temporal_peaks(df: DataFrame) -> DataFrame:
    """Best season, weekday, hour and business period by revenue.
    Ties go to the first key (alphabetical; weekday order for days)."""
    # One scan: at most 4 x 7 x 24 x 4 groups hold all four keys.
    return peaks_of(df.groupBy(*PEAK_KEYS).agg(_rev_units()))


PEAK_KEYS = ("Season", "DayOfWeek", "DayName", "Hour", "BusinessPeriod")


def peaks_of(g: DataFrame) -> DataFrame:
    """A13 from revenue units by ``PEAK_KEYS``."""
    parts = F.explode(F.array(*[
        F.struct(F.lit(name).alias("part"), F.col(key).cast("string").alias("value"), order.cast("string").alias("place"))
        for name, key, order in (("best_season", "Season", F.col("Season")), ("best_day", "DayName", F.col("DayOfWeek")),
                                 ("peak_hour", "Hour", F.lpad(F.col("Hour").cast("string"), 2, "0")),
                                 ("best_period", "BusinessPeriod", F.col("BusinessPeriod")))]))
    sums = (g.select(parts.alias("p"), REV_UNITS).where(F.col("p.value").isNotNull()).groupBy("p")
             .agg(F.sum(REV_UNITS).alias(REV_UNITS)).select("p.*", REV_UNITS))

    def best(name: str) -> F.Column:
        mine = F.col("part") == name
        return F.min_by(F.when(mine, F.col("value")), F.when(mine, F.struct((-F.col(REV_UNITS)).alias("n"), "place")))

    return sums.agg(best("best_season").alias("best_season"), best("best_day").alias("best_day"),
                    best("peak_hour").cast("int").alias("peak_hour"), best("best_period").alias("best_period"))


# -------------------------------------------------------------- product ---

def product_metrics(df: DataFrame) -> DataFrame:
    """Per (StockCode, Description) quantity, revenue, invoices,
    customers, revenue per invoice and quantity per invoice."""
    g = (df.where(F.col("StockCode").isNotNull() & F.col("Description").isNotNull())
           .groupBy("StockCode", "Description")
           .agg(F.sum("Quantity").alias("Quantity"), _rev_units(),
                F.count_distinct("InvoiceNo").alias("TransactionCount"),
                F.count_distinct("CustomerID").alias("UniqueCustomers")))
    rev = tf.units_to_money(REV_UNITS)
    return g.select("StockCode", "Description", "Quantity", rev.alias("TotalAmount"),
                    "TransactionCount", "UniqueCustomers",
                    tf.safe_ratio(rev, F.col("TransactionCount")).alias("AvgOrderValue"),
                    tf.safe_ratio(F.col("Quantity"), F.col("TransactionCount")).alias("AvgQuantityPerOrder"))


def top_products(df: DataFrame, by: str = "TotalAmount", n: int = 20) -> DataFrame:
    """Metrics of the n products with the largest revenue or quantity; ties
    keep key order (StockCode, Description).

    Two phases: the ranking needs one combinable sum per product, so invoices
    and customers are counted for the n winners alone (their keys, at most n
    rows, are broadcast to the lines)."""
    order = [F.desc("_by"), "StockCode", "Description"]
    total = {"TotalAmount": F.sum(tf.money_units("TotalAmount")), "Quantity": F.sum("Quantity")}[by]
    first = (df.where(F.col("StockCode").isNotNull() & F.col("Description").isNotNull())
               .groupBy("StockCode", "Description").agg(total.alias("_by")).orderBy(*order).limit(n).select("StockCode", "Description"))
    lines = df.join(F.broadcast(first), ["StockCode", "Description"], "left_semi")
    return product_metrics(lines).orderBy(F.desc(by), "StockCode", "Description")


def category_performance(df: DataFrame) -> DataFrame:
    """Per category revenue, quantity, invoices, customers, AOV; revenue
    descending.  The categories are counted at once and written (a row each), in
    as many pieces as the lines need."""
    with partitions_for(df.sparkSession, df.count()):
        g = cut(df.where(F.col("ProductCategory").isNotNull()).groupBy("ProductCategory")
                  .agg(_rev_units(), F.sum("Quantity").alias("Quantity"),
                       F.count_distinct("InvoiceNo").alias("Transactions"),
                       F.count_distinct("CustomerID").alias("UniqueCustomers")), "categories")
    rev = tf.units_to_money(REV_UNITS)
    return (g.select("ProductCategory", rev.alias("TotalAmount"), "Quantity", "Transactions",
                     "UniqueCustomers", tf.safe_ratio(rev, F.col("Transactions")).alias("AvgOrderValue"))
             .orderBy(F.desc("TotalAmount"), "ProductCategory"))


def _product_revenue(df: DataFrame) -> DataFrame:
    """Revenue units per product; rows without a full key are left out."""
    return (df.where(F.col("StockCode").isNotNull() & F.col("Description").isNotNull())
              .groupBy("StockCode", "Description").agg(_rev_units()))


def pareto_share(df: DataFrame, share: float = 0.2) -> DataFrame:
    """Revenue share of the top int(share * n) products.

    No product is numbered or sorted: radix selection finds the revenue at the
    edge of the top products, those above it count whole, and of those equal to
    it as many as are left, whichever they are.
    """
    return _pareto(_product_revenue(df), share)


def _pareto(g: DataFrame, share: float) -> DataFrame:
    units = cut(g.select(REV_UNITS), "product-units")
    total = units.count()
    top_n = math.floor(total * share)
    found = {}

    def edge_rank(n: int) -> list[int]:  # products without revenue come last
        found["taken"] = min(top_n, n)
        return [n - found["taken"]] if found["taken"] else []

    at = select_ranks(units, {REV_UNITS: edge_rank})[REV_UNITS].at
    edge = next((f.value for f in at.values()), None)
    u = F.col(REV_UNITS)
    if edge is None:
        top = F.lit(0).cast("bigint")
    else:
        top = F.coalesce(F.sum(F.when(u > edge, u)), F.lit(0)) + (F.lit(found["taken"]) - F.count_if(u > edge)) * F.lit(edge)
    sums = units.agg(F.count(F.lit(1)).alias("total_products"), top.alias("_top"), F.sum(u).alias("_tot"))
    return sums.select(
        "total_products", F.lit(top_n).cast("bigint").alias("top_n"),
        tf.units_to_money("_top").alias("top_revenue"),
        tf.units_to_money("_tot").alias("total_revenue"),
        (F.col("_top") / F.col("_tot") * 100).alias("top_share_pct"))


def product_insights(df: DataFrame) -> DataFrame:
    """Number of products, top-20% share, leading category and the
    highest-revenue product (first 50 characters)."""
    # One pass over the lines: a product belongs to one category, so the
    # categories are summed from the written product table.
    by = cut(df.groupBy("StockCode", "Description", "ProductCategory").agg(_rev_units()), "product-revenue")
    first = lambda c, *keys: F.min_by(c, F.struct((-F.col(REV_UNITS)).alias("n"), *keys))
    cat = (by.where(F.col("ProductCategory").isNotNull()).groupBy("ProductCategory").agg(F.sum(REV_UNITS).alias(REV_UNITS))
             .agg(first("ProductCategory", "ProductCategory").alias("top_category")))
    g = (by.where(F.col("StockCode").isNotNull() & F.col("Description").isNotNull())
           .groupBy("StockCode", "Description").agg(F.sum(REV_UNITS).alias(REV_UNITS)))
    prod = g.agg(first("Description", "StockCode", "Description").alias("_d"))
    head = attach_one_row(_pareto(g, 0.2).select("total_products", "top_share_pct"), cat)
    return attach_one_row(head, prod.select(tf.truncate_label("_d", 50, ellipsis=False).alias("top_product")))


def sample_products(metrics: DataFrame, n: int = 500, seed: str = "0") -> DataFrame:
    """min(n, count) products in a seeded pseudo-random order (hash of
    the key), so a sample is reproducible and each task keeps only n rows."""
    h = F.md5(F.concat_ws("|", F.lit(seed), F.col("StockCode"), F.col("Description")))
    return metrics.orderBy(h, "StockCode", "Description").limit(n)


def top_products_by_description(df: DataFrame, n: int = 15, label_len: int = 40) -> DataFrame:
    """Revenue by Description, top n, with a display label."""
    g = df.where(F.col("Description").isNotNull()).groupBy("Description").agg(_rev_units())
    return (g.orderBy(F.desc(REV_UNITS), "Description").limit(n)
             .select("Description", _money(name="TotalAmount"),
                     tf.truncate_label("Description", label_len).alias("Label")))


def category_revenue(df: DataFrame) -> DataFrame:
    """Category revenue ascending."""
    return (df.where(F.col("ProductCategory").isNotNull()).groupBy("ProductCategory").agg(_rev_units())
              .select("ProductCategory", _money())
              .orderBy("TotalAmount", "ProductCategory"))


# ------------------------------------------------------------- geography ---

def country_metrics(df: DataFrame) -> DataFrame:
    """Per country revenue, invoices, customers, quantity, revenue per
    invoice and per customer (null without identified customers)."""
    g = (df.where(F.col("Country").isNotNull()).groupBy("Country")
           .agg(_rev_units(), F.count_distinct("InvoiceNo").alias("Transactions"),
                F.count_distinct("CustomerID").alias("UniqueCustomers"),
                F.sum("Quantity").alias("Quantity")))
    rev = tf.units_to_money(REV_UNITS)
    return (g.select("Country", rev.alias("TotalAmount"), "Transactions", "UniqueCustomers", "Quantity",
                     tf.safe_ratio(rev, F.col("Transactions")).alias("AvgOrderValue"),
                     tf.safe_ratio(rev, F.col("UniqueCustomers")).alias("RevenuePerCustomer"))
             .orderBy(F.desc("TotalAmount"), "Country"))


def top_countries(df: DataFrame, n: int = 10) -> DataFrame:
    """A37."""
    return (df.where(F.col("Country").isNotNull()).groupBy("Country").agg(_rev_units())
              .orderBy(F.desc(REV_UNITS), "Country").limit(n)
              .select("Country", _money()))


def country_summary(df: DataFrame) -> DataFrame:
    """Revenue and mean line value rounded to 2, invoices, identified
    customers; revenue descending."""
    has_id = F.col("HasCustomerID") if "HasCustomerID" in df.columns else F.col("CustomerID").isNotNull()
    g = (df.where(F.col("Country").isNotNull()).groupBy("Country")
           .agg(_rev_units(), F.count(F.lit(1)).alias("_n"),
                F.count_distinct("InvoiceNo").alias("Transaction_Count"),
                F.count_distinct(F.when(has_id, F.col("CustomerID"))).alias("Customer_Count")))
    return country_summary_of(g)


def country_summary_of(g: DataFrame) -> DataFrame:
    """A36 from revenue units, lines and counts by country."""
    return (g.select("Country", tf.money_round2(REV_UNITS).alias("Total_Revenue"),
                     tf.money_round2(REV_UNITS, "_n").alias("Avg_Order_Value"),
                     "Transaction_Count", "Customer_Count")
             .orderBy(F.desc("Total_Revenue"), "Country"))


def season_summary(df: DataFrame) -> DataFrame:
    """Revenue, mean line value (both rounded to 2) and invoices by season."""
    g = (df.groupBy("Season")
           .agg(_rev_units(), F.count(F.lit(1)).alias("_n"),
                F.count_distinct("InvoiceNo").alias("Transaction_Count")))
    return season_summary_of(g)


def season_summary_of(g: DataFrame) -> DataFrame:
    """A35 from revenue units, lines and invoices by season."""
    return g.select("Season", tf.money_round2(REV_UNITS).alias("Total_Revenue"),
                    tf.money_round2(REV_UNITS, "_n").alias("Avg_Revenue"), "Transaction_Count")


def home_market_share(df: DataFrame, home: str = tf.HOME_MARKET) -> DataFrame:
    """A15 + A39: country count, home revenue share, number and share of the
    other countries, the top other country, the country of highest revenue
    per invoice and the country with most customers."""
    g = (df.where(F.col("Country").isNotNull()).groupBy("Country")
           .agg(_rev_units(), F.count_distinct("InvoiceNo").alias("_inv"),
                F.count_distinct("CustomerID").alias("_cust")))
    return home_share_of(g, home)


def home_share_of(g: DataFrame, home: str = tf.HOME_MARKET) -> DataFrame:
    """A15 + A39 from revenue units, invoices and customers by country."""
    is_home = F.col("Country") == F.lit(home)
    home_units = F.coalesce(F.sum(F.when(is_home, F.col(REV_UNITS))), F.lit(0))
    tot = F.sum(REV_UNITS)
    aov = F.col(REV_UNITS) / F.col("_inv")
    return g.agg(
        F.count(F.lit(1)).alias("countries"),
        tf.units_to_money(home_units).alias("home_revenue"),
        tf.ratio_or_zero(home_units * 100, tot).alias("home_share_pct"),
        F.count_if(~is_home).alias("other_countries"),
        (F.lit(100.0) - tf.ratio_or_zero(home_units * 100, tot)).alias("other_share_pct"),
        F.min_by(F.when(~is_home, F.col("Country")),
                 F.struct(is_home.alias("h"), (-F.col(REV_UNITS)).alias("n"), F.col("Country"))
                 ).alias("top_other_country"),
        F.min_by("Country", F.struct((-aov).alias("a"), F.col("Country"))).alias("top_aov_country"),
        F.min_by("Country", F.struct((-F.col("_cust")).alias("c"), F.col("Country"))).alias("most_customers_country"),
    )
