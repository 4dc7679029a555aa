"""Cleaning operators: filters F1-F5, projections P1-P15, invoice features.

Each function is ``DataFrame -> DataFrame`` so a job is a ``.transform`` chain
that Catalyst fuses into scan-filter-project stages.  The two IQR fences are
the exception: each is measured by a job of its own (exact quantiles, one row)
whose result is applied as literals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll import functions as tf
from tillroll.sources.schemas import CLEANED_COLUMNS, RAW_COLUMNS
from tillroll.operators.radix import quantiles
from tillroll.plans.materialize import cut, drop_cut, partitions_for


# ---------------------------------------------------------------- filters ---

def drop_cancelled(df: DataFrame, col: str = "InvoiceNo", prefix: str = "C") -> DataFrame:
    """drop invoices whose number starts with 'C' (case-sensitive).

    A null invoice number is kept, as the reference compares the text 'nan'.
    """
    return df.where(~F.coalesce(F.col(col).cast("string").startswith(prefix), F.lit(False)))


def drop_missing_description(df: DataFrame, col: str = "Description") -> DataFrame:
    """F2."""
    return df.where(F.col(col).isNotNull())


def positive_amounts(df: DataFrame, qty: str = "Quantity", price: str = "UnitPrice") -> DataFrame:
    """F3 + F4: Quantity > 0 and UnitPrice > 0 (NaN price dropped: Spark
    orders NaN above every number)."""
    p = F.col(price)
    return df.where((F.col(qty) > 0) & (p > 0) & ~F.isnan(p))


def identified_customers(df: DataFrame) -> DataFrame:
    """lines of identified customers."""
    if "HasCustomerID" in df.columns:
        return df.where(F.col("HasCustomerID") & F.col("CustomerID").isNotNull())
    return df.where(F.col("CustomerID").isNotNull())


def iqr_fences(df: DataFrame, col: str, k: float = 1.5) -> tuple[float | None, float | None]:
    """(Q1 - k*IQR, Q3 + k*IQR) by radix selection: at most two scans of ``col``
    and the filter columns for prices and counts, no row moved."""
    q1, q3 = quantiles(df, {col: [0.25, 0.75]})[col]
    return (None, None) if q1 is None else (q1 - k * (q3 - q1), q3 + k * (q3 - q1))


def iqr_filter(df: DataFrame, col: str, k: float = 1.5) -> DataFrame:
    """keep rows with Q1-k*IQR <= col <= Q3+k*IQR (inclusive fences).

    The two fences are selected first and applied as literals: the main pass is
    then a plain filter that Parquet can push down, and later fences do not
    re-plan this lineage."""
    return _within(df, col, *iqr_fences(df, col, k))


def _within(df: DataFrame, col: str, lo: float | None, hi: float | None) -> DataFrame:
    if lo is None:  # no rows
        return df.where(F.lit(False))
    return df.where((F.col(col) >= F.lit(lo)) & (F.col(col) <= F.lit(hi)))


def sequential_iqr(df: DataFrame, cols: Sequence[str] = ("Quantity", "UnitPrice"),
                   k: float = 1.5) -> DataFrame:
    """F5 applied column after column; each fence is measured on the
    survivors of the previous one.  The scans that measure read ``cols`` alone,
    which are written first: what ``df`` filters by is read once."""
    written = measured = cut(df.select(*cols), "fenced")
    for c in cols:
        fences = iqr_fences(measured, c, k)
        df, measured = _within(df, c, *fences), _within(measured, c, *fences)
    drop_cut(written)
    return df


# ------------------------------------------------------------ projections ---

def parse_invoice_ts(df: DataFrame, col: str = "InvoiceDate", fmt: str = "M/d/yyyy H:mm",
                     lenient: bool = False) -> DataFrame:
    """Text -> TIMESTAMP_NTZ.  Strict by default (a bad value raises)."""
    dtype = dict(df.dtypes)[col]
    if dtype != "string":
        return df.withColumn(col, F.col(col).cast("timestamp_ntz"))
    if not lenient:
        return df.withColumn(col, F.to_timestamp_ntz(F.col(col), F.lit(fmt)))
    # Bad values become null.  The text is read at offset zero and counted from
    # the epoch, so that the session's time zone has no part in it.
    instant = F.try_to_timestamp(F.concat(F.col(col), F.lit(" +00:00")), F.lit(fmt + " xxx"))
    return (df.withColumn("_us", F.unix_micros(instant))
              .withColumn(col, F.expr("timestampadd(MICROSECOND, _us, TIMESTAMP_NTZ'1970-01-01 00:00:00')")).drop("_us"))


def time_features(df: DataFrame, ts: str = "InvoiceDate") -> DataFrame:
    """Year, Month, Day, Hour, DayOfWeek (Mon = 0), DayName, MonthName."""
    t = F.col(ts)
    return df.withColumns({
        "Year": F.year(t),
        "Month": F.month(t),
        "Day": F.dayofmonth(t),
        "Hour": F.hour(t),
        "DayOfWeek": tf.weekday_monday0(t),
        "DayName": tf.day_name(t),
        "MonthName": tf.month_name(t),
    })


def calendar_labels(df: DataFrame) -> DataFrame:
    """IsWeekend, Season, BusinessPeriod."""
    return df.withColumns({
        "IsWeekend": F.col("DayOfWeek").isin(5, 6),
        "Season": tf.season_of("Month"),
        "BusinessPeriod": tf.business_period_of("Hour"),
    })


def standardize_description(df: DataFrame, col: str = "Description") -> DataFrame:
    """P8-P10."""
    return df.withColumn(col, tf.clean_description(col))


def categorize_product(df: DataFrame, col: str = "Description",
                       rules=tf.CATEGORY_RULES, out: str = "ProductCategory") -> DataFrame:
    """P11."""
    return df.withColumn(out, tf.categorize(col, rules))


def line_total(df: DataFrame) -> DataFrame:
    """TotalAmount = Quantity * UnitPrice."""
    return df.withColumn("TotalAmount", F.col("Quantity") * F.col("UnitPrice"))


def customer_flags(df: DataFrame) -> DataFrame:
    """HasCustomerID and integral CustomerID (guests stay null)."""
    return df.withColumns({
        "HasCustomerID": F.col("CustomerID").isNotNull(),
        "CustomerID": F.col("CustomerID").cast("bigint"),
    })


def clean_country(df: DataFrame, col: str = "Country") -> DataFrame:
    """P15."""
    return df.withColumn(col, tf.title_case(col))


# --------------------------------------------------------- invoice features ---

def invoice_features(df: DataFrame) -> DataFrame:
    """Per-invoice value, item count and distinct products on each line.

    The lines are written by invoice (``layout.write_keyed``), so neither the
    aggregate nor the join that brings it back moves a line.  An invoice with a
    large share of all rows is spread over the buckets; lines without an invoice
    number keep null features."""
    from tillroll.plans.layout import write_keyed
    lines = write_keyed(df, "InvoiceNo", "lines-by-invoice")
    return lines.attach(lines.aggregate([
        tf.money_sum("TotalAmount").alias("TransactionValue"), F.sum("Quantity").alias("ItemsPerTransaction"),
        F.count_distinct("StockCode").alias("UniqueProductsPerTransaction")])).select(
            *df.columns, "TransactionValue", "ItemsPerTransaction", "UniqueProductsPerTransaction")


# ------------------------------------------------------------------- job ---

def kept_raw_lines(raw: DataFrame) -> DataFrame:
    """Lines that the filters keep."""
    return (raw.transform(drop_cancelled)
               .transform(parse_invoice_ts)
               .transform(drop_missing_description)
               .transform(positive_amounts)
               .transform(sequential_iqr))


def kept_lines(raw: DataFrame) -> DataFrame:
    """``kept_raw_lines`` with invoice features and customer flags."""
    # Row filters and the per-invoice join run on narrow lines first; the
    # text and calendar projections (the costly part per row) come after, so
    # they run once per surviving line.  Row-wise the result is the same as
    # the reference's step order (no step reads a column a later one changes).
    # The fenced lines are written once, by invoice.
    return (raw.transform(kept_raw_lines)
               .transform(line_total)
               .transform(invoice_features)
               .transform(customer_flags))


def described_lines(df: DataFrame) -> DataFrame:
    """``kept_lines`` with what follows from a line alone: calendar, cleaned
    texts, category."""
    return (df.transform(time_features)
              .transform(standardize_description)
              .transform(categorize_product)
              .transform(clean_country)
              .transform(calendar_labels))


def _extra(raw: DataFrame) -> list[str]:
    return [c for c in raw.columns if c not in RAW_COLUMNS]


def clean_sales(raw: DataFrame, keep_extra: bool = True, drop_duplicates: bool = False) -> DataFrame:
    """The full cleaning job (24 reference columns, plus
    any extra item columns of the input when ``keep_extra``)."""
    extra = _extra(raw) if keep_extra else []
    df = raw.transform(kept_lines).transform(described_lines)
    if drop_duplicates:
        df = df.dropDuplicates()
    return df.select(*CLEANED_COLUMNS, *extra)


TOGETHER_LINES = 4096  # an invoice of so many lines is never too large to lie together
_PER_INVOICE = ("TransactionValue", "ItemsPerTransaction", "UniqueProductsPerTransaction")


def _odd_invoices(lines: DataFrame, key: str, counted: DataFrame, total: int) -> DataFrame:
    """Per-invoice features of the invoices that don't lie together once lines are
    stored by ``key``: those with lines of several keys, or too many lines.
    ``counted`` has the number of lines by invoice and key."""
    from tillroll.plans.layout import HOT_FRACTION
    of = (counted.where(F.col("InvoiceNo").isNotNull()).groupBy("InvoiceNo")
          .agg(F.sum("_c").alias("n"), F.coalesce(F.sum(F.when(F.col(key).isNotNull(), F.col("_c"))), F.lit(0)).alias("known"),
               F.min(key).alias("lo"), F.max(key).alias("hi")))
    mixed = ((F.col("known") > 0) & (F.col("known") < F.col("n"))) | (F.col("lo") != F.col("hi"))
    odd = cut(of.where(F.coalesce(mixed, F.lit(False)) | (F.col("n") > F.lit(max(total * HOT_FRACTION, TOGETHER_LINES)))).select("InvoiceNo"), "odd-invoices")
    if odd.isEmpty():  # the lines needn't be read
        lines = lines.where(F.lit(False))
    return cut(line_total(lines.join(odd, "InvoiceNo", "left_semi")).groupBy("InvoiceNo").agg(
        tf.money_sum("TotalAmount").alias("_value"), F.sum("Quantity").alias("_items"),
        F.count_distinct("StockCode").alias("_products"), F.lit(True).alias("_odd")), "odd-invoice-features")


def write_clean_sales(raw: DataFrame, key: str, name: str, rounds: int = 1):
    """``clean_sales(raw)`` stored by ``key`` (``layout.KeyedTable``), a column
    that ``described_lines`` leaves alone: lines move before they are described.

    They move once.  An invoice mostly has one customer, so its lines meet where
    they are stored and its features are read there by a window; the features of
    other invoices are found first and come along on their lines.  Which these are,
    and which keys have many lines, is read from one count by invoice and key.
    ``rounds`` as in ``write_keyed``, for written lines."""
    from tillroll.plans.layout import SALT, write_keyed
    extra = _extra(raw)
    lines = raw.transform(kept_raw_lines).transform(customer_flags)
    with partitions_for(raw.sparkSession, raw.count()):
        counted = cut(lines.groupBy("InvoiceNo", key).agg(F.count(F.lit(1)).alias("_c")), f"{name}-invoices")
        total = counted.agg(F.sum("_c")).first()[0] or 0
        known = lines.join(_odd_invoices(lines, key, counted, total), "InvoiceNo", "left")

    usual = F.col("_odd").isNull() & F.col("InvoiceNo").isNotNull()

    def features(df: DataFrame) -> DataFrame:
        df = line_total(df)
        of = Window.partitionBy(key, SALT, "InvoiceNo")
        together = {"TransactionValue": tf.units_to_money(F.sum(tf.money_units("TotalAmount")).over(of)),
                    "ItemsPerTransaction": F.sum("Quantity").over(of),
                    "UniqueProductsPerTransaction": F.size(F.collect_set(F.when(usual, F.col("StockCode"))).over(of)).cast("bigint")}
        return df.withColumns({c: F.when(F.col("_odd"), F.col(found)).when(F.col("InvoiceNo").isNotNull(), together[c])
                               for c, found in zip(_PER_INVOICE, ("_value", "_items", "_products"), strict=True)})

    stored = write_keyed(known, key, name, together=F.when(usual, F.col("InvoiceNo")), counted=counted, rounds=rounds,
                         finish=lambda df: described_lines(features(df)).select(*CLEANED_COLUMNS, *extra, SALT))
    drop_cut(counted)
    return stored


def cleaned_from_tables(spark, sf_dir: str) -> DataFrame:
    """Cleaned lines from the driver's tables through the raw adapter."""
    from tillroll.sources.retail import retail_raw
    return clean_sales(retail_raw(spark, sf_dir))


def step_flags(raw: DataFrame) -> dict[str, Column]:
    """Cumulative per-row flags of the cleaning steps, for one-pass counters."""
    cancelled = F.coalesce(F.col("InvoiceNo").cast("string").startswith("C"), F.lit(False))
    no_desc = ~cancelled & F.col("Description").isNull()
    bad_qty = ~cancelled & ~no_desc & ~(F.col("Quantity") > 0)
    p = F.col("UnitPrice")
    bad_price = ~cancelled & ~no_desc & ~bad_qty & ~((p > 0) & ~F.isnan(p))
    return {"cancelled": cancelled, "no_desc": no_desc, "bad_qty": bad_qty, "bad_price": bad_price}
