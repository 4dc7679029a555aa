"""Independent DuckDB SQL for every registered query (the correctness oracle).

The SQL re-derives the raw lines from the driver tables and re-implements the
cleaning in plain SQL, so a Spark result is checked against a second engine
end to end.  Conventions shared with the Spark side: money sums are exact
sums of 1/10,000 units, counts are BIGINT, computed columns carry the same
aliases.
"""

from __future__ import annotations

# --------------------------------------------------------------- adapter ---

RAW_CTE = r"""
raw_base AS (
  SELECT
    CASE WHEN o_orderkey % 701 = 3 THEN NULL WHEN o_orderkey % 50 = 0 THEN 'C' || CAST(o_orderkey AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) END AS InvoiceNo,
    CASE WHEN (l_orderkey + l_linenumber) % 401 <> 7 THEN 'P' || CAST(p_partkey AS VARCHAR) END AS StockCode,
    CASE WHEN p_partkey % 400 = 3 THEN NULL
         WHEN o_orderkey % 12 = 5 AND l_linenumber = 1 THEN ' tea set ' WHEN o_orderkey % 12 = 5 AND l_linenumber = 2 THEN ' tea tin '
         WHEN o_orderkey % 12 = 5 AND l_linenumber = 3 THEN ' tea towel '
         ELSE ' ' || p_name || CASE p_partkey % 8 WHEN 0 THEN ' bag' WHEN 1 THEN ' candle'
              WHEN 2 THEN ' christmas light' WHEN 3 THEN ' xmas' WHEN 4 THEN ' vintage'
              WHEN 5 THEN ', no.5!' WHEN 6 THEN '  garden' ELSE '' END || ' ' END AS Description,
    CAST(CASE WHEN o_orderkey % 50 = 0 THEN -l_quantity WHEN o_orderkey % 613 = 1 THEN -1
              WHEN o_orderkey % 211 = 0 THEN l_quantity * 100 ELSE l_quantity END AS BIGINT) AS Quantity,
    CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INTEGER))
      + to_minutes(CAST((o_orderkey * 7) % 60 AS INTEGER)) AS InvoiceDate,
    CASE WHEN (l_orderkey + l_linenumber) % 307 = 0 THEN CAST(0.0 AS DOUBLE)
         WHEN p_partkey % 40 = 7 THEN p_retailprice * 10 ELSE p_retailprice END AS UnitPrice,
    CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS CustomerID,
    CASE WHEN o_orderkey % 97 = 5 THEN NULL WHEN n_nationkey = 0 THEN ' united kingdom ' ELSE n_name END AS Country,
    p_brand AS Brand, p_type AS PType, o_orderkey AS okey_
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey),
raw AS (
  SELECT * EXCLUDE (okey_) FROM raw_base
  UNION ALL SELECT * EXCLUDE (okey_) FROM raw_base WHERE okey_ % 500 = 1)"""

STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def clean_desc_sql(x: str) -> str:
    s = f"upper({STRIP.format(x=x)})"
    s = rf"regexp_replace({s}, '[^\w\s]', ' ', 'g')"
    return rf"regexp_replace({s}, '\s+', ' ', 'g')"


def title_sql(x: str) -> str:
    return (rf"array_to_string(list_transform(regexp_extract_all(lower({STRIP.format(x=x)}), "
            rf"'(\p{{L}}+|\P{{L}}+)'), lambda t: upper(t[1]) || t[2:]), '')")


CATEGORY_SQL = """CASE
  WHEN contains(lower(Description), 'bag') OR contains(lower(Description), 'tote') OR contains(lower(Description), 'shopping') THEN 'Bags & Accessories'
  WHEN contains(lower(Description), 'candle') OR contains(lower(Description), 'holder') OR contains(lower(Description), 'light') THEN 'Home Decor'
  WHEN contains(lower(Description), 'christmas') OR contains(lower(Description), 'xmas') OR contains(lower(Description), 'decoration') THEN 'Seasonal'
  WHEN contains(lower(Description), 'vintage') OR contains(lower(Description), 'antique') OR contains(lower(Description), 'craft') THEN 'Vintage & Crafts'
  WHEN contains(lower(Description), 'kitchen') OR contains(lower(Description), 'cup') OR contains(lower(Description), 'mug') OR contains(lower(Description), 'plate') THEN 'Kitchen & Dining'
  WHEN contains(lower(Description), 'garden') OR contains(lower(Description), 'outdoor') OR contains(lower(Description), 'plant') THEN 'Garden & Outdoor'
  ELSE 'Other' END"""

SEASON_SQL = """CASE WHEN month(InvoiceDate) IN (12, 1, 2) THEN 'Winter' WHEN month(InvoiceDate) IN (3, 4, 5) THEN 'Spring'
  WHEN month(InvoiceDate) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END"""

PERIOD_SQL = """CASE WHEN hour(InvoiceDate) >= 6 AND hour(InvoiceDate) < 12 THEN 'Morning'
  WHEN hour(InvoiceDate) >= 12 AND hour(InvoiceDate) < 18 THEN 'Afternoon'
  WHEN hour(InvoiceDate) >= 18 AND hour(InvoiceDate) < 22 THEN 'Evening' ELSE 'Night' END"""

# Money: exact BIGINT units of 1/10,000.
U = "CAST(round(TotalAmount * 10000) AS BIGINT)"


def money(units_expr: str) -> str:
    return f"(CAST({units_expr} AS DOUBLE) / 10000.0)"


def msum(col: str = "TotalAmount") -> str:
    return money(f"sum(CAST(round({col} * 10000) AS BIGINT))")


FILTERED_CTE = rf"""
f1 AS (SELECT * FROM raw WHERE NOT coalesce(starts_with(InvoiceNo, 'C'), false) AND Description IS NOT NULL),
f2 AS (SELECT * REPLACE ({clean_desc_sql('Description')} AS Description) FROM f1
       WHERE Quantity > 0 AND UnitPrice > 0 AND NOT isnan(UnitPrice)),
qf AS (SELECT quantile_cont(Quantity, 0.25) AS q1, quantile_cont(Quantity, 0.75) AS q3 FROM f2),
f3 AS (SELECT f2.* FROM f2, qf WHERE Quantity >= q1 - 1.5 * (q3 - q1) AND Quantity <= q3 + 1.5 * (q3 - q1)),
pf AS (SELECT quantile_cont(UnitPrice, 0.25) AS q1, quantile_cont(UnitPrice, 0.75) AS q3 FROM f3),
f4 AS (SELECT f3.* FROM f3, pf WHERE UnitPrice >= q1 - 1.5 * (q3 - q1) AND UnitPrice <= q3 + 1.5 * (q3 - q1))"""

CLEANED_CTE = rf"""
inv AS (SELECT InvoiceNo,
          {money('sum(CAST(round(Quantity * UnitPrice * 10000) AS BIGINT))')} AS TransactionValue,
          CAST(sum(Quantity) AS BIGINT) AS ItemsPerTransaction,
          count(DISTINCT StockCode) AS UniqueProductsPerTransaction
        FROM f4 GROUP BY InvoiceNo),
cleaned AS (
  SELECT f4.InvoiceNo, StockCode, Description, Quantity, InvoiceDate, UnitPrice,
    CAST(CustomerID AS BIGINT) AS CustomerID,
    {title_sql('Country')} AS Country,
    CAST(year(InvoiceDate) AS INTEGER) AS Year, CAST(month(InvoiceDate) AS INTEGER) AS Month,
    CAST(day(InvoiceDate) AS INTEGER) AS Day, CAST(hour(InvoiceDate) AS INTEGER) AS Hour,
    CAST(isodow(InvoiceDate) - 1 AS INTEGER) AS DayOfWeek,
    dayname(InvoiceDate) AS DayName, monthname(InvoiceDate) AS MonthName,
    {CATEGORY_SQL} AS ProductCategory,
    Quantity * UnitPrice AS TotalAmount,
    CustomerID IS NOT NULL AS HasCustomerID,
    TransactionValue, ItemsPerTransaction, UniqueProductsPerTransaction,
    (isodow(InvoiceDate) - 1) IN (5, 6) AS IsWeekend,
    {SEASON_SQL} AS Season,
    {PERIOD_SQL} AS BusinessPeriod,
    Brand, PType
  FROM f4 LEFT JOIN inv ON f4.InvoiceNo = inv.InvoiceNo)"""

CLEANED_COLS = ("InvoiceNo, StockCode, Description, Quantity, InvoiceDate, UnitPrice, CustomerID, Country, "
                "Year, Month, Day, Hour, DayOfWeek, DayName, MonthName, ProductCategory, TotalAmount, "
                "HasCustomerID, TransactionValue, ItemsPerTransaction, UniqueProductsPerTransaction, "
                "IsWeekend, Season, BusinessPeriod")


def with_raw(body: str, *ctes: str) -> str:
    extra = "".join("," + c for c in ctes)
    return f"WITH {RAW_CTE}{extra}\n{body}"


def with_cleaned(body: str, *ctes: str) -> str:
    extra = "".join("," + c for c in ctes)
    return f"WITH {RAW_CTE},{FILTERED_CTE},{CLEANED_CTE}{extra}\n{body}"
