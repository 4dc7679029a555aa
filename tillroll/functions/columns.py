"""Column expressions (JVM-side, no Python UDFs).

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --------------------------------------------------------------------------
# Fixed values that must equal the reference's (labels, keyword lists, codes).
# --------------------------------------------------------------------------

# Product category by first matching keyword group (substring match on the
# lower-cased cleaned description); no match gives "Other".
CATEGORY_RULES: list[tuple[str, list[str]]] = [
    ("Bags & Accessories", ["bag", "tote", "shopping"]),
    ("Home Decor", ["candle", "holder", "light"]),
    ("Seasonal", ["christmas", "xmas", "decoration"]),
    ("Vintage & Crafts", ["vintage", "antique", "craft"]),
    ("Kitchen & Dining", ["kitchen", "cup", "mug", "plate"]),
    ("Garden & Outdoor", ["garden", "outdoor", "plant"]),
]
DEFAULT_CATEGORY = "Other"

# Seasons by calendar month; any other month is "Autumn".
SEASON_MONTHS: list[tuple[str, list[int]]] = [
    ("Winter", [12, 1, 2]),
    ("Spring", [3, 4, 5]),
    ("Summer", [6, 7, 8]),
]
DEFAULT_SEASON = "Autumn"

# Business periods by hour, half-open [start, end); other hours are "Night".
BUSINESS_PERIODS: list[tuple[str, int, int]] = [
    ("Morning", 6, 12),
    ("Afternoon", 12, 18),
    ("Evening", 18, 22),
]
DEFAULT_PERIOD = "Night"

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August",
          "September", "October", "November", "December"]

# RFM score codes (R, F, M digits) per segment, first listed segment wins.
# "Cannot Lose Them" repeats 155/154/144, which "At Risk" already claims.
RFM_SCORE_SEGMENTS: list[tuple[str, list[str]]] = [
    ("Champions", ["555", "554", "544", "545", "454", "455", "445"]),
    ("Loyal Customers", ["543", "444", "435", "355", "354", "345", "344", "335"]),
    ("Potential Loyalists", ["553", "551", "552", "541", "542", "533", "532", "531", "452", "451"]),
    ("New Customers", ["512", "511", "422", "421", "412", "411", "311"]),
    ("At Risk", ["155", "154", "144", "214", "215", "115", "114"]),
    ("Cannot Lose Them", ["245", "155", "154", "144", "135", "125", "124"]),
]
RFM_SCORE_DEFAULT = "Others"

# Rule-based segments on (R, F, M) scores, first matching rule wins.
# Each bound is (op, value) with op one of ">=", "<=".
RFM_RULE_SEGMENTS: list[tuple[str, tuple[str, int], tuple[str, int], tuple[str, int]]] = [
    ("Champions", (">=", 4), (">=", 4), (">=", 4)),
    ("Loyal Customers", (">=", 4), (">=", 3), (">=", 3)),
    ("New Customers", (">=", 4), (">=", 1), (">=", 1)),
    ("At Risk", ("<=", 2), (">=", 3), (">=", 3)),
    ("Churned/Lost", ("<=", 2), ("<=", 2), ("<=", 2)),
    ("Potentially Loyal", (">=", 3), (">=", 2), (">=", 2)),
]
RFM_RULE_DEFAULT = "Others"

# CLV value segments, lowest quintile first.
CLV_SEGMENT_LABELS = ["Low Value", "Medium-Low", "Medium", "Medium-High", "High Value"]

HOME_MARKET = "United Kingdom"

# White space removed by the reference's strip(): every code point that
# Python's str.isspace() accepts (all lie below U+3001).
STRIP_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# The same set as a regex class body, and Python's word characters
# (letters, numbers, underscore) — Java's (?U)\w and \s differ from Python's.
WS_CLASS = "".join(f"\\x{{{ord(c):X}}}" for c in STRIP_CHARS)
WORD_CLASS = r"\p{L}\p{N}_"
# Python's title() starts a word at a cased character (Unicode Cased
# property: Lowercase, Uppercase or Titlecase) after an uncased one.
CASED_CLASS = r"\p{IsLowercase}\p{IsUppercase}\p{IsTitlecase}"

# Money is summed as exact integers of 1/10,000 currency unit.
MONEY_SCALE = 10_000


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------
# Calendar
# --------------------------------------------------------------------------

def season_of(month: str | Column) -> Column:
    m = col_(month)
    expr = None
    for name, months in SEASON_MONTHS:
        expr = (F.when if expr is None else expr.when)(m.isin(months), F.lit(name))
    return expr.otherwise(F.lit(DEFAULT_SEASON))


def business_period_of(hour: str | Column) -> Column:
    h = col_(hour)
    expr = None
    for name, lo, hi in BUSINESS_PERIODS:
        cond = (h >= lo) & (h < hi)
        expr = (F.when if expr is None else expr.when)(cond, F.lit(name))
    return expr.otherwise(F.lit(DEFAULT_PERIOD))


def weekday_monday0(ts: str | Column) -> Column:
    """Day of week with Monday = 0 ... Sunday = 6."""
    return F.weekday(col_(ts))


def day_name(ts: str | Column) -> Column:
    """Full English weekday name (array lookup, cheaper than date_format)."""
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.weekday(col_(ts)) + 1)


def month_name(ts: str | Column) -> Column:
    """Full English month name."""
    return F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(col_(ts)))


def elapsed_days(start: str | Column, end: str | Column) -> Column:
    """Whole 24-hour blocks from start to end, floored like Python's
    ``timedelta.days`` (not calendar-date changes; -1 hour gives -1)."""
    iv = col_(end) - col_(start)
    d = F.extract(F.lit("DAY"), iv)  # truncated toward zero
    floored = F.when(iv < F.make_dt_interval(d), d - 1).otherwise(d)
    return floored.cast("bigint")


def month_start(ts: str | Column) -> Column:
    """First day of the month as DATE (stays a date for TIMESTAMP_NTZ input)."""
    return F.trunc(F.to_date(col_(ts)), "MM")


def months_between_buckets(later: str | Column, earlier: str | Column) -> Column:
    """Whole calendar months between two month buckets."""
    a, b = col_(later), col_(earlier)
    return (F.year(a) - F.year(b)) * 12 + (F.month(a) - F.month(b))


# --------------------------------------------------------------------------
# Text
# --------------------------------------------------------------------------

def strip_ws(c: str | Column) -> Column:
    """Trim white space at both ends like Python's ``str.strip()`` (plain
    ``trim`` only strips U+0020); a character-set trim, no regex."""
    return F.btrim(col_(c), F.lit(STRIP_CHARS))


def clean_description(c: str | Column) -> Column:
    """strip -> upper -> non-word/non-space chars to blank -> collapse blanks.

    There is deliberately no second strip: "TEA!" becomes "TEA ".
    """
    s = F.upper(strip_ws(c))
    general = F.regexp_replace(F.regexp_replace(s, f"[^{WORD_CLASS}{WS_CLASS}]", " "), f"[{WS_CLASS}]+", " ")
    # ASCII words and single blanks only: both replacements would leave the text as it is.
    return F.when(s.rlike("^[A-Z0-9_]++(?: [A-Z0-9_]++)*+\\z"), s).otherwise(general)


def categorize(desc: str | Column, rules: Sequence[tuple[str, Sequence[str]]] = CATEGORY_RULES,
               default: str = DEFAULT_CATEGORY) -> Column:
    """First rule with a keyword contained in lower(desc)."""
    low = F.lower(col_(desc))
    expr = None
    for name, words in rules:
        cond = None
        for w in words:
            hit = low.contains(w)
            cond = hit if cond is None else (cond | hit)
        expr = (F.when if expr is None else expr.when)(cond, F.lit(name))
    return expr.otherwise(F.lit(default))


def title_case(c: str | Column) -> Column:
    """Title case that restarts after any non-letter ("guinea-bissau" ->
    "Guinea-Bissau", "3rd" -> "3Rd"), after trimming white space."""
    low = F.lower(strip_ws(c))
    runs = F.regexp_extract_all(low, F.lit(f"([{CASED_CLASS}]+|[^{CASED_CLASS}]+)"), 0)
    general = F.array_join(F.transform(runs, lambda x: F.initcap(x)), "")
    # Single blanks and words that have no letter after their first run of letters: initcap
    # gives the same result in codegen.  The ASCII form is tried first, its test costs least.
    plain = low.rlike("^[a-z]++[0-9_]*+(?: [a-z]++[0-9_]*+)*+\\z") | low.rlike(f"^[{CASED_CLASS}]+( [{CASED_CLASS}]+)*$")
    return F.when(plain, F.initcap(low)).otherwise(general)


def truncate_label(c: str | Column, n: int, ellipsis: bool = True) -> Column:
    """First n characters; with ``ellipsis`` longer values get '...' appended."""
    s = col_(c)
    if not ellipsis:
        return F.substring(s, 1, n)
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("..."))).otherwise(s)


# --------------------------------------------------------------------------
# Money and ratios
# --------------------------------------------------------------------------

def money_units(c: str | Column) -> Column:
    """Amount as an exact BIGINT count of 1/10,000 units."""
    return F.round(col_(c) * MONEY_SCALE).cast("bigint")


def units_to_money(units: str | Column) -> Column:
    return col_(units) / F.lit(float(MONEY_SCALE))


def money_sum(c: str | Column) -> Column:
    """Exact, order-independent sum of a money column (as DOUBLE).

    Summing BIGINT units keeps the aggregation in fast integer code and makes
    the result independent of partitioning, unlike a DOUBLE sum.
    """
    return units_to_money(F.sum(money_units(c)))


def half_even_div(a: str | Column, b: str | Column) -> Column:
    """round(a / b) with ties to even, exact for BIGINT a and b > 0."""
    a, b = col_(a), col_(b)
    r = F.pmod(a, b)
    q = ((a - r).cast("decimal(38,0)") / b.cast("decimal(38,0)")).cast("bigint")
    twice = r * 2
    return F.when(twice > b, q + 1).when(twice < b, q).otherwise(q + F.pmod(q, F.lit(2)))


def money_round2(units_sum: str | Column, count: str | Column | int = 1) -> Column:
    """units_sum / count rounded half-even to 2 decimals (exact decimal rule)."""
    cnt = F.lit(count) if isinstance(count, int) else col_(count)
    cents = half_even_div(col_(units_sum), cnt.cast("bigint") * (MONEY_SCALE // 100))
    return cents / F.lit(100.0)


def safe_ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is 0 (ANSI division would raise)."""
    return F.try_divide(col_(a), col_(b))


def ratio_or_zero(a: str | Column, b: str | Column) -> Column:
    """a / b, 0 where b is 0 or null (the dashboard's guarded ratios)."""
    return F.coalesce(F.try_divide(col_(a), col_(b)), F.lit(0.0))


def round_sig(c: str | Column, digits: int = 10) -> Column:
    """Round to ``digits`` significant digits (for float results that depend
    on summation order, e.g. regression fits and means of ratios)."""
    x = col_(c)
    k = F.lit(digits - 1) - F.floor(F.log10(F.abs(x))).cast("int")
    up = F.pow(F.lit(10.0), k)
    down = F.pow(F.lit(10.0), -k)
    rounded = F.when(k >= 0, F.round(x * up) / up).otherwise(F.round(x / down) * down)
    return F.when(x.isNull() | (x == 0) | F.isnan(x), x).otherwise(rounded)


# --------------------------------------------------------------------------
# Segments
# --------------------------------------------------------------------------

def segment_by_score_code(code: str | Column) -> Column:
    c = col_(code)
    expr = None
    for name, codes in RFM_SCORE_SEGMENTS:
        expr = (F.when if expr is None else expr.when)(c.isin(codes), F.lit(name))
    return expr.otherwise(F.lit(RFM_SCORE_DEFAULT))


def segment_by_rules(r: str | Column, f: str | Column, m: str | Column) -> Column:
    cols = (col_(r), col_(f), col_(m))
    expr = None
    for name, *bounds in RFM_RULE_SEGMENTS:
        cond = None
        for column, (op, v) in zip(cols, bounds):
            term = column >= v if op == ">=" else column <= v
            cond = term if cond is None else (cond & term)
        expr = (F.when if expr is None else expr.when)(cond, F.lit(name))
    return expr.otherwise(F.lit(RFM_RULE_DEFAULT))


def score_code(r: str | Column, f: str | Column, m: str | Column) -> Column:
    return F.concat(col_(r).cast("string"), col_(f).cast("string"), col_(m).cast("string"))
