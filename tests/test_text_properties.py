"""Text functions equal the Python string semantics of the original
(str.strip / upper / re.sub with Python's \\w and \\s / title / in)."""

import datetime as dt
import itertools
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tillroll import functions as tf

# Latin-1 (the export's encoding) plus Unicode white space, marks, numbers,
# connector punctuation and uncased letters where Java and Python differ.
# Known, documented differences are left out: '\u00df' starting a word
# (Python title-cases it to 'Ss', Java per code point keeps it) and dotted
# capital I U+0130 (lower-cased to two code points before title-casing).
LATIN1 = [chr(c) for c in range(0x20, 0x100) if c != 0xDF]
EXTRA = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u3000\u203f\u00b2\u00bd\u0301"
         "\u01c6\u4e00\u0660_-'!., ")
ALPHABET = st.one_of(st.sampled_from(LATIN1), st.sampled_from(list(EXTRA)))
TEXTS = st.lists(st.text(alphabet=ALPHABET, max_size=25), min_size=1, max_size=40)


def py_clean(s):
    s = s.strip().upper()
    s = re.sub(r"[^\w\s]", " ", s)
    return re.sub(r"\s+", " ", s)


def py_category(s):
    d = s.lower()
    for name, words in tf.CATEGORY_RULES:
        if any(w in d for w in words):
            return name
    return tf.DEFAULT_CATEGORY


def _run(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r.o for r in df.select("i", expr("s").alias("o")).orderBy("i").collect()]


@settings(max_examples=25, deadline=None)
@given(TEXTS)
def test_clean_description_like_python(spark, values):
    assert _run(spark, values, tf.clean_description) == [py_clean(v) for v in values]


@settings(max_examples=25, deadline=None)
@given(TEXTS)
def test_title_case_like_python(spark, values):
    assert _run(spark, values, tf.title_case) == [v.strip().title() for v in values]


def test_plain_texts_like_python(spark):
    """Every short text of the kinds that the short ways of both functions take, and their neighbours."""
    values = [""] + ["".join(t) for n in range(1, 6) for t in itertools.product("aB1_ !", repeat=n)]
    values += [x + end for x in ("nation_3", "tea 1x", "x-ray", "\u00e9a") for end in ("\n", "\u2028", " ", "\u00e9", "_1 b")]
    assert _run(spark, values, tf.clean_description) == [py_clean(v) for v in values]
    assert _run(spark, values, tf.title_case) == [v.strip().title() for v in values]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abcghilmnoprstuvxyz -BCHKLMOPSTVX")), max_size=30),
                min_size=1, max_size=40))
def test_categorize_like_python(spark, values):
    assert _run(spark, values, tf.categorize) == [py_category(v) for v in values]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(min_value=-10**15, max_value=10**15), min_size=1, max_size=40),
       st.integers(min_value=1, max_value=5000))
def test_half_even_cents_like_decimal(spark, units, count):
    from decimal import ROUND_HALF_EVEN, Decimal
    df = spark.createDataFrame([(i, u) for i, u in enumerate(units)], "i int, u bigint")
    got = [r.o for r in df.select("i", tf.money_round2("u", count).alias("o")).orderBy("i").collect()]
    want = [float((Decimal(u) / Decimal(10000 * count)).quantize(Decimal("0.01"), rounding=ROUND_HALF_EVEN))
            for u in units]
    assert got == want


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.datetimes(), st.datetimes()), min_size=1, max_size=40))
def test_elapsed_days_like_timedelta(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)],
                               "i int, a timestamp_ntz, b timestamp_ntz")
    got = [r.o for r in df.select("i", tf.elapsed_days("a", "b").alias("o")).orderBy("i").collect()]
    assert got == [(b - a).days for a, b in pairs]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.datetimes(min_value=dt.datetime(1900, 1, 1), max_value=dt.datetime(2100, 12, 31)),
                min_size=2, max_size=40))
def test_calendar_features_like_python(spark, stamps):
    import calendar
    from pyspark.sql import functions as F
    from tillroll.operators.cleaning import calendar_labels, time_features
    df = spark.createDataFrame([(i, t) for i, t in enumerate(stamps)], "i int, InvoiceDate timestamp_ntz")
    out = calendar_labels(time_features(df)).withColumn("Bucket", tf.month_start("InvoiceDate"))
    out = out.withColumn("FromFirst", tf.months_between_buckets("Bucket", F.lit(stamps[0].date().replace(day=1))))
    rows = out.orderBy("i").collect()

    def season(m):
        return "Winter" if m in (12, 1, 2) else "Spring" if m in (3, 4, 5) else "Summer" if m in (6, 7, 8) else "Autumn"

    def period(h):
        return "Morning" if 6 <= h < 12 else "Afternoon" if 12 <= h < 18 else "Evening" if 18 <= h < 22 else "Night"

    first = stamps[0]
    for r, t in zip(rows, stamps):
        assert (r.Year, r.Month, r.Day, r.Hour, r.DayOfWeek) == (t.year, t.month, t.day, t.hour, t.weekday())
        assert r.DayName == calendar.day_name[t.weekday()] and r.MonthName == calendar.month_name[t.month]
        assert r.IsWeekend == (t.weekday() >= 5) and r.Season == season(t.month)
        assert r.BusinessPeriod == period(t.hour)
        assert r.Bucket == t.date().replace(day=1)
        assert r.FromFirst == (t.year - first.year) * 12 + (t.month - first.month)
