"""Exact order statistics by radix selection.

Values at given ranks are found without sorting or moving rows.  A scan counts
rows by a digit of their value, combined map-side, so a few thousand counts
per column are all that is shuffled.  The running counts show which digits hold
a wanted rank; the next scan divides only those, by a digit relative to their
smallest and largest value, and so on until a digit holds one distinct value.
All columns and ranks go in the same scans.

The first digit is the sign and a sixteenth of an octave of the magnitude
(``floor(log2|x| * 16)``), later ones are ``floor((x - lo) / (hi - lo) * 4096)``.
Each step of either is monotone also after rounding, so a digit's order is the
values' order; and the smallest and largest value of a digit never share the
next one, so every scan makes progress.  Prices in cents and counts need two
scans, whatever the size of the table.

Integral columns are compared as longs, exactly; others as doubles, where NaN
is above every number and -0.0 equals 0.0.  Nulls are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OCTAVE = 16
_PARTS = 4096
_ZERO, _TOP, _NAN = 0, 1 << 20, 1 << 21
_INTEGRAL = {"tinyint", "smallint", "int", "bigint"}


class Found(NamedTuple):
    value: float | int
    below: int  # rows with a smaller value


class Selection(NamedTuple):
    n: int  # rows with a value
    least: float | int | None
    greatest: float | int | None
    digits: int  # a lower bound of the number of distinct values
    at: dict[int, Found]  # by rank, from 0


class _Part(NamedTuple):
    """A digit that holds wanted ranks."""

    lo: float | int
    hi: float | int
    below: int
    ranks: list[int]


def _first_digit(x: Column) -> Column:
    magnitude = F.floor(F.log2(F.abs(x.cast("double"))) * _OCTAVE) + 1100 * _OCTAVE
    sized = F.when(x > 0, magnitude).otherwise(-magnitude)
    d = x.cast("double")
    return (F.when(F.isnan(d), F.lit(_NAN)).when(d == float("inf"), F.lit(_TOP)).when(d == float("-inf"), F.lit(-_TOP))
             .when(x == 0, F.lit(_ZERO)).otherwise(sized)).cast("bigint")


def _next_digit(x: Column, parts: Sequence[_Part], integral: bool) -> tuple[Column, Column]:
    """The part a value is in (null: none) and its digit there."""
    value = (lambda v: F.lit(v).cast("bigint")) if integral else F.lit
    part, digit = F.lit(None).cast("int"), F.lit(None).cast("bigint")
    for j, p in enumerate(parts):
        inside = (x >= value(p.lo)) & (x <= value(p.hi))
        place = F.floor((x - value(p.lo)).cast("double") / F.lit(float(p.hi - p.lo)) * _PARTS).cast("bigint")
        part, digit = F.when(inside, F.lit(j)).otherwise(part), F.when(inside, F.least(place, F.lit(_PARTS - 1))).otherwise(digit)
    return part, digit


def _counts(df: DataFrame, cells: Sequence[tuple[Column, Column, Column, bool]]) -> list:
    """Rows (column, part, digit, n, lo, hi) of the values that are in a part."""
    fields = [F.struct(F.lit(i).alias("i"), part.cast("int").alias("part"), digit.alias("digit"), (x if whole else F.lit(None)).cast("bigint").alias("l"),
                       (F.lit(None) if whole else x).cast("double").alias("d")) for i, (x, part, digit, whole) in enumerate(cells)]
    one = df.select(F.explode(F.array(*fields)).alias("x")) if len(fields) > 1 else df.select(fields[0].alias("x"))
    got = (one.select("x.*").where("part is not null").groupBy("i", "part", "digit")
           .agg(F.count(F.lit(1)).alias("n"), F.min("l"), F.max("l"), F.min("d"), F.max("d")).collect())
    return [(i, part, digit, n, l0 if l0 is not None else d0, l1 if l1 is not None else d1) for i, part, digit, n, l0, l1, d0, d1 in got]


def _divide(digits: list[tuple], below: int, ranks: Sequence[int], found: dict[int, Found]) -> list[_Part]:
    """Wanted ranks in sorted (n, lo, hi): known ones go to ``found``, the rest
    are parts to be divided."""
    parts, todo = [], sorted(set(ranks))
    for n, lo, hi in digits:
        here = [r for r in todo if below <= r < below + n]
        if here and (lo == hi or lo != lo):
            found.update((r, Found(lo, below)) for r in here)
        elif here:
            parts.append(_Part(lo, hi, below, here))
        below += n
    return parts


def select_ranks(df: DataFrame, wanted: Mapping[str, Callable[[int], Sequence[int]]]) -> dict[str, Selection]:
    """For each column the values at the ranks (from 0, nulls left out) that
    ``wanted[column]`` names for its number of values."""
    names, types = list(wanted), dict(df.dtypes)
    whole = {c: types[c] in _INTEGRAL for c in names}
    value = {c: F.col(c).cast("bigint") if whole[c] else F.col(c).cast("double") + 0.0 for c in names}
    here = F.lit(0)
    rows = _counts(df.select(*names), [(value[c], F.when(F.col(c).isNotNull(), here), _first_digit(value[c]), whole[c]) for c in names])
    out, parts = {}, {}
    for i, c in enumerate(names):
        digits = [x[3:] for x in sorted((r for r in rows if r[0] == i), key=lambda r: r[2])]
        n = sum(d[0] for d in digits)
        out[c] = Selection(n, digits[0][1] if n else None, digits[-1][2] if n else None, len(digits), {})
        parts[c] = _divide(digits, 0, wanted[c](n) if n else [], out[c].at)
    while open_ := [c for c in names if parts[c]]:
        rows = _counts(df.select(*open_), [(value[c], *_next_digit(value[c], parts[c], whole[c]), whole[c]) for c in open_])
        for i, c in enumerate(open_):
            new = []
            for j, p in enumerate(parts[c]):
                digits = [x[3:] for x in sorted((r for r in rows if r[:2] == (i, j)), key=lambda r: r[2])]
                new += _divide(digits, p.below, p.ranks, out[c].at)
            parts[c] = new
    return out


def _ranks(n: int, probs: Sequence[float]) -> list[int]:
    return [r for p in probs for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))]


def interpolated(s: Selection, probs: Sequence[float]) -> list[float | None]:
    """Linearly interpolated quantiles (nulls without any value)."""
    if not s.n:
        return [None] * len(probs)
    out = []
    for p in probs:
        at = (s.n - 1) * p
        lo, hi = float(s.at[math.floor(at)].value), float(s.at[math.ceil(at)].value)
        frac = at - math.floor(at)
        out.append(lo if frac == 0 else lo + (hi - lo) * frac)
    return out


def select_quantiles(df: DataFrame, probs: Mapping[str, Sequence[float]]) -> dict[str, Selection]:
    """Selections that hold what ``interpolated`` needs for each column."""
    return select_ranks(df, {c: (lambda n, p=tuple(p): _ranks(n, p)) for c, p in probs.items()})


def quantiles(df: DataFrame, probs: Mapping[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """Exact, linearly interpolated quantiles of several columns at once."""
    found = select_quantiles(df, probs)
    return {c: interpolated(found[c], p) for c, p in probs.items()}
