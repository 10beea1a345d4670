"""Numbers and dates: bounds, bands and tolerant parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def num(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Bounded; null stays null, which greatest() and least() alone would pass over."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def between(x: Column, best: float, worst: float) -> Column:
    """1 at ``best``, 0 at ``worst``, linear between and clamped outside."""
    return clamp((x - worst) / (best - worst)) if best != worst else F.lit(1.0)


def or_default(x: Column, default: float) -> Column:
    """``default`` where ``x`` is null or zero."""
    return F.coalesce(F.nullif(x.cast("double"), F.lit(0.0)), F.lit(float(default)))


def round_half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def round_exact(x: Column, digits: int) -> Column:
    """Rounded by the exact binary value, halves to even, as ``round`` of a Python float.

    ``x`` times the power of ten is taken as a sum of two doubles, p and its error e (Veltkamp's
    split, Dekker's product), so whether it is above the middle between two integers is exact.
    """
    scale = float(10**digits)
    high = scale * 134217729.0 - (scale * 134217729.0 - scale)
    low = scale - high

    def rounded(v: Column) -> Column:
        p, c = v * scale, v * 134217729.0
        vh = c - (c - v)
        vl = v - vh
        e = ((vh * high - p) + vh * low + vl * high) + vl * low
        n = F.floor(p).cast("double")
        above = ((p - n) - 0.5) + e
        whole = F.when(above > 0, n + 1).when(above < 0, n).otherwise(n + F.abs(n % 2))
        return F.when(F.abs(p) < 2.0**52, whole / scale).otherwise(v)

    return F.get(F.transform(F.array(x.cast("double")), rounded), F.lit(0))  # x is evaluated once


def parse_date(text: Column) -> Column:
    """A date from Y-m-d, Y-m or Y in the first ten characters, else null."""
    s = F.substring(F.trim(text), 1, 10)
    return F.coalesce(*[F.try_to_date(s, f) for f in ("yyyy-M-d", "yyyy-M", "yyyy")])


def whole(x: Column) -> Column:
    """A number as text without decimals, halves to even."""
    return F.bround(x, 0).cast("int").cast("string")


def fixed(x: Column, digits: int) -> Column:
    """A number as text with ``digits`` decimals."""
    return F.format_string(f"%.{digits}f", round_exact(x, digits))


def python_title(text: Column) -> Column:
    """Upper case for each letter that follows no letter, lower case for the others."""
    parts = F.regexp_extract_all(text, F.lit(r"[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 20)))), "")
