"""Shared column expressions. All are JVM-side (no Python per row).

Decimal rule: money, ratings and durations are exact decimals; a quotient is taken on
operands narrowed to ``decimal(20, s)`` so Spark keeps 12-24 fraction digits before the
final HALF_UP rounding (wide ``decimal(38, s)`` operands would cut the quotient to 6
digits and round twice).
"""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str, places: int, *, num_scale: int = 0,
          den_scale: int = 0, precision: int = 38) -> Column:
    """``num / den`` rounded half away from zero to ``places`` as ``decimal(precision, places)``.

    Division by zero raises (ANSI), as the dialect the reports were written for does.
    """
    q = col(num).cast(f"decimal(20,{num_scale})") / col(den).cast(f"decimal(20,{den_scale})")
    return F.round(q, places).cast(f"decimal({precision},{places})")


def mean(total: Column | str, count: Column | str, *, scale: int = 2, places: int = 6) -> Column:
    """Mean from a pre-aggregated sum and count: the value ``avg`` gives, NULL for no rows."""
    return F.when(col(count) > 0, ratio(total, count, places, num_scale=scale, precision=22 if places == 6 else 38))


def band(value: Column | str, low: float, high: float, labels: Sequence[str]) -> Column:
    """Three-way band: ``< low``, ``between low and high`` (inclusive), else (NULL included)."""
    v = col(value)
    return (F.when(v < low, F.lit(labels[0]))
            .when(v.between(low, high), F.lit(labels[1]))
            .otherwise(F.lit(labels[2])))


def percent_text(value: Column | str) -> Column:
    """Percent to two places as text with a trailing ``%`` (sign kept, no padding)."""
    return F.concat(col(value).cast("decimal(38,2)").cast("string"), F.lit("%"))


def joined_text(*parts: Column | str) -> Column:
    """Concatenation where a NULL part reads as empty text (the dialect's ``||``).

    Strings are column names; pass literals as ``F.lit(...)``.
    """
    return F.concat(*[F.coalesce(col(p), F.lit("")) for p in parts])


def add_months_keep_end(d: Column | str, months: int) -> Column:
    """ADD_MONTHS of the dialect: a month-end date maps to the month end of the target month."""
    c = col(d)
    shifted = F.add_months(c, months)
    return F.when(c == F.last_day(c), F.last_day(shifted)).otherwise(shifted)


def months_back_literal(as_of: dt.datetime, months: int) -> dt.datetime:
    """Driver-side ADD_MONTHS for one constant, so the bound reaches the scan as a literal."""
    total = as_of.year * 12 + (as_of.month - 1) - months
    year, month = divmod(total, 12)
    month += 1
    last_src = calendar.monthrange(as_of.year, as_of.month)[1]
    last_dst = calendar.monthrange(year, month)[1]
    day = last_dst if as_of.day == last_src else min(as_of.day, last_dst)
    return as_of.replace(year=year, month=month, day=day)


def first_date_at_or_after(ts: dt.datetime) -> dt.date:
    """Smallest calendar date d with ``d (at midnight) >= ts``."""
    d = ts.date()
    return d if ts == dt.datetime.combine(d, dt.time()) else d + dt.timedelta(days=1)
