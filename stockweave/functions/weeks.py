"""Week arithmetic on integer ``YYYYWW`` labels, as column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEKS_IN_YEAR = 52.18  # fixed value: period of the cyclic week encoding


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_week(c) -> Column:
    """``202314``, ``"202314"``, ``202314.0`` or ``"202314.0"`` to int."""
    return F.regexp_replace(as_col(c).cast("string"), r"\.0$", "").cast("int")


def year_of(c) -> Column:
    c = as_col(c)
    return ((c - c % 100) / 100).cast("int")


def week_of(c) -> Column:
    return (as_col(c) % 100).cast("int")


def monday_of(c) -> Column:
    """Monday of the ISO week: the week of January 4th is week 1."""
    c = as_col(c)
    jan4 = F.make_date(year_of(c), F.lit(1), F.lit(4))
    return F.date_add(F.date_trunc("week", jan4).cast("date"), (week_of(c) - 1) * 7)


def week_label(d) -> Column:
    """ISO ``YYYYWW`` of a date or timestamp.

    The Thursday of a week decides its year; its day of year gives the week.
    Cheaper per row than the ISO field functions.
    """
    d = as_col(d).cast("date")
    thursday = F.date_add(d, 3 - F.weekday(d))
    week = F.floor((F.dayofyear(thursday) - 1) / 7) + 1
    return (F.year(thursday) * 100 + week).cast("int")


def _year_starts() -> list[int]:
    base = dt.date.fromisocalendar(1900, 1, 1)
    return [(dt.date.fromisocalendar(y, 1, 1) - base).days // 7 for y in range(1900, 2201)]


def week_number(c) -> Column:
    """Running number of a week label, from 0 at 1900-W01; earlier weeks are negative.

    Years 1900–2200 come from a table, which is cheaper per row than dates.
    """
    c = as_col(c)
    starts = F.array(*[F.lit(n) for n in _year_starts()])
    fourth = F.make_date(year_of(c), F.lit(1), F.lit(4))
    first_monday = F.date_sub(fourth, F.weekday(fourth))
    other = F.floor(F.datediff(first_monday, F.lit(dt.date(1900, 1, 1))) / 7).cast("int")
    return F.coalesce(F.get(starts, year_of(c) - 1900), other) + week_of(c) - 1


def shift_week(c, n) -> Column:
    """The ISO week ``n`` weeks later (earlier when negative)."""
    step = F.lit(n * 7) if isinstance(n, int) else (n * 7).cast("int")
    return week_label(F.date_add(monday_of(c), step))


def weeks_ago(c, n: int) -> Column:
    return shift_week(c, -n)


def iso_weeks_between(a, b) -> Column:
    return (week_number(b) - week_number(a)).cast("int")


def flat52_weeks_between(a, b) -> Column:
    """Difference on a calendar in which every year has 52 weeks."""
    a, b = as_col(a), as_col(b)
    return (year_of(b) * 52 + week_of(b) - year_of(a) * 52 - week_of(a)).cast("int")


def format_week(c) -> Column:
    """``W05·2025``; a dash when there is no week."""
    c = as_col(c)
    return F.coalesce(F.format_string("W%02d·%d", week_of(c), year_of(c)), F.lit("—"))


def human(c, decimals: int = 0) -> Column:
    """Short number: 12.3M, 45K or 678, with thousands separators below 1000."""
    c = as_col(c)
    return (
        F.when(F.abs(c) >= 1e6, F.format_string(f"%.{max(decimals, 1)}fM", c / 1e6))
        .when(F.abs(c) >= 1e3, F.format_string(f"%.{decimals}fK", c / 1e3))
        .otherwise(F.format_string("%,.0f", c))
    )


# Driver-side twins, for parameters only (never for data).


def week_monday(yw: int) -> dt.date:
    return dt.date.fromisocalendar(yw // 100, yw % 100, 1)


def week_add(yw: int, n: int) -> int:
    y, w, _ = (week_monday(yw) + dt.timedelta(weeks=n)).isocalendar()
    return y * 100 + w


def week_span(a: int, b: int) -> int:
    """Whole weeks from ``a`` to ``b``."""
    return (week_monday(b) - week_monday(a)).days // 7


def week_index(c, first: int) -> Column:
    """0-based position on the calendar that starts at ``first``."""
    start = (week_monday(first) - week_monday(190001)).days // 7
    return (week_number(c) - start).cast("int")


def week_at(pos, first: int, n: int) -> Column:
    """Label of a position below ``n``; the calendar is a literal array."""
    labels = F.array(*[F.lit(week_add(first, i)) for i in range(n)])
    return F.get(labels, as_col(pos))
