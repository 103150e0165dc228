"""Month and quarter keys, event time, publication lags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_end(d: Column) -> Column:
    return F.last_day(d)


def quarter_stamp(d: Column, stamp: str = "quarter_end") -> Column:
    """The end of d's quarter, or with stamp='first_month' the end of that quarter's first month, which looks ahead."""
    first = F.trunc(d, "quarter")
    return F.last_day(first if stamp == "first_month" else F.add_months(first, 2))


def event_month(d: Column, peak: Column) -> Column:
    """Months from the peak's month to d's month."""
    return (F.year(d) - F.year(peak)) * 12 + F.month(d) - F.month(peak)


def lagged(d: Column, days: int | Column) -> Column:
    return F.date_add(d, days)


def year_month(text: Column) -> Column:
    """'YYYY-MM' or 'YYYYMM' as the first of the month."""
    return F.to_date(F.concat(F.regexp_replace(text.cast("string"), "-", ""), F.lit("01")), "yyyyMMdd")


def episode_window(start: Column, peak: Column, end: Column, before: int = 3, after: int = 2, floor: int = 1993, cap: int = 2026) -> dict[str, Column]:
    """From January 1, ``before`` years ahead of the start (or peak), to December 31, ``after`` years past the end (or peak)."""
    first = F.greatest(F.coalesce(start, peak) - before, F.lit(floor))
    last = F.least(F.coalesce(end, peak) + after, F.lit(cap))
    return {"window_start": F.make_date(first, F.lit(1), F.lit(1)), "window_end": F.make_date(last, F.lit(12), F.lit(31))}
