"""Date functions: fiscal years, month indexes, anniversaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fiscal_year(day: Column | str) -> Column:
    """The federal fiscal year: it begins on the first of October before."""
    return F.year(F.add_months(_col(day), 3))


def month_index(day: Column | str) -> Column:
    """Months since year 0, so that differences are whole months."""
    return F.year(_col(day)) * 12 + F.month(_col(day)) - 1


def anniversary(day: Column | str, months: Column | int) -> Column:
    """The same day some months on; the last day of the month where that day is missing."""
    return F.add_months(_col(day), months)


def exact_anniversary(day: Column | str, months: Column | int) -> Column:
    """As anniversary(), but null where the day is missing in that month."""
    there = F.add_months(_col(day), months)
    return F.when(F.dayofmonth(there) == F.dayofmonth(_col(day)), there)


def whole_months_between(start: Column | str, end: Column | str) -> Column:
    """Completed months: a month is complete on the same day of a later one, so the last of February does not complete a
    month begun on the 31st.  Null where the end comes first."""
    a, b = _col(start), _col(end)
    return F.when(b >= a, month_index(b) - month_index(a) - F.when(F.dayofmonth(b) < F.dayofmonth(a), 1).otherwise(0)).cast("int")
