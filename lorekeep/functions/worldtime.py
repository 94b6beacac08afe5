"""World time as Julian day numbers: integer arithmetic, astronomical years (1 BCE is 0), floor division."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Years before this have no months and days here.
FIRST_YEAR = -4700
_TIME = r"^[+-]\d+-\d\d-\d\dT"


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b)


def _shifted(y: Column, m: Column) -> tuple[Column, Column]:
    """Years that begin in March, so that a leap day ends one."""
    a = _div(14 - m, 12)
    return y + 4800 - a, m + 12 * a - 3


def jdn_gregorian(y: Column, m: Column, d: Column) -> Column:
    y2, m2 = _shifted(y, m)
    return (d + _div(153 * m2 + 2, 5) + 365 * y2 + _div(y2, 4) - _div(y2, 100) + _div(y2, 400) - 32045).cast("long")


def jdn_julian(y: Column, m: Column, d: Column) -> Column:
    y2, m2 = _shifted(y, m)
    return (d + _div(153 * m2 + 2, 5) + 365 * y2 + _div(y2, 4) - 32083).cast("long")


def gregorian_text(jdn: Column) -> Column:
    """Year-month-day of a day number: Spark's dates are days of the proleptic Gregorian calendar."""
    date = F.date_add(F.lit("1970-01-01").cast("date"), (jdn - 2440588).cast("int"))
    return _dashed(F.year(date), F.month(date), F.day(date))


def year_span(year: Column, precision: Column) -> tuple[Column, Column]:
    """First and last astronomical year of a year (9), decade (8), century (7) or millennium (6). Years before the era
    mirror those after it: the first century before it is -99 to 0."""
    before = 1 - year  # as years before the era are counted
    hundreds = lambda y, size: (_div(y + size - 1, size) - 1) * size + 1
    tens = lambda y: (F.greatest(_div(y, 10) * 10, F.lit(1)), _div(y, 10) * 10 + 9)
    spans = {8: (tens(year), tens(before)), 7: tuple((hundreds(y, 100), hundreds(y, 100) + 99) for y in (year, before)), 6: tuple((hundreds(y, 1000), hundreds(y, 1000) + 999) for y in (year, before))}
    first, last = F.when(precision >= 9, year), F.when(precision >= 9, year)
    for p, (after, mirrored) in spans.items():
        first = first.when(precision == p, F.when(year > 0, after[0]).otherwise(1 - mirrored[1]))
        last = last.when(precision == p, F.when(year > 0, after[1]).otherwise(1 - mirrored[0]))
    return first.cast("long"), last.cast("long")


def time_parts(text: Column) -> tuple[Column, Column, Column]:
    """Astronomical year, month and day of a time like +1879-03-14T00:00:00Z; -0044 is the year -43. Null for any other
    text; month and day may be 0."""
    cells = F.when(text.rlike(_TIME), F.split(F.substring(text, F.lit(2), F.length(text)), "[-T]"))
    year = F.get(cells, 0).try_cast("long")
    return F.when(F.startswith(text, F.lit("-")), 1 - year).otherwise(year), F.get(cells, 1).try_cast("int"), F.get(cells, 2).try_cast("int")


def stated_precision(month: Column, day: Column, precision: Column) -> Column:
    """The precision cut to what a time states: a day of month 0 or day 0 is none. Null is a year."""
    p = F.least(F.coalesce(precision, F.lit(9)), F.lit(11))
    return F.when((p >= 11) & (month > 0) & (day > 0), p).when((p >= 10) & (month > 0), 10).otherwise(F.least(p, F.lit(9)))


def day_bounds(year: Column, month: Column, day: Column, precision: Column, julian: Column) -> tuple[Column, Column]:
    """First and last Julian day numbers of a time as it is stated: at its precision, in its own calendar; null beyond
    the calendar's reach."""
    of = lambda y, m, d: F.when(julian, jdn_julian(y, m, d)).otherwise(jdn_gregorian(y, m, d))
    p, one = stated_precision(month, day, precision), F.lit(1)
    next_month = F.when(month == 12, 1).otherwise(month + 1)
    next_year = F.when(month == 12, year + 1).otherwise(year)
    low, high = year_span(year, p)
    first = F.when(p == 11, of(year, month, day)).when(p == 10, of(year, month, one)).otherwise(of(low, one, one))
    last = F.when(p == 11, of(year, month, day)).when(p == 10, of(next_year, next_month, one) - 1).otherwise(of(high + 1, one, one) - 1)
    able = F.when(p >= 10, year >= FIRST_YEAR).otherwise(low >= FIRST_YEAR)
    return F.when(able, first), F.when(able, last)


def _dashed(year: Column, month: Column | None = None, day: Column | None = None) -> Column:
    y = F.when(year < 0, F.concat(F.lit("-"), F.lpad((-year).cast("string"), 4, "0"))).when(year < 10000, F.lpad(year.cast("string"), 4, "0")).otherwise(year.cast("string"))
    y = F.when(year <= -10000, year.cast("string")).otherwise(y)
    return F.concat_ws("-", y, *(F.lpad(c.cast("string"), 2, "0") for c in (month, day) if c is not None))


def read_times(df: DataFrame, time: str, precision: str, julian: str, prefix: str = "") -> DataFrame:
    """df with shown (the time cut to what it states, in the Gregorian calendar), shown_precision, first_day and last_day,
    their names after the prefix. A day of the Julian calendar is shown as a Gregorian one; a Julian month has no
    Gregorian name and is shown as its year. Each step is a projection of its own, so that none is computed again."""
    y, m, d, p, first, last = (f"_{prefix}{n}" for n in ("year", "month", "day", "stated", "first", "last"))
    year, month, day = time_parts(F.col(time))
    out = df.withColumns({y: year, m: month, d: day}).withColumn(p, stated_precision(F.col(m), F.col(d), F.col(precision)))
    low, high = day_bounds(F.col(y), F.col(m), F.col(d), F.col(p), F.coalesce(F.col(julian), F.lit(False)))
    known = F.col(y).isNotNull()
    out = out.withColumns({first: F.when(known, low), last: F.when(known, high)})
    old = F.coalesce(F.col(julian), F.lit(False))
    whole_day = (F.col(p) == 11) & ~(old & (F.col(y) < FIRST_YEAR))
    month_shown = (F.col(p) >= 10) & ~old
    shown = F.when(whole_day & old, gregorian_text(F.col(first))).when(whole_day, _dashed(F.col(y), F.col(m), F.col(d))).when(month_shown, _dashed(F.col(y), F.col(m))).otherwise(_dashed(F.col(y)))
    how = F.when(whole_day, 11).when(month_shown, 10).otherwise(F.least(F.col(p), F.lit(9)))
    out = out.withColumns({f"{prefix}shown": F.when(known, shown), f"{prefix}shown_precision": F.when(known, how).cast("int"), f"{prefix}first_day": F.col(first), f"{prefix}last_day": F.col(last)})
    return out.drop(y, m, d, p, first, last)
