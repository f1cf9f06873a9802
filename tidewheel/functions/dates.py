"""Calendar columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parts(ts: Column) -> dict[str, Column]:
    """hour, weekday (Monday 0), month, year, day and month names, two-digit hour, date, weekend flag."""
    return {
        "hour": F.hour(ts), "weekday": F.weekday(ts), "month": F.month(ts), "year": F.year(ts), "day_name": F.date_format(ts, "EEE"),
        "month_name": F.date_format(ts, "MMM"), "hour_text": F.date_format(ts, "HH"), "date": F.to_date(ts), "weekend": F.weekday(ts) >= 5,
    }


def cyclic(x: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a position in a cycle."""
    return F.sin(x * F.lit(2 * 3.141592653589793 / period)), F.cos(x * F.lit(2 * 3.141592653589793 / period))


def day_type(ts: Column) -> Column:
    return F.when(F.weekday(ts) == 5, "Saturday").when(F.weekday(ts) == 6, "Sunday").otherwise("weekday")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def duration(start: Column, end: Column, unit: str = "minutes") -> Column:
    return (micros(end) - micros(start)) / F.lit({"seconds": 1e6, "minutes": 6e7, "hours": 3.6e9, "days": 8.64e10}[unit])


def truncated(ts: Column, unit: str) -> Column:
    """date_trunc that keeps timestamps without a time zone so."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def _easter(year: int) -> dt.date:
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    w = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * w) // 451
    return dt.date(year, (h + w - 7 * m + 114) // 31, (h + w - 7 * m + 114) % 31 + 1)


def _nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th such weekday of a month, from its end for n < 0."""
    if n > 0:
        first = dt.date(year, month, 1)
        return first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(1)
    return last - dt.timedelta((last.weekday() - weekday) % 7 - 7 * (n + 1))


def holidays(spark: SparkSession, years: range, calendar: str = "fr") -> DataFrame:
    """date, holiday: French public holidays or United States federal ones, a row each."""
    rows: list[tuple[dt.date, str]] = []
    for y in years:
        e = _easter(y)
        if calendar == "fr":
            fixed = {(1, 1): "New Year", (5, 1): "Labour Day", (5, 8): "Victory Day", (7, 14): "National Day", (8, 15): "Assumption", (11, 1): "All Saints", (11, 11): "Armistice", (12, 25): "Christmas"}
            rows += [(dt.date(y, *d), n) for d, n in fixed.items()]
            rows += [(e + dt.timedelta(k), n) for k, n in ((1, "Easter Monday"), (39, "Ascension"), (50, "Whit Monday"))]
        else:
            fixed = {(1, 1): "New Year", (7, 4): "Independence Day", (11, 11): "Veterans Day", (12, 25): "Christmas"}
            for d, n in fixed.items():
                day = dt.date(y, *d)
                rows.append((day + dt.timedelta({5: -1, 6: 1}.get(day.weekday(), 0)), n))
            rows += [(_nth(y, 1, 0, 3), "Martin Luther King"), (_nth(y, 2, 0, 3), "Presidents"), (_nth(y, 5, 0, -1), "Memorial Day"), (_nth(y, 9, 0, 1), "Labor Day"), (_nth(y, 10, 0, 2), "Columbus Day"), (_nth(y, 11, 3, 4), "Thanksgiving")]
    return spark.createDataFrame(rows, "date date, holiday string")
