"""Reporting periods as Column expressions: one struct (type, start, end, label) for a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import blank_to_null, let

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

# How periods are written, on lower-cased text, in order of precedence.
QUARTER = r"\bq([1-4])\s*(?:fy|fiscal year)?\s*(\d{4})\b|\b(\d{4})\s*q([1-4])\b"
FISCAL_YEAR = r"(?:fy|fiscal year)\s*(\d{4})|\b(\d{4})\s*fiscal year\b"
YEAR_ENDED = rf"year ended .*?({'|'.join(MONTHS)})\s+(\d{{1,2}}),?\s+(\d{{4}})"
YEAR = r"\b(\d{4})\b"
DAY = r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{4})\b"


def rolling_date(year: Column, month: Column, day: Column) -> Column:
    """A date whose month and day may overflow into the next ones; null before year 1."""
    start = F.make_date(F.when(year >= 1, year), F.lit(1), F.lit(1))
    return F.date_add(F.add_months(start, month - 1), day - 1)


def _group(text: Column, pattern: str, *groups: int) -> Column:
    return F.coalesce(*[blank_to_null(F.regexp_extract(text, pattern, g)) for g in groups])


def parse_period(period: Column) -> Column:
    """period_type, period_start, period_end and period_label of a period as written."""
    return let(F.trim(F.coalesce(period, F.lit(""))), lambda text: let(F.lower(text), lambda low: _parsed(text, low)))


def _parsed(text: Column, low: Column) -> Column:

    def result(kind: Column | str | None, start: Column, end: Column, label: Column) -> Column:
        kind = kind if isinstance(kind, Column) else F.lit(kind).cast("string")
        return F.struct(kind.alias("period_type"), start.alias("period_start"), end.alias("period_end"), label.alias("period_label"))

    nothing, one = F.lit(None).cast("date"), F.lit(1)
    quarter, quarter_year = (_group(low, QUARTER, *g).cast("int") for g in ((1, 4), (2, 3)))
    first = rolling_date(quarter_year, (quarter - 1) * 3 + 1, one)
    fiscal = _group(low, FISCAL_YEAR, 1, 2).cast("int")
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(low, YEAR_ENDED, 1)).cast("int")
    ended_day, ended_year = (_group(low, YEAR_ENDED, g).cast("int") for g in (2, 3))
    year = _group(low, YEAR, 1).cast("int")
    day, day_month, day_year = (_group(text, DAY, g).cast("int") for g in (1, 2, 3))
    date = rolling_date(day_year, day_month, day)
    return (
        F.when(text == "", result(None, nothing, nothing, F.lit(None).cast("string")))
        .when(
            low.rlike(QUARTER),
            result(
                F.when(low.rlike("fy|fiscal"), "fiscalQuarter").otherwise("quarter"), first, F.last_day(F.add_months(first, 2)),
                F.concat(F.lit("Q"), quarter, F.lit(" "), quarter_year),
            ),
        )
        .when(low.rlike(FISCAL_YEAR), result("fiscalYear", rolling_date(fiscal, one, one), rolling_date(fiscal, F.lit(12), F.lit(31)), F.concat(F.lit("FY"), fiscal)))
        .when(low.rlike(YEAR_ENDED), result("date", rolling_date(ended_year, one, one), rolling_date(ended_year, month, ended_day), text))
        .when(low.rlike(YEAR) & (F.length(low) <= 12), result("year", rolling_date(year, one, one), rolling_date(year, F.lit(12), F.lit(31)), year.cast("string")))
        .when(text.rlike(DAY), result("date", date, date, text))
        .otherwise(result("text", nothing, nothing, text))
    )
