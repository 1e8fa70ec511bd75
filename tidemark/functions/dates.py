"""Date and period arithmetic as Column expressions.

Month arithmetic clamps to the last day of a month, as Spark does. Every clock is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AUTHORITATIVE = ["REPORTED", "DERIVED_FROM_REPORTED_BOUNDARIES"]

# Inclusive day ranges a period type may carry.
TYPE_DURATION = {
    "STANDALONE_QUARTER": (45, 130),
    "YTD_6M": (150, 220),
    "YTD_9M": (230, 310),
    "FISCAL_YEAR": (330, 380),
    "CALENDAR_YEAR": (350, 380),
}

# Inclusive day ranges from which a type is inferred.
INFERRED_TYPE = [
    ("STANDALONE_QUARTER", 70, 120),
    ("YTD_6M", 150, 220),
    ("YTD_9M", 230, 310),
    ("FISCAL_YEAR", 330, 380),
]

# Provider spellings of period types.
TYPE_ALIASES = {
    "QUARTER": "STANDALONE_QUARTER", "QUARTERLY": "STANDALONE_QUARTER", "3M": "STANDALONE_QUARTER",
    "6M": "YTD_6M", "SEMI_ANNUAL": "YTD_6M", "9M": "YTD_9M",
    "FY": "FISCAL_YEAR", "ANNUAL": "FISCAL_YEAR", "12M": "FISCAL_YEAR",
}


def iso_date(text: Column) -> Column:
    """Date of a strict yyyy-MM-dd text, null for anything else (2024-02-30 included)."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def epoch_day(day: Column) -> Column:
    return F.unix_date(day)


def from_epoch_day(number: Column) -> Column:
    return F.date_from_unix_date(number)


def inclusive_days(start: Column, end: Column) -> Column:
    """Days in [start, end]; null when a bound is missing or the range is reversed."""
    return F.when(start <= end, F.datediff(end, start) + 1)


def overlap_days(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.datediff(F.least(a_end, b_end), F.greatest(a_start, b_start)) + 1)


def day_after(day: Column) -> Column:
    return F.date_add(day, 1)


def shift_year(day: Column, years: int) -> Column:
    return F.add_months(day, 12 * years)


def shift_quarter_end(day: Column, quarters: int) -> Column:
    """Move back by quarters; a month end stays a month end."""
    moved = F.add_months(day, -3 * quarters)
    return F.when(day == F.last_day(day), F.last_day(moved)).otherwise(moved)


def near_boundary(actual: Column, expected: Column, tolerance: int = 7) -> Column:
    return F.coalesce(F.abs(F.datediff(actual, expected)) <= tolerance, F.lit(False))


def fiscal_year_range(year: Column, month: Column, day: Column) -> tuple[Column, Column]:
    """First and last day of the fiscal year that ends on month/day of ``year``."""
    return F.date_add(F.make_date(year - 1, month, day), 1), F.make_date(year, month, day)


def fiscal_quarter_range(year: Column, quarter: Column, month: Column, day: Column) -> tuple[Column, Column]:
    first = F.add_months(fiscal_year_range(year, month, day)[0], (quarter - 1) * 3)
    return first, F.date_sub(F.add_months(first, 3), 1)


def fiscal_year(end: Column, fye_month: Column) -> Column:
    return F.year(end) + F.when(F.month(end) > fye_month, 1).otherwise(0)


def fiscal_quarter(end: Column, fye_month: Column, label: Column | None = None) -> Column:
    """Quarter from an explicit label when it names one, else from months before the year end."""
    months_left = (fye_month - F.month(end) + 12) % 12
    computed = (F.lit(4) - F.round(months_left / 3)).cast("int")
    computed = F.when(computed.between(1, 4), computed)
    if label is None:
        return computed
    named = F.regexp_extract(F.upper(F.coalesce(label, F.lit(""))), r"Q([1-4])", 1)
    return F.when(named != "", named.cast("int")).otherwise(computed)


def type_matches_duration(period_type: Column, days: Column) -> Column:
    """True unless the type has a duration range and the days fall outside it."""
    fits = F.lit(True)
    for name, (low, high) in TYPE_DURATION.items():
        fits = F.when(period_type == name, days.between(low, high)).otherwise(fits)
    return F.when(days.isNull() | period_type.isNull(), True).otherwise(fits)


def classify_period(start: Column, end: Column, explicit: Column | None = None, authority: Column | None = None) -> Column:
    """Period type from an explicit label or, without one, from the duration."""
    days = inclusive_days(start, end)
    inferred = F.lit("UNKNOWN")
    for name, low, high in reversed(INFERRED_TYPE):
        inferred = F.when(days.between(low, high), name).otherwise(inferred)
    if explicit is None:
        return inferred
    label = F.upper(F.trim(explicit))
    requested = F.when(label.isin(*TYPE_DURATION, "UNKNOWN"), label)
    for alias, name in TYPE_ALIASES.items():
        requested = F.when(label == alias, name).otherwise(requested)
    reported = F.coalesce(authority.isin(AUTHORITATIVE), F.lit(False)) if authority is not None else F.lit(False)
    rejected = reported & ~type_matches_duration(requested, days)
    return F.when(requested.isNotNull(), F.when(rejected, "UNKNOWN").otherwise(requested)).otherwise(inferred)


def has_authoritative_bounds(start: Column, end: Column, authority: Column) -> Column:
    return start.isNotNull() & end.isNotNull() & F.coalesce(authority.isin(AUTHORITATIVE), F.lit(False))


_MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
_MONTH_WORD = rf"({_MONTHS})(?:uary|ruary|ch|il|e|y|ust|t|tember|ober|ember)?"


def parse_date_header(text: Column) -> Column:
    """Date of 'March 31, 2025' or '31 March 2025' inside a header label."""
    low = F.lower(text)
    first = rf"\b{_MONTH_WORD}\s+(\d{{1,2}}),?\s+(20\d{{2}})\b"
    second = rf"\b(\d{{1,2}})\s+{_MONTH_WORD}\s+(20\d{{2}})\b"
    names = F.array(*[F.lit(m) for m in _MONTHS.split("|")])

    def read(hit: Column, pattern: str, month: int, day: int) -> Column:
        """Date of the piece that a pattern found; its parts are read from that piece."""
        part = lambda i: F.regexp_extract(hit, pattern, i)
        return iso_date(F.concat_ws("-", part(3), F.lpad(F.array_position(names, part(month)).cast("string"), 2, "0"), F.lpad(part(day), 2, "0")))

    def found(pattern: str, month: int, day: int, otherwise: Column) -> Column:
        # a lambda's argument is computed once
        return F.get(F.transform(F.array(F.regexp_extract(low, pattern, 0)), lambda hit: F.when(hit != "", read(hit, pattern, month, day)).otherwise(otherwise)), 0)

    return found(first, 1, 2, found(second, 2, 1, F.lit(None).cast("date")))


def calendar_quarter_label(day: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(day).cast("string"), F.lit(" "), F.year(day).cast("string"))


def parse_period_label(title: Column) -> dict[str, Column]:
    """Type, label, year and number of 'Q1 2025' / 'H1 2025' titles."""
    quarter, half = r"(?i)\bQ([1-4])\s+(\d{4})\b", r"(?i)\bH([12])\s+(\d{4})\b"
    is_quarter, is_half = title.rlike(quarter), title.rlike(half)

    def part(group):
        found = F.when(is_quarter, F.regexp_extract(title, quarter, group)).when(is_half, F.regexp_extract(title, half, group))
        return found.cast("int")

    label = (
        F.when(is_quarter, F.concat(F.lit("Q"), part(1).cast("string"), F.lit(" "), part(2).cast("string")))
        .when(is_half, F.concat(F.lit("H"), part(1).cast("string"), F.lit(" "), part(2).cast("string")))
        .otherwise(F.regexp_replace(title, r"(?i)^Earnings Call:\s*", ""))
    )
    kind = F.when(is_quarter, "quarter").when(is_half, "half").otherwise("other")
    return {"type": kind, "label": label, "number": part(1), "year": part(2)}


# Months back of each watchlist reference.
REFERENCE_MONTHS = {"month": 1, "month3": 3, "month6": 6, "year": 12, "month18": 18, "year2": 24}

# Months back of each chart range.
RANGE_MONTHS = {"1mo": 1, "3mo": 3, "6mo": 6, "1y": 12, "18mo": 18, "2y": 24}


def reference_targets(as_of: Column, custom: Column) -> Column:
    """Array of (key, target date) for the watchlist references."""
    targets = {"week": F.date_sub(as_of, 7), "ytd": F.date_sub(F.trunc(as_of, "year"), 1), "custom": custom}
    targets |= {key: F.add_months(as_of, -months) for key, months in REFERENCE_MONTHS.items()}
    return F.array(*[F.struct(F.lit(k).alias("key"), v.alias("target")) for k, v in targets.items()])


def range_start(range_key: Column, end: Column) -> Column:
    start = F.when(range_key == "ytd", F.trunc(end, "year"))
    for key, months in RANGE_MONTHS.items():
        start = start.when(range_key == key, F.add_months(end, -months))
    return start.otherwise(F.date_sub(end, 1))
