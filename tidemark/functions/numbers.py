"""Arithmetic with the fail-closed rule: a missing or unusable input gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    v = value.cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def close_enough(a: Column, b: Column, tolerance: float) -> Column:
    """Relative agreement on a scale of at least one."""
    return F.abs(a - b) <= F.greatest(F.lit(1.0), F.abs(a), F.abs(b)) * tolerance


def growth_abs(current: Column, prior: Column) -> Column:
    """(c - p) / |p|, for panels of reported columns."""
    return F.when(prior != 0, (current - prior) / F.abs(prior))


def growth_ratio(current: Column, prior: Column) -> Column:
    """c / p - 1, for valuation columns."""
    return F.when(prior != 0, current / prior - 1)


def percent_change(current: Column, reference: Column) -> Column:
    """(c / r - 1) * 100, for prices."""
    return F.when(reference != 0, (current / reference - 1) * 100)


def enterprise_value(price, shares, debt, cash, preferred=None, minority=None, adjustments=None) -> tuple[Column, Column]:
    """Equity value and enterprise value; the latter needs both debt and cash."""
    zero = F.lit(0.0)
    equity = price * shares
    ev = (
        equity + debt
        + (zero if preferred is None else F.coalesce(preferred, zero))
        + (zero if minority is None else F.coalesce(minority, zero))
        - cash
        + (zero if adjustments is None else F.coalesce(adjustments, zero))
    )
    return equity, ev


def valuation_multiple(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator)


def margin(metric: Column, revenue: Column) -> Column:
    return F.when(revenue != 0, metric / revenue)


def forward_by_margin(forward_revenue: Column, ltm: Column, ltm_revenue: Column) -> Column:
    """Forward metric at the trailing margin."""
    return F.when(ltm_revenue != 0, forward_revenue * (ltm / ltm_revenue))


def ntm_blend(current: Column, following: Column, days_left: Column) -> Column:
    """Blend of two fiscal years weighted by the days left in the current one."""
    weight = days_left / F.lit(365.0)
    return F.when(days_left.between(0, 365), current * weight + following * (F.lit(1.0) - weight))


def relative_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


def consensus_warning(a: Column, b: Column, tolerance: float = 0.02) -> Column:
    diff = relative_difference(a, b)
    return F.when(diff.isNull(), "SINGLE_SOURCE").when(diff > tolerance, "DIFFERENCE_ABOVE_TOLERANCE").otherwise("AGREES")


def parse_compact_number(text: Column) -> Column:
    """'1.2B' style numbers."""
    pattern = r"(?i)^(-?[\d,.]+)\s*([KMBT])?$"
    cleaned = F.trim(text)
    base = F.regexp_replace(F.regexp_extract(cleaned, pattern, 1), ",", "").try_cast("double")
    suffix = F.upper(F.regexp_extract(cleaned, pattern, 2))
    scale = (
        F.when(suffix == "K", 1e3).when(suffix == "M", 1e6).when(suffix == "B", 1e9).when(suffix == "T", 1e12).otherwise(1.0)
    )
    return base * scale


def parse_cell_number(text: Column) -> Column:
    """Table cell: separators and currency signs dropped, (n) negative, dashes and N/A null."""
    bare = F.regexp_replace(text, r"[,$€£¥₩%\s]", "")
    signed = F.when(bare.startswith("("), F.regexp_replace(bare, r"^\((.+)\)$", "-$1")).otherwise(bare)
    # signs, dashes and N/A hold no digit
    return F.when(text.rlike("[0-9]") & signed.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), signed.try_cast("double"))


def parse_tagged_number(text: Column, scale: Column, sign: Column, nil: Column) -> Column:
    """Tagged number with a power-of-ten scale and an optional minus sign."""
    signed = F.regexp_replace(F.regexp_replace(text, r"[,$€£¥₩\s]", ""), r"^\((.+)\)$", "-$1")
    power = F.pow(F.lit(10.0), F.coalesce(scale.try_cast("double"), F.lit(0.0)))
    value = F.when(signed != "", signed.try_cast("double")) * power * F.when(sign == "-", -1.0).otherwise(1.0)
    return F.when(~F.coalesce(F.lower(nil) == "true", F.lit(False)), value)


# Scale words and their factors.
SCALE_WORDS = [
    (r"\b(?:thousand|thousands|000s)\b", 1e3),
    (r"\b(?:million|millions|mm)\b", 1e6),
    (r"\b(?:billion|billions|bn)\b", 1e9),
]
# Fixed value: currencies recognised in unit text.
CURRENCY_CODES = "USD|EUR|GBP|JPY|CAD|AUD|CHF"


def unit_scale(units: Column) -> Column:
    low = F.lower(F.coalesce(units, F.lit("")))
    out = F.lit(1.0)
    for pattern, factor in reversed(SCALE_WORDS):
        out = F.when(low.rlike(pattern), factor).otherwise(out)
    return out


def currency_of(explicit: Column, units: Column) -> Column:
    found = F.upper(F.regexp_extract(F.coalesce(units, F.lit("")), rf"(?i)\b({CURRENCY_CODES})\b", 1))
    return F.upper(F.coalesce(explicit, F.when(found != "", found)))


def unit_text(text: Column) -> Column:
    """A title or heading as the unit rules read it."""
    # single blanks stay as they are
    return F.lower(F.regexp_replace(text, r"\s{2,}|[\t\n\x0B\f\r]", " "))


def unit_word(low: Column) -> Column:
    return F.regexp_extract(low, r"(?:in\s+(?:(?:usd|eur|gbp|u\.s\. dollars?)\s+)?|\b(?:usd|eur|gbp)\s+)(thousands|millions|billions)", 1)


def named_units(low: Column, word: Column) -> tuple[Column, Column]:
    """Currency and scale, each by itself, of a text folded by ``unit_text``."""
    currency = (
        F.when(low.rlike(r"\b(?:usd|u\.s\. dollars?)\b|\$"), "USD")
        .when(low.rlike(r"\b(?:eur|euros?)\b|€"), "EUR")
        .when(low.rlike(r"\b(?:gbp|pounds? sterling)\b|£"), "GBP")
    )
    scale = (
        F.when(word == "thousands", 1e3).when(word == "millions", 1e6).when(word == "billions", 1e9)
        .when(low.rlike(r"\$\s*['’]?\s*\(?0{3}s?\)?"), 1e3)
        .when(low.rlike(r"\b(?:actual dollars|dollars)\b"), 1.0)
    )
    return currency, scale


def infer_units(text: Column) -> tuple[Column, Column]:
    """Currency and scale named in a table title or heading; both null unless both are explicit."""
    low = unit_text(text)
    currency, scale = named_units(low, unit_word(low))
    both = currency.isNotNull() & scale.isNotNull()
    return F.when(both, currency), F.when(both, scale)


def normalize_currency(code: Column) -> Column:
    return F.when(code == "GBp", "GBP").otherwise(code)


# Symbols put before amounts.
CURRENCY_SYMBOLS = {"USD": "$", "EUR": "EUR ", "JPY": "JPY ", "GBP": "GBP ", "GBp": "p", "CNY": "CNY "}


def currency_symbol(code: Column) -> Column:
    out = F.concat(F.coalesce(code, F.lit("")), F.lit(" "))
    for key, symbol in CURRENCY_SYMBOLS.items():
        out = F.when(code == key, symbol).otherwise(out)
    return out


def money_label(value: Column, currency: Column) -> Column:
    """Compact amount: T/B/M suffix, parentheses when negative."""
    size = F.abs(value)
    divisor = F.when(size >= 1e12, 1e12).when(size >= 1e9, 1e9).when(size >= 1e6, 1e6).otherwise(1.0)
    suffix = F.when(size >= 1e12, "T").when(size >= 1e9, "B").when(size >= 1e6, "M").otherwise("")
    digits = F.when(size >= 1e6, F.format_string("%.1f", size / divisor)).otherwise(F.format_string("%.0f", size))
    shown = F.concat(currency_symbol(currency), digits, suffix)
    return F.when(value.isNull(), "N/A").when(value < 0, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)


def percent_label(ratio: Column) -> Column:
    sign = F.when(ratio >= 0, "+").otherwise("")
    return F.when(ratio.isNull(), "N/A").otherwise(F.concat(sign, F.format_string("%.1f", ratio * 100), F.lit("%")))


def multiple_label(value: Column, denominator: Column) -> Column:
    """'12.3x'; N/M when the denominator is not positive."""
    return (
        F.when(value.isNotNull(), F.concat(F.format_string("%.1f", value), F.lit("x")))
        .when(denominator <= 0, "N/M").otherwise("N/A")
    )
