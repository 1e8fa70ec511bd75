from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import numbers as N
from tidemark.functions import strings as S


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text,expected", [("2024-02-29", date(2024, 2, 29)), ("2024-02-30", None), ("2024-2-1", None), ("x", None)])
def test_iso_date(spark, text, expected):
    assert value(spark, D.iso_date(F.lit(text))) == expected


@pytest.mark.parametrize("text,expected", [
    ("1,234", 1234.0), ("(56.5)", -56.5), ("$ 7", 7.0), ("—", None), ("N/A", None), ("", None), ("12%", 12.0), ("abc", None), ("€1,000", 1000.0)])
def test_parse_cell_number(spark, text, expected):
    assert value(spark, N.parse_cell_number(F.lit(text))) == expected


@pytest.mark.parametrize("text,expected", [("1.5B", 1.5e9), ("-2K", -2000.0), ("3,000", 3000.0), ("n/a", None), ("4t", 4e12)])
def test_parse_compact_number(spark, text, expected):
    assert value(spark, N.parse_compact_number(F.lit(text))) == expected


@pytest.mark.parametrize("days,expected", [(91, "STANDALONE_QUARTER"), (181, "YTD_6M"), (273, "YTD_9M"), (365, "FISCAL_YEAR"), (140, "UNKNOWN")])
def test_classify_period(spark, days, expected):
    start = F.to_date(F.lit("2023-01-01"))
    assert value(spark, D.classify_period(start, F.date_add(start, days - 1))) == expected


def test_explicit_type_rejected_by_reported_duration(spark):
    start, end = F.to_date(F.lit("2023-01-01")), F.to_date(F.lit("2023-12-31"))
    assert value(spark, D.classify_period(start, end, F.lit("quarter"), F.lit("REPORTED"))) == "UNKNOWN"
    assert value(spark, D.classify_period(start, end, F.lit("quarter"), F.lit("INFERRED"))) == "STANDALONE_QUARTER"


def test_quarter_end_keeps_month_end(spark):
    assert value(spark, D.shift_quarter_end(F.to_date(F.lit("2024-05-31")), 1)) == date(2024, 2, 29)
    assert value(spark, D.shift_quarter_end(F.to_date(F.lit("2024-05-28")), 1)) == date(2024, 2, 28)


def test_date_headers(spark):
    assert value(spark, D.parse_date_header(F.lit("Nine months ended September 30, 2021"))) == date(2021, 9, 30)
    assert value(spark, D.parse_date_header(F.lit("Year to 3 Mar 2022"))) == date(2022, 3, 3)
    assert value(spark, D.parse_date_header(F.lit("2022"))) is None


def test_enterprise_value_fails_closed(spark):
    equity, ev = N.enterprise_value(F.lit(10.0), F.lit(5.0), F.lit(None).cast("double"), F.lit(1.0))
    assert value(spark, equity) == 50.0
    assert value(spark, ev) is None


def test_number_tokens(spark):
    found = value(spark, S.number_tokens(F.lit("Revenue of $1,250 million rose 12.5% over 3 quarters to 2024")))
    assert found == ["$1250m", "12.5%", "2024"]


def test_filing_url_rejects_traversal(spark):
    good = value(spark, S.filing_url(F.lit("0000000042"), F.lit("0000000001-24-000007"), F.lit("a b.htm"), "https://x"))
    assert good == "https://x/42/000000000124000007/a%20b.htm"
    assert value(spark, S.filing_url(F.lit("42"), F.lit("0000000001-24-000007"), F.lit("../b.htm"), "https://x")) is None


def test_word_edges_are_ascii(spark):
    assert value(spark, F.lit("étion").rlike(S.rx(r"\btion\b"))) is True


def test_word_edges_are_the_general_ones():
    """Edges that look at one side match where the general edge does."""
    import random
    import re

    from tidemark.functions import strings as S

    patterns = [r"\bthe|and\b", r"tion\b", r"\b(?:non-gaap|adjusted)\b", r"\b(?:ab|c?)z", r"\b(ab|cd)?e", r"a?\bb", r"\s\b", r"\bx?y", r"\b[ab]", r"_\b", r"(?:x|\bab)\b", r"\b(a(b|c)|c)d"]
    narrow = [p for p in patterns if S.rx(p) != p.replace(r"\b", S._EDGE)]
    assert narrow and len(narrow) < len(patterns)
    dice = random.Random(1)
    for pattern in patterns:
        ours, general = re.compile(S.rx(pattern)), re.compile(pattern.replace(r"\b", S._EDGE))
        for _ in range(300):
            text = "".join(dice.choice(["the", "and", "non-gaap", "adjusted", "é", " ", "-", "x", "y", "ab", "c", "z", "d", "e", "1", "_", "tion"]) for _ in range(dice.randint(0, 9)))
            assert [m.span() for m in ours.finditer(text)] == [m.span() for m in general.finditer(text)], (pattern, text)
