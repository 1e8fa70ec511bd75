from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import periods as P
from tidemark.operators import rollups as R

SCHEMA = (
    "source_id string, ticker string, metric string, period_type string, start_date date, end_date date, authority string, fiscal_year int, "
    "fiscal_quarter int, calendar_id string, value double, currency string, unit string, provider string, filed date, accession string, form string, "
    "scope string, op_scope string, basis string, method string, definition string, restated boolean")


def row(sid, kind, start, end, value, fy, fq, filed, provider="FILED", authority="REPORTED", restated=False, definition="D"):
    return (sid, "AAA", "revenue", kind, date.fromisoformat(start), date.fromisoformat(end), authority, fy, fq, "CAL", float(value), "USD", "USD", provider,
            date.fromisoformat(filed), None, "10-Q", "CONSOLIDATED", "UNSPECIFIED", "REPORTED", None, definition, restated)


def year_rows(fy, base):
    y = str(fy)
    return [
        row(f"q1{fy}", "STANDALONE_QUARTER", f"{y}-01-01", f"{y}-03-31", base, fy, 1, f"{y}-05-01"),
        row(f"h1{fy}", "YTD_6M", f"{y}-01-01", f"{y}-06-30", base * 2 + 1, fy, 2, f"{y}-08-01"),
        row(f"n1{fy}", "YTD_9M", f"{y}-01-01", f"{y}-09-30", base * 3 + 3, fy, 3, f"{y}-11-01"),
        row(f"fy{fy}", "FISCAL_YEAR", f"{y}-01-01", f"{y}-12-31", base * 4 + 6, fy, 4, f"{fy + 1}-02-15"),
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_later_filing_of_the_same_provider_wins(spark):
    rows = [row("a", "FISCAL_YEAR", "2022-01-01", "2022-12-31", 100, 2022, 4, "2023-02-01"), row("b", "FISCAL_YEAR", "2022-01-01", "2022-12-31", 150, 2022, 4, "2024-02-01")]
    out = P.dedupe_economic_periods(frame(spark, rows)).collect()
    assert [(r.source_id, r.alternatives, r.dedup_status) for r in out] == [("b", 1, None)]


def test_conflicting_providers_both_stay(spark):
    rows = [row("a", "STANDALONE_QUARTER", "2022-01-01", "2022-03-31", 100, 2022, 1, "2022-05-01"),
            row("b", "STANDALONE_QUARTER", "2022-01-03", "2022-04-02", 120, 2022, 1, "2022-05-01", provider="STANDARDIZED")]
    out = P.dedupe_economic_periods(frame(spark, rows)).collect()
    assert sorted((r.source_id, r.conflict) for r in out) == [("a", "VALUE_CONFLICT"), ("b", "VALUE_CONFLICT")]


def test_agreeing_providers_prefer_the_standardized_one(spark):
    rows = [row("a", "STANDALONE_QUARTER", "2022-01-01", "2022-03-31", 100, 2022, 1, "2022-05-01"),
            row("b", "STANDALONE_QUARTER", "2022-01-03", "2022-04-02", 100.05, 2022, 1, "2022-05-01", provider="STANDARDIZED")]
    assert [r.source_id for r in P.dedupe_economic_periods(frame(spark, rows)).collect()] == ["b"]


def test_two_values_in_one_filing_are_a_conflict(spark):
    rows = [row("a", "FISCAL_YEAR", "2022-01-01", "2022-12-31", 100, 2022, 4, "2023-02-01"), row("b", "FISCAL_YEAR", "2022-01-01", "2022-12-31", 150, 2022, 4, "2023-02-01")]
    out = P.dedupe_economic_periods(frame(spark, rows)).collect()
    assert sorted((r.source_id, r.conflict) for r in out) == [("a", "VALUE_CONFLICT"), ("b", "VALUE_CONFLICT")]


def test_quarters_from_cumulative_periods(spark):
    quarters, failures = P.derive_standalone_quarters(frame(spark, year_rows(2022, 100)))
    got = {r.fiscal_quarter: (r.start_date, r.value) for r in quarters.collect()}
    assert got == {1: (date(2022, 1, 1), 100.0), 2: (date(2022, 4, 1), 101.0), 3: (date(2022, 7, 1), 102.0), 4: (date(2022, 10, 1), 103.0)}
    assert failures.count() == 0


def test_blocked_steps_write_failures(spark):
    rows = year_rows(2022, 100) + [row("x", "YTD_6M", "2022-01-01", "2022-06-30", 900, 2022, 2, "2022-08-01", provider="OTHER")]
    quarters, failures = P.derive_standalone_quarters(frame(spark, rows))
    assert sorted(r.fiscal_quarter for r in quarters.collect()) == [1, 4]
    assert sorted(r.method for r in failures.collect()) == ["RESOLVE_CUMULATIVE_SOURCE", "YTD_6M_MINUS_Q1", "YTD_9M_MINUS_YTD_6M"]


@pytest.fixture(scope="module")
def three_years(spark):
    rows = year_rows(2021, 80) + year_rows(2022, 100) + year_rows(2023, 120)[:3]
    obs = P.dedupe_economic_periods(frame(spark, rows))
    quarters, _ = P.derive_standalone_quarters(None, obs)
    return obs.cache(), quarters.cache()


def test_ltm_uses_the_bridge_and_quarters_together(three_years):
    obs, quarters = three_years
    out = R.ltm_resolve(obs, quarters, "2023-12-31").first()
    # quarters to September 2023: 103 + 120 + 121 + 122
    assert (out.value, out.construction, out.status) == (466.0, "FOUR_QUARTERS", "VERIFIED_DERIVED")


def test_ltm_full_year_when_nothing_is_newer(three_years):
    obs, quarters = three_years
    out = R.ltm_resolve(obs, quarters, "2022-12-31").first()
    assert (out.value, out.construction, out.status) == (406.0, "FULL_YEAR", "VERIFIED_REPORTED")


def test_calendar_year_priority_and_gaps(three_years):
    obs, quarters = three_years
    got = {r.year: (r.value, r.status) for r in R.calendar_year(obs, quarters, [2021, 2022, 2023]).collect()}
    assert got[2021] == (326.0, "VERIFIED_REPORTED")
    assert got[2022] == (406.0, "VERIFIED_REPORTED")
    assert got[2023] == (None, "INSUFFICIENT_PERIOD_COVERAGE")


def test_mixed_definitions_block_the_sum(spark):
    rows = [row(f"q{i}", "STANDALONE_QUARTER", s, e, 10, 2022, i, "2023-01-01", definition="A" if i < 4 else "B") for i, (s, e) in enumerate(
        [("2022-01-01", "2022-03-31"), ("2022-04-01", "2022-06-30"), ("2022-07-01", "2022-09-30"), ("2022-10-01", "2022-12-31")], 1)]
    quarters = P.dedupe_economic_periods(frame(spark, rows))
    assert R.ltm_four_quarters(quarters, "2022-12-31").first().reason == "DEFINITION_INCOMPATIBLE"


def test_allocation_over_the_year_end(spark):
    df = frame(spark, [row("a", "STANDALONE_QUARTER", "2022-12-02", "2023-03-01", 90, 2023, 1, "2023-05-01")])
    got = {r.year: (r.overlap_days, r.contribution) for r in P.allocate_to_years(df, [2022, 2023]).collect()}
    assert got == {2022: (30, 30.0), 2023: (60, 60.0)}


def test_coverage_counts_gaps_and_overlaps(spark):
    rows = [row("a", "STANDALONE_QUARTER", "2022-01-01", "2022-03-31", 1, 2022, 1, "2022-05-01"), row("b", "STANDALONE_QUARTER", "2022-03-30", "2022-06-30", 1, 2022, 2, "2022-08-01"),
            row("c", "STANDALONE_QUARTER", "2022-08-01", "2022-12-31", 1, 2022, 4, "2023-02-01")]
    out = P.coverage(frame(spark, rows).withColumn("x", F.lit(1)), [2022]).first()
    assert (out.overlaps, out.gaps, out.complete) == (1, 1, False)
