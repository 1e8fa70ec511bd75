import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as entry  # noqa: E402
import verify  # noqa: E402
from tidemark.catalog.views import Views  # noqa: E402

SMALL = "/root/testdata/sf0.001"
SAMPLE = ["V01_watchlist_snapshot", "J02_price_on_or_before", "W16_resample", "W05_dedupe_economic_periods", "A06_calendar_year", "T05_rank_targeted_filings",
          "A13_estimate_with_reported", "Q09_promote_snapshot", "X03_qa_exchanges", "X20_score_chunks", "R01_stream_latest_quote", "E04_recon_facts"]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name, monkeypatch):
    monkeypatch.setattr(verify, "SF_DIR", SMALL)
    _, status, detail, _ = verify.run(name, spark, entry.queries(), entry.oracle_sql())
    assert status == "ok", detail


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")
@pytest.mark.parametrize("name", ["J10_filings_near_gap", "J03_match_provider_to_filed", "J15_completeness_grid", "J20_allocate_to_years", "J26_fill_cell_grid"])
def test_no_cross_or_nested_loop_join(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")
@pytest.mark.parametrize("view", ["obs", "ledger", "cells", "estimates", "provider"])
def test_views_read_line_items_once(spark, view):
    plan = getattr(Views(spark, SMALL), view)()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_extendedprice") > 0 and sum("Relation [l_orderkey" in line for line in plan.splitlines()) == 1


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")
def test_exchange_summaries_hold_whole_answers_of_every_exchange(spark, monkeypatch):
    monkeypatch.setattr(verify, "SF_DIR", SMALL)
    name = "J24_exchange_with_analysis"
    assert name in entry.oracle_sql()
    _, status, detail, _ = verify.run(name, spark, entry.queries(), entry.oracle_sql())
    assert status == "ok", detail
