"""Stage tables of a history lie by ticker, so that its groups, windows and joins move no rows."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import facts as A
from tidemark.operators import periods as P
from tidemark.operators import rollups as R
from tidemark.plans import history
from tidemark.session import bucketed, joined_in_place

AS_OF = "1999-12-31"
OBS = ("ticker string, source_id string, metric string, period_type string, start_date date, end_date date, authority string, fiscal_year int, fiscal_quarter int, calendar_id string, value double, "
       "currency string, unit string, provider string, filed date, accession string, form string, scope string, op_scope string, basis string, method string, definition string, restated boolean")
ENDS = [(3, 31, "STANDALONE_QUARTER"), (6, 30, "YTD_6M"), (9, 30, "YTD_9M"), (12, 31, "FISCAL_YEAR")]


def _filed(spark):
    rows = []
    for ticker in "ABCDE":
        for year in (1997, 1998, 1999):
            for metric, size in (("revenue", 100.0), ("costOfRevenue", 60.0), ("operatingCashFlow", 30.0), ("capitalExpenditures", 10.0)):
                for i, (month, day, kind) in enumerate(ENDS, 1):
                    end = dt.date(year, month, day)
                    rows.append((ticker, f"{ticker}{year}{i}{metric}", metric, kind, dt.date(year, 1, 1), end, "REPORTED", year, i, "FYE12", size * i, "USD", "USD", "FILED", end,
                                 f"{ticker}{year}{i}", "10-K", "CONSOLIDATED", "UNSPECIFIED", "REPORTED", None, f"DEF_{metric}", False))
    return spark.createDataFrame(rows, OBS).select("source_id", *[x.split()[0] for x in OBS.split(", ") if not x.startswith("source_id")])


def _provider(filed):
    shifted = [F.date_sub(x, 1).alias(x) for x in ("start_date", "end_date")]
    same = [x for x in filed.columns if x not in ("source_id", "start_date", "end_date", "authority", "provider", "accession")]
    rows = filed.where("fiscal_quarter = 1").select(F.concat(F.lit("STD:"), "source_id").alias("source_id"), *same, *shifted, F.lit("INFERRED").alias("authority"), F.lit("STANDARDIZED").alias("provider"),
                                                    F.lit(None).cast("string").alias("accession"))
    return rows.select(filed.columns)


def _plan(df):
    with joined_in_place(df.sparkSession):
        return df._jdf.queryExecution().executedPlan().toString()


def test_history_moves_rows_once(spark):
    setting, threshold = "spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.autoBroadcastJoinThreshold"
    before, size = spark.conf.get(setting), spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        filed = _filed(spark)
        out = history.canonical_history(filed, _provider(filed), [1998, 1999], AS_OF)
        assert "Exchange" not in _plan(out)
        facts, tasks = history.by_ticker(filed)
        assert "Exchange" not in _plan(P.dedupe_economic_periods(facts))
        every, _ = history.canonical_records(facts, _provider(filed), tasks)
        assert "Exchange" not in _plan(R.calendar_year(every, every, [1998, 1999])) + _plan(R.ltm_resolve(every, every, AS_OF))
        free = A.cash_flow_minus_capex(every.where("metric = 'operatingCashFlow'"), every.where("metric = 'capitalExpenditures'"), ["ticker", "source_id"])
        assert "Exchange" not in _plan(free)
    finally:
        spark.conf.set(threshold, size)
    assert spark.conf.get(setting) == before
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("history")]
    got = {(r["ticker"], r["metric"], r["period"]): r["value"] for r in out.collect()}
    assert {m: got["C", m, "1999A"] for m in ("revenue", "grossProfit", "freeCashFlow")} == {"revenue": 400.0, "grossProfit": 160.0, "freeCashFlow": 80.0}
    assert len(got) == 5 * 6 * 3


def test_parts_of_a_table(spark):
    a, b = spark.range(40).selectExpr("id % 7 AS k", "id AS v"), spark.range(9).selectExpr("id AS v", "IF(id > 6, NULL, id) AS k")
    both = bucketed([a, b], "parts", "k", 5)
    assert both.columns == ["k", "v"]
    assert sorted(both.collect(), key=str) == sorted(a.unionByName(b).collect(), key=str)
    assert "Exchange" not in _plan(both.groupBy("k", "v").count())
