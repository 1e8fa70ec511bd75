"""Queries that ask for the same rows several times read the line items, or the ledger, once."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.catalog import q_estimates, q_rollups
from tidemark.catalog.views import Views
from tidemark.plans import history


def _tables(spark, path):
    spark.range(240).selectExpr(
        "id AS l_orderkey", "id AS l_partkey", "id % 5 AS l_suppkey", "CAST(id AS INT) AS l_linenumber", "1.0D AS l_quantity", "CAST(100 + id AS DOUBLE) AS l_extendedprice", "0.1D AS l_discount",
        "0.1D AS l_tax", "'A' AS l_returnflag", "'F' AS l_linestatus", "add_months(timestamp '1996-01-05', CAST(3 * (id DIV 5 % 24) AS INT)) AS l_shipdate").write.parquet(f"{path}/lineitem.parquet")
    spark.range(5).selectExpr("id AS s_suppkey", "CAST(0 AS INT) AS s_nationkey").write.parquet(f"{path}/supplier.parquet")
    spark.range(1).selectExpr("CAST(0 AS INT) AS n_nationkey", "CAST(0 AS INT) AS n_regionkey").write.parquet(f"{path}/nation.parquet")
    return Views(spark, str(path))


def test_estimates_rest_on_kept_quarters(spark, tmp_path):
    out = q_estimates.a13(_tables(spark, tmp_path))
    assert not [f for f in out.inputFiles() if "lineitem" in f]
    assert out.count() == 5 * 2 * 4


def test_reconciliation_rests_on_kept_quarters(spark, tmp_path):
    views = _tables(spark, tmp_path)
    out = q_rollups.a15(views)
    assert not [f for f in out.inputFiles() if "lineitem" in f]
    assert out.count() == views.obs().where("form = '10-K'").count() and out.where("NOT reconciles").count() == 0


def test_ledger_is_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(value):
        read.add(1)
        return value

    rows, day = [], dt.date(1999, 1, 1)
    for metric, concept in (("revenue", "Revenues"), ("costOfRevenue", "CostOfRevenue"), ("ebit", "OperatingIncomeLoss")):
        for month in (3, 6, 9, 12):
            end = dt.date(1999, month, 31 if month in (3, 12) else 30)
            rows.append(("A", "us-gaap", concept, metric, day, end, float(month * 10), "USD", "10-K" if month == 12 else "10-Q", end, f"a{month}", None, [metric]))
    rows.append(("A", "us-gaap", "Revenues", "revenue", day, dt.date(1999, 3, 31), 1.0, "USD", "10-Q", day, "a0", "Part", ["revenue"]))
    ledger = spark.createDataFrame(rows, "ticker string, namespace string, concept string, label string, start_date date, end_date date, value double, currency string, form string, "
                                         "filed date, accession string, segment string, metrics array<string>")
    out = history.ledger_build(ledger.withColumn("value", F.udf(seen, "double").asNondeterministic()("value")), [1999]).collect()
    assert {(r["metric"], r["value"], r["method"]) for r in out} == {("revenue", 120.0, "CALENDAR_YEAR_DERIVED"), ("grossProfit", 0.0, "CALENDAR_YEAR_DERIVED")}
    assert read.value == len(rows)
