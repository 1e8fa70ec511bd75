"""Estimate queries: last two fiscal years scaled up act as consensus."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.views import Views
from tidemark.operators import estimates as E

c = F.col
AS_OF = "2001-05-15"
YEARS = [2000, 2001, 2002]


def filed(v: Views):
    return v.quarters().where("metric = 'revenue'")


@query("P29_select_estimate", """
SELECT ticker, metric, value, end_date, 'FY' || year(end_date) || 'E' AS label FROM v_estimates WHERE period = '0y'""")
def p29(v: Views):
    return E.select_estimate(v.estimates()).select("ticker", "metric", "value", "end_date", "label")


_WEIGHTS = """
w AS (SELECT ticker, CASE WHEN n = 4 THEN value / total ELSE 0.25 END AS weight, slot FROM (
 SELECT ticker, value, sum(value) OVER (PARTITION BY ticker) AS total, count(*) OVER (PARTITION BY ticker) AS n, row_number() OVER (PARTITION BY ticker ORDER BY end_date) AS slot
 FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY end_date DESC) AS rn FROM v_quarters WHERE metric = 'revenue' AND value > 0) WHERE rn <= 4))"""


@query("A11_seasonality", f"WITH {_WEIGHTS} SELECT ticker, CAST(slot AS INTEGER) AS slot, weight FROM w")
def a11(v: Views):
    return E.seasonality(filed(v)).select("ticker", F.posexplode("weights").alias("p", "weight")).select("ticker", (c("p") + 1).alias("slot"), "weight")


_PLAN = _WEIGHTS + """,
plan AS (SELECT e.ticker, e.metric, e.period, e.value AS annual, CAST(w.slot AS INTEGER) AS slot, w.weight, e.value * w.weight AS value,
 CASE WHEN w.slot = 1 THEN CAST(e.end_date - INTERVAL 12 MONTH + INTERVAL 1 DAY AS DATE) ELSE CAST(CAST(e.end_date - INTERVAL 12 MONTH + INTERVAL 1 DAY AS DATE) + INTERVAL (3 * (w.slot - 1)) MONTH AS DATE) END AS start_date,
 CASE WHEN w.slot = 4 THEN e.end_date ELSE CAST(CAST(e.end_date - INTERVAL 12 MONTH + INTERVAL 1 DAY AS DATE) + INTERVAL (3 * w.slot) MONTH - INTERVAL 1 DAY AS DATE) END AS end_date
 FROM v_estimates e JOIN w ON e.ticker = w.ticker WHERE e.metric = 'revenue')"""


def planned(v: Views):
    # estimates, shares and filed rows all rest on the quarters of the line items
    v.keep("quarter_wide")
    return E.estimate_to_quarters(v.estimates().where("metric = 'revenue'"), E.seasonality(filed(v)))


@query("A12_estimate_to_quarters", f"WITH {_PLAN} SELECT ticker, period, slot, start_date, end_date, value FROM plan")
def a12(v: Views):
    return planned(v).select("ticker", "period", "slot", "start_date", "end_date", "value")


_ASSIGN = _PLAN + f""",
ov AS (SELECT p.*, f.start_date AS fs, f.end_date AS fe, f.value AS fv, least(p.end_date, f.end_date) - greatest(p.start_date, f.start_date) + 1 AS o FROM plan p JOIN v_quarters f ON f.ticker = p.ticker AND f.metric = 'revenue'
 AND f.end_date <= DATE '{AS_OF}' AND f.start_date <= p.end_date AND f.end_date >= p.start_date),
asg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, period, fe ORDER BY slot) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY ticker, period, slot ORDER BY o DESC, fe) AS r1 FROM ov WHERE o / (end_date - start_date + 1) >= 0.8) WHERE r1 = 1) WHERE r2 = 1)"""


@query("J19_assign_reported", f"WITH {_ASSIGN} SELECT ticker, period, slot, fe AS filed_end, fv AS filed_value FROM asg")
def j19(v: Views):
    return E.assign_reported(planned(v), filed(v), AS_OF).select("ticker", "period", "slot", "filed_end", "filed_value")


_MIXED = _ASSIGN + """,
tot AS (SELECT p.ticker, p.period, max(p.annual) AS annual, coalesce(sum(a.fv), 0) AS filed_total, list_sum(list(CASE WHEN a.fv IS NULL THEN p.weight END ORDER BY p.slot)) AS open_weight FROM plan p LEFT JOIN asg a ON a.ticker = p.ticker AND a.period = p.period AND a.slot = p.slot GROUP BY ALL),
mixed AS (SELECT p.ticker, p.period, p.slot, coalesce(a.fs, p.start_date) AS start_date, coalesce(a.fe, p.end_date) AS end_date, coalesce(a.fv, CASE WHEN t.open_weight > 0 THEN (t.annual - t.filed_total) * (p.weight / t.open_weight) END) AS value,
 CASE WHEN a.fv IS NULL THEN 'CONSENSUS' ELSE 'FILED' END AS source, CASE WHEN t.annual - t.filed_total < 0 THEN 'Low' ELSE 'Medium' END AS confidence
 FROM plan p LEFT JOIN asg a ON a.ticker = p.ticker AND a.period = p.period AND a.slot = p.slot JOIN tot t ON t.ticker = p.ticker AND t.period = p.period)"""


def mixed(v: Views):
    return E.estimate_with_reported(planned(v), filed(v), AS_OF)


@query("A13_estimate_with_reported", f"WITH {_MIXED} SELECT ticker, period, slot, start_date, end_date, round(value, 4) AS value, source, confidence FROM mixed")
def a13(v: Views):
    return mixed(v).select("ticker", "period", "slot", "start_date", "end_date", F.round("value", 4).alias("value"), "source", "confidence")


_MERGED = _MIXED + """,
merged AS (SELECT ticker, CAST(y AS INTEGER) AS year, sum(value * ((least(end_date, make_date(y, 12, 31)) - greatest(start_date, make_date(y, 1, 1)) + 1) / (end_date - start_date + 1))) AS value, count(*) AS components
 FROM mixed JOIN (VALUES (2000), (2001), (2002)) t(y) ON year(start_date) <= y AND year(end_date) >= y WHERE value IS NOT NULL GROUP BY ALL)"""


@query("A14_merge_estimates", f"WITH {_MERGED} SELECT ticker, year, round(value, 3) AS value, components FROM merged")
def a14(v: Views):
    return E.merge_estimates(mixed(v), YEARS).select("ticker", "year", F.round("value", 3).alias("value"), "components")


@query("A10_ntm", f"""
WITH {_MIXED}, once AS (SELECT ticker, start_date, end_date, arg_min(value, period) AS value FROM mixed WHERE value IS NOT NULL GROUP BY ALL),
d AS (SELECT *, least(end_date, DATE '2002-05-15') - greatest(start_date, DATE '2001-05-16') + 1 AS days FROM once)
SELECT ticker, CASE WHEN sum(days) >= 360 THEN round(sum(value * (days / (end_date - start_date + 1))), 3) END AS value, CAST(sum(days) AS BIGINT) AS covered_days, CASE WHEN sum(days) = 365 THEN 'Medium' ELSE 'Low' END AS confidence FROM d WHERE days > 0 GROUP BY ticker""")
def a10(v: Views):
    return E.ntm(mixed(v), AS_OF).select("ticker", F.round("value", 3).alias("value"), "covered_days", "confidence")
