"""Valuation table queries over yearly cells, last prices and instant balances of suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import q_estimates as QE
from tidemark.catalog.registry import query
from tidemark.catalog.views import Views
from tidemark.operators import estimates as E
from tidemark.operators import valuation as VA

c = F.col
TAGS = {"cash": ["NoSuchTag", "ebit"], "debt": ["adjustedEbitda", "ebit"], "shares": ["costOfRevenue"]}
ACTUALS = [1997, 1998, 1999]


def quotes(v: Views):
    return v.prices().groupBy("ticker").agg(F.max_by("close", "day").alias("price"))


def balances(v: Views):
    facts = v.quarters().select("ticker", c("metric").alias("tag"), "end_date", F.date_add("end_date", 30).alias("filed"), "value")
    return VA.point_balance(facts, TAGS)


CAP_SQL = """
bal AS (SELECT ticker, metric, arg_max(value, end_date) AS value, max(end_date) AS end_date FROM v_quarters GROUP BY ALL),
q AS (SELECT ticker, arg_max(close, day) AS price FROM v_prices GROUP BY ticker),
cap AS (SELECT ticker, price, cash, debt, shares, price * shares AS equity_value, price * shares + debt + 0 + 0 - cash + 0 AS enterprise_value FROM q LEFT JOIN (SELECT ticker, max(value) FILTER (metric = 'ebit') AS cash,
 max(value) FILTER (metric = 'adjustedEbitda') AS debt, max(value) FILTER (metric = 'costOfRevenue') AS shares FROM bal GROUP BY ticker) USING (ticker))"""


@query("V13_point_balance", f"""
WITH {CAP_SQL} SELECT ticker, CASE metric WHEN 'ebit' THEN 'cash' WHEN 'adjustedEbitda' THEN 'debt' ELSE 'shares' END AS item, metric AS tag, end_date, value FROM bal WHERE metric IN ('ebit', 'adjustedEbitda', 'costOfRevenue')""")
def v13(v: Views):
    facts = v.quarters().select("ticker", c("metric").alias("tag"), "end_date", F.date_add("end_date", 30).alias("filed"), "value")
    # ebit serves as cash here, so the second choice of debt is left out
    return VA.point_balance(facts, {"cash": ["NoSuchTag", "ebit"], "debt": ["adjustedEbitda"], "shares": ["costOfRevenue"]}).select("ticker", "item", "tag", "end_date", "value")


def capital(v: Views):
    facts = v.quarters().select("ticker", c("metric").alias("tag"), "end_date", F.date_add("end_date", 30).alias("filed"), "value")
    points = VA.point_balance(facts, {"cash": ["NoSuchTag", "ebit"], "debt": ["adjustedEbitda"], "shares": ["costOfRevenue"]})
    return VA.capital_structure(points, quotes(v))


def actuals(v: Views):
    return v.cells().where(c("year").isin(ACTUALS)).withColumn("ordinal", c("year"))


def forward(v: Views):
    ltm = v.cells().where("year = 1999")
    revenue = E.merge_estimates(QE.mixed(v), [2001]).select(
        "ticker", F.concat(c("year").cast("string"), F.lit("E")).alias("period"), c("year").alias("ordinal"), "value")
    return VA.forward_cells(revenue, ltm, ["grossProfit", "ebit", "freeCashFlow"])


_CELLS = """act AS (SELECT ticker, metric, period, year AS ordinal, value FROM v_cells WHERE year BETWEEN 1997 AND 1999),
ltm AS (SELECT ticker, max(value) FILTER (metric = 'revenue') AS r, max(value) FILTER (metric = 'grossProfit') AS g, max(value) FILTER (metric = 'ebit') AS e, max(value) FILTER (metric = 'freeCashFlow') AS f FROM v_cells WHERE year = 1999 GROUP BY ticker),
fwd AS (SELECT ticker, '2001E' AS period, 2001 AS ordinal, unnest(['revenue', 'grossProfit', 'ebit', 'freeCashFlow']) AS metric, unnest([m.value, CASE WHEN r <> 0 THEN m.value * (g / r) END, CASE WHEN r <> 0 THEN m.value * (e / r) END, CASE WHEN r <> 0 THEN m.value * (f / r) END]) AS value
 FROM merged m LEFT JOIN ltm USING (ticker) WHERE year = 2001),
cells AS (SELECT ticker, metric, period, ordinal, value FROM act UNION ALL SELECT ticker, metric, period, ordinal, value FROM fwd),
mult AS (SELECT c.ticker, CASE metric WHEN 'revenue' THEN 'evRevenue' WHEN 'grossProfit' THEN 'evGrossProfit' WHEN 'ebit' THEN 'evEbit' WHEN 'adjustedEbitda' THEN 'evEbitda' ELSE 'evFreeCashFlow' END AS item, period,
 CASE WHEN c.value > 0 THEN enterprise_value / c.value END AS value FROM cells c LEFT JOIN cap USING (ticker) WHERE metric IN ('revenue', 'grossProfit', 'ebit', 'adjustedEbitda', 'freeCashFlow')),
wide AS (SELECT ticker, period, ordinal, max(value) FILTER (metric = 'revenue') AS r, max(value) FILTER (metric = 'grossProfit') AS g, max(value) FILTER (metric = 'adjustedEbitda') AS a FROM cells GROUP BY ALL),
gm AS (SELECT ticker, period, unnest(['revenueGrowth', 'grossMargin', 'ebitdaMargin']) AS item, unnest([CASE WHEN lr <> 0 THEN r / lr - 1 END, CASE WHEN r <> 0 THEN g / r END, CASE WHEN r <> 0 THEN a / r END]) AS value
 FROM (SELECT *, lag(r) OVER (PARTITION BY ticker ORDER BY ordinal) AS lr FROM wide))"""


@query("V03_valuation_table", f"""
WITH {QE._MERGED}, {CAP_SQL}, {_CELLS}
SELECT ticker, item, period, CASE WHEN period = '2001E' THEN round(value, 6) ELSE value END AS value FROM (SELECT ticker, metric AS item, period, value FROM cells UNION ALL SELECT ticker, item, period, value FROM mult UNION ALL SELECT ticker, item, period, value FROM gm
 UNION ALL SELECT ticker, unnest(['price', 'equity_value', 'debt', 'cash', 'enterprise_value']), 'Current', unnest([price, equity_value, debt, cash, enterprise_value]) FROM cap)""")
def v03(v: Views):
    table = VA.valuation_table(actuals(v), forward(v), capital(v))
    return table.withColumn("value", F.when(c("period") == "2001E", F.round("value", 6)).otherwise(c("value")))


@query("V18_valuation_columns", f"""
WITH {QE._MERGED}, {CAP_SQL}, {_CELLS}
SELECT ticker, round(max(value) FILTER (item = 'evRevenue' AND period = '1999A'), 6) AS "evRevenue_1999A", round(max(value) FILTER (item = 'evRevenue' AND period = '2001E'), 6) AS "evRevenue_2001E",
 round(max(value) FILTER (item = 'grossMargin' AND period = '1999A'), 6) AS "grossMargin_1999A" FROM (SELECT ticker, item, period, value FROM mult UNION ALL SELECT ticker, item, period, value FROM gm UNION ALL SELECT ticker, 'price', 'Current', price FROM cap) GROUP BY ticker""")
def v18(v: Views):
    table = VA.valuation_table(actuals(v), forward(v), capital(v)).withColumn("value", F.round("value", 6))
    return VA.valuation_columns(table, ["evRevenue_1999A", "evRevenue_2001E", "grossMargin_1999A"])


@query("Q16_fail_closed_forward", f"""
WITH {QE._MERGED}, {CAP_SQL}, {_CELLS} SELECT ticker, metric, period, CASE WHEN value IS NULL THEN 'MISSING_SOURCE_DATA' ELSE 'DERIVED_ESTIMATE' END AS status, CASE WHEN value IS NULL THEN 'FORWARD_BASIS_UNAVAILABLE' END AS reason
FROM (SELECT f.ticker, f.metric, f.period, CASE WHEN f.metric = 'revenue' OR u.map_pos <> 3 THEN f.value END AS value FROM fwd f JOIN v_universe u ON f.ticker = u.ticker)""")
def q16(v: Views):
    ltm = v.cells().where("year = 1999 AND region_key <> 3")
    revenue = E.merge_estimates(QE.mixed(v), [2001]).select("ticker", F.lit("2001E").alias("period"), c("year").alias("ordinal"), "value")
    cells = VA.forward_cells(revenue, ltm, ["grossProfit", "ebit", "freeCashFlow"])
    return cells.select("ticker", "metric", "period", "status", "reason")


@query("V04_apply_market", f"""
WITH {CAP_SQL}, n AS (SELECT ticker, arg_min(close, day) AS price FROM v_prices GROUP BY ticker)
SELECT ticker, CASE metric WHEN 'revenue' THEN 'evRevenue' WHEN 'grossProfit' THEN 'evGrossProfit' WHEN 'ebit' THEN 'evEbit' WHEN 'adjustedEbitda' THEN 'evEbitda' ELSE 'evFreeCashFlow' END AS item, period,
 CASE WHEN v.value > 0 THEN (n.price * shares + debt + 0 + 0 - cash + 0) / v.value END AS value FROM v_cells v JOIN cap USING (ticker) JOIN n USING (ticker) WHERE year BETWEEN 1997 AND 1999 AND metric IN ('revenue', 'grossProfit', 'ebit', 'adjustedEbitda', 'freeCashFlow')""")
def v04(v: Views):
    fresh = v.prices().groupBy("ticker").agg(F.min_by("close", "day").alias("price"))
    return VA.apply_market(actuals(v), capital(v), fresh)


@query("V05_apply_consensus", f"""
WITH {QE._MERGED}, {CAP_SQL}, {_CELLS}, stored AS (SELECT ticker, metric, period, value FROM act UNION ALL SELECT ticker, metric, '2001E', 0 FROM act WHERE period = '1999A' AND metric IN ('revenue', 'adjustedEbitda'))
SELECT ticker, metric, period, round(value, 4) AS value FROM (SELECT ticker, metric, period, value FROM fwd UNION ALL SELECT * FROM stored s WHERE NOT EXISTS (SELECT 1 FROM fwd f WHERE f.ticker = s.ticker AND f.metric = s.metric AND f.period = s.period))""")
def v05(v: Views):
    base = actuals(v).select("ticker", "metric", "period", "value")
    old = base.where("period = '1999A' AND metric IN ('revenue', 'adjustedEbitda')").withColumns({"period": F.lit("2001E"), "value": F.lit(0.0)})
    out = VA.apply_consensus(base.unionByName(old), forward(v).select("ticker", "metric", "period", "value"))
    return out.withColumn("value", F.round("value", 4))


@query("J14_assemble_valuation", """
SELECT i.ticker, price, last_day, greatest(hi, price) AS high52, least(lo, price) AS low52, CASE WHEN greatest(hi, price) <> 0 THEN price / greatest(hi, price) - 1 END AS below_high52, CASE WHEN least(lo, price) <> 0 THEN price / least(lo, price) - 1 END AS above_low52
FROM v_issuers i LEFT JOIN (SELECT ticker, arg_max(close, day) AS price FROM v_prices GROUP BY ticker) q USING (ticker) LEFT JOIN (SELECT ticker, max(close) AS hi, min(close) AS lo, max(day) AS last_day FROM v_prices WHERE day >= DATE '2000-11-01' GROUP BY ticker) h USING (ticker)""")
def j14(v: Views):
    return VA.assemble(v.issuers().select("ticker"), quotes(v), v.prices().where("day >= date'2000-11-01'"))


@query("P30_cell_value", """
SELECT w.ticker, w.metric, w.period, c.value, c.status FROM (SELECT DISTINCT ticker, metric, '1998A' AS period FROM v_cells UNION SELECT DISTINCT ticker, metric, '1980A' FROM v_cells) w LEFT JOIN v_cells c USING (ticker, metric, period)""")
def p30(v: Views):
    keys = v.cells().select("ticker", "metric").distinct()
    wanted = keys.select("ticker", "metric", F.explode(F.array(F.lit("1998A"), F.lit("1980A"))).alias("period"))
    return VA.cell_value(v.cells().select("ticker", "metric", "period", "value", "status"), wanted)


@query("V07_fundamentals_panel", f"""
WITH {CAP_SQL}, a AS (SELECT ticker, metric, max(value) FILTER (year = 1998) AS y0, max(value) FILTER (year = 1999) AS y1 FROM v_cells GROUP BY ALL), e AS (SELECT * FROM v_estimates WHERE period = '0y')
SELECT a.ticker, a.metric, y0, y1, CASE WHEN y0 <> 0 THEN (y1 - y0) / abs(y0) END AS growth, e.value AS estimate, 'FY' || year(e.end_date) || 'E' AS label, CASE WHEN y1 <> 0 THEN (e.value - y1) / abs(y1) END AS estimate_growth,
 CASE WHEN e.value > 0 THEN enterprise_value / e.value END AS ev_to_estimate FROM a LEFT JOIN e USING (ticker, metric) LEFT JOIN cap USING (ticker)""")
def v07(v: Views):
    return VA.fundamentals_panel(v.cells(), E.select_estimate(v.estimates()), capital(v), [1998, 1999])


@query("S10_read_fundamental_series", """
SELECT ticker, metric AS type, end_date AS as_of, value FROM v_quarters""")
def s10(v: Views):
    from tidemark.sources.readers import fundamental_series

    # type-keyed payload: one row per ticker and type, points bounded by the calendar
    point = F.struct(c("end_date").cast("string").alias("asOfDate"), F.struct(c("value").alias("raw")).alias("reportedValue"))
    packed = v.quarters().groupBy("ticker", "metric").agg(F.collect_list(point).alias("points"))
    return fundamental_series(packed.select("ticker", F.create_map("metric", "points").alias("series")))
