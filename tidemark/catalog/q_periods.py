"""Period queries: deduplication, standalone quarters, coverage, allocation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.views import Views
from tidemark.functions import dates as D
from tidemark.operators import periods as P

c = F.col
YEARS = [1996, 1997, 1998, 1999, 2000]

# latest filing of each filed period; clusters hold one end in the filed rows
_WIN = """win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, metric, period_type, end_date ORDER BY filed DESC, value DESC, source_id DESC) AS rn,
 count(*) OVER (PARTITION BY ticker, metric, period_type, end_date) - 1 AS alternatives FROM v_obs) WHERE rn = 1)"""
# standalone quarters from filed rows
QUARTERS_SQL = _WIN + """,
sq AS (SELECT source_id, ticker, metric, start_date, end_date, fiscal_year, fiscal_quarter, value, filed, 'REPORTED' AS authority FROM win WHERE fiscal_quarter = 1
 UNION ALL SELECT a.source_id || '|MINUS|' || b.source_id, a.ticker, a.metric, CAST(b.end_date + 1 AS DATE), a.end_date, a.fiscal_year, a.fiscal_quarter, a.value - b.value, a.filed, 'DERIVED_FROM_REPORTED_BOUNDARIES'
 FROM win a JOIN win b ON a.ticker = b.ticker AND a.metric = b.metric AND a.fiscal_year = b.fiscal_year AND a.fiscal_quarter = b.fiscal_quarter + 1 AND a.start_date = b.start_date)"""


@query("W05_dedupe_economic_periods", f"""
WITH {_WIN},
both_ AS (SELECT *, lag(end_date) OVER (PARTITION BY ticker, metric, period_type ORDER BY end_date, filed, source_id) AS pe FROM (SELECT * EXCLUDE (rn) FROM win
 UNION ALL SELECT *, 0 FROM (SELECT * REPLACE ('REPORTED' AS authority, CASE WHEN metric = 'ebit' THEN value + 5000 ELSE value END AS value) FROM v_provider))),
cl AS (SELECT *, sum(CASE WHEN pe IS NULL OR end_date - pe > 7 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker, metric, period_type ORDER BY end_date, filed, source_id) AS k FROM both_),
m AS (SELECT *, max(value) OVER w AS hi, min(value) OVER w AS lo, sum(alternatives + 1) OVER w - 1 AS alts, row_number() OVER (w ORDER BY CASE provider WHEN 'STANDARDIZED' THEN 300 ELSE 220 END DESC, filed DESC) AS rn FROM cl WINDOW w AS (PARTITION BY ticker, metric, period_type, k))
SELECT source_id, value, CAST(alts AS BIGINT) AS alternatives, CASE WHEN clash THEN 'VALUE_CONFLICT' END AS conflict FROM (SELECT *, hi - lo > greatest(1.0, abs(hi), abs(lo)) * 0.001 AS clash FROM m) WHERE rn = 1 OR clash""")
def w05(v: Views):
    provider = v.provider().withColumns({"authority": F.lit("REPORTED"), "value": F.when(c("metric") == "ebit", c("value") + 5000).otherwise(c("value"))})
    return P.dedupe_economic_periods(v.obs().unionByName(provider)).select("source_id", "value", "alternatives", "conflict")


@query("W07_cumulative_to_quarters", f"""
WITH {_WIN} SELECT a.ticker, a.metric, CASE WHEN a.fiscal_quarter = 1 THEN a.start_date ELSE CAST(b.end_date + 1 AS DATE) END AS start_date, a.end_date,
 CASE WHEN a.fiscal_quarter = 1 THEN a.value ELSE a.value - b.value END AS value, CASE WHEN a.fiscal_quarter = 1 THEN 'reported-quarter' ELSE 'normalized-cumulative-ytd' END AS derivation
FROM win a LEFT JOIN win b ON a.ticker = b.ticker AND a.metric = b.metric AND a.start_date = b.start_date AND a.fiscal_quarter = b.fiscal_quarter + 1 WHERE a.fiscal_quarter = 1 OR b.value IS NOT NULL""")
def w07(v: Views):
    return P.cumulative_to_quarters(v.obs()).select("ticker", "metric", "start_date", "end_date", "value", "derivation")


@query("W08_derive_standalone_quarters", f"WITH {QUARTERS_SQL} SELECT source_id, ticker, metric, start_date, end_date, fiscal_year, fiscal_quarter, value, authority FROM sq")
def w08(v: Views):
    quarters, _ = P.derive_standalone_quarters(v.obs())
    return quarters.select("source_id", "ticker", "metric", "start_date", "end_date", "fiscal_year", "fiscal_quarter", "value", "authority")


@query("W08_derivation_failures", f"""
WITH {_WIN} SELECT ticker, metric, fiscal_year, method, CAST(fq AS INTEGER) AS fiscal_quarter, 'VALUE_CONFLICT' AS reason FROM (SELECT DISTINCT ticker, metric, fiscal_year FROM win WHERE period_type = 'YTD_6M' AND fiscal_year = 1998),
 (VALUES ('RESOLVE_CUMULATIVE_SOURCE', NULL), ('YTD_6M_MINUS_Q1', 2), ('YTD_9M_MINUS_YTD_6M', 3)) AS t(method, fq)""")
def w08_failures(v: Views):
    obs = v.obs()
    rival = obs.where("period_type = 'YTD_6M' AND fiscal_year = 1998").withColumns({
        "value": c("value") + 5e6, "provider": F.lit("OTHER"), "source_id": F.concat(F.lit("OTHER:"), "source_id")})
    _, failures = P.derive_standalone_quarters(obs.unionByName(rival))
    return failures.select("ticker", "metric", "fiscal_year", "method", "fiscal_quarter", "reason")


@query("W09_consecutive", f"""
WITH {QUARTERS_SQL} SELECT source_id, coalesce(start_date = lag(end_date) OVER (PARTITION BY ticker, metric ORDER BY end_date) + 1, TRUE) AS follows FROM sq""")
def w09(v: Views):
    quarters, _ = P.derive_standalone_quarters(v.obs())
    window = Window.partitionBy("ticker", "metric").orderBy("end_date")
    return quarters.select("source_id", P.follows_previous(window).alias("follows"))


@query("W13_coverage", f"""
WITH {QUARTERS_SQL}, y AS (SELECT CAST(y AS INTEGER) AS year, make_date(y, 1, 1) AS lo, make_date(y, 12, 31) AS hi FROM (VALUES (1996), (1997), (1998), (1999), (2000)) t(y)),
p AS (SELECT s.ticker, s.metric, y.year, greatest(s.start_date, y.lo) AS a, least(s.end_date, y.hi) AS b, y.lo, y.hi FROM sq s JOIN y ON s.start_date <= y.hi AND s.end_date >= y.lo WHERE fiscal_quarter <> 3 OR fiscal_year <> 1998),
g AS (SELECT *, coalesce(max(b) OVER (PARTITION BY ticker, metric, year ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, lo) AS cur FROM p)
SELECT ticker, metric, year, count(*) AS intervals, CAST(sum(b - a + 1) AS BIGINT) AS covered_days, count(*) FILTER (a < cur) AS overlaps, count(*) FILTER (a > cur) + CASE WHEN max(b) < max(hi) THEN 1 ELSE 0 END AS gaps,
 count(*) FILTER (a < cur) = 0 AND sum(b - a + 1) = max(hi) - max(lo) + 1 AS complete FROM g GROUP BY ALL""")
def w13(v: Views):
    quarters, _ = P.derive_standalone_quarters(v.obs())
    return P.coverage(quarters.where("fiscal_quarter <> 3 OR fiscal_year <> 1998"), YEARS)


@query("J20_allocate_to_years", """
SELECT source_id, CAST(y AS INTEGER) AS year, CAST(least(end_date, make_date(y, 12, 31)) - greatest(start_date, make_date(y, 1, 1)) + 1 AS INTEGER) AS overlap_days, CAST(end_date - start_date + 1 AS INTEGER) AS total_days,
 value * ((least(end_date, make_date(y, 12, 31)) - greatest(start_date, make_date(y, 1, 1)) + 1) / (end_date - start_date + 1)) AS contribution,
 least(end_date, make_date(y, 12, 31)) - greatest(start_date, make_date(y, 1, 1)) <> end_date - start_date AS clipped
FROM v_all_obs JOIN (VALUES (1996), (1997), (1998), (1999), (2000)) t(y) ON year(start_date) <= y AND year(end_date) >= y""")
def j20(v: Views):
    return P.allocate_to_years(v.all_obs(), YEARS).select("source_id", "year", "overlap_days", "total_days", "contribution", "clipped")


@query("P26_bridge_kind", """
SELECT source_id, CASE WHEN period_type IN ('YTD_6M', 'YTD_9M') THEN period_type WHEN period_type = 'STANDALONE_QUARTER' AND end_date - start_date + 1 BETWEEN 75 AND 110 THEN 'YTD_3M' END AS kind FROM v_all_obs""")
def p26(v: Views):
    return v.all_obs().select("source_id", P.bridge_kind(c("period_type"), D.inclusive_days(c("start_date"), c("end_date"))).alias("kind"))


@query("P27_exact_derived", """
SELECT source_id, fiscal_quarter <> 2 AND metric <> 'ebit' AS exact FROM v_obs""")
def p27(v: Views):
    late = F.when(c("fiscal_quarter") == 2, F.date_add("end_date", 1)).otherwise(c("end_date"))
    one = lambda end: F.struct("ticker", "scope", "op_scope", "currency", "unit", "start_date", end.alias("end_date"), "authority", F.lit(None).cast("string").alias("dedup_status"))
    row = {k: c(k) for k in ("ticker", "scope", "op_scope", "currency", "unit", "start_date", "end_date")} | {"basis": F.lit("DERIVED"), "method": F.when(c("metric") == "ebit", "OTHER").otherwise("CFO_MINUS_CAPEX")}
    return v.obs().select("source_id", P.exact_derived(F.array(one(c("end_date")), one(late)), row).alias("exact"))
