"""Trailing-twelve-month and calendar-year queries over supplier quarters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.q_periods import _WIN, QUARTERS_SQL
from tidemark.catalog.registry import query
from tidemark.catalog.views import Views
from tidemark.operators import periods as P
from tidemark.operators import rollups as R
from tidemark.session import written

c = F.col
AS_OF = "2000-12-31"
YEARS = [1996, 1997, 1998, 1999, 2000]
YEARS_SQL = "(VALUES (1996), (1997), (1998), (1999), (2000)) t(y)"


def observations(v: Views):
    """Deduplicated filed rows and the standalone quarters derived from them.

    Written as Parquet, since a checkpoint computes its last stage twice; wide rows are dealt out again by ticker.
    """
    v.keep("quarter_wide")
    obs = v.dealt(written(P.dedupe_economic_periods(v.obs()), "observations"), "ticker")
    quarters, _ = P.derive_standalone_quarters(None, obs)
    return obs, written(quarters, "quarters")


FOUR_SQL = f"""
known AS (SELECT *, row_number() OVER (PARTITION BY ticker, metric ORDER BY end_date DESC) AS back, lag(end_date) OVER (PARTITION BY ticker, metric ORDER BY end_date) AS pe FROM sq WHERE end_date <= DATE '{AS_OF}'),
four AS (SELECT ticker, metric, count(*) AS n, sum(value) AS total, min(start_date) AS s, max(end_date) AS e, bool_and(back = 4 OR pe IS NULL OR start_date = pe + 1) AS ok FROM known WHERE back <= 4 GROUP BY ticker, metric)"""


@query("A01_ltm_four_quarters", f"""
WITH {QUARTERS_SQL}, {FOUR_SQL}
SELECT ticker, metric, CASE WHEN n = 4 AND ok THEN total END AS value, CASE WHEN n = 4 AND ok THEN 'VERIFIED_DERIVED' ELSE 'INSUFFICIENT_PERIOD_COVERAGE' END AS status,
 CASE WHEN n <> 4 THEN 'FOUR_CONSECUTIVE_QUARTERS_UNAVAILABLE' WHEN NOT ok THEN 'LTM_PERIOD_GAP' END AS reason, CASE WHEN n = 4 AND ok THEN s END AS ltm_start, CASE WHEN n = 4 AND ok THEN e END AS ltm_end FROM four""")
def a01(v: Views):
    _, quarters = observations(v)
    return R.ltm_four_quarters(quarters, AS_OF)


@query("A01_ltm_against_reported", f"""
WITH {QUARTERS_SQL}, {FOUR_SQL}
SELECT ticker, metric, CAST(NULL AS DOUBLE) AS value, 'STALE_SOURCE_COVERAGE' AS status, 'LATEST_REPORTED_PERIOD_NOT_INGESTED' AS reason FROM four WHERE metric = 'ebit'
UNION ALL SELECT ticker, metric, total, 'VERIFIED_DERIVED', NULL FROM four WHERE metric <> 'ebit'""")
def a01_reported(v: Views):
    _, quarters = observations(v)
    known = quarters.where(c("end_date") <= F.to_date(F.lit(AS_OF))).groupBy("ticker", "metric").agg(F.max("end_date").alias("e"))
    reported = known.select("ticker", "metric", F.when(c("metric") == "ebit", F.last_day(F.add_months("e", 3))).otherwise(F.date_sub("e", 3)).alias("period_end"))
    return R.ltm_four_quarters(quarters, AS_OF, reported).select("ticker", "metric", "value", "status", "reason")


@query("A02_ltm_simple", f"""
WITH {QUARTERS_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY ticker, metric ORDER BY end_date DESC) AS back, lag(end_date) OVER (PARTITION BY ticker, metric ORDER BY end_date) AS pe FROM sq)
SELECT ticker, metric, CASE WHEN count(*) = 4 AND bool_and(back = 4 OR start_date = pe + 1) THEN sum(value) END AS value, max(end_date) AS ltm_end,
 CASE WHEN count(*) = 4 AND bool_and(back = 4 OR start_date = pe + 1) THEN 'VERIFIED_DERIVED' ELSE 'MISSING_BUT_AVAILABLE' END AS status FROM l WHERE back <= 4 GROUP BY ticker, metric""")
def a02(v: Views):
    _, quarters = observations(v)
    return R.ltm_simple(quarters)


_PQ = """pq AS (SELECT ticker, metric, end_date, value, fiscal_year, fiscal_quarter, CASE WHEN fiscal_quarter = 1 AND metric = 'ebit' THEN 'EUR' ELSE currency END AS currency FROM v_provider)"""


def provider_quarters(v: Views):
    rows = P.dedupe_provider_quarters(v.provider())
    return rows.withColumn("currency", F.when((c("fiscal_quarter") == 1) & (c("metric") == "ebit"), "EUR").otherwise(c("currency")))


@query("A03_ltm_provider", f"""
WITH {_PQ}, l AS (SELECT *, row_number() OVER (PARTITION BY ticker, metric ORDER BY end_date DESC) AS back FROM pq WHERE end_date <= DATE '{AS_OF}')
SELECT ticker, metric, CASE WHEN count(*) = 4 AND count(DISTINCT currency) = 1 THEN sum(value) END AS value,
 concat_ws(',', CASE WHEN count(*) <> 4 THEN 'UNIQUE_QUARTER_COUNT_NOT_FOUR' END, CASE WHEN count(DISTINCT currency) <> 1 THEN 'INCONSISTENT_OR_UNKNOWN_CURRENCY' END) AS failures
FROM l WHERE back <= 4 GROUP BY ticker, metric""")
def a03(v: Views):
    return R.ltm_provider(provider_quarters(v), AS_OF).select("ticker", "metric", "value", F.array_join("failures", ",").alias("failures"))


@query("A07_calendar_year_by_quarter_end", f"""
WITH {_PQ} SELECT ticker, metric, CAST(year(end_date) AS INTEGER) AS year, CASE WHEN count(*) = 4 AND count(DISTINCT currency) = 1 THEN sum(value) END AS value,
 concat_ws(',', CASE WHEN count(*) <> 4 THEN 'UNIQUE_QUARTER_COUNT_NOT_FOUR' END, CASE WHEN count(DISTINCT currency) <> 1 THEN 'INCONSISTENT_OR_UNKNOWN_CURRENCY' END) AS failures
FROM pq GROUP BY ticker, metric, year(end_date)""")
def a07(v: Views):
    return R.calendar_year_by_quarter_end(provider_quarters(v)).select("ticker", "metric", "year", "value", F.array_join("failures", ",").alias("failures"))


DIRECT_SQL = f"""
direct AS (SELECT a.ticker, a.metric, CASE WHEN y.end_date = a.newest THEN y.value END AS value, CASE WHEN y.end_date IS NULL THEN 'LATEST_VERIFIED_FULL_YEAR_UNAVAILABLE' WHEN y.end_date < a.newest THEN 'LATEST_FULL_YEAR_PRECEDES_LATEST_OBSERVATION' END AS reason,
 CASE WHEN y.end_date = a.newest THEN y.start_date END AS ltm_start, CASE WHEN y.end_date = a.newest THEN y.end_date END AS ltm_end, CASE WHEN y.end_date = a.newest THEN 'VERIFIED_REPORTED' END AS status
 FROM (SELECT ticker, metric, max(end_date) AS newest FROM win WHERE end_date <= DATE '{AS_OF}' GROUP BY ALL) a
 LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, metric ORDER BY end_date DESC) AS back FROM win WHERE period_type = 'FISCAL_YEAR' AND end_date <= DATE '{AS_OF}' AND end_date - start_date + 1 BETWEEN 350 AND 378) WHERE back = 1) y
 ON a.ticker = y.ticker AND a.metric = y.metric)"""


@query("A04_ltm_direct_annual", f"WITH {_WIN}, {DIRECT_SQL} SELECT * FROM direct")
def a04(v: Views):
    obs, _ = observations(v)
    return R.ltm_direct_annual(obs, AS_OF)


def _bridge(limit: str) -> str:
    return f"""
kinds AS (SELECT *, CASE period_type WHEN 'STANDALONE_QUARTER' THEN 'YTD_3M' ELSE period_type END AS kind FROM win WHERE period_type <> 'FISCAL_YEAR' {limit}),
pairs AS (SELECT a.ticker, a.metric, a.kind, a.source_id AS current_id, b.source_id AS prior_id, a.value AS cv, b.value AS pv, a.start_date AS cs, a.end_date AS ce, b.start_date AS ps, b.end_date AS pe
 FROM kinds a JOIN kinds b ON a.ticker = b.ticker AND a.metric = b.metric AND a.kind = b.kind AND year(a.start_date) = year(b.start_date) + 1 AND year(a.end_date) = year(b.end_date) + 1
 AND strftime(a.start_date, '%m-%d') = strftime(b.start_date, '%m-%d') AND strftime(a.end_date, '%m-%d') = strftime(b.end_date, '%m-%d')
 AND abs((a.end_date - a.start_date) - (b.end_date - b.start_date)) <= 1),
bridge AS (SELECT p.ticker, p.metric, p.kind, y.value + p.cv - p.pv AS value, 'VERIFIED_DERIVED' AS status, CAST(p.pe + 1 AS DATE) AS ltm_start, p.ce AS ltm_end, current_id, prior_id, y.source_id AS year_id
 FROM pairs p JOIN win y ON y.period_type = 'FISCAL_YEAR' AND y.ticker = p.ticker AND y.metric = p.metric AND y.start_date = p.ps AND y.end_date + 1 = p.cs {limit.replace('end_date', 'y.end_date')})"""


BRIDGE_SQL = _bridge(f"AND end_date <= DATE '{AS_OF}'")


@query("J08_prior_year_match", f"WITH {_WIN}, {_bridge('')} SELECT ticker, metric, kind, current_id, prior_id FROM pairs")
def j08(v: Views):
    obs, _ = observations(v)
    return R.prior_year_match(obs).select("ticker", "metric", "kind", c("cur.source_id").alias("current_id"), c("pri.source_id").alias("prior_id"))


@query("J09_fy_ytd_bridge", f"WITH {_WIN}, {BRIDGE_SQL} SELECT ticker, metric, kind, value, status, ltm_start, ltm_end, current_id, prior_id, year_id FROM bridge")
def j09(v: Views):
    obs, _ = observations(v)
    return R.fy_ytd_bridge(obs, AS_OF).drop("reason")


RESOLVE_SQL = """
bb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, metric ORDER BY ltm_end DESC, current_id, year_id) AS rn FROM bridge) WHERE rn = 1),
resolved AS (SELECT d.ticker, d.metric, CASE WHEN d.value IS NOT NULL THEN d.value WHEN qv IS NOT NULL AND b.value IS NOT NULL THEN CASE WHEN f.e > b.ltm_end THEN qv WHEN f.e < b.ltm_end THEN b.value WHEN abs(qv - b.value) <= greatest(1.0, abs(b.value) * 0.005) THEN qv END
  ELSE coalesce(qv, b.value) END AS value, CASE WHEN d.value IS NOT NULL THEN 'FULL_YEAR' WHEN qv IS NOT NULL AND (b.value IS NULL OR f.e >= b.ltm_end) THEN 'FOUR_QUARTERS' WHEN b.value IS NOT NULL THEN 'FY_YTD_BRIDGE' END AS how
 FROM direct d LEFT JOIN (SELECT *, CASE WHEN n = 4 AND ok THEN total END AS qv FROM four) f ON d.ticker = f.ticker AND d.metric = f.metric LEFT JOIN bb b ON d.ticker = b.ticker AND d.metric = b.metric)"""


@query("A05_ltm_resolve", f"""
WITH {QUARTERS_SQL}, {FOUR_SQL}, {DIRECT_SQL}, {BRIDGE_SQL}, {RESOLVE_SQL}
SELECT ticker, metric, value, CASE WHEN value IS NOT NULL THEN how END AS construction FROM resolved""")
def a05(v: Views):
    obs, quarters = observations(v)
    return R.ltm_resolve(obs, quarters, AS_OF).select("ticker", "metric", "value", "construction")


CY_SQL = f"""
cells AS (SELECT DISTINCT ticker, metric, CAST(y AS INTEGER) AS year FROM win, {YEARS_SQL}),
dir AS (SELECT c.ticker, c.metric, c.year, max(w.value) AS value, count(*) AS n FROM cells c JOIN win w ON c.ticker = w.ticker AND c.metric = w.metric AND w.period_type = 'FISCAL_YEAR' AND w.end_date - w.start_date + 1 BETWEEN 350 AND 378
 AND abs(w.start_date - make_date(c.year, 1, 1)) <= 7 AND abs(w.end_date - make_date(c.year, 12, 31)) <= 7 GROUP BY ALL),
br AS (SELECT ticker, metric, year(ltm_end) AS year, value FROM (SELECT *, row_number() OVER (PARTITION BY ticker, metric, ltm_end ORDER BY current_id, year_id) AS rn FROM bridge WHERE strftime(ltm_end, '%m-%d') = '12-31' AND strftime(ltm_start, '%m-%d') = '01-01' AND year(ltm_end) = year(ltm_start)) WHERE rn = 1),
qs AS (SELECT c.ticker, c.metric, c.year, count(*) AS n, sum(value) AS total, sum(least(end_date, make_date(c.year, 12, 31)) - greatest(start_date, make_date(c.year, 1, 1)) + 1) AS covered,
 bool_and(start_date >= make_date(c.year, 1, 1) AND end_date <= make_date(c.year, 12, 31)) AS inside FROM cells c JOIN sq s ON c.ticker = s.ticker AND c.metric = s.metric AND s.start_date <= make_date(c.year, 12, 31) AND s.end_date >= make_date(c.year, 1, 1) GROUP BY ALL),
cy AS (SELECT c.ticker, c.metric, c.year, CASE WHEN d.n = 1 THEN d.value WHEN b.value IS NOT NULL THEN b.value WHEN q.covered = make_date(c.year, 12, 31) - make_date(c.year, 1, 1) + 1 THEN q.total END AS value,
 CASE WHEN d.n = 1 THEN 'REPORTED_CALENDAR_YEAR' WHEN b.value IS NOT NULL THEN 'EXACT_DERIVED_CALENDAR_YEAR' WHEN q.covered = make_date(c.year, 12, 31) - make_date(c.year, 1, 1) + 1 THEN 'EXACT_FROM_CALENDAR_QUARTERS' END AS classification,
 CASE WHEN d.n = 1 THEN 'VERIFIED_REPORTED' WHEN b.value IS NOT NULL OR q.covered = make_date(c.year, 12, 31) - make_date(c.year, 1, 1) + 1 THEN 'VERIFIED_DERIVED' ELSE 'INSUFFICIENT_PERIOD_COVERAGE' END AS status
 FROM cells c LEFT JOIN dir d USING (ticker, metric, year) LEFT JOIN br b USING (ticker, metric, year) LEFT JOIN qs q USING (ticker, metric, year))"""


@query("A06_calendar_year", f"WITH {QUARTERS_SQL}, {_bridge('')}, {CY_SQL} SELECT ticker, metric, year, value, classification, status FROM cy")
def a06(v: Views):
    obs, quarters = observations(v)
    return R.calendar_year(obs, quarters, YEARS).select("ticker", "metric", "year", "value", "classification", "status")


@query("A06_calendar_year_from_quarters", f"""
WITH {QUARTERS_SQL}, y AS (SELECT CAST(y AS INTEGER) AS year FROM {YEARS_SQL}), sh AS (SELECT ticker, metric, value, CAST(start_date + 15 AS DATE) AS start_date, CAST(end_date + 15 AS DATE) AS end_date, source_id FROM sq),
keys AS (SELECT DISTINCT ticker, metric, year FROM sh, y),
p AS (SELECT k.ticker, k.metric, k.year, count(*) AS n, sum(least(end_date, make_date(k.year, 12, 31)) - greatest(start_date, make_date(k.year, 1, 1)) + 1) AS covered,
 list_sum(list(value * ((least(end_date, make_date(k.year, 12, 31)) - greatest(start_date, make_date(k.year, 1, 1)) + 1) / (end_date - start_date + 1)) ORDER BY start_date)) AS total
 FROM keys k JOIN sh s ON k.ticker = s.ticker AND k.metric = s.metric AND s.start_date <= make_date(k.year, 12, 31) AND s.end_date >= make_date(k.year, 1, 1) GROUP BY ALL)
SELECT k.ticker, k.metric, k.year, CASE WHEN covered = make_date(k.year, 12, 31) - make_date(k.year, 1, 1) + 1 THEN round(total, 4) END AS value,
 CASE WHEN covered = make_date(k.year, 12, 31) - make_date(k.year, 1, 1) + 1 THEN 'CALENDARIZED_ESTIMATE' END AS classification FROM keys k LEFT JOIN p USING (ticker, metric, year)""")
def a06_estimate(v: Views):
    _, quarters = observations(v)
    # quarters that straddle the year end: allocated by days
    shifted = quarters.withColumns({"start_date": F.date_add("start_date", 15), "end_date": F.date_add("end_date", 15)})
    out = R.calendar_year(shifted, shifted, YEARS)
    return out.select("ticker", "metric", "year", F.round("value", 4).alias("value"), "classification")


@query("A08_calendar_year_ledger", f"""
WITH {QUARTERS_SQL}, s AS (SELECT ticker, metric, year(end_date) AS year, count(*) AS n, sum(value) AS total, bool_or(fiscal_quarter = 2 AND fiscal_year = 1998 AND metric = 'ebit') AS bad FROM sq WHERE year(end_date) BETWEEN 1996 AND 2000 GROUP BY ALL),
a AS (SELECT ticker, metric, year(end_date) AS year, value FROM win WHERE period_type = 'FISCAL_YEAR' AND strftime(start_date, '%m-%d') = '01-01' AND strftime(end_date, '%m-%d') = '12-31' AND year(end_date) BETWEEN 1996 AND 2000)
SELECT ticker, metric, CAST(year AS INTEGER) AS year, CASE WHEN n = 4 AND NOT bad THEN total ELSE value END AS value,
 CASE WHEN n = 4 AND NOT bad THEN 'CALENDAR_YEAR_DERIVED' WHEN value IS NOT NULL THEN 'CALENDAR_YEAR_REPORTED' WHEN bad THEN 'SOURCE_OR_RECONCILIATION_REQUIRES_REVIEW' ELSE 'PARTIAL_STANDALONE_QUARTER_COVERAGE' END AS method
FROM s FULL JOIN a USING (ticker, metric, year)""")
def a08(v: Views):
    obs, quarters = observations(v)
    bad = (c("fiscal_quarter") == 2) & (c("fiscal_year") == 1998) & (c("metric") == "ebit")
    marked = quarters.withColumn("validation", F.when(bad, "FAILED").otherwise("VALID"))
    return R.calendar_year_ledger(marked, obs.where("period_type = 'FISCAL_YEAR'"), YEARS)


@query("A09_allocated_year_sum", f"""
SELECT ticker, metric, CAST(y AS INTEGER) AS year, round(sum(value * ((least(end_date, make_date(y, 12, 31)) - greatest(start_date, make_date(y, 1, 1)) + 1) / (end_date - start_date + 1))), 4) AS value,
 bool_or(start_date < make_date(y, 1, 1) OR end_date > make_date(y, 12, 31)) AS derived, count(*) AS components
FROM v_provider JOIN {YEARS_SQL} ON year(start_date) <= y AND year(end_date) >= y GROUP BY ALL""")
def a09(v: Views):
    return R.allocated_year_sum(v.provider(), YEARS).withColumn("value", F.round("value", 4))


@query("A15_annual_reconciliation", f"""
WITH {QUARTERS_SQL} SELECT y.ticker, y.metric, y.start_date, y.end_date, max(y.value) AS annual, sum(q.value) AS quarter_sum, abs(sum(q.value) - max(y.value)) <= greatest(1.0, abs(sum(q.value)), abs(max(y.value))) * 0.001 AS reconciles
FROM v_obs y JOIN sq q ON y.ticker = q.ticker AND y.metric = q.metric AND q.start_date >= y.start_date AND q.end_date <= y.end_date WHERE y.form = '10-K' GROUP BY ALL HAVING count(*) = 4""")
def a15(v: Views):
    _, quarters = observations(v)
    return R.annual_reconciliation(quarters, v.obs().where("form = '10-K'"))


@query("Q24_series_compatible", """
SELECT ticker, fiscal_year, count(DISTINCT u) = 1 AS same_series, count(DISTINCT definition) <= 1 AS same_definition FROM (SELECT *, CASE WHEN metric = 'ebit' AND fiscal_quarter = 2 THEN 'EUR' ELSE unit END AS u FROM v_obs WHERE metric IN ('ebit')) GROUP BY ALL
UNION ALL SELECT ticker, fiscal_year + 10000, TRUE, FALSE FROM v_obs WHERE metric <> 'ebit' GROUP BY ALL""")
def q24(v: Views):
    rows = v.obs().withColumns({"unit": F.when((c("metric") == "ebit") & (c("fiscal_quarter") == 2), "EUR").otherwise(c("unit")),
                                "fiscal_year": c("fiscal_year") + F.when(c("metric") == "ebit", 0).otherwise(10000)})
    return R.series_compatible(rows, ["ticker", "fiscal_year"])


ROLLING_SQL = """
roll AS (SELECT ticker, metric, end_date AS ltm_end, min(start_date) OVER w AS ltm_start, count(*) OVER w AS n, sum(value) OVER w AS total, bool_and(step) OVER (PARTITION BY ticker, metric ORDER BY end_date ROWS 2 PRECEDING) AS ok,
  min(cur) OVER w = max(cur) OVER w AS onec FROM (SELECT *, coalesce(start_date = lag(end_date) OVER (PARTITION BY ticker, metric ORDER BY end_date) + 1, FALSE) AS step, CASE WHEN metric = 'ebit' AND fiscal_year >= 2000 THEN 'EUR' ELSE 'USD' END AS cur FROM sq)
 WINDOW w AS (PARTITION BY ticker, metric ORDER BY end_date ROWS 3 PRECEDING)),
rolling AS (SELECT ticker, metric, ltm_start, ltm_end, CASE WHEN ok AND onec THEN total END AS value, CASE WHEN NOT ok THEN 'LTM_QUARTERS_NOT_CONTIGUOUS' WHEN NOT onec THEN 'CURRENCY_INCOMPATIBLE' END AS reason FROM roll WHERE n = 4)"""


def rolling(v: Views):
    obs, quarters = observations(v)
    mixed = quarters.withColumn("currency", F.when((c("metric") == "ebit") & (c("fiscal_year") >= 2000), "EUR").otherwise(c("currency")))
    return obs, R.rolling_four_quarters(mixed)


@query("W10_rolling_four_quarters", f"WITH {QUARTERS_SQL}, {ROLLING_SQL} SELECT * FROM rolling")
def w10(v: Views):
    return rolling(v)[1]


@query("W12_choose_ltm", f"""
WITH {QUARTERS_SQL}, {ROLLING_SQL}, {_bridge('')},
cand AS (SELECT ticker, metric, ltm_start, ltm_end, value, 'DIRECT_REPORTED_LTM' AS derivation, 3 AS q FROM (SELECT ticker, metric, start_date AS ltm_start, end_date AS ltm_end, value FROM win WHERE period_type = 'FISCAL_YEAR' AND metric = 'revenue')
 UNION ALL SELECT ticker, metric, ltm_start, ltm_end, value, 'SUM_OF_FOUR_QUARTERS', 2 FROM rolling WHERE reason IS NULL
 UNION ALL SELECT ticker, metric, ltm_start, ltm_end, value, 'FY_PLUS_CURRENT_YTD_MINUS_PRIOR_YTD', 1 FROM bridge WHERE metric <> 'ebit'),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, metric ORDER BY ltm_end DESC, q DESC) AS rn FROM cand) WHERE rn = 1),
bad AS (SELECT ticker, metric, max(ltm_end) AS e FROM rolling WHERE reason = 'CURRENCY_INCOMPATIBLE' GROUP BY ALL)
SELECT b.ticker, b.metric, ltm_start, ltm_end, value, derivation, CASE WHEN e > ltm_end THEN 'CURRENCY_INCOMPATIBLE' END AS stale_reason, CASE WHEN e > ltm_end THEN e END AS stale_end FROM best b LEFT JOIN bad USING (ticker, metric)""")
def w12(v: Views):
    obs, rows = rolling(v)
    direct = obs.where("period_type = 'FISCAL_YEAR' AND metric = 'revenue'").select("ticker", "metric", c("start_date").alias("ltm_start"), c("end_date").alias("ltm_end"), "value")
    return R.choose_ltm(direct, rows, R.fy_ytd_bridge(obs.where("metric <> 'ebit'")))


@query("W15_period_growth", f"""
SELECT ticker, metric, fiscal_year, value, CASE WHEN lag(value) OVER w <> 0 THEN value / lag(value) OVER w - 1 END AS growth FROM v_cumulative WHERE fiscal_quarter = 4 WINDOW w AS (PARTITION BY ticker, metric ORDER BY fiscal_year)""")
def w15(v: Views):
    return R.period_growth(v.cumulative().where("fiscal_quarter = 4").select("ticker", "metric", "fiscal_year", "value"), "fiscal_year")


@query("Q15_ltm_freshness", f"""
WITH {QUARTERS_SQL}, {FOUR_SQL} SELECT ticker, metric, CASE WHEN n = 4 AND ok AND e >= DATE '2000-12-31' THEN total END AS value,
 CASE WHEN n = 4 AND ok AND e < DATE '2000-12-31' THEN 'REQUIRES_REVIEW' WHEN n = 4 AND ok THEN 'VERIFIED_DERIVED' ELSE 'INSUFFICIENT_PERIOD_COVERAGE' END AS status FROM four""")
def q15(v: Views):
    _, quarters = observations(v)
    expected = v.issuers().select("ticker", F.to_date(F.lit("2000-12-31")).alias("expected_end"))
    return R.ltm_freshness(R.ltm_four_quarters(quarters, AS_OF), expected).select("ticker", "metric", "value", "status")


@query("A29_required_gaps", f"""
WITH {QUARTERS_SQL}, {_bridge('')}, {CY_SQL.replace('(1996)', '(1994), (1996)')} SELECT DISTINCT ticker, metric, 'CY' AS purpose, make_date(year, 1, 1) AS gap_start, make_date(year, 12, 31) AS gap_end FROM cy WHERE value IS NULL""")
def a29(v: Views):
    obs, quarters = observations(v)
    cells = R.calendar_year(obs, quarters, [1994, *YEARS]).withColumns({
        "purpose": F.lit("CY"), "gap_start": F.make_date("year", F.lit(1), F.lit(1)), "gap_end": F.make_date("year", F.lit(12), F.lit(31))})
    return R.required_gaps(cells)


@query("U05_except_keys", f"""
SELECT DISTINCT ticker, metric, fiscal_year FROM v_cumulative WHERE fiscal_quarter = 4 AND (ticker, metric, fiscal_year) NOT IN (SELECT ticker, metric, fiscal_year FROM v_cumulative WHERE fiscal_quarter = 4 AND region_key = 2)""")
def u05(v: Views):
    cells = v.cumulative().where("fiscal_quarter = 4")
    keys = ["ticker", "metric", "fiscal_year"]
    return cells.select(keys).distinct().join(cells.where("region_key = 2").select(keys), keys, "left_anti")
