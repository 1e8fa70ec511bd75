"""Audit, sanity, promotion and comparison queries over yearly metric cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.q_valuation import CAP_SQL, capital
from tidemark.catalog.registry import query
from tidemark.catalog.views import Views
from tidemark.operators import quality as Q

c = F.col
METRICS = ["revenue", "costOfRevenue", "operatingCashFlow", "capitalExpenditures", "ebit", "adjustedEbitda", "grossProfit", "freeCashFlow"]
PERIODS = [f"{y}A" for y in range(1995, 2002)]
VER = "('VERIFIED_REPORTED', 'VERIFIED_DERIVED')"


def auditable(v: Views):
    """Metric cells and their multiples, with a few wrong recomputations."""
    cells = v.cells().select("ticker", "metric", "period", "value", c("value").alias("recomputed"), F.when(c("status") == "VERIFIED_REPORTED", "Filed actual").otherwise(
        "Derived Calculation").alias("source_type"), c("status").alias("source_status"), F.lit(False).alias("manual"), "reason")
    ev = v.cells().where("metric IN ('revenue', 'ebit')").join(capital(v).select("ticker", "enterprise_value"), "ticker")
    ratio = F.when(c("value") > 0, c("enterprise_value") / c("value"))
    multiples = ev.select("ticker", F.when(c("metric") == "revenue", "evRevenue").otherwise("evEbit").alias("metric"), "period", ratio.alias("value"),
                          F.when(c("year") == 1996, ratio * 2).otherwise(ratio).alias("recomputed"), F.lit("Derived Calculation").alias("source_type"), c("status").alias("source_status"),
                          F.lit(False).alias("manual"), "reason")
    price = capital(v).select("ticker", F.lit("price").alias("metric"), F.lit("Current").alias("period"), c("price").alias("value"), F.lit(None).cast("double").alias("recomputed"),
                              F.lit("Market quote").alias("source_type"), F.lit(None).cast("string").alias("source_status"), F.lit(False).alias("manual"), F.lit(None).cast("string").alias("reason"))
    return cells.unionByName(multiples).unionByName(price)


_AUD = CAP_SQL + f""",
aud AS (SELECT ticker, metric, period, CASE WHEN metric IN ('costOfRevenue') THEN CASE WHEN status = 'VERIFIED_REPORTED' THEN 'VERIFIED' ELSE 'VERIFIED WITH WARNING' END ELSE status END AS audit_status, reason, TRUE AS ok FROM v_cells
 UNION ALL SELECT v.ticker, CASE metric WHEN 'revenue' THEN 'evRevenue' ELSE 'evEbit' END, period, CASE WHEN status NOT IN {VER} THEN status WHEN enterprise_value / value IS NULL OR value <= 0 THEN 'UNVERIFIED' WHEN year = 1996 THEN 'FAILED' ELSE 'VERIFIED_DERIVED' END, reason, value IS NULL OR NOT (year = 1996 AND enterprise_value / value <> 0)
 FROM v_cells v JOIN cap USING (ticker) WHERE metric IN ('revenue', 'ebit')
 UNION ALL SELECT ticker, 'price', 'Current', 'VERIFIED WITH WARNING', NULL, TRUE FROM cap)"""


@query("Q02_audit_cells", f"WITH {_AUD} SELECT ticker, metric, period, audit_status, audit_status IN ('VERIFIED', 'VERIFIED_REPORTED', 'VERIFIED_DERIVED') AS displayable FROM aud")
def q02(v: Views):
    return Q.audit_cells(auditable(v)).select("ticker", "metric", "period", "audit_status", "displayable")


@query("Q03_audit_summary", f"""
WITH {_AUD} SELECT count(*) AS total, CAST(0 AS BIGINT) AS stale, count(*) FILTER (contains(lower(reason), 'conflict')) AS conflicts, count(*) FILTER (NOT ok) AS mismatches,
 count(DISTINCT CASE WHEN audit_status IN ('UNVERIFIED', 'FAILED', 'REQUIRES_REVIEW', 'INSUFFICIENT_PERIOD_COVERAGE') THEN ticker END) AS incomplete_companies FROM aud""")
def q03(v: Views):
    return Q.audit_summary(Q.audit_cells(auditable(v)))


@query("P19_strictly_displayable", f"WITH {_AUD} SELECT ticker, metric, period, CASE WHEN suffix(period, 'A') THEN audit_status IN {VER} ELSE audit_status IN ('VERIFIED', 'VERIFIED_REPORTED', 'VERIFIED_DERIVED') END AS shown FROM aud")
def p19(v: Views):
    return Q.audit_cells(auditable(v)).select("ticker", "metric", "period", Q.strictly_displayable(c("audit_status"), c("period").endswith("A")).alias("shown"))


@query("A20_status_summary", "SELECT ticker, status, count(*) AS n FROM v_cells GROUP BY ticker, status UNION ALL SELECT NULL, status, count(*) FROM v_cells GROUP BY status UNION ALL SELECT NULL, NULL, count(*) FROM v_cells")
def a20(v: Views):
    return Q.status_summary(v.cells())


@query("A21_root_cause", """
SELECT CASE WHEN reason = 'VALUE_CONFLICT' THEN 'Restated or conflicting SEC fact' WHEN metric = 'capitalExpenditures' THEN 'Missing capex component' ELSE 'Unavailable source coverage' END AS cause, count(*) AS n FROM v_cells GROUP BY 1""")
def a21(v: Views):
    return Q.root_causes(v.cells().withColumn("method", F.when(c("metric") == "capitalExpenditures", "capital-lookup").otherwise("lookup")))


@query("A22_provider_metadata_audit", """
SELECT provider, count(*) AS observations, count(start_date) AS with_start, count(fiscal_year) AS with_fiscal_year, count(fiscal_quarter) AS with_fiscal_quarter, count(filed) AS with_filing_date, count(accession) AS with_accession,
 count(scope) AS with_scope, count(source_id) AS with_source, count(*) FILTER (start_date IS NULL) AS with_only_end FROM (SELECT * REPLACE (CASE WHEN fiscal_quarter <> 2 THEN start_date END AS start_date) FROM v_all_obs) GROUP BY provider""")
def a22(v: Views):
    return Q.provider_metadata_audit(v.all_obs().withColumn("start_date", F.when(c("fiscal_quarter") != 2, c("start_date"))))


def run_a(v: Views):
    return v.cells()


def run_b(v: Views):
    """A later run: one metric recovered, one regressed, one changed, one ticker region missing."""
    cells = v.cells().where("NOT (region_key = 4 AND metric = 'costOfRevenue')")
    lost = (c("metric") == "freeCashFlow") & (c("year") == 1999) & (c("region_key") == 0)
    status = F.when((c("metric") == "ebit") & (c("year") == 1997), "VERIFIED_DERIVED").when(lost, "MISSING_SOURCE_DATA").otherwise(c("status"))
    value = F.when((c("metric") == "ebit") & (c("year") == 1997), 5.0).when(lost, F.lit(None)).when(c("metric") == "grossProfit", c("value") + 1e7).otherwise(c("value"))
    return cells.withColumns({"status": status, "value": value, "reason": F.when(lost, "SOURCE_TIMEOUT").otherwise(c("reason"))})


_B = """rb AS (SELECT ticker, metric, year, period, region_key, CASE WHEN metric = 'ebit' AND year = 1997 THEN 5.0 WHEN lost THEN NULL WHEN metric = 'grossProfit' THEN value + 1e7 ELSE value END AS value,
 CASE WHEN metric = 'ebit' AND year = 1997 THEN 'VERIFIED_DERIVED' WHEN lost THEN 'MISSING_SOURCE_DATA' ELSE status END AS status, CASE WHEN lost THEN 'SOURCE_TIMEOUT' ELSE reason END AS reason
 FROM (SELECT *, metric = 'freeCashFlow' AND year = 1999 AND region_key = 0 AS lost FROM v_cells WHERE NOT (region_key = 4 AND metric = 'costOfRevenue')))"""
_DIFF = _B + f""",
diff AS (SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.metric, b.metric) AS metric, coalesce(a.period, b.period) AS period, a.status AS before_status, b.status AS after_status,
 CASE WHEN b.status IN {VER} AND NOT coalesce(a.status IN {VER}, FALSE) THEN 'RECOVERED' WHEN NOT coalesce(b.status IN {VER}, FALSE) AND a.status IN {VER} THEN 'REGRESSED' WHEN NOT coalesce(b.status IN {VER}, FALSE) THEN 'REMAINING' ELSE 'STABLE' END AS change
 FROM v_cells a FULL JOIN rb b ON a.ticker = b.ticker AND a.metric = b.metric AND a.period = b.period)"""


@query("J17_audit_diff", f"WITH {_DIFF} SELECT * FROM diff")
def j17(v: Views):
    return Q.audit_diff(run_a(v), run_b(v))


@query("Q22_exception_report", f"WITH {_DIFF} SELECT d.ticker, d.metric, d.period, change, r.value, r.reason FROM diff d LEFT JOIN rb r USING (ticker, metric, period) WHERE change <> 'STABLE'")
def q22(v: Views):
    return Q.exception_report(run_a(v), run_b(v)).select("ticker", "metric", "period", "change", "value", "reason")


_SHADOW = _B + """,
sh AS (SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.metric, b.metric) AS metric, coalesce(a.period, b.period) AS period, b.value IS NOT NULL AND (a.value IS NULL OR abs(CASE WHEN a.value <> 0 THEN (b.value - a.value) / abs(a.value) ELSE b.value - a.value END) > 0.001) AS different,
 b.value IS NULL AS unavailable, b.status, b.reason FROM v_cells a FULL JOIN rb b ON a.ticker = b.ticker AND a.metric = b.metric AND a.period = b.period)"""


def compared(v: Views):
    return Q.shadow_compare(run_a(v), run_b(v).withColumn("classification", F.lit("REPORTED_CALENDAR_YEAR")))


@query("Q21_shadow_compare", f"""
WITH {_SHADOW} SELECT ticker, metric, period, different, unavailable, CASE WHEN NOT different AND NOT unavailable THEN NULL WHEN status = 'INSUFFICIENT_PERIOD_COVERAGE' THEN status WHEN reason = 'VALUE_CONFLICT' THEN 'SOURCE_VALUE_CONFLICT'
 WHEN unavailable THEN 'MISSING_PROVIDER_PERIOD' ELSE 'PERIOD_CLASSIFICATION_DIFFERENCE' END AS cause FROM sh""")
def q21(v: Views):
    return compared(v).select("ticker", "metric", "period", "different", "unavailable", "cause")


@query("A23_comparison_summary", f"""
WITH {_SHADOW} SELECT count(*) FILTER (NOT different AND NOT unavailable) AS matching, count(*) FILTER (different) AS different, count(*) FILTER (unavailable) AS unavailable, CAST(0 AS BIGINT) AS stale,
 count(*) FILTER (status = 'REQUIRES_REVIEW') AS requires_review, CAST(0 AS BIGINT) AS definition_incompatible, count(*) FILTER (status IN ('INSUFFICIENT_PERIOD_COVERAGE', 'MISSING_SOURCE_DATA')) AS insufficient_coverage, CAST(0 AS BIGINT) AS operation_scope_incompatible FROM sh""")
def a23(v: Views):
    return Q.comparison_summary(compared(v))


@query("J18_golden_compare", f"""
WITH {_B} SELECT a.ticker, a.metric, a.period, a.value AS expected, b.value AS actual, ok AS match, CASE WHEN ok THEN NULL WHEN b.value IS NULL THEN coalesce(b.reason, 'PRODUCTION_VALUE_MISSING') WHEN a.value IS NULL THEN 'PRODUCTION_VALUE_PRESENT_WHERE_GOLDEN_IS_NA' ELSE 'VALUE_MISMATCH' END AS root_cause
FROM v_cells a LEFT JOIN rb b USING (ticker, metric, period), LATERAL (SELECT CASE WHEN a.value IS NULL THEN b.value IS NULL ELSE coalesce(abs(b.value - a.value) <= greatest(1.0, abs(a.value) * 1e-9), FALSE) END AS ok)""")
def j18(v: Views):
    return Q.golden_compare(run_a(v), run_b(v).withColumn("method", c("reason")), ["ticker", "metric", "period"]).drop("method")


@query("J15_completeness_grid", f"""
WITH {_B}, g AS (SELECT ticker, unnest({METRICS}) AS metric, p.period FROM v_issuers, (SELECT unnest({PERIODS}) AS period) p)
SELECT ticker, metric, period, 'MISSING_AUDIT_CELL' AS reason FROM g WHERE NOT EXISTS (SELECT 1 FROM rb WHERE rb.ticker = g.ticker AND rb.metric = g.metric AND rb.period = g.period)
UNION ALL SELECT ticker, metric, period, 'DUPLICATE_AUDIT_CELL' FROM g WHERE metric = 'revenue' AND EXISTS (SELECT 1 FROM rb WHERE rb.ticker = g.ticker AND rb.metric = g.metric AND rb.period = g.period)""")
def j15(v: Views):
    cells = run_b(v)
    return Q.completeness_grid(v.issuers(), cells.unionByName(cells.where("metric = 'revenue'")), METRICS, PERIODS)


@query("J26_fill_cell_grid", f"""
WITH g AS (SELECT ticker, unnest({METRICS}) AS metric, p.period FROM v_issuers, (SELECT unnest({PERIODS}) AS period) p) SELECT ticker, metric, period, value, coalesce(status, 'MISSING_SOURCE_DATA') AS status FROM g LEFT JOIN v_cells USING (ticker, metric, period)""")
def j26(v: Views):
    return Q.fill_cell_grid(v.issuers(), v.cells(), METRICS, PERIODS, "MISSING_SOURCE_DATA")


@query("Q04_historical_audit_issues", f"""
SELECT ticker, metric, period, status, issue FROM (
 SELECT *, 'MANDATORY_CELL_UNRESOLVED' AS issue FROM v_cells WHERE value IS NULL AND status IN ('REQUIRES_REVIEW', 'INSUFFICIENT_PERIOD_COVERAGE')
 UNION ALL SELECT *, 'NULL_WITHOUT_EXPLICIT_REASON' FROM v_cells WHERE value IS NULL AND region_key = 2
 UNION ALL SELECT *, 'VALUE_WITHOUT_COMPONENT_LINEAGE' FROM v_cells WHERE value IS NOT NULL AND metric = 'costOfRevenue'
 UNION ALL SELECT *, 'INCOMPLETE_COMPONENT_PROVENANCE' FROM v_cells WHERE value IS NOT NULL AND metric = 'grossProfit')""")
def q04(v: Views):
    part = F.struct(F.lit("FILED").alias("provider"), F.when(c("metric") != "grossProfit", c("ticker")).alias("source_id"), F.lit(None).cast("date").alias("start_date"), F.make_date("year", F.lit(12), F.lit(31)).alias("end_date"),
                    c("year").alias("fiscal_year"), F.lit(4).alias("fiscal_quarter"), F.lit("D").alias("definition"), F.lit("U").alias("op_scope"))
    records = v.cells().withColumns({"components": F.when(c("metric") == "costOfRevenue", F.filter(F.array(part), lambda x: F.lit(False))).otherwise(F.array(part)), "search_completed": F.lit(True),
                                     "reason": F.when(c("region_key") != 2, c("reason"))})
    return Q.audit_issues(records)


@query("Q05_economic_sanity", """
WITH w AS (SELECT ticker, year, max(value) FILTER (metric = 'revenue') AS r, max(value) FILTER (metric = 'grossProfit') AS g, max(value) FILTER (metric = 'adjustedEbitda') AS a, max(value) FILTER (metric = 'freeCashFlow') AS f, max(value) FILTER (metric = 'operatingCashFlow') AS o FROM v_cells GROUP BY ALL),
p AS (SELECT w.*, b.r AS pr, b.g AS pg, b.a AS pa FROM w LEFT JOIN w b ON w.ticker = b.ticker AND w.year = b.year + 1)
SELECT ticker, year, metric, flag FROM (SELECT ticker, year, 'grossProfit' AS metric, 'NEGATIVE_GROSS_PROFIT' AS flag FROM p WHERE g < 0
 UNION ALL SELECT ticker, year, 'grossProfit', 'EXTREME_GROSS_MARGIN' FROM p WHERE r <> 0 AND (g / r < -0.25 OR g / r > 1.1) UNION ALL SELECT ticker, year, 'adjustedEbitda', 'EXTREME_ADJ_EBITDA_MARGIN' FROM p WHERE r <> 0 AND (a / r < -2 OR a / r > 1.5)
 UNION ALL SELECT ticker, year, 'freeCashFlow', 'EXTREME_FCF_MARGIN' FROM p WHERE r <> 0 AND (f / r < -2 OR f / r > 2) UNION ALL SELECT ticker, year, 'revenue', 'LARGE_YOY_REVENUE_CHANGE' FROM p WHERE pr <> 0 AND (r / pr - 1 < -0.75 OR r / pr - 1 > 3)
 UNION ALL SELECT ticker, year, 'grossProfit', 'LARGE_YOY_MARGIN_CHANGE' FROM p WHERE r <> 0 AND pr <> 0 AND abs(g / r - pg / pr) > 0.75 UNION ALL SELECT ticker, year, 'adjustedEbitda', 'LARGE_YOY_MARGIN_CHANGE' FROM p WHERE r <> 0 AND pr <> 0 AND abs(a / r - pa / pr) > 0.75
 UNION ALL SELECT ticker, year, 'freeCashFlow', 'FCF_DIRECTION_INCONSISTENT_WITH_CFO' FROM p WHERE f > o + greatest(1.0, abs(o)) * 0.001)""".replace("v_cells GROUP BY ALL), p", "v_cells GROUP BY ALL), p").replace("max(value) FILTER (metric = 'grossProfit') AS g,", "max(value - 6e6) FILTER (metric = 'grossProfit') AS g,"))
def q05(v: Views):
    shifted = v.cells().withColumn("value", F.when(c("metric") == "grossProfit", c("value") - 6e6).otherwise(c("value")))
    return Q.economic_sanity(shifted)


@query("Q06_result_sanity", """
SELECT v.ticker, v.metric, v.period, CASE WHEN bad IS NULL THEN nv END AS value, CASE WHEN bad IS NULL THEN v.status ELSE 'REQUIRES_REVIEW' END AS status, coalesce(bad, v.reason) AS reason
FROM (SELECT *, CASE WHEN metric = 'revenue' AND year = 1997 THEN -value WHEN metric = 'grossProfit' AND year = 1998 THEN value * 2 ELSE value END AS nv FROM v_cells) v
LEFT JOIN (SELECT ticker, period, CASE WHEN year = 1997 THEN -value ELSE value END AS r FROM v_cells WHERE metric = 'revenue') x USING (ticker, period),
LATERAL (SELECT CASE WHEN metric = 'revenue' AND nv < 0 THEN 'NEGATIVE_REVENUE' WHEN metric = 'grossProfit' AND nv > r * 1.01 THEN 'GROSS_PROFIT_EXCEEDS_REVENUE' END AS bad)""")
def q06(v: Views):
    broken = v.cells().withColumn("value", F.when((c("metric") == "revenue") & (c("year") == 1997), -c("value")).when((c("metric") == "grossProfit") & (c("year") == 1998), c("value") * 2).otherwise(c("value")))
    return Q.result_sanity(broken).select("ticker", "metric", "period", "value", "status", "reason")


@query("Q07_apply_derivation_failures", """
SELECT ticker, metric, period, CASE WHEN hit THEN NULL ELSE value END AS value, CASE WHEN hit THEN 'OPERATION_SCOPE_INCOMPATIBLE' ELSE status END AS status FROM (SELECT *, metric = 'freeCashFlow' AND (ticker, period) IN (SELECT DISTINCT ticker, year(end_date) || 'A' FROM v_obs WHERE restated) AS hit FROM v_cells)""")
def q07(v: Views):
    failures = v.obs().where("restated").select("ticker", "end_date", F.lit("OPERATION_SCOPE_INCOMPATIBLE").alias("reason"))
    return Q.apply_derivation_failures(v.cells(), failures).select("ticker", "metric", "period", "value", "status")


@query("Q08_snapshot_state", """
SELECT ticker, CASE WHEN region_key = 0 OR region_key = 1 THEN 'INCOMPATIBLE' WHEN region_key = 2 THEN 'STALE' ELSE 'READY' END AS state, CASE region_key WHEN 0 THEN 'ENGINE_VERSION_MISMATCH' WHEN 1 THEN 'ACTUAL_YEAR_SET_MISMATCH' ELSE '' END AS reasons FROM v_issuers""")
def q08(v: Views):
    r = c("region_key")
    healthy = v.cells().where("metric = 'adjustedEbitda' AND year = 1999").select("ticker", (Q.metric_health(c("status"), c("value")) == "HEALTHY").alias("healthy"))
    snapshots = v.issuers().join(healthy, "ticker", "left").select(
        "ticker", F.when(r == 0, "v1").otherwise("v2").alias("engine_version"), F.when(r == 1, F.array(F.lit(1999))).otherwise(F.array(F.lit(1999), F.lit(1998))).alias("actual_years"),
        F.when(r == 2, F.lit("2001-01-01")).otherwise(F.lit("2001-05-20")).cast("timestamp").alias("updated_at"), F.lit(True).alias("valid"), F.coalesce("healthy", F.lit(True)).alias("healthy"))
    out = Q.snapshot_state(snapshots, "v2", [1998, 1999], F.to_date(F.lit("2001-06-01")))
    return out.select("ticker", "state", F.array_join("reasons", ",").alias("reasons"))


def with_end(df):
    return df.withColumn("latest_end", F.make_date("year", F.lit(12), F.lit(31)))


@query("Q09_promote_snapshot", f"""
WITH {_B}, o AS (SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.metric, b.metric) AS metric, coalesce(a.period, b.period) AS period, a.value AS av, a.status AS ast, b.value AS bv, b.status AS bst, a.ticker IS NOT NULL AS old, b.ticker IS NOT NULL AS new,
 a.value IS NOT NULL AND a.status IN {VER} AND NOT coalesce(b.value IS NOT NULL AND b.status IN {VER}, FALSE) AND (b.ticker IS NULL OR b.status = 'MISSING_SOURCE_DATA') AS deg FROM v_cells a FULL JOIN rb b ON a.ticker = b.ticker AND a.metric = b.metric AND a.period = b.period),
t AS (SELECT ticker, bool_or(deg) AS rej FROM o GROUP BY ticker)
SELECT ticker, metric, period, CASE WHEN rej THEN av ELSE bv END AS value, CASE WHEN rej THEN ast ELSE bst END AS status, CASE WHEN rej THEN 'RETAINED' ELSE 'ACCEPTED' END AS decision, deg AS degraded FROM o JOIN t USING (ticker) WHERE CASE WHEN rej THEN old ELSE new END""")
def q09(v: Views):
    return Q.promote_snapshot(with_end(run_a(v)), with_end(run_b(v))).select("ticker", "metric", "period", "value", "status", "decision", "degraded")


@query("Q10_migrate_snapshot", """
SELECT ticker, sum(value) AS value, 'SUM_OF_FOUR_QUARTERS' AS derivation, min(start_date) AS ltm_start, max(end_date) AS ltm_end, 'v2' AS version, TRUE AS migrated
FROM v_quarters WHERE metric = 'adjustedEbitda' AND year(start_date) = 2000 GROUP BY ticker""")
def q10(v: Views):
    from tidemark.operators.company_metric import migrate_ltm

    # a trailing cell per ticker without bounds, with the four quarters it was built from
    recent = v.quarters().where("metric = 'adjustedEbitda' AND start_date >= date'2000-01-01' AND start_date < date'2001-01-01'")
    part = F.struct(c("start_date").alias("source_start"), c("end_date").alias("source_end"), F.lit(None).cast("string").alias("role"), c("value").alias("normalized_value"))
    cells = recent.groupBy("ticker").agg(F.sort_array(F.collect_list(part)).alias("components"), F.sum("value").alias("value"))
    return migrate_ltm(cells.withColumns({"derivation": F.lit("SUM_OF_FOUR_QUARTERS"), "ltm_start": F.lit(None).cast("date"), "ltm_end": F.lit(None).cast("date"), "version": F.lit("v1")}), "v2").drop("components")


@query("Q23_conflict_candidates")
def q23(v: Views):
    from tidemark.operators import periods as P

    provider = v.provider().withColumns({"authority": F.lit("REPORTED"), "value": F.when(c("metric") == "ebit", c("value") + 5000).otherwise(c("value"))})
    return Q.conflict_candidates(P.dedupe_economic_periods(v.obs().unionByName(provider)))


@query("Q26_company_metric_complete", f"""
SELECT ticker, count(DISTINCT CASE WHEN value IS NOT NULL AND status IN {VER} THEN period END) = 2 AS complete FROM v_cells WHERE metric = 'adjustedEbitda' AND period IN ('1999A', CASE WHEN region_key = 3 THEN '1998A' ELSE '1997A' END) GROUP BY ticker""")
def q26(v: Views):
    cells = v.cells().withColumn("period", F.when((c("period") == "1998A") & (c("region_key") == 3), "1997A").when((c("period") == "1997A") & (c("region_key") == 3), "1998A").otherwise(c("period")))
    return Q.company_metric_complete(cells, ["1999A", "1997A"])


@query("Q27_audit_records", """
SELECT ticker, metric, period, CASE WHEN metric <> 'adjustedEbitda' OR year <> 1999 THEN value END AS displayed_value, CASE WHEN metric = 'adjustedEbitda' AND year = 1999 THEN 'REQUIRES_REVIEW' ELSE status END AS validation_status,
 CASE WHEN metric = 'adjustedEbitda' AND year = 1999 THEN 'LINEAGE_MISMATCH' WHEN value IS NULL THEN reason END AS failure_reason FROM v_cells""")
def q27(v: Views):
    return Q.audit_records(v.cells().withColumn("invariant_failure", F.when((c("metric") == "adjustedEbitda") & (c("year") == 1999), "LINEAGE_MISMATCH")))


@query("S17_read_audited_cells", f"""
WITH {_B}, own AS (SELECT * FROM rb WHERE region_key = 1) SELECT ticker, metric, period, value, status FROM own UNION ALL SELECT ticker, metric, period, value, status FROM v_cells WHERE ticker NOT IN (SELECT ticker FROM own)""")
def s17(v: Views):
    columns = ["ticker", "metric", "period", "value", "status"]
    return Q.read_audited_cells(run_b(v).where("region_key = 1").select(columns), run_a(v).select(columns))


@query("U04_replace_rows", f"""
WITH {_B} SELECT ticker, metric, period, value FROM rb WHERE region_key = 2 UNION ALL SELECT ticker, metric, period, value FROM v_cells WHERE region_key <> 2""")
def u04(v: Views):
    columns = ["ticker", "metric", "period", "value"]
    return Q.replace_rows(run_a(v).select(columns), run_b(v).where("region_key = 2").select(columns))


@query("S15_latest_compatible_ledger", """
SELECT ticker, max(fetched) AS fetched FROM (SELECT ticker, fiscal_year, TIMESTAMP '2001-01-01 00:00:00' + INTERVAL (fiscal_year - 1995) HOUR AS fetched, CASE WHEN fiscal_year <= 2000 THEN 6 ELSE 5 END AS ver FROM v_fiscal) WHERE ver = 6 GROUP BY ticker""")
def s15(v: Views):
    from tidemark.sources.readers import latest_compatible_ledger

    stamp = F.timestamp_add("HOUR", c("fiscal_year") - 1995, F.lit("2001-01-01 00:00:00").cast("timestamp"))
    store = v.fiscal().select("ticker", stamp.alias("fetched"), F.when(c("fiscal_year") <= 2000, 6).otherwise(5).alias("schema_version"), F.lit("INLINE").alias("source_kind"))
    best = latest_compatible_ledger(store, 6, F.lit("2001-01-01 12:00:00").cast("timestamp"))
    return best.select("ticker", "fetched").distinct()
