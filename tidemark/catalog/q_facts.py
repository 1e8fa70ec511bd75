"""Fact scanning, policies, candidate selection and metric pairing over supplier quarters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.views import Views
from tidemark.functions import dates as D
from tidemark.functions import numbers as N
from tidemark.operators import facts as A
from tidemark.operators import periods as PD
from tidemark.operators.keyed import prefer

c = F.col
CONCEPT_SQL = """CASE concept WHEN 'Revenues' THEN 'revenue' WHEN 'SalesRevenueNet' THEN 'revenue' WHEN 'TotalRevenues' THEN 'revenue'
 WHEN 'CostOfRevenue' THEN 'costOfRevenue' WHEN 'NetCashProvidedByUsedInOperatingActivities' THEN 'operatingCashFlow'
 WHEN 'PaymentsToAcquirePropertyPlantAndEquipment' THEN 'capitalExpenditures' WHEN 'OperatingIncomeLoss' THEN 'ebit' ELSE 'adjustedEbitda' END"""


def with_metrics(v: Views):
    return v.ledger().withColumn("metrics", A.metric_candidates(c("namespace"), c("concept"), c("label")))


def company_facts(v: Views):
    """Nested fact payloads: one row per ticker and concept, items bounded by the calendar."""
    item = F.struct(c("start_date").cast("string").alias("start"), c("end_date").cast("string").alias("end"), c("value").alias("val"), "form",
                    c("filed").cast("string").alias("filed"), c("accession").alias("accn"), F.lit(None).cast("string").alias("fp"), "segment")
    items = v.ledger().groupBy("ticker", "namespace", "concept", "label").agg(F.collect_list(item).alias("items"))
    body = F.struct(c("label").alias("label"), F.create_map(F.lit("USD"), c("items"), F.lit("shares"), F.slice("items", 1, 1)).alias("units"))
    return items.select("ticker", F.create_map("namespace", F.create_map("concept", body)).alias("facts"))


@query("S04_read_company_facts", f"""
SELECT ticker, namespace, concept, currency, start_date, end_date, value AS val, CAST(end_date - start_date AS INTEGER) + 1 AS duration_days, namespace = 'company' AS company_extension,
 sha256(ticker || ':' || namespace || ':' || concept || ':USD:' || CAST(start_date AS VARCHAR) || ':' || CAST(end_date AS VARCHAR) || ':' || accession || ':' || coalesce(segment, '')) AS id
FROM v_ledger WHERE end_date - start_date + 1 BETWEEN 45 AND 400""")
def s04(v: Views):
    return A.read_company_facts(company_facts(v)).select(
        "ticker", "namespace", "concept", "currency", "start_date", "end_date", "val", "duration_days", "company_extension", "id")


@query("S05_read_company_fact_candidates", f"""
SELECT l.ticker, {CONCEPT_SQL} AS metric, concept, value, accession, filed, CAST(year(end_date) + CASE WHEN month(end_date) > fye_month THEN 1 ELSE 0 END AS INTEGER) AS fiscal_year,
 CAST(4 - round(((fye_month - month(end_date) + 12) % 12) / 3) AS INTEGER) AS fiscal_quarter,
 CASE WHEN end_date - start_date + 1 <= 120 THEN 'STANDALONE_QUARTER' WHEN end_date - start_date + 1 <= 220 THEN 'YTD_6M' WHEN end_date - start_date + 1 <= 310 THEN 'YTD_9M' ELSE 'FISCAL_YEAR' END AS period_type
FROM v_ledger l JOIN v_issuers i ON l.ticker = i.ticker WHERE segment IS NULL AND end_date <= DATE '2000-06-30' AND filed <= DATE '2000-06-30'
 AND {CONCEPT_SQL} IN ('revenue', 'capitalExpenditures', 'ebit')""")
def s05(v: Views):
    rows = A.company_fact_candidates(company_facts(v), v.issuers().select("ticker", "fye_month"), ["revenue", "capitalExpenditures", "ebit"], "2000-06-30")
    return rows.select("ticker", "metric", "concept", "value", "accession", "filed", "fiscal_year", "fiscal_quarter", "period_type")


@query("S06_read_supplemental_facts", """
SELECT source_id, CASE WHEN fiscal_quarter = 1 THEN NULL ELSE start_date END AS start_date, CASE WHEN fiscal_quarter = 1 THEN 'UNKNOWN' ELSE 'REPORTED' END AS authority, period_type, value
FROM v_obs WHERE metric IN ('revenue', 'capitalExpenditures') AND end_date <= DATE '2000-06-30' AND filed <= DATE '2000-06-30'""")
def s06(v: Views):
    q1 = c("fiscal_quarter") == 1
    records = v.obs().withColumns({"segment": F.lit(None).cast("string"), "explicit_mapping": q1,
                                   "authority": F.when(q1, "INFERRED").when(c("fiscal_quarter") > 2, c("authority"))})
    rows = A.supplemental_candidates(records, ["revenue", "capitalExpenditures"], "2000-06-30")
    return rows.select("source_id", "start_date", "authority", "period_type", "value")


def provider_rows(v: Views):
    """Provider feed: thousands, some rows without a currency, capex negative."""
    names = {"revenue": "revenue", "operatingCashFlow": "net_cash_from_operating_activities", "capitalExpenditures": "total_capex", "ebit": "ebit_margin"}
    name = F.lit(None).cast("string")
    for metric, provider in names.items():
        name = F.when(c("metric") == metric, provider).otherwise(name)
    rows = v.provider().where(c("metric").isin(list(names))).withColumn("provider_metric", name)
    sign = F.when(c("metric") == "capitalExpenditures", -1.0).otherwise(1.0)
    return rows.select(
        "source_id", "ticker", "provider_metric", (c("value") * sign).alias("raw_value"),
        F.when(c("fiscal_quarter") == 1, F.when(c("metric") == "revenue", "USD thousands").otherwise("thousands")).otherwise("USD").alias("units"),
        F.lit(None).cast("string").alias("currency"), F.when(c("fiscal_quarter") != 2, c("start_date")).alias("start_date"), "end_date", "fiscal_year", "fiscal_quarter",
        F.lit(None).cast("string").alias("date_authority"), F.when(c("fiscal_quarter") == 4, "Product segment").otherwise("Company total").alias("scope"),
        F.lit(None).cast("string").alias("confidence"), F.when(c("fiscal_quarter") > 2, F.lit("u")).alias("source_url"), "filed")


_PROV = """prov AS (SELECT *, CASE metric WHEN 'revenue' THEN 'revenue' WHEN 'operatingCashFlow' THEN 'net_cash_from_operating_activities' WHEN 'capitalExpenditures' THEN 'total_capex' ELSE 'ebit_margin' END AS provider_metric,
 value * CASE WHEN fiscal_quarter = 1 THEN 1000.0 ELSE 1 END AS scaled FROM v_provider WHERE metric IN ('revenue','operatingCashFlow','capitalExpenditures','ebit'))"""


@query("S07_read_provider_quarters", f"""
WITH {_PROV} SELECT source_id, provider_metric, end_date FROM (SELECT *, row_number() OVER (PARTITION BY ticker, provider_metric ORDER BY end_date DESC) AS rn FROM prov WHERE provider_metric <> 'ebit_margin') WHERE rn <= 20""")
def s07(v: Views):
    return A.last_quarters(provider_rows(v)).select("source_id", "provider_metric", "end_date")


@query("J13_repair_units", f"WITH {_PROV} SELECT source_id, 'USD' AS currency, fiscal_quarter = 1 AND metric <> 'revenue' AS unit_repaired FROM prov")
def j13(v: Views):
    return A.repair_units(provider_rows(v)).select("source_id", "currency", "unit_repaired")


@query("P12_adapt_provider_row", f"""
WITH {_PROV} SELECT source_id, CASE WHEN metric <> 'ebit' THEN metric END AS metric, scaled AS value, CASE WHEN fiscal_quarter <> 2 THEN 'INFERRED' ELSE 'UNKNOWN' END AS authority,
 CASE WHEN fiscal_quarter = 4 THEN 'PRODUCT SEGMENT' ELSE 'CONSOLIDATED' END AS scope, 'STANDALONE_QUARTER' AS period_type, CASE WHEN metric = 'ebit' THEN 'UNSUPPORTED_PROVIDER_METRIC' END AS reason FROM prov""")
def p12(v: Views):
    rows = A.adapt_provider_rows(A.repair_units(provider_rows(v)))
    positive = F.when(c("metric") == "capitalExpenditures", c("value")).otherwise(c("value"))
    return rows.select("source_id", "metric", positive.alias("value"), "authority", "scope", "period_type", "reason")


@query("P13_normalize_quarter", f"""
WITH {_PROV} SELECT source_id, scaled AS value, CASE WHEN fiscal_quarter = 1 AND metric <> 'revenue' THEN NULL ELSE 'USD' END AS currency, fiscal_quarter <> 4 AS scope_valid,
 CASE WHEN fiscal_quarter = 4 THEN 'PRODUCT SEGMENT' ELSE 'CONSOLIDATED' END AS scope, CASE WHEN fiscal_quarter > 2 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence,
 CASE WHEN fiscal_quarter <> 2 THEN 'STANDALONE_QUARTER' ELSE 'UNKNOWN' END AS period_type FROM prov""")
def p13(v: Views):
    return A.normalize_quarters(provider_rows(v)).select("source_id", "value", "currency", "scope_valid", "scope", "confidence", "period_type")


@query("P03_classify_period", """
SELECT source_id, CASE WHEN d BETWEEN 70 AND 120 THEN 'STANDALONE_QUARTER' WHEN d BETWEEN 150 AND 220 THEN 'YTD_6M' WHEN d BETWEEN 230 AND 310 THEN 'YTD_9M' WHEN d BETWEEN 330 AND 380 THEN 'FISCAL_YEAR' ELSE 'UNKNOWN' END AS inferred,
 CASE WHEN authority = 'REPORTED' AND d NOT BETWEEN 45 AND 130 THEN 'UNKNOWN' ELSE 'STANDALONE_QUARTER' END AS as_quarter FROM (SELECT *, end_date - start_date + 1 AS d FROM v_all_obs)""")
def p03(v: Views):
    s, e = c("start_date"), c("end_date")
    return v.all_obs().select("source_id", D.classify_period(s, e).alias("inferred"), D.classify_period(s, e, F.lit(" 3m "), c("authority")).alias("as_quarter"))


@query("P04_type_matches_duration", """
SELECT source_id, CASE period_type WHEN 'STANDALONE_QUARTER' THEN d BETWEEN 45 AND 130 WHEN 'YTD_6M' THEN d BETWEEN 150 AND 220 WHEN 'YTD_9M' THEN d BETWEEN 230 AND 310 WHEN 'FISCAL_YEAR' THEN d BETWEEN 330 AND 380 ELSE TRUE END AS own,
 d BETWEEN 350 AND 380 AS calendar_year FROM (SELECT *, end_date - start_date + 1 AS d FROM v_all_obs)""")
def p04(v: Views):
    days = D.inclusive_days(c("start_date"), c("end_date"))
    return v.all_obs().select("source_id", D.type_matches_duration(c("period_type"), days).alias("own"), D.type_matches_duration(F.lit("CALENDAR_YEAR"), days).alias("calendar_year"))


@query("P05_available_as_of", "SELECT source_id FROM v_all_obs WHERE end_date <= DATE '1999-03-31' AND filed <= DATE '1999-03-31'")
def p05(v: Views):
    return v.all_obs().where(A.available_as_of(c("filed"), c("end_date"), "1999-03-31")).select("source_id")


@query("P06_metric_candidates", f"SELECT accession, concept, segment, {CONCEPT_SQL} AS metrics FROM v_ledger")
def p06(v: Views):
    return with_metrics(v).select("accession", "concept", "segment", F.array_join("metrics", ",").alias("metrics"))


_SCOPED = """CASE form WHEN '10-Q' THEN 'from continuing operations' WHEN '10-K/A' THEN 'including discontinued operations' ELSE label END"""


def scoped_label():
    return F.when(c("form") == "10-Q", "from continuing operations").when(c("form") == "10-K/A", "including discontinued operations").otherwise(c("label"))


@query("P07_operation_scope", """
SELECT accession, concept, segment, CASE form WHEN '10-Q' THEN 'CONTINUING_OPERATIONS' WHEN '10-K/A' THEN 'TOTAL_INCLUDING_DISCONTINUED' ELSE 'UNSPECIFIED' END AS op_scope FROM v_ledger""")
def p07(v: Views):
    return v.ledger().select("accession", "concept", "segment", A.operation_scope(c("concept"), scoped_label()).alias("op_scope"))


@query("J21_split_operation_evidence", """
WITH e AS (SELECT DISTINCT ticker, accession, start_date, end_date FROM v_obs WHERE form = '10-K' AND metric = 'operatingCashFlow')
SELECT o.source_id, CASE WHEN e.accession IS NOT NULL THEN 'TOTAL_INCLUDING_DISCONTINUED' ELSE 'UNSPECIFIED' END AS op_scope
FROM v_obs o LEFT JOIN e USING (ticker, accession, start_date, end_date) WHERE o.metric = 'operatingCashFlow'""")
def j21(v: Views):
    flows = v.obs().where("metric = 'operatingCashFlow'")
    text = F.explode(F.when(c("form") == "10-K", F.array(F.lit("Operating activities, continuing operations"), F.lit("Operating activities, discontinued operations")))
                     .otherwise(F.array(F.lit("Operating activities, continuing operations"))))
    facts = flows.select("ticker", "accession", "start_date", "end_date", F.lit("NetCash").alias("concept"), text.alias("label"))
    return A.apply_split_evidence(flows, A.split_operation_evidence(facts)).select("source_id", "op_scope")


@query("P09_fiscal_labels", "SELECT ticker, metric, end_date, fiscal_year, fiscal_quarter FROM v_fiscal")
def p09(v: Views):
    rows = v.quarters().join(v.issuers(), "ticker")
    return rows.select("ticker", "metric", "end_date", D.fiscal_year(c("end_date"), c("fye_month")).alias("fiscal_year"),
                       D.fiscal_quarter(c("end_date"), c("fye_month"), F.lit("FY")).alias("fiscal_quarter"))


@query("P10_unit_scale_currency", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1e3 WHEN '2-HIGH' THEN 1e6 WHEN '3-MEDIUM' THEN 1e9 ELSE 1.0 END AS scale,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'USD' WHEN '2-HIGH' THEN 'EUR' WHEN '4-NOT SPECIFIED' THEN 'GBP' END AS currency FROM orders""")
def p10(v: Views):
    p = c("o_orderpriority")
    units = F.when(p == "1-URGENT", "USD (thousands)").when(p == "2-HIGH", "eur mm").when(p == "3-MEDIUM", "billions of shares").when(p == "4-NOT SPECIFIED", "GBP").otherwise("ratio")
    return v.table("orders").select("o_orderkey", N.unit_scale(units).alias("scale"), N.currency_of(F.lit(None).cast("string"), units).alias("currency"))


@query("P11_reporting_scope", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'GEOGRAPHIC AREA' WHEN 'O' THEN 'CONSOLIDATED' ELSE 'UNKNOWN' END AS scope, o_orderstatus = 'O' AS valid FROM orders""")
def p11(v: Views):
    raw = F.when(c("o_orderstatus") == "F", " Geographic area").when(c("o_orderstatus") == "O", "company wide").otherwise("other")
    scope, valid = A.reporting_scope(raw, F.lit(False))
    return v.table("orders").select("o_orderkey", scope.alias("scope"), valid.alias("valid"))


@query("P20_source_shape", """
SELECT source_id, CASE WHEN basis = 'DERIVED' THEN 'Derived standardized metric' WHEN form IS NOT NULL THEN 'Filed actual' ELSE 'Provider actual' END AS source_type FROM v_all_obs""")
def p20(v: Views):
    return v.all_obs().select("source_id", A.source_shape(c("form"), c("basis") == "DERIVED").alias("source_type"))


@query("P21_lineage", """
SELECT metric, provider, source_id, accession, filed, value, currency, unit, scope, op_scope, period_type, start_date, end_date, basis, definition FROM v_all_obs""")
def p21(v: Views):
    return v.all_obs().select(A.lineage()).select("lineage.*")


@query("P25_component_struct", """
SELECT source_id, CAST(least(end_date, DATE '1998-12-31') - greatest(start_date, DATE '1998-01-01') AS INTEGER) + 1 AS overlap_days, CAST(end_date - start_date AS INTEGER) + 1 AS total_days,
 value * ((least(end_date, DATE '1998-12-31') - greatest(start_date, DATE '1998-01-01') + 1) / (end_date - start_date + 1)) AS contribution
FROM v_all_obs WHERE start_date <= DATE '1998-12-31' AND end_date >= DATE '1998-01-01'""")
def p25(v: Views):
    lo, hi = F.to_date(F.lit("1998-01-01")), F.to_date(F.lit("1998-12-31"))
    days = D.overlap_days(c("start_date"), c("end_date"), lo, hi)
    parts = v.all_obs().where(days > 0).select(A.component(days).alias("x"))
    return parts.select("x.source_id", "x.overlap_days", "x.total_days", "x.contribution")


@query("P22_compact_components", """
SELECT ticker, metric, fiscal_year, CAST(least(8, count(DISTINCT source_id)) AS INTEGER) AS kept FROM v_all_obs GROUP BY ALL""")
def p22(v: Views):
    # one fiscal year of one series: a handful of periods per array
    doubled = v.all_obs().withColumn("__x", F.explode(F.array(F.lit(1), F.lit(2)))).select("ticker", "metric", "fiscal_year", A.component().alias("x"))
    packed = doubled.groupBy("ticker", "metric", "fiscal_year").agg(F.collect_list("x").alias("xs"))
    return packed.select("ticker", "metric", "fiscal_year", F.size(A.compact_components(c("xs"))).alias("kept"))


@query("P31_has_authoritative_bounds", "SELECT source_id, authority = 'REPORTED' AS authoritative FROM v_all_obs")
def p31(v: Views):
    return v.all_obs().select("source_id", D.has_authoritative_bounds(c("start_date"), c("end_date"), c("authority")).alias("authoritative"))


@query("P32_map_period_type", """
SELECT source_id, CASE WHEN fiscal_quarter = 3 THEN 'YTD_9M' WHEN fiscal_quarter = 2 THEN 'STANDALONE_QUARTER' ELSE
 CASE WHEN end_date - start_date + 1 BETWEEN 70 AND 120 THEN 'STANDALONE_QUARTER' WHEN end_date - start_date + 1 BETWEEN 330 AND 380 THEN 'FISCAL_YEAR' ELSE 'UNKNOWN' END END AS period_type FROM v_obs""")
def p32(v: Views):
    q = c("fiscal_quarter")
    return v.obs().select("source_id", A.map_period_type(F.when(q == 3, "9M"), F.when(q != 2, c("start_date")), c("end_date"), c("authority"), q, "QUARTERLY").alias("period_type"))


@query("P24_reported_period_valid", """
SELECT source_id, CASE form WHEN '10-Q' THEN TRUE WHEN '10-K' THEN FALSE ELSE FALSE END AS valid FROM v_obs""")
def p24(v: Views):
    evidence = F.when(c("form") == "10-Q", "FORM_REPORT_PERIOD").otherwise("EARNINGS_EXHIBIT_PERIOD")
    return v.obs().select("source_id", A.reported_period_valid(c("form"), evidence, F.lit(True), c("end_date")).alias("valid"))


@query("Q01_validate_observation", """
SELECT source_id, concat_ws(',', CASE WHEN fiscal_quarter = 2 THEN 'MISSING_CURRENCY' END, CASE WHEN metric = 'ebit' THEN 'INVALID_OPERATION_SCOPE' END,
 CASE WHEN fiscal_quarter = 3 AND authority = 'REPORTED' THEN 'INCOMPLETE_PERIOD_RANGE' WHEN fiscal_quarter = 3 THEN 'INCOMPLETE_PERIOD_RANGE' END,
 CASE WHEN authority = 'REPORTED' AND fiscal_quarter = 4 THEN 'PERIOD_TYPE_DURATION_CONFLICT' END) AS failures FROM v_all_obs""")
def q01(v: Views):
    q = c("fiscal_quarter")
    bad = v.all_obs().withColumns({
        "currency": F.when(q != 2, c("currency")), "op_scope": F.when(c("metric") != "ebit", c("op_scope")), "end_date": F.when(q != 3, c("end_date")),
        "period_type": F.when((q == 4) & (c("authority") == "REPORTED"), "YTD_9M").otherwise(c("period_type"))})
    return bad.select("source_id", F.array_join(A.observation_failures(), ",").alias("failures"))


@query("W01_latest_filed_per_period", """
SELECT ticker, concept, start_date, end_date, value FROM (SELECT *, row_number() OVER (PARTITION BY ticker, concept, start_date, end_date ORDER BY filed DESC, accession DESC) AS rn
 FROM v_ledger WHERE segment IS NULL) WHERE rn = 1""")
def w01(v: Views):
    return A.latest_filed_per_period(v.ledger().where("segment IS NULL")).select("ticker", "concept", "start_date", "end_date", "value")


_W02 = """
WITH r AS (SELECT *, CASE concept WHEN 'Revenues' THEN 0 WHEN 'SalesRevenueNet' THEN 1 ELSE 100 END AS cr,
 CASE WHEN end_date - start_date + 1 >= 330 THEN CASE form WHEN '10-K/A' THEN 0 WHEN '10-K' THEN 1 ELSE 16 END ELSE CASE form WHEN '10-Q' THEN 1 WHEN '10-K/A' THEN 3 WHEN '10-K' THEN 4 END END AS fr
 FROM v_ledger WHERE segment IS NULL AND concept IN ('Revenues', 'SalesRevenueNet', 'TotalRevenues')),
w AS (SELECT *, row_number() OVER (PARTITION BY ticker, start_date, end_date ORDER BY cr, fr, filed DESC, accession DESC) AS rn, count(*) OVER (PARTITION BY ticker, start_date, end_date) - 1 AS alternatives,
 max(value) OVER (PARTITION BY ticker, start_date, end_date, concept) AS hi, min(value) OVER (PARTITION BY ticker, start_date, end_date, concept) AS lo FROM r)"""


@query("W02_select_source_fact", _W02 + """
SELECT ticker, start_date, end_date, concept, value, alternatives, restated, CASE WHEN restated THEN 'LATEST_AUTHORITATIVE_COMPARABLE_RECAST' WHEN cr = 100 THEN 'COMPANY_EXTENSION_ECONOMIC_CONCEPT' ELSE 'HIGHEST_PRIORITY_STANDARD_CONCEPT' END AS decision
FROM (SELECT *, NOT (abs(hi - value) <= greatest(1.0, abs(hi), abs(value)) * 1e-6 AND abs(lo - value) <= greatest(1.0, abs(lo), abs(value)) * 1e-6) AS restated FROM w WHERE rn = 1)""")
def w02(v: Views):
    return A.select_source_fact(with_metrics(v), "revenue").select("ticker", "start_date", "end_date", "concept", "value", "alternatives", "restated", "decision")


def candidates(v: Views):
    rows = v.ledger().where("segment IS NULL AND concept IN ('Revenues', 'SalesRevenueNet', 'TotalRevenues')")
    return rows.withColumns({"metric": F.lit("revenue"), "op_scope": F.when(c("form") == "10-K/A", "CONTINUING_OPERATIONS").otherwise("UNSPECIFIED"),
                             "authority": F.lit("REPORTED"), "period_type": D.classify_period(c("start_date"), c("end_date"))})


@query("W03_select_candidate_period", """
WITH r AS (SELECT *, CASE WHEN form = '10-K/A' THEN 'CONTINUING_OPERATIONS' ELSE 'UNSPECIFIED' END AS op_scope, CASE concept WHEN 'Revenues' THEN 0 WHEN 'SalesRevenueNet' THEN 1 ELSE 100 END AS cr FROM v_ledger
 WHERE segment IS NULL AND concept IN ('Revenues', 'SalesRevenueNet', 'TotalRevenues')),
n AS (SELECT *, row_number() OVER (PARTITION BY ticker, start_date, end_date, op_scope ORDER BY cr, filed DESC, accession DESC) AS rn, count(*) OVER (PARTITION BY ticker, start_date, end_date, op_scope) - 1 AS competing FROM r)
SELECT ticker, start_date, end_date, op_scope, concept, value, CAST(competing AS INTEGER) AS competing, 0 AS conflicts, 'HIGH' AS confidence FROM n WHERE rn = 1""")
def w03(v: Views):
    return A.select_candidate_period(candidates(v), "revenue").select("ticker", "start_date", "end_date", "op_scope", "concept", "value", "competing", "conflicts", "confidence")


@query("W04_prefer_operation_scope", """
SELECT source_id, op_scope FROM (SELECT *, row_number() OVER (PARTITION BY ticker, metric, period_type, calendar_id, fiscal_year, fiscal_quarter
 ORDER BY CASE authority WHEN 'REPORTED' THEN 0 ELSE 2 END, CASE op_scope WHEN 'CONTINUING_OPERATIONS' THEN 0 ELSE 2 END, filed DESC, source_id DESC) AS rn
 FROM (SELECT * REPLACE (CASE WHEN restated THEN 'CONTINUING_OPERATIONS' ELSE 'TOTAL_INCLUDING_DISCONTINUED' END AS op_scope) FROM v_all_obs)) WHERE rn = 1""")
def w04(v: Views):
    rows = v.all_obs().withColumn("op_scope", F.when(c("restated"), "CONTINUING_OPERATIONS").otherwise("TOTAL_INCLUDING_DISCONTINUED"))
    return A.prefer_operation_scope(rows).select("source_id", "op_scope")


@query("W06_dedupe_provider_quarters", """
SELECT ticker, metric, ticker || ':' || fiscal_year || ':' || fiscal_quarter AS economic_quarter_id, count(*) AS sources, arg_max(source_id, {'p': CASE provider WHEN 'STANDARDIZED' THEN 320 ELSE 220 END, 'f': filed, 's': source_id}) AS source_id,
 arg_max(value, {'p': CASE provider WHEN 'STANDARDIZED' THEN 320 ELSE 220 END, 'f': filed, 's': source_id}) AS value
FROM v_all_obs WHERE period_type = 'STANDALONE_QUARTER' GROUP BY ticker, metric, fiscal_year, fiscal_quarter""")
def w06(v: Views):
    rows = v.all_obs().where("period_type = 'STANDALONE_QUARTER'")
    return PD.dedupe_provider_quarters(rows).select("ticker", "metric", "economic_quarter_id", "sources", "source_id", "value")


@query("J03_match_provider_to_filed", """
SELECT p.source_id, f.source_id AS filed_id FROM v_provider p JOIN v_obs f ON p.ticker = f.ticker AND p.metric = f.metric AND f.period_type = 'STANDALONE_QUARTER' AND abs(p.end_date - f.end_date) <= 7
 AND p.fiscal_year = f.fiscal_year AND p.fiscal_quarter = f.fiscal_quarter QUALIFY count(*) OVER (PARTITION BY p.source_id) = 1""")
def j03(v: Views):
    return A.match_provider_to_filed(v.provider(), v.obs()).select("source_id", "filed_id")


@query("J23_enrich_with_period_evidence", """
SELECT p.source_id, coalesce(f.start_date, p.start_date) AS start_date, coalesce(f.end_date, p.end_date) AS end_date, coalesce(f.authority, p.authority) AS authority,
 CASE WHEN f.source_id IS NULL THEN 'NONE' WHEN abs(p.value - f.value) <= greatest(1.0, abs(p.value), abs(f.value)) * 0.001 THEN 'FILED_PERIOD_ATTACHED' ELSE 'VALUE_MISMATCH' END AS evidence,
 CASE WHEN abs(p.value - f.value) > greatest(1.0, abs(p.value), abs(f.value)) * 0.001 THEN 'REQUIRES_REVIEW' END AS dedup_status
FROM (SELECT * REPLACE (CASE WHEN metric = 'ebit' THEN value + 5000 ELSE value END AS value) FROM v_provider) p LEFT JOIN v_obs f ON p.ticker = f.ticker AND p.metric = f.metric
 AND f.period_type = 'STANDALONE_QUARTER' AND abs(p.end_date - f.end_date) <= 7 AND p.fiscal_year = f.fiscal_year AND p.fiscal_quarter = f.fiscal_quarter""")
def j23(v: Views):
    provider = v.provider().withColumn("value", F.when(c("metric") == "ebit", c("value") + 5000).otherwise(c("value")))
    return A.enrich_with_period_evidence(provider, v.obs()).select("source_id", "start_date", "end_date", "authority", "evidence", "dedup_status")


@query("J07_fill_missing_quarters", """
WITH f AS (SELECT * FROM v_obs WHERE period_type = 'STANDALONE_QUARTER')
SELECT source_id FROM f UNION ALL SELECT source_id FROM v_provider p WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.ticker = p.ticker AND f.metric = p.metric AND abs(f.end_date - p.end_date) <= 7)""")
def j07(v: Views):
    primary = v.obs().where("period_type = 'STANDALONE_QUARTER'")
    return A.fill_missing_quarters(primary, v.provider()).select("source_id")


_FCF = """
WITH cash AS (SELECT * FROM v_obs WHERE metric = 'operatingCashFlow'), cap AS (SELECT * REPLACE (CASE WHEN fiscal_quarter = 2 THEN 'CONTINUING_OPERATIONS' ELSE op_scope END AS op_scope) FROM v_obs WHERE metric = 'capitalExpenditures'
 AND NOT (fiscal_quarter = 3 AND fiscal_year = 1998)),
p AS (SELECT a.source_id, a.value, a.op_scope, b.source_id AS bid, b.value AS bv, b.op_scope AS bop FROM cash a LEFT JOIN cap b ON a.ticker = b.ticker AND a.period_type = b.period_type AND a.fiscal_year = b.fiscal_year
 AND a.fiscal_quarter = b.fiscal_quarter AND abs(a.end_date - b.end_date) <= 7 AND abs(a.start_date - b.start_date) <= 14),
g AS (SELECT source_id, value, count(bid) AS periods, count(bid) FILTER (op_scope = bop) AS matches, max(bv) FILTER (op_scope = bop) AS bv, max(bid) FILTER (op_scope = bop) AS bid FROM p GROUP BY source_id, value)"""


@query("J04_cash_flow_minus_capex", _FCF + """
SELECT CASE WHEN matches = 1 THEN source_id || '|CFO_MINUS_CAPEX|' || bid ELSE source_id END AS source_id, CASE WHEN matches = 1 THEN value - bv END AS value,
 CASE WHEN periods = 0 THEN 'MISSING_MATCHED_CAPEX_PERIOD' WHEN matches > 1 THEN 'AMBIGUOUS_CAPEX_PERIOD_MATCH' WHEN matches = 0 THEN 'OPERATION_SCOPE_INCOMPATIBLE' END AS reason FROM g""")
def j04(v: Views):
    obs = v.obs().withColumns({"dedup_status": F.lit(None).cast("string")})
    capex = obs.where("metric = 'capitalExpenditures' AND NOT (fiscal_quarter = 3 AND fiscal_year = 1998)").withColumn(
        "op_scope", F.when(c("fiscal_quarter") == 2, "CONTINUING_OPERATIONS").otherwise(c("op_scope")))
    return A.cash_flow_minus_capex(obs.where("metric = 'operatingCashFlow'"), capex).select("source_id", "value", "reason")


@query("J05_revenue_minus_cost", """
WITH d AS (SELECT DISTINCT ticker, start_date, end_date FROM v_obs WHERE metric = 'ebit' AND fiscal_quarter = 1),
k AS (SELECT ticker, start_date, end_date, period_type, count(*) AS n, max(value) AS cost FROM v_obs WHERE metric = 'costOfRevenue' GROUP BY ALL)
SELECT r.ticker, r.start_date, r.end_date, r.filed, CASE WHEN n = 1 THEN r.value - abs(cost) END AS value, CASE WHEN n > 1 THEN 'AMBIGUOUS_COST_OF_REVENUE' END AS reason
FROM v_obs r JOIN k USING (ticker, start_date, end_date, period_type) WHERE metric = 'revenue' AND NOT EXISTS (SELECT 1 FROM d WHERE d.ticker = r.ticker AND d.start_date = r.start_date AND d.end_date = r.end_date)""")
def j05(v: Views):
    obs = v.obs().withColumn("dedup_status", F.lit(None).cast("string"))
    out = A.revenue_minus_cost(obs.where("metric = 'revenue'"), obs.where("metric = 'costOfRevenue'"), obs.where("metric = 'ebit' AND fiscal_quarter = 1"))
    return out.select("ticker", "start_date", "end_date", "filed", "value", "reason")


@query("J06_paired_metric", """
SELECT a.ticker, a.start_date, a.end_date, a.value + b.value AS value FROM v_quarters a JOIN v_quarters b ON a.ticker = b.ticker AND a.start_date = b.start_date AND a.end_date = b.end_date
WHERE a.metric = 'ebit' AND b.metric = 'adjustedEbitda'""")
def j06(v: Views):
    rows = v.quarters().withColumn("source_id", F.concat_ws(":", "ticker", "metric", "start_date"))
    return A.paired_metric(rows.where("metric = 'ebit'"), rows.where("metric = 'adjustedEbitda'"), 1, "ebitPlus", "SUM").select("ticker", "start_date", "end_date", "value")


@query("U01_prefer", """
SELECT source_id FROM v_obs WHERE restated UNION ALL SELECT source_id FROM v_obs o WHERE NOT restated AND NOT EXISTS (
 SELECT 1 FROM v_obs p WHERE p.restated AND p.ticker = o.ticker AND p.metric = o.metric AND p.start_date = o.start_date AND p.end_date = o.end_date)""")
def u01(v: Views):
    obs = v.obs()
    return prefer(obs.where("restated"), obs.where("NOT restated"), ["ticker", "metric", "start_date", "end_date"]).select("source_id")


@query("U02_union", "SELECT source_id, provider FROM v_all_obs")
def u02(v: Views):
    return v.obs().unionByName(v.provider()).select("source_id", "provider")


@query("A24_latest_reported_period", """
SELECT a.ticker, a.metric, greatest(a.e, b.e) AS period_end FROM (SELECT ticker, metric, max(end_date) AS e FROM v_obs WHERE filed <= DATE '2000-12-31' AND end_date <= DATE '2000-12-31' AND form IN ('10-K', '10-Q', '10-K/A') GROUP BY ALL) a
LEFT JOIN (SELECT 'S' || cik AS ticker, max(report_date) AS e FROM v_filings WHERE form IN ('10-Q','10-Q/A','10-K','10-K/A') AND report_date <= DATE '2000-12-31' AND filing_date <= DATE '2000-12-31' GROUP BY 1) b ON a.ticker = b.ticker""")
def a24(v: Views):
    filings = v.filings().withColumn("ticker", F.concat(F.lit("S"), "cik"))
    return A.latest_reported_period(v.obs().withColumn("explicit_mapping", F.lit(False)), filings, "2000-12-31")


@query("A25_latest_expected_quarter", """
SELECT coalesce(a.ticker, b.ticker) AS ticker, greatest(a.e, b.e) AS expected_end FROM (SELECT 'S' || cik AS ticker, max(report_date) AS e FROM v_filings WHERE form IN ('10-Q','10-Q/A') GROUP BY 1) a
FULL JOIN (SELECT ticker, max(end_date) AS e FROM v_quarters WHERE metric = 'revenue' GROUP BY ticker) b ON a.ticker = b.ticker""")
def a25(v: Views):
    filings = v.filings().withColumn("ticker", F.concat(F.lit("S"), "cik"))
    return A.latest_expected_quarter(filings, v.quarters().where("metric = 'revenue'"))


@query("A28_reporting_currency", "SELECT ticker, CASE WHEN max(region_key) = 3 THEN 'EUR' ELSE 'USD' END AS currency FROM v_cumulative WHERE fiscal_quarter = 4 GROUP BY ticker")
def a28(v: Views):
    rows = v.obs().join(v.issuers().select("ticker", "region_key"), "ticker").withColumn(
        "currency", F.when((c("region_key") == 3) & (c("fiscal_quarter") == 4), "EUR").otherwise("USD"))
    return A.reporting_currency(rows)


@query("Q17_additive_capex", """
WITH k AS (SELECT * FROM v_obs WHERE metric = 'capitalExpenditures'), g AS (SELECT ticker, start_date, end_date, accession, filed, floor(value * 0.75) + floor(value / 4) AS value FROM k),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, start_date, end_date ORDER BY filed DESC, accession DESC) AS rn FROM g) WHERE rn = 1),
r AS (SELECT ticker, start_date, end_date, max(value) AS hi, min(value) AS lo FROM g GROUP BY ALL),
t AS (SELECT b.ticker, b.start_date, b.end_date, count(*) FILTER (abs(k.value - b.value) > greatest(1.0, abs(k.value), abs(b.value)) * 0.001) AS n FROM k JOIN b USING (ticker, start_date, end_date) GROUP BY ALL)
SELECT b.ticker, b.start_date, b.end_date, b.accession, b.value, CASE WHEN hi - b.value > greatest(1.0, hi) * 0.001 OR b.value - lo > greatest(1.0, b.value) * 0.001 OR n > 0 THEN 'SOURCE_VALUE_CONFLICT' END AS conflict
FROM b JOIN r USING (ticker, start_date, end_date) JOIN t USING (ticker, start_date, end_date)""")
def q17(v: Views):
    capex = v.obs().where("metric = 'capitalExpenditures'")
    parts = F.array(F.struct(F.lit("PaymentsNet").alias("concept"), F.lit("Purchases of property and equipment net of computer hardware").alias("label"), F.floor(c("value") * 0.75).cast("double").alias("v")),
                    F.struct(F.lit("Hardware").alias("concept"), F.lit("Purchases of computer hardware").alias("label"), F.floor(c("value") / 4).cast("double").alias("v")),
                    F.struct(F.lit("Capex").alias("concept"), F.lit("Total capital expenditures").alias("label"), c("value").alias("v")))
    rows = capex.select("ticker", "metric", "start_date", "end_date", "accession", "filed", F.inline(parts)).withColumnRenamed("v", "value")
    return A.additive_capex(rows)
