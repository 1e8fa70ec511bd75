"""The shared views in SQL, used by the comparison queries. views.py builds the same rows in Spark."""

_OBS_COLS = """source_id, ticker, metric, period_type, start_date, end_date, authority, fiscal_year,
 fiscal_quarter, calendar_id, value, currency, unit, provider, filed, accession, form, scope, op_scope, basis,
 method, definition, restated"""

VIEWS = {
    "v_lines": """
SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS ticker, l_orderkey, l_partkey, l_linenumber,
 CAST(l_shipdate AS DATE) AS day, CAST(l_extendedprice AS DECIMAL(18,2)) AS ext,
 CAST(l_discount AS DECIMAL(18,2)) AS disc, CAST(l_quantity AS DECIMAL(18,2)) AS qty,
 CAST(l_tax AS DECIMAL(18,2)) AS tax, l_returnflag, l_linestatus
FROM lineitem""",
    "v_prices": """
SELECT ticker, day, sum_ext / sum_qty AS close, (sum_ext / sum_qty) * (1 - sum_disc / n) AS adj_close, volume
FROM (SELECT ticker, day, CAST(sum(ext) AS DOUBLE) AS sum_ext, CAST(sum(qty) AS DOUBLE) AS sum_qty,
  CAST(sum(disc) AS DOUBLE) AS sum_disc, CAST(count(*) AS DOUBLE) AS n, CAST(floor(sum(qty)) AS BIGINT) AS volume
  FROM v_lines GROUP BY ticker, day)""",
    "v_universe": """
SELECT r_regionkey AS map_pos, r_name AS map_name, n_nationkey AS layer_pos, n_name AS layer,
 s_suppkey AS company_pos, s_name AS company, 'S' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS ticker,
 CASE WHEN s_acctbal < 0 THEN 'Private' ELSE 'Public' END AS type, n_name AS country
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_issuers": """
SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS ticker, n_regionkey AS region_key,
 CASE n_regionkey WHEN 1 THEN 3 WHEN 2 THEN 6 WHEN 3 THEN 9 ELSE 12 END AS fye_month
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "v_quarter_wide": """
SELECT ticker, CAST(date_trunc('quarter', day) AS DATE) AS start_date,
 CAST(floor(sum(ext * (1 - disc))) AS DOUBLE) AS revenue,
 CAST(floor(sum(CASE WHEN l_linestatus = 'F' THEN ext ELSE 0 END)) AS DOUBLE) AS "costOfRevenue",
 CAST(floor(sum(CASE WHEN l_returnflag <> 'A' THEN ext ELSE 0 END)) AS DOUBLE) AS "operatingCashFlow",
 CAST(floor(sum(CASE WHEN l_returnflag = 'A' THEN ext ELSE 0 END)) AS DOUBLE) AS "capitalExpenditures",
 CAST(floor(sum(ext * disc)) AS DOUBLE) AS ebit,
 CAST(floor(sum(ext * tax)) AS DOUBLE) AS "adjustedEbitda",
 count(*) AS n
FROM v_lines GROUP BY ticker, CAST(date_trunc('quarter', day) AS DATE)""",
    "v_quarters": """
SELECT ticker, metric, start_date, CAST(start_date + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS end_date, value, n
FROM (UNPIVOT v_quarter_wide ON revenue, "costOfRevenue", "operatingCashFlow", "capitalExpenditures", ebit,
 "adjustedEbitda" INTO NAME metric VALUE value)""",
    "v_fiscal": """
SELECT q.ticker, q.metric, q.start_date, q.end_date, q.value, q.n, i.fye_month, i.region_key,
 CAST(year(q.end_date) + CASE WHEN month(q.end_date) > i.fye_month THEN 1 ELSE 0 END AS INTEGER) AS fiscal_year,
 CAST(CASE WHEN month(q.end_date) = i.fye_month THEN 4
  WHEN month(q.end_date) > i.fye_month THEN (month(q.end_date) - i.fye_month) / 3
  ELSE (month(q.end_date) - i.fye_month + 12) / 3 END AS INTEGER) AS fiscal_quarter
FROM v_quarters q JOIN v_issuers i ON q.ticker = i.ticker""",
    "v_cumulative": """
SELECT * FROM (SELECT ticker, metric, fye_month, region_key, fiscal_year, fiscal_quarter, end_date,
 min(start_date) OVER w AS start_date, sum(value) OVER w AS value, sum(n) OVER w AS n, count(*) OVER w AS filled
 FROM v_fiscal WINDOW w AS (PARTITION BY ticker, metric, fiscal_year ORDER BY fiscal_quarter
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
WHERE filled = fiscal_quarter""",
    "v_obs": f"""
SELECT {_OBS_COLS} FROM (
SELECT 'FILED:' || accession || ':' || metric AS source_id, * EXCLUDE (n) FROM (
 SELECT ticker, metric,
  CASE fiscal_quarter WHEN 1 THEN 'STANDALONE_QUARTER' WHEN 2 THEN 'YTD_6M' WHEN 3 THEN 'YTD_9M' ELSE 'FISCAL_YEAR' END
   AS period_type, start_date, end_date, 'REPORTED' AS authority, fiscal_year, fiscal_quarter,
  'FYE' || lpad(CAST(fye_month AS VARCHAR), 2, '0') AS calendar_id, value, 'USD' AS currency, 'USD' AS unit,
  'FILED' AS provider, CAST(end_date + CASE WHEN fiscal_quarter = 4 THEN 75 ELSE 40 END AS DATE) AS filed,
  substr(ticker, 2, 10) || '-' || substr(CAST(year(end_date + CASE WHEN fiscal_quarter = 4 THEN 75 ELSE 40 END)
   AS VARCHAR), 3, 2) || '-' || lpad(CAST(fiscal_year * 10 + fiscal_quarter AS VARCHAR), 6, '0') AS accession,
  CASE WHEN fiscal_quarter = 4 THEN '10-K' ELSE '10-Q' END AS form, 'CONSOLIDATED' AS scope,
  'UNSPECIFIED' AS op_scope, 'REPORTED' AS basis, CAST(NULL AS VARCHAR) AS method,
  'DEF_' || metric AS definition, FALSE AS restated, n FROM v_cumulative
 UNION ALL
 SELECT ticker, metric, 'FISCAL_YEAR', start_date, end_date, 'REPORTED', fiscal_year, fiscal_quarter,
  'FYE' || lpad(CAST(fye_month AS VARCHAR), 2, '0'), value + n, 'USD', 'USD', 'FILED',
  CAST(end_date + 440 AS DATE),
  substr(ticker, 2, 10) || '-' || substr(CAST(year(end_date + 440) AS VARCHAR), 3, 2) || '-' ||
   lpad(CAST(fiscal_year * 10 + 9 AS VARCHAR), 6, '0'),
  '10-K/A', 'CONSOLIDATED', 'UNSPECIFIED', 'REPORTED', NULL, 'DEF_' || metric, TRUE, n
 FROM v_cumulative WHERE fiscal_quarter = 4 AND region_key IN (1, 2)))""",
    "v_provider": f"""
SELECT {_OBS_COLS} FROM (
SELECT 'STD:' || ticker || ':' || metric || ':' || strftime(end_date, '%Y-%m-%d') AS source_id, ticker, metric,
 'STANDALONE_QUARTER' AS period_type, CAST(start_date - CAST(dayofweek(end_date) AS INTEGER) AS DATE) AS start_date,
 CAST(end_date - CAST(dayofweek(end_date) AS INTEGER) AS DATE) AS end_date, 'INFERRED' AS authority, fiscal_year,
 fiscal_quarter, 'FYE' || lpad(CAST(fye_month AS VARCHAR), 2, '0') AS calendar_id,
 CASE WHEN fiscal_quarter = 3 THEN floor(value * 1.25) ELSE value END AS value, 'USD' AS currency, 'USD' AS unit,
 'STANDARDIZED' AS provider, CAST(end_date + 50 AS DATE) AS filed, CAST(NULL AS VARCHAR) AS accession,
 CAST(NULL AS VARCHAR) AS form, 'CONSOLIDATED' AS scope, 'UNSPECIFIED' AS op_scope, 'REPORTED' AS basis,
 CAST(NULL AS VARCHAR) AS method, 'DEF_' || metric AS definition, FALSE AS restated
FROM v_fiscal)""",
    "v_all_obs": "SELECT * FROM v_obs UNION ALL SELECT * FROM v_provider",
    "v_ledger": """
SELECT ticker, 'us-gaap' AS namespace, CASE metric WHEN 'revenue' THEN CASE WHEN form = '10-K' THEN 'SalesRevenueNet'
   ELSE 'Revenues' END WHEN 'costOfRevenue' THEN 'CostOfRevenue'
  WHEN 'operatingCashFlow' THEN 'NetCashProvidedByUsedInOperatingActivities'
  WHEN 'capitalExpenditures' THEN 'PaymentsToAcquirePropertyPlantAndEquipment'
  WHEN 'ebit' THEN 'OperatingIncomeLoss' ELSE 'AdjustedEBITDA' END AS concept,
 metric AS label, start_date, end_date, value, 'USD' AS currency, form, filed, accession,
 CAST(NULL AS VARCHAR) AS segment FROM v_obs
UNION ALL
SELECT ticker, 'company', 'TotalRevenues', 'Total revenues', start_date, end_date, value + 7, 'USD', form,
 CAST(filed + 10 AS DATE), accession, NULL FROM v_obs WHERE metric = 'revenue'
UNION ALL
SELECT ticker, 'us-gaap', 'Revenues', 'revenue', start_date, end_date, floor(value / 2), 'USD', form, filed, accession,
 'ProductLine' FROM v_obs WHERE metric = 'revenue' AND form = '10-K'""",
    "v_filings": """
SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, 'C' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS ticker,
 CASE o_orderpriority WHEN '1-URGENT' THEN '8-K' WHEN '2-HIGH' THEN '10-Q' WHEN '3-MEDIUM' THEN '10-K'
  WHEN '4-NOT SPECIFIED' THEN '6-K' ELSE 'DEF 14A' END
  || CASE WHEN o_orderstatus = 'P' AND o_orderpriority <> '5-LOW' THEN '/A' ELSE '' END AS form,
 CAST(o_orderdate AS DATE) AS filing_date,
 CAST(date_trunc('quarter', o_orderdate) - INTERVAL 1 DAY AS DATE) AS report_date,
 lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '-' || strftime(o_orderdate, '%y') || '-' ||
  strftime(o_orderdate, '%y%m%d') AS accession,
 'doc' || CAST(o_orderkey AS VARCHAR) || '.htm' AS primary_document, o_orderkey
FROM orders""",
    "v_cells": """
SELECT ticker, metric, year, CAST(year AS VARCHAR) || 'A' AS period, CASE WHEN status IN ('VERIFIED_REPORTED', 'VERIFIED_DERIVED') THEN value END AS value, status,
 CASE status WHEN 'REQUIRES_REVIEW' THEN 'VALUE_CONFLICT' WHEN 'INSUFFICIENT_PERIOD_COVERAGE' THEN 'LTM_PERIOD_GAP' END AS reason, region_key
FROM (SELECT *, CASE WHEN metric = 'ebit' AND year = 1997 THEN 'REQUIRES_REVIEW' WHEN metric = 'adjustedEbitda' AND year = 1998 THEN 'INSUFFICIENT_PERIOD_COVERAGE'
 WHEN region_key IN (1, 2) THEN 'VERIFIED_REPORTED' ELSE 'VERIFIED_DERIVED' END AS status FROM (
 SELECT ticker, metric, fiscal_year AS year, value, region_key FROM v_cumulative WHERE fiscal_quarter = 4
 UNION ALL SELECT a.ticker, 'grossProfit', a.fiscal_year, a.value - b.value, a.region_key FROM v_cumulative a JOIN v_cumulative b ON a.ticker = b.ticker AND a.fiscal_year = b.fiscal_year
  AND a.metric = 'revenue' AND b.metric = 'costOfRevenue' AND a.fiscal_quarter = 4 AND b.fiscal_quarter = 4
 UNION ALL SELECT a.ticker, 'freeCashFlow', a.fiscal_year, a.value - b.value, a.region_key FROM v_cumulative a JOIN v_cumulative b ON a.ticker = b.ticker AND a.fiscal_year = b.fiscal_year
  AND a.metric = 'operatingCashFlow' AND b.metric = 'capitalExpenditures' AND a.fiscal_quarter = 4 AND b.fiscal_quarter = 4))""",
    "v_estimates": """
SELECT ticker, metric, CASE WHEN rn = 1 THEN '0y' ELSE '+1y' END AS period,
 CAST(end_date + INTERVAL 1 YEAR AS DATE) AS end_date, floor(value * CASE WHEN rn = 1 THEN 1.25 ELSE 1.5 END) AS value
FROM (SELECT *, row_number() OVER (PARTITION BY ticker, metric ORDER BY end_date) AS rn FROM (
 SELECT *, row_number() OVER (PARTITION BY ticker, metric ORDER BY end_date DESC) AS back
 FROM v_cumulative WHERE fiscal_quarter = 4) WHERE back <= 2)""",
    "v_blocks": """
SELECT conv_id AS call_id, turn AS seq, CASE role WHEN 'user' THEN 'Dana Reed' WHEN 'assistant' THEN 'Kim Sato'
  ELSE 'Operator' END AS speaker, CASE role WHEN 'user' THEN 'Analyst - Northfield Research'
  WHEN 'assistant' THEN 'Chief Executive Officer' ELSE 'Operator' END AS role, text FROM conversations""",
    "v_paragraphs": """
SELECT doc_id, CAST(pos AS BIGINT) AS pos, text FROM (
 SELECT doc_id, unnest(parts) AS text, generate_subscripts(parts, 1) AS pos
 FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
WHERE length(trim(text)) > 0""",
}
