"""Filing inventory queries; customers act as issuers, orders as filings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.views import Views
from tidemark.operators import filings as FL

c = F.col
FIN = "('10-K','10-K/A','10-Q','10-Q/A','8-K','8-K/A','20-F','20-F/A','40-F','40-F/A','6-K','S-1','S-1/A','F-1','F-1/A','10','10/A','10-12B','10-12B/A')"
DIRECT = "('10-Q','10-Q/A','10-K','10-K/A','20-F','20-F/A','40-F','40-F/A')"
ANNUAL = "('10-K','10-K/A','20-F','20-F/A','40-F','40-F/A','S-1','S-1/A','F-1','F-1/A')"
EXHIBIT = "('6-K','6-K/A','8-K','8-K/A')"
SUPPORTED = DIRECT[:-1] + "," + EXHIBIT[1:-1] + ",'S-1','S-1/A','F-1','F-1/A')"
YEARS = [1997, 1998, 1999]


def cat_sql(form: str) -> str:
    return f"""CASE WHEN {form} IN ('10-K','10-K/A') THEN '10-K' WHEN {form} IN ('10-Q','10-Q/A') THEN '10-Q'
 WHEN {form} IN ('8-K','8-K/A') THEN '8-K' WHEN {form} = 'DEF 14A' THEN 'DEF 14A' ELSE 'Other' END"""


def submissions(v: Views):
    """Column-shaped inventories: archive pages of one issuer and year, cut by order range so that none grows large."""
    row = F.struct("accession", "form", "filing_date", "report_date", "primary_document")
    packed = v.filings().groupBy("cik", F.year("filing_date").alias("page"), F.floor(c("o_orderkey") / 100_000)).agg(F.sort_array(F.collect_list(row)).alias("r"))
    names = ["accession", "form", "filing_date", "report_date", "primary_document"]
    return packed.select("cik", "page", F.struct(*[c(f"r.{n}").alias(n) for n in names]).alias("recent"))


@query("S01_read_company_index", """
SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, c_name AS name, upper(c_mktsegment) || c_custkey AS ticker, 'X' || c_nationkey AS exchange
FROM customer""")
def s01(v: Views):
    row = F.array(F.lower("c_mktsegment"), F.concat(F.lit(" "), c("c_name"), F.lit(" ")), c("c_custkey").cast("string"),
                  F.concat(F.lit("X"), c("c_nationkey").cast("string")))
    # one page of the list per country and segment keeps every payload row small
    row = F.array(F.concat(F.lower("c_mktsegment"), c("c_custkey").cast("string")), row[1], row[2], row[3])
    fields = F.array(*[F.lit(x) for x in ("ticker", "name", "cik", "exchange")])
    payload = v.table("customer").select(fields.alias("fields"), F.array(row).alias("data"))
    return FL.company_index(payload)


@query("S02_read_submissions", f"SELECT cik, accession, form, filing_date, report_date, primary_document, {cat_sql('form')} AS category FROM v_filings")
def s02(v: Views):
    return FL.submission_rows(submissions(v))


@query("S03_read_financial_filings", f"""
SELECT cik, accession, form, filing_date, report_date, primary_document, suffix(form, '/A') AS amendment,
 'FILED:' || cik || ':' || accession AS source_id, sha256(cik || ':' || accession || ':' || primary_document) AS source_hash
FROM v_filings WHERE form IN {FIN}""")
def s03(v: Views):
    pages = submissions(v)
    names = ["cik", "accession", "form", "filing_date", "report_date", "primary_document"]
    recent = FL.submission_rows(pages.where("page >= 2000")).select(names)
    archive = FL.submission_rows(pages).select(names)
    return FL.financial_filings(recent, archive)


@query("P01_filing_category", f"SELECT o_orderkey, {cat_sql('form')} AS category FROM v_filings")
def p01(v: Views):
    return v.filings().select("o_orderkey", FL.filing_category(c("form")).alias("category"))


@query("P02_filter_filings", f"""
SELECT accession FROM v_filings WHERE {cat_sql('form')} IN ('10-K', '8-K') AND filing_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'
 AND (contains(lower(form), '/a') OR contains(CAST(filing_date AS VARCHAR), '/a') OR contains(accession, '/a'))""")
def p02(v: Views):
    return FL.filter_filings(v.filings(), ["10-K", "8-K"], "1996-01-01", "1999-12-31", " /A ").select("accession")


@query("P08_form_supports_period", f"""
SELECT form, period_type, period_type NOT IN ('FISCAL_YEAR','CALENDAR_YEAR') OR form IN {ANNUAL} OR form IN {EXHIBIT} AS supported, count(*) AS n
FROM (SELECT form, CASE WHEN month(filing_date) <= 6 THEN 'FISCAL_YEAR' ELSE 'YTD_6M' END AS period_type FROM v_filings) GROUP BY ALL""")
def p08(v: Views):
    rows = v.filings().select("form", F.when(F.month("filing_date") <= 6, "FISCAL_YEAR").otherwise("YTD_6M").alias("period_type"))
    return rows.groupBy("form", "period_type", FL.form_supports_period(c("form"), c("period_type")).alias("supported")).agg(F.count("*").alias("n"))


def existing(v: Views):
    old = v.filings().where("form IN ('10-K', '10-Q') AND filing_date < date'1999-01-01'")
    return old.select("ticker", F.when(c("form") == "10-K", "revenue").otherwise("ebit").alias("metric"), c("report_date").alias("period_end"), "filing_date")


@query("P17_filing_eligible", f"""
WITH ex AS (SELECT ticker, max(report_date) AS e, max(filing_date) AS f, max(report_date) FILTER (form = '10-K') AS e_rev,
 max(report_date) FILTER (form = '10-Q') AS e_ebit FROM v_filings WHERE form IN ('10-K','10-Q') AND filing_date < DATE '1999-01-01' GROUP BY ticker)
SELECT accession, form FROM v_filings LEFT JOIN ex USING (ticker) WHERE form IN {SUPPORTED} AND CASE WHEN form IN {DIRECT} THEN e IS NULL OR
 (CASE WHEN e_rev IS NOT NULL THEN report_date > e_rev ELSE report_date >= e END) OR (CASE WHEN e_ebit IS NOT NULL THEN report_date > e_ebit ELSE report_date >= e END)
 ELSE f IS NULL OR filing_date >= f END""")
def p17(v: Views):
    return FL.filing_eligible(v.filings(), existing(v), ["revenue", "ebit"]).select("accession", "form")


@query("P28_filings_from_year", f"SELECT accession FROM v_filings WHERE form IN {FIN} AND year(coalesce(report_date, filing_date)) >= 1999")
def p28(v: Views):
    return FL.filings_from_year(v.filings(), 1999).select("accession")


@query("T01_order_filings", f"SELECT accession, filing_date, {cat_sql('form')} AS category FROM v_filings")
def t01(v: Views):
    return FL.order_filings(v.filings()).select("accession", "filing_date", FL.filing_category(c("form")).alias("category"))


@query("T02_order_inventory", "SELECT accession, filing_date, form FROM v_filings")
def t02(v: Views):
    return FL.order_inventory(v.filings()).select("accession", "filing_date", "form")


@query("T03_search_companies", """
SELECT name, score FROM (SELECT c_name AS name, CASE WHEN lower(c_name) = 'customer#00000012' THEN 700.0 WHEN starts_with(lower(c_name), 'customer#00000012')
 THEN 600.0 - length(c_name) / 100 WHEN contains(lower(c_name), 'customer#00000012') THEN 400.0 - instr(lower(c_name), 'customer#00000012') + 1 ELSE 0 END AS score FROM customer)
WHERE score > 0 ORDER BY score DESC, name LIMIT 12""")
def t03(v: Views):
    companies = v.table("customer").select(c("c_name").alias("name"), c("c_mktsegment").alias("ticker"))
    return FL.search_companies(companies, "Customer#00000012").select("name", "score")


@query("J22_resolve_company", """
SELECT '17' AS query, c_name AS name FROM customer WHERE c_custkey = 17
UNION ALL SELECT '000000042', c_name FROM customer WHERE c_custkey = 42
UNION ALL SELECT 'omer#0000003', (SELECT min(c_name) FROM customer WHERE contains(lower(c_name), 'omer#0000003')) WHERE EXISTS (SELECT 1 FROM customer WHERE contains(lower(c_name), 'omer#0000003'))
UNION ALL SELECT 'BUILDING5', (SELECT c_name FROM customer WHERE starts_with(c_mktsegment || c_custkey, 'BUILDING5') ORDER BY length(c_mktsegment || c_custkey), c_name LIMIT 1)""")
def j22(v: Views):
    companies = v.table("customer").select(F.lpad(c("c_custkey").cast("string"), 10, "0").alias("cik"), c("c_name").alias("name"),
                                           F.concat("c_mktsegment", c("c_custkey").cast("string")).alias("ticker"))
    return FL.resolve_company(companies, ["17", "000000042", "omer#0000003", "BUILDING5"]).select("query", "name")


@query("T04_latest_annual_and_quarters", f"""
WITH a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filing_date DESC, accession DESC) AS rn FROM v_filings WHERE form IN ('10-K','10-K/A')) WHERE rn = 1)
SELECT cik, accession FROM a UNION ALL SELECT q.cik, q.accession FROM v_filings q JOIN a ON q.cik = a.cik AND q.filing_date >= a.filing_date WHERE q.form IN ('10-Q','10-Q/A')""")
def t04(v: Views):
    return FL.latest_annual_and_later_quarters(v.filings()).select("cik", "accession")


@query("A19_category_counts", f"""
SELECT cik, category, count(*) FILTER ({cat_sql('form')} = category) AS n FROM v_filings,
 (VALUES ('10-K'), ('10-Q'), ('8-K'), ('DEF 14A'), ('Ownership'), ('Other')) AS g(category) GROUP BY cik, category""")
def a19(v: Views):
    return FL.category_counts(v.filings())


@query("J01_attach_filing", """
SELECT f.o_orderkey, f.accession, p.report_date AS filing_report_date, p.accession || '.url' AS filing_url, 'FILED:' || p.accession AS filing_source_id
FROM v_filings f LEFT JOIN (SELECT * FROM v_filings WHERE form IN ('10-K','10-Q')) p ON f.accession = p.accession""")
def j01(v: Views):
    filings = v.filings().where("form IN ('10-K', '10-Q')").select("accession", "report_date", F.concat("accession", F.lit(".url")).alias("url"),
                                                                  F.concat(F.lit("FILED:"), "accession").alias("source_id"))
    return FL.attach_filing(v.filings().select("o_orderkey", "accession"), filings)


def gaps(v: Views):
    return v.filings().where("form IN ('10-K', '10-K/A')").select(
        "ticker", c("o_orderkey").alias("gap_id"), F.date_sub("report_date", 364).alias("gap_start"), c("report_date").alias("gap_end"),
        F.when(c("form") == "10-K", "CY").otherwise("LTM").alias("purpose"))


_NEAR = f"""
WITH gaps AS (SELECT ticker, o_orderkey AS gap_id, CAST(report_date - 364 AS DATE) AS gap_start, report_date AS gap_end,
 CASE WHEN form = '10-K' THEN 190 ELSE 280 END AS win FROM v_filings WHERE form IN ('10-K','10-K/A')),
near AS (SELECT g.*, f.accession, f.form, f.filing_date, f.report_date FROM gaps g JOIN v_filings f ON f.ticker = g.ticker
 WHERE f.report_date BETWEEN g.gap_start - 35 AND g.gap_end + 130 OR abs(f.report_date - g.gap_end) <= 130 OR f.filing_date BETWEEN g.gap_end AND g.gap_end + g.win)"""


@query("J10_filings_near_gap", _NEAR + " SELECT gap_id, accession FROM near")
def j10(v: Views):
    return FL.filings_near_gap(v.filings(), gaps(v)).select("gap_id", "accession")


@query("T05_rank_targeted_filings", _NEAR + f"""
SELECT gap_id, accession, CAST(score AS INTEGER) AS score, CAST(pick AS INTEGER) AS pick FROM (
SELECT *, row_number() OVER (PARTITION BY gap_id ORDER BY score, filing_date DESC, accession DESC) AS pick FROM (
SELECT gap_id, accession, filing_date, abs(report_date - gap_end) - CASE WHEN form IN {DIRECT} THEN 80 ELSE 0 END - CASE WHEN form IN {ANNUAL} THEN 35 ELSE 0 END
 - CASE WHEN form IN {EXHIBIT} AND accession LIKE '%1-0%' THEN 70 ELSE 0 END - CASE WHEN suffix(form, '/A') THEN 5 ELSE 0 END AS score FROM near)) WHERE pick <= 6""")
def t05(v: Views):
    evidence = c("accession").contains("1-0")
    return FL.rank_targeted_filings(v.filings(), gaps(v), evidence).select("gap_id", "accession", "score", "pick")


_COMP = f"""
cur AS (SELECT * FROM elig WHERE form IN ('8-K','8-K/A','6-K')),
qs AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filing_date DESC, accession DESC) AS bucket FROM elig WHERE form IN ('10-Q','10-Q/A') QUALIFY bucket <= 4),
ans AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filing_date DESC, accession DESC) AS bucket FROM elig WHERE form IN {ANNUAL} QUALIFY bucket <= 4),
comp AS (SELECT * FROM (SELECT c.cik, 'quarterly' AS kind, q.accession AS anchor, q.bucket, row_number() OVER (PARTITION BY c.cik, q.accession
  ORDER BY CASE WHEN starts_with(c.accession, c.cik) THEN 0 ELSE 1 END, c.filing_date DESC, c.accession DESC) AS pick, c.accession
 FROM cur c JOIN qs q ON c.cik = q.cik AND abs(c.filing_date - q.filing_date) <= 2) WHERE pick <= 2
 UNION ALL SELECT * FROM (SELECT c.cik, 'annual', a.accession, a.bucket, row_number() OVER (PARTITION BY c.cik, a.accession
  ORDER BY a.filing_date - c.filing_date, c.filing_date DESC, c.accession DESC) AS pick, c.accession
 FROM cur c JOIN ans a ON c.cik = a.cik AND c.filing_date > a.report_date AND c.filing_date <= a.filing_date) WHERE pick <= 4
 UNION ALL SELECT * FROM (SELECT cik, 'year', NULL, year(filing_date) - 1997 AS bucket, row_number() OVER (PARTITION BY cik, year(filing_date)
  ORDER BY filing_date DESC, accession DESC) AS pick, accession FROM cur WHERE month(filing_date) <= 3 AND year(filing_date) BETWEEN 1998 AND 2000) WHERE pick <= 2)"""


@query("J11_companion_reports", f"WITH elig AS (SELECT * FROM v_filings), {_COMP} SELECT cik, kind, anchor, CAST(bucket AS INTEGER) AS bucket, CAST(pick AS INTEGER) AS pick, accession FROM comp")
def j11(v: Views):
    return FL.companion_reports(v.filings(), YEARS)


@query("W21_interleave_buckets", f"""
WITH elig AS (SELECT * FROM v_filings), {_COMP}
SELECT cik, accession, CAST(position AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY pick, bucket, accession) AS position FROM comp WHERE kind = 'annual') WHERE position <= 3""")
def w21(v: Views):
    rows = FL.companion_reports(v.filings(), YEARS).where("kind = 'annual'")
    return FL.interleave_buckets(rows, ["cik"], 3).select("cik", "accession", "position")


_SUPP = f"""
WITH elig AS (SELECT * FROM v_filings WHERE form IN {FIN} AND year(coalesce(report_date, filing_date)) >= 1996), {_COMP},
places AS (SELECT cik, accession, 1 AS cl, bucket AS a, 0 AS b FROM qs UNION ALL SELECT cik, accession, 2, bucket, pick FROM comp WHERE kind = 'quarterly'
 UNION ALL SELECT cik, accession, 3, r, 0 FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filing_date DESC, accession DESC) AS r FROM cur) WHERE r <= 6
 UNION ALL SELECT cik, accession, 4, bucket, 0 FROM ans UNION ALL SELECT cik, accession, 5, pick, bucket FROM comp WHERE kind = 'annual'
 UNION ALL SELECT cik, accession, 6, pick, bucket FROM comp WHERE kind = 'year'
 UNION ALL SELECT cik, accession, 7, DATE '1970-01-01' - filing_date, 0 FROM cur UNION ALL SELECT cik, accession, 8, DATE '1970-01-01' - filing_date, 0 FROM elig),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY place, accession DESC) AS position FROM (
 SELECT cik, accession, min({{'c': cl, 'a': a, 'b': b}}) AS place FROM places GROUP BY cik, accession)) WHERE position <= CAP)"""


@query("E10_select_supplemental_filings", _SUPP.replace("CAP", "36") + " SELECT cik, accession, CAST(position AS INTEGER) AS position FROM chosen")
def e10(v: Views):
    return FL.select_supplemental_filings(v.filings(), YEARS)


@query("A26_search_completeness", _SUPP.replace("CAP", "4") + """
SELECT cik, CAST(y AS INTEGER) AS year, count(*) AS relevant, count(ch.accession) AS examined, count(*) - count(ch.accession) AS excluded, count(*) = count(ch.accession) AS completed
FROM elig JOIN (VALUES (1997), (1998), (1999)) t(y) ON abs(year(report_date) - y) <= 1 LEFT JOIN chosen ch USING (cik, accession) GROUP BY cik, y""")
def a26(v: Views):
    return FL.search_completeness(v.filings(), FL.select_supplemental_filings(v.filings(), YEARS, 4), YEARS)


@query("J12_filings_for_call", """
WITH near AS (SELECT q.o_orderkey AS call_id, f.accession, f.form, abs(CAST(q.filing_date - 5 AS DATE) - f.filing_date) AS distance,
 CASE f.form WHEN '8-K' THEN 1 WHEN '6-K' THEN 2 WHEN '10-Q' THEN 3 WHEN '10-K' THEN 4 ELSE 0 END AS fr
 FROM v_filings q JOIN v_filings f ON q.ticker = f.ticker AND abs(CAST(q.filing_date - 5 AS DATE) - f.filing_date) <= 18 WHERE q.form = '10-Q'),
pf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY call_id, form ORDER BY distance, accession) AS rn FROM near) WHERE rn = 1)
SELECT call_id, accession, form, CAST(distance AS INTEGER) AS distance, CAST(pick AS INTEGER) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY distance, fr, accession) AS pick FROM pf) WHERE pick <= 4""")
def j12(v: Views):
    calls = v.filings().where("form = '10-Q'").select("ticker", c("o_orderkey").alias("call_id"), F.date_sub("filing_date", 5).alias("call_date"))
    found = FL.filings_for_call(calls, v.filings().select("ticker", "accession", "form", "filing_date"))
    return found.select("call_id", "accession", "form", "distance", "pick")


@query("Q25_inventory_complete", """
SELECT cik, CAST(year(filing_date) AS INTEGER) AS page, bool_and(form <> '10-Q') AS recent_present, bool_and(form <> '10-Q') AND count(*) < 3 AS complete FROM v_filings GROUP BY 1, 2, floor(o_orderkey / 100000)""")
def q25(v: Views):
    # a page whose quarterly filings lack a report date is not complete
    pages = submissions(v)
    recent = pages["recent"]
    broken = F.struct(recent["accession"].alias("accession"), recent["form"].alias("form"),
                      F.zip_with(recent["form"], recent["report_date"], lambda f, d: F.when(f != "10-Q", d)).alias("report_date"))
    pages = pages.select("cik", "page", broken.alias("recent"), F.lit(2).alias("archives_listed"), F.least(F.lit(2), F.lit(4) - F.size(recent["form"])).alias("archives_loaded"))
    keyed = pages.withColumn("cik", F.concat_ws("/", "cik", "page"))
    out = FL.inventory_complete(keyed)
    return out.select(F.split("cik", "/")[0].alias("cik"), F.split("cik", "/")[1].cast("int").alias("page"), "recent_present", "complete")
