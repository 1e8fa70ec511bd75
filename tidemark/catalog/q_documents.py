"""Document queries: every order becomes a small filing page whose numbers come from the order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.q_filings import _NEAR, gaps
from tidemark.catalog.q_periods import QUARTERS_SQL
from tidemark.catalog.registry import query
from tidemark.catalog.views import Views
from tidemark.operators import company_metric as CM
from tidemark.operators import completion as CO
from tidemark.operators import extract as X
from tidemark.operators import filings as FL
from tidemark.session import cut_lineage, shared_folder, spread, written


c = F.col

# fields of the page: quarter end twenty years after the order, two numbers, the kind of page
PAGE_SQL = """
page AS (SELECT o_orderkey AS doc_id, o_orderpriority AS kind, CAST(last_day(date_trunc('quarter', o_orderdate) + INTERVAL 20 YEAR + INTERVAL 2 MONTH) AS DATE) AS qend, o_custkey + 1000 AS v1, -(o_custkey + 7) AS v2, o_custkey AS k FROM orders)"""


def page_fields(v: Views):
    day = F.to_date("o_orderdate")
    end = F.last_day(F.add_months(F.trunc(day, "quarter"), 242))
    return v.table("orders").select(c("o_orderkey").alias("doc_id"), c("o_orderpriority").alias("kind"), end.alias("qend"), (c("o_custkey") + 1000).alias("v1"),
                                    (c("o_custkey") + 7).alias("v2"), c("o_custkey").alias("k"))


def pages(v: Views):
    kind = c("kind")
    units = F.when(kind == "5-LOW", "EUR in millions").when(kind == "2-HIGH", "unaudited").otherwise("USD in thousands")
    caption = F.when(kind == "3-MEDIUM", "Segment results").otherwise("Reconciliation")
    again = F.when(kind == "4-NOT SPECIFIED", "<tr><td>Consolidated Adjusted EBITDA</td><td>1</td><td>2</td></tr>").otherwise("")
    sign = F.when(kind.isin("5-LOW", "2-HIGH"), "").otherwise("$ ")
    html = F.concat(
        F.lit("<html><body><script>var x = '<table>';</script><p>Reconciliation of net income to Adjusted EBITDA (non-GAAP)</p><p>("), units, F.lit(")</p><table><caption>"), caption,
        F.lit("</caption><tr><th></th><th>Three months ended "), F.date_format("qend", "MMMM d, yyyy"), F.lit("</th><th>Year ended December 31, "), F.year("qend").cast("string"),
        F.lit("</th></tr><tr><td>Net income</td><td colspan=\"2\">see note</td></tr><tr><td>Depreciation</td><td>1</td><td>2</td></tr><tr><td>Interest expense</td><td>3</td><td>4</td></tr>"
              "<tr><td>Adjusted EBITDA</td><td>"), sign, F.format_number("v1", 0), F.lit("</td><td>("), F.format_number("v2", 0), F.lit(")</td></tr>"), again,
        F.lit("</table><h2>Consolidated statements (USD in thousands)</h2><table><tr><th></th><th>Three months ended "), F.date_format("qend", "MMMM d, yyyy"),
        F.lit("</th></tr><tr><td>Total revenues</td><td>"), F.format_number("v1", 0), F.lit("</td></tr><tr><td>Cost of revenue (1)</td><td>"), F.format_number("k", 0),
        F.lit("</td></tr><tr><td>Other</td><td>9</td></tr></table></body></html>"))
    return spread(page_fields(v)).select("doc_id", "kind", "qend", "v1", "v2", "k", html.alias("html"))


def filing_dates(v: Views):
    return page_fields(v).select("doc_id", F.lit(12).alias("fye_month"), F.lit(31).alias("fye_day"), F.when(c("kind") == "1-URGENT", "10-Q").otherwise("10-K").alias("form"),
                                 F.when(c("k") > 700, F.add_months("qend", 3)).otherwise(c("qend")).alias("report_date"))


@query("E01_explode_tables", f"""
WITH {PAGE_SQL}, base AS (SELECT doc_id, 0 AS t, unnest([0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4]) AS r, unnest([0, 1, 2, 0, 1, 2, 0, 1, 2, 0, 1, 2, 0, 1, 2]) AS c, unnest(['', 'Three months ended ' || strftime(qend, '%B %-d, %Y'), 'Year ended December 31, ' || year(qend), 'Net income', 'see note', 'see note',
  'Depreciation', '1', '2', 'Interest expense', '3', '4', 'Adjusted EBITDA', CASE WHEN kind IN ('5-LOW', '2-HIGH') THEN '' ELSE '$ ' END || format('{{:,}}', v1), '(' || format('{{:,}}', -v2) || ')']) AS text FROM page
 UNION ALL SELECT doc_id, 0, unnest([5, 5, 5]), unnest([0, 1, 2]), unnest(['Consolidated Adjusted EBITDA', '1', '2']) FROM page WHERE kind = '4-NOT SPECIFIED'
 UNION ALL SELECT doc_id, 1, unnest([0, 0, 1, 1, 2, 2, 3, 3]), unnest([0, 1, 0, 1, 0, 1, 0, 1]), unnest(['', 'Three months ended ' || strftime(qend, '%B %-d, %Y'), 'Total revenues', format('{{:,}}', v1), 'Cost of revenue (1)', format('{{:,}}', k), 'Other', '9']) FROM page)
SELECT doc_id, CAST(t AS INTEGER) AS table_no, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, text, r = 0 AS is_header FROM base""")
def e01(v: Views):
    return X.explode_tables(pages(v)).select("doc_id", "table_no", "row", "col", "text", "is_header")


@query("E02_table_context", f"""
WITH {PAGE_SQL} SELECT doc_id, 0 AS table_no, CASE kind WHEN '3-MEDIUM' THEN 'Segment results' ELSE 'Reconciliation' END AS caption,
 'Reconciliation of net income to Adjusted EBITDA (non-GAAP) (' || CASE kind WHEN '5-LOW' THEN 'EUR in millions' WHEN '2-HIGH' THEN 'unaudited' ELSE 'USD in thousands' END || ')' AS context FROM page""")
def e02(v: Views):
    return X.table_contexts(pages(v)).where("table_no = 0")


@query("E03_period_from_headers", f"""
WITH {PAGE_SQL} SELECT doc_id, CASE kind WHEN '1-URGENT' THEN 'QUARTER' WHEN '2-HIGH' THEN 'QUARTER' WHEN '3-MEDIUM' THEN 'CALENDAR_YEAR' WHEN '4-NOT SPECIFIED' THEN 'YTD_6M' ELSE 'CALENDAR_YEAR' END AS type,
 CAST(CASE kind WHEN '1-URGENT' THEN date_trunc('quarter', qend) WHEN '2-HIGH' THEN make_date(year(qend), 4, 1) WHEN '4-NOT SPECIFIED' THEN qend + INTERVAL 1 DAY - INTERVAL 6 MONTH ELSE make_date(year(qend), 1, 1) END AS DATE) AS start_date,
 CASE kind WHEN '1-URGENT' THEN qend WHEN '2-HIGH' THEN make_date(year(qend), 6, 30) WHEN '4-NOT SPECIFIED' THEN qend ELSE make_date(year(qend), 12, 31) END AS end_date FROM page""")
def e03(v: Views):
    kind, year = c("kind"), F.year("qend").cast("string")
    label = (
        F.when(kind == "1-URGENT", F.concat(F.lit("Three months ended "), F.date_format("qend", "d MMMM yyyy"))).when(kind == "2-HIGH", F.concat(F.lit("Q2'"), F.substring(year, 3, 2)))
        .when(kind == "3-MEDIUM", F.concat(F.lit("CY "), year)).when(kind == "4-NOT SPECIFIED", year).otherwise(F.concat(F.lit("FY "), year)))
    context = F.when(kind == "4-NOT SPECIFIED", F.concat(F.lit("Six months ended "), F.date_format("qend", "MMMM d"))).otherwise("")
    rows = page_fields(v).select("doc_id", F.array(F.lit("Metric"), label).alias("labels"), context.alias("context"))
    out = X.with_period(rows, c("labels"), F.lit(12), F.lit(31), c("context"))
    return out.select("doc_id", "period.type", "period.start_date", "period.end_date")


def recon(v: Views):
    # parsed once: the stage table feeds every branch of the extraction
    parsed = written(X.parsed_tables(pages(v)), "parsed-tables")
    return X.recon_facts(X.cells_of(parsed), X.contexts_of(parsed), filing_dates(v))


_FACTS = PAGE_SQL + """,
facts AS (SELECT doc_id, kind, qend, k, CASE p WHEN 1 THEN v1 ELSE v2 END * CASE kind WHEN '5-LOW' THEN 1e6 ELSE 1e3 END AS value, CASE kind WHEN '5-LOW' THEN 'EUR' ELSE 'USD' END AS currency,
 CASE p WHEN 1 THEN 'QUARTER' ELSE 'CALENDAR_YEAR' END AS type, CAST(CASE p WHEN 1 THEN date_trunc('quarter', qend) ELSE make_date(year(qend), 1, 1) END AS DATE) AS start_date, CASE p WHEN 1 THEN qend ELSE make_date(year(qend), 12, 31) END AS end_date
 FROM page, (VALUES (1), (2)) t(p) WHERE kind IN ('1-URGENT', '5-LOW'))"""


@query("E04_recon_facts", f"WITH {_FACTS} SELECT doc_id, value, currency, type, start_date, end_date FROM facts")
def e04(v: Views):
    return recon(v)[0].select("doc_id", "value", "currency", "type", "start_date", "end_date")


@query("E04_recon_rejections", f"""
WITH {PAGE_SQL} SELECT doc_id, 0 AS table_no, CASE kind WHEN '2-HIGH' THEN 'EXPLICIT_UNITS_MISSING' WHEN '3-MEDIUM' THEN 'SEGMENT_TABLE_EXCLUDED' ELSE 'ADJUSTED_EBITDA_ROW_COUNT' END AS reason FROM page WHERE kind IN ('2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')""")
def e04_rejections(v: Views):
    return recon(v)[1]


_STATEMENTS = PAGE_SQL + """,
st AS (SELECT doc_id, unnest(['revenue', 'costOfRevenue']) AS metric, unnest([v1, k]) * CASE kind WHEN '5-LOW' THEN 1e6 ELSE 1e3 END AS value, CAST(date_trunc('quarter', qend) AS DATE) AS start_date, qend AS end_date
 FROM page WHERE kind <> '3-MEDIUM' AND NOT (kind = '1-URGENT' AND k > 700)
 UNION ALL SELECT doc_id, 'depreciation', 1 * CASE kind WHEN '5-LOW' THEN 1e6 ELSE 1e3 END, CAST(date_trunc('quarter', qend) AS DATE), qend FROM page WHERE kind IN ('1-URGENT', '4-NOT SPECIFIED', '5-LOW') AND NOT (kind = '1-URGENT' AND k > 700)
 UNION ALL SELECT doc_id, 'depreciation', 2 * CASE kind WHEN '5-LOW' THEN 1e6 ELSE 1e3 END, make_date(year(qend), 1, 1), make_date(year(qend), 12, 31) FROM page WHERE kind IN ('1-URGENT', '4-NOT SPECIFIED', '5-LOW'))"""


def statements(v: Views):
    parsed = written(X.parsed_tables(pages(v)), "parsed-tables")
    return X.statement_facts(X.cells_of(parsed), X.contexts_of(parsed), filing_dates(v))


@query("E05_statement_facts", f"WITH {_STATEMENTS} SELECT * FROM st")
def e05(v: Views):
    return statements(v).select("doc_id", "metric", "value", "start_date", "end_date")


@query("E06_slide_facts", f"WITH {PAGE_SQL} SELECT doc_id, 'USD' AS currency, CAST(date_trunc('quarter', qend) AS DATE) AS start_date, qend AS end_date, v1 * 1e6 AS value FROM page")
def e06(v: Views):
    text = F.concat(F.lit("Investor slides Adjusted EBITDA Reconciliation (US $m) Quarter ended "), F.date_format("qend", "MMMM d, yyyy"), F.lit(" Net income 5 Adjusted EBITDA "),
                    F.format_number("v1", 0), F.lit(" Adjusted EBITDA Margin 12%"))
    return X.slide_facts(page_fields(v).select("doc_id", text.alias("text")))


def tagged(v: Views, inline: bool):
    kind = c("kind")
    start = F.trunc("qend", "quarter").cast("string")
    segment = F.when(kind == "3-MEDIUM", "<xbrli:segment><m>Products</m></xbrli:segment>").otherwise("")
    context = F.concat(F.lit('<xbrli:context id="c1"><xbrli:entity>'), segment, F.lit("</xbrli:entity><xbrli:period><xbrli:startDate>"), start, F.lit("</xbrli:startDate><xbrli:endDate>"),
                       c("qend").cast("string"), F.lit('</xbrli:endDate></xbrli:period></xbrli:context><xbrli:unit id="u1"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit>'))
    sign = F.when(kind == "2-HIGH", ' sign="-"').otherwise("")
    if inline:
        fact = F.concat(F.lit('<p>Revenue was <ix:nonFraction name="us-gaap:Revenues" contextRef="c1" unitRef="u1" scale="3"'), sign, F.lit(">"), F.format_number("v1", 0),
                        F.lit('</ix:nonFraction></p><ix:nonFraction name="us-gaap:Assets" contextRef="c1" unitRef="u1">5</ix:nonFraction>'))
    else:
        fact = F.concat(F.lit('<us-gaap:Revenues contextRef="c1" unitRef="u1" decimals="0" scale="3"'), sign, F.lit(">"), c("v1").cast("string"),
                        F.lit('</us-gaap:Revenues><us-gaap:Assets contextRef="c1" unitRef="u1">5</us-gaap:Assets>'))
    return page_fields(v).select("doc_id", F.concat(F.lit("<x>"), context, fact, F.lit("</x>")).alias("html"))


_TAGGED = f"""
WITH {PAGE_SQL} SELECT doc_id, 'us-gaap' AS namespace, 'Revenues' AS concept, CAST(v1 * 1000 * CASE WHEN kind = '2-HIGH' THEN -1 ELSE 1 END AS DOUBLE) AS value, 'USD' AS currency, CAST(date_trunc('quarter', qend) AS DATE) AS start_date, qend AS end_date, kind = '3-MEDIUM' AS segmented FROM page"""


@query("E07_inline_facts", _TAGGED)
def e07(v: Views):
    rows = X.inline_facts(tagged(v, True))
    return rows.select("doc_id", "namespace", "concept", "value", "currency", "start_date", "end_date", c("segment").isNotNull().alias("segmented"))


@query("E08_instance_facts", _TAGGED)
def e08(v: Views):
    rows = X.instance_facts(tagged(v, False), "html")
    return rows.select("doc_id", "namespace", "concept", "value", "currency", "start_date", "end_date", c("segment").isNotNull().alias("segmented"))


BASE = "https://archive.example.org/data"


def exhibits(v: Views):
    links = F.concat(F.lit('<a href="ex99-1.htm">Press</a> <a href="ex99-1.htm">again</a> <a href="notes.pdf">99.1</a> <a href="https://archive.example.org/data/'), c("doc_id").cast("string"),
                     F.lit('/q.html">Results</a> <a href="https://other.example.org/results.htm">Results</a> <a href="index.htm">Index</a>'))
    return X.linked_exhibits(page_fields(v).select("doc_id", c("doc_id").cast("string").alias("folder"), links.alias("html")), BASE)


@query("E09_linked_exhibits", f"""
SELECT o_orderkey AS doc_id, '{BASE}/' || o_orderkey || '/' || n AS url, n AS name FROM orders, (VALUES ('ex99-1.htm'), ('q.html')) t(n)""")
def e09(v: Views):
    return exhibits(v)


_NOISE = "|".join(rf"<{t}[^>]*>[\s\S]*?</{t}>" for t in X.NOISE)
_READ = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--[\s\S]*?-->', ' ', 'g'), '{_NOISE}', ' ', 'gi'), '<(?:br|hr)\s*/?>', chr(10), 'gi'), '</(?:p|div|section|article|main|li|h[1-6]|tr)>', chr(10), 'gi')"""
_DEC = "replace(replace(replace(replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>')"
READABLE_SQL = rf"""array_to_string(list_filter(list_transform(string_split({_DEC.format(x=_READ)}, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))),
 lambda x: length(x) >= 35 AND NOT regexp_matches(x, '(?i)^(cookie|privacy policy|terms of use|subscribe|sign in)\b')), chr(10))"""


@query("E11_readable_text", rf"""
SELECT page_id, nullif(replace(replace(replace(replace(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), '&amp;', '&'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '') AS title,
 length(t) AS n_chars, md5(t) AS text_md5 FROM (SELECT page_id, html, {READABLE_SQL} AS t FROM pages)""")
def e11(v: Views):
    return X.readable_text(v.table("pages").select("page_id", "html")).select("page_id", "title", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("E12_forecast_row", f"WITH {PAGE_SQL} SELECT doc_id, CASE WHEN kind = '1-URGENT' THEN k * 1e6 ELSE v1 * 1e9 END AS value FROM page")
def e12(v: Views):
    years = F.when(c("kind") == "1-URGENT", "FY 2022 FY 2023").otherwise("FY 2023 FY 2024")
    text = F.concat(F.lit("Fiscal Year "), years, F.lit(" Period Ending Dec\nOperating Income "), c("v1").cast("string"), F.lit("B "), c("k").cast("string"), F.lit("M\nNet Income 1B 2B\n"))
    return X.forecast_row(page_fields(v).select("doc_id", text.alias("text")), "Operating Income", 2023, ["Net Income", "EPS"])


@query("E13_evidence_documents", f"""
WITH near AS (SELECT q.o_orderkey AS call_id, f.o_orderkey AS doc_id, f.accession, f.form, f.primary_document, abs(CAST(q.filing_date - 5 AS DATE) - f.filing_date) AS distance,
 CASE f.form WHEN '8-K' THEN 1 WHEN '6-K' THEN 2 WHEN '10-Q' THEN 3 WHEN '10-K' THEN 4 ELSE 0 END AS fr
 FROM v_filings q JOIN v_filings f ON q.ticker = f.ticker AND abs(CAST(q.filing_date - 5 AS DATE) - f.filing_date) <= 18 WHERE q.form = '10-Q'),
pf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY call_id, form ORDER BY distance, accession) AS rn FROM near) WHERE rn = 1),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY distance, fr, accession) AS pick FROM pf) WHERE pick <= 4),
every AS (SELECT o_orderkey AS call_id, 'https://ir.example.org/' || o_orderkey AS url, 'Company Document' AS source FROM v_filings WHERE form = '10-Q'
 UNION ALL SELECT call_id, '{BASE}/' || doc_id || '/' || primary_document, form FROM picked
 UNION ALL SELECT call_id, '{BASE}/' || doc_id || '/' || n, 'Exhibit of ' || form FROM picked, (VALUES ('ex99-1.htm'), ('q.html')) t(n) WHERE form IN ('8-K', '6-K')),
once AS (SELECT call_id, url, min(source) AS source FROM every GROUP BY ALL)
SELECT call_id, o.url, source, f.form || ' ' || f.accession AS text FROM once o LEFT JOIN v_filings f ON o.url = '{BASE}/' || f.o_orderkey || '/' || f.primary_document""")
def e13(v: Views):
    filings = v.filings()
    calls = filings.where("form = '10-Q'").select("ticker", c("o_orderkey").alias("call_id"), F.date_sub("filing_date", 5).alias("call_date"))
    url = F.concat(F.lit(BASE + "/"), c("o_orderkey").cast("string"), F.lit("/"), "primary_document")
    documents = filings.select("accession", url.alias("url"), F.concat_ws(" ", "form", "accession").alias("text"))
    attached = exhibits(v).join(filings.select(c("o_orderkey").alias("doc_id"), "accession"), "doc_id").select("accession", "url")
    linked = calls.select("call_id", F.concat(F.lit("https://ir.example.org/"), c("call_id").cast("string")).alias("url"))
    return X.evidence_documents(calls, linked, filings.select("ticker", "accession", "form", "filing_date"), documents, attached)


def filed_pages(v: Views):
    """The document of every filing: a page with tagged numbers, a fourth of them instance documents; a segment has half the number."""
    start, end, price = F.trunc("report_date", "quarter"), c("report_date"), F.format_number("o_totalprice", 2)
    bounds = F.concat(F.lit("<xbrli:period><xbrli:startDate>"), start.cast("string"), F.lit("</xbrli:startDate><xbrli:endDate>"), end.cast("string"), F.lit("</xbrli:endDate></xbrli:period>"))
    context = F.concat(F.lit('<xbrli:context id="c1">'), bounds, F.lit('</xbrli:context><xbrli:context id="c2"><xbrli:segment>Products</xbrli:segment>'), bounds,
                       F.lit('</xbrli:context><xbrli:unit id="u1"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit>'))
    half = F.format_number(c("o_totalprice") / 2, 2)
    tag = lambda number, of: F.concat(F.lit(f'<p><ix:nonFraction name="us-gaap:Revenues" contextRef="{of}" unitRef="u1">'), number, F.lit("</ix:nonFraction></p>"))
    element = lambda number, of: F.concat(F.lit(f'<us-gaap:Revenues contextRef="{of}" unitRef="u1">'), number, F.lit("</us-gaap:Revenues>"))
    inline = F.concat(F.lit("<html>"), context, tag(half, "c2"), tag(price, "c1"), F.lit("</html>"))
    instance = F.concat(F.lit("<xbrl>"), context, element(half, "c2"), element(price, "c1"), F.lit("</xbrl>"))
    other = c("o_orderkey") % 4 == 3
    rows = v.filings().join(v.table("orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return rows.select("accession", F.when(other, "xml").otherwise("html").alias("kind"), F.when(other, instance).otherwise(inline).alias("body"))


@query("E14_complete_gaps", _NEAR + f""", ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gap_id ORDER BY score, filing_date DESC, accession DESC) AS pick FROM (
SELECT gap_id, accession, filing_date, abs(report_date - gap_end) - CASE WHEN form IN ('10-K', '10-K/A', '10-Q', '10-Q/A') THEN 80 ELSE 0 END - CASE WHEN form IN ('10-K', '10-K/A') THEN 35 ELSE 0 END - CASE WHEN suffix(form, '/A') THEN 5 ELSE 0 END AS score FROM near)) WHERE pick <= 6)
SELECT r.gap_id, r.accession, 'revenue' AS metric, o.o_totalprice AS value FROM ranked r JOIN v_filings f USING (accession) JOIN orders o ON f.o_orderkey = o.o_orderkey WHERE r.filing_date <= DATE '1999-12-31' AND f.report_date <= DATE '1999-12-31'""")
def e14(v: Views):
    path = shared_folder(v.spark, "filed-documents")
    CO.write_documents(filed_pages(v), path)
    asked = gaps(v).select("ticker", F.lit("revenue").alias("metric"), "purpose", "gap_start", "gap_end", "gap_id")
    filings = v.filings().withColumns({"fye_month": F.lit(12), "fye_day": F.lit(31)})
    chosen = cut_lineage(FL.rank_targeted_filings(filings, asked, F.lit(False)).select("gap_id", "accession"))
    facts = CO.extracted_records(CO.chosen_documents(v.spark, path, chosen), filings, "1999-12-31", ["revenue"])
    return chosen.join(facts, "accession").select("gap_id", "accession", "metric", "value")


def eligible_rows(v: Views):
    facts = recon(v)[0].join(page_fields(v).select("doc_id", "k", "kind"), "doc_id")
    return facts.withColumns({
        "source_kind": F.lit("RECONCILIATION_TABLE"), "table_title": F.lit("Reconciliation"), "row_label": c("label"), "column_label": F.when(c("k") != 13, c("type")), "source_id": c("doc_id").cast("string"),
        "source_hash": F.lit("h"), "filing_url": F.lit("u"), "accession": c("doc_id").cast("string"), "period_type": c("type"), "reported_units": F.lit("units"), "form": F.lit("10-K"),
        "segment": F.lit(None).cast("string")})


@query("P23_is_eligible_recon_fact", f"WITH {_FACTS} SELECT doc_id, type, k <> 13 AS eligible FROM facts")
def p23(v: Views):
    return eligible_rows(v).select("doc_id", "type", CM.is_eligible_recon_fact().alias("eligible"))


@query("A30_evidence_count", f"""
WITH {_FACTS} SELECT CAST(k AS VARCHAR) AS ticker, CAST(y AS INTEGER) AS year, count(*) AS facts FROM facts JOIN (VALUES (2017), (2018), (2019)) t(y) ON year(start_date) <= y AND year(end_date) >= y GROUP BY ALL""")
def a30(v: Views):
    return CM.evidence_count(eligible_rows(v).withColumn("ticker", c("k").cast("string")), [2017, 2018, 2019])


@query("W11_select_authoritative_recon", f"""
WITH {_FACTS} SELECT ticker, type AS period_type, start_date, end_date, doc_id, alternatives FROM (SELECT CAST(k AS VARCHAR) AS ticker, type, start_date, end_date, doc_id, count(*) OVER (PARTITION BY k, type, start_date, end_date) - 1 AS alternatives,
 row_number() OVER (PARTITION BY k, type, start_date, end_date ORDER BY CASE WHEN type = 'CALENDAR_YEAR' THEN CASE kind WHEN '5-LOW' THEN 1e6 ELSE 1e3 END END, CASE WHEN type = 'CALENDAR_YEAR' THEN o_orderdate END, CASE WHEN type <> 'CALENDAR_YEAR' THEN o_orderdate END DESC,
  CASE WHEN type = 'CALENDAR_YEAR' THEN CAST(doc_id AS VARCHAR) END, CASE WHEN type <> 'CALENDAR_YEAR' THEN CAST(doc_id AS VARCHAR) END DESC) AS rn FROM facts JOIN orders ON doc_id = o_orderkey) WHERE rn = 1""")
def w11(v: Views):
    filed = v.table("orders").select(c("o_orderkey").alias("doc_id"), F.to_date("o_orderdate").alias("filed"))
    rows = eligible_rows(v).withColumn("ticker", c("k").cast("string")).join(filed, "doc_id")
    return CM.select_authoritative_recon(rows).select("ticker", "period_type", "start_date", "end_date", "doc_id", "alternatives")


BASE_TERMS = ["stock based compensation", "restructuring charges", "impairment of goodwill", "acquisition costs", "depreciation", "interest", "severance", "litigation"]


def definitions(v: Views):
    """Definitions of a supplier: eight shared terms, one of them replaced in second quarters; in the third quarter of 1996
    another one too, which fits the second quarter's wording but no other."""
    odd = F.when(c("fiscal_quarter") == 2, "fx").when((c("fiscal_quarter") == 3) & (c("fiscal_year") == 1998), "wholly other words")
    terms = F.array(*[F.lit(t) for t in BASE_TERMS])
    chained = F.concat(F.slice(terms, 1, 6), F.array(F.lit("foreign exchange"), F.lit("hedging")))
    own = F.when((c("fiscal_quarter") == 3) & (c("fiscal_year") == 1996), chained).when(odd == "fx", F.array_append(F.slice(terms, 1, 7), F.lit("foreign exchange"))).when(odd.isNotNull(), F.array(*[F.lit(f"term {x}") for x in "pqrst"])).otherwise(terms)
    rows = v.fiscal().where("metric = 'adjustedEbitda'").withColumn("terms", own)
    return rows.withColumn("fingerprint", F.md5(F.array_join("terms", "|")))


@query("Q12_definitions_compatible", """
SELECT ticker, fiscal_year, NOT (fiscal_year = 1998 AND bool_or(fiscal_quarter = 3) AND count(*) > 1) AND NOT (fiscal_year = 1996 AND bool_or(fiscal_quarter = 3) AND bool_or(fiscal_quarter IN (1, 4))) AS compatible FROM v_fiscal WHERE metric = 'adjustedEbitda' GROUP BY ticker, fiscal_year""")
def q12(v: Views):
    rows = definitions(v)
    return CM.definitions_compatible(rows, ["ticker", "fiscal_year"])


def entries(v: Views):
    """Yearly entries with their four quarters; a few are broken on purpose."""
    part = F.struct(c("start_date").alias("source_start"), c("end_date").alias("source_end"), F.concat_ws(":", "ticker", "start_date").alias("source_id"), c("value").alias("normalized_value"),
                    F.when((c("fiscal_year") == 1996) & (c("fiscal_quarter") == 4), "EUR").otherwise("USD").alias("currency"), F.lit("QUARTER").alias("role"))
    rows = v.fiscal().where("metric = 'adjustedEbitda'").groupBy("ticker", "fiscal_year").agg(
        F.sort_array(F.collect_list(part)).alias("components"), F.sum("value").alias("value"), F.min("start_date").alias("ltm_start"), F.max("end_date").alias("ltm_end"))
    return rows.withColumns({"value": c("value") + F.when(c("fiscal_year") == 1997, 1).otherwise(0), "derivation": F.lit("SUM_OF_FOUR_QUARTERS"), "requested": F.lit("LTM")})


@query("Q11_assert_company_metric", """
SELECT ticker, fiscal_year, concat_ws(',', CASE WHEN fiscal_year = 1996 AND count(*) > 1 AND bool_or(fiscal_quarter = 4) THEN 'CURRENCY_MIXED' END, CASE WHEN count(*) <> 4 THEN 'QUARTER_COUNT' END, CASE WHEN fiscal_year = 1997 THEN 'QUARTER_SUM_MISMATCH' END) AS failures
FROM v_fiscal WHERE metric = 'adjustedEbitda' GROUP BY ticker, fiscal_year""")
def q11(v: Views):
    return CM.assert_company_metric(entries(v)).select("ticker", "fiscal_year", F.array_join("failures", ",").alias("failures"))


@query("Q13_lineage_identity")
def q13(v: Views):
    entry = {"metric": F.lit("COMPANY_METRIC"), "value": c("value"), "ltm_start": c("ltm_start"), "ltm_end": c("ltm_end"), "derivation": c("derivation")}
    return entries(v).select("ticker", "fiscal_year", CM.lineage_identity(entry, c("components")).alias("identity"))


@query("Q14_negative_search_status", """
SELECT v.ticker, v.period, CASE WHEN year = 1998 AND region_key = 1 THEN 'NOT_REPORTED' WHEN year = 1998 AND region_key = 2 THEN 'LEGITIMATE_NA' ELSE v.status END AS status FROM v_cells v WHERE metric = 'adjustedEbitda'""")
def q14(v: Views):
    cells = v.cells().where("metric = 'adjustedEbitda'").withColumn("components", F.lit(3))
    searches = v.cells().where("metric = 'adjustedEbitda' AND year = 1998 AND region_key IN (1, 2)").select(
        "ticker", "period", F.lit(True).alias("completed"), F.when(c("region_key") == 1, 0).otherwise(2).alias("eligible_found"))
    return CM.negative_search_status(cells, searches).select("ticker", "period", "status")


@query("V11_company_metric_build", f"""
WITH {QUARTERS_SQL}, y AS (SELECT CAST(y AS INTEGER) AS year FROM (VALUES (1996), (1997), (1998), (1999), (2000)) t(y)), keys AS (SELECT DISTINCT ticker, year FROM sq, y WHERE metric = 'adjustedEbitda'),
d AS (SELECT ticker, year(end_date) AS year, max(value) AS v FROM win WHERE metric = 'adjustedEbitda' AND period_type = 'FISCAL_YEAR' AND strftime(start_date, '%m-%d') = '01-01' AND strftime(end_date, '%m-%d') = '12-31' GROUP BY ALL),
q AS (SELECT ticker, year(end_date) AS year, CASE WHEN count(*) = 4 THEN sum(value) END AS v FROM sq WHERE metric = 'adjustedEbitda' GROUP BY ALL)
SELECT k.ticker, k.year, coalesce(d.v, q.v) AS value, CASE WHEN d.v IS NOT NULL THEN 'DIRECT' WHEN q.v IS NOT NULL THEN 'SUM_OF_FOUR_QUARTERS' END AS derivation FROM keys k LEFT JOIN d USING (ticker, year) LEFT JOIN q USING (ticker, year)""")
def v11(v: Views):
    from tidemark.catalog.q_rollups import observations

    obs, quarters = observations(v)
    columns = [x for x in obs.columns if x in quarters.columns]
    facts = obs.where("metric = 'adjustedEbitda' AND period_type <> 'STANDALONE_QUARTER'").select(columns).unionByName(
        quarters.where("metric = 'adjustedEbitda'").select(columns))
    return CM.company_metric_years(facts, [1996, 1997, 1998, 1999, 2000]).select("ticker", "year", "value", "derivation")


