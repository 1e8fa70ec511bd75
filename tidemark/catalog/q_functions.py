"""Scalar functions (F01-F40) over whole columns of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.views import Views
from tidemark.functions import dates as D
from tidemark.functions import numbers as N
from tidemark.functions import strings as S

ARCHIVE = "https://archive.example.org/data"
c = F.col


@query("F01_pad_cik", """
SELECT c_custkey, lpad(regexp_replace(c_name, '[^0-9]', '', 'g'), 10, '0') AS padded,
 CAST(CAST(regexp_replace(c_name, '[^0-9]', '', 'g') AS BIGINT) AS VARCHAR) AS compact FROM customer""")
def f01(v: Views):
    return v.table("customer").select("c_custkey", S.pad_cik(c("c_name")).alias("padded"), S.compact_cik(c("c_name")).alias("compact"))


@query("F02_filing_url", f"""
SELECT accession, '{ARCHIVE}/' || CAST(CAST(cik AS BIGINT) AS VARCHAR) || '/' || replace(accession, '-', '') || '/' ||
 primary_document AS url, CAST(NULL AS VARCHAR) AS bad_url FROM v_filings""")
def f02(v: Views):
    return v.filings().select(
        "accession", S.filing_url(c("cik"), c("accession"), c("primary_document"), ARCHIVE).alias("url"),
        S.filing_url(c("cik"), c("accession"), F.concat(F.lit("../"), c("primary_document")), ARCHIVE).alias("bad_url"),
    )


@query("F03_normalize_ws", r"""
SELECT page_id, md5(trim(regexp_replace(html, '[ \t\n\v\f\r]+', ' ', 'g'))) AS ws,
 md5(replace(replace(replace(replace(html, '&amp;', '&'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>')) AS decoded FROM pages""")
def f03(v: Views):
    return v.table("pages").select("page_id", F.md5(S.normalize_ws(c("html"))).alias("ws"), F.md5(S.decode_entities(c("html"))).alias("decoded"))


_STRIP = r"""regexp_replace(regexp_replace(html, '<script[\s\S]*?</script>|<style[\s\S]*?</style>', ' ', 'gi'), '{tags}', '{sep}', 'gi')"""
_DECODE = "replace(replace(replace(replace({x}, '&amp;', '&'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>')"


@query("F04_strip_html", rf"""
SELECT page_id, length(t) AS n_chars, md5(t) AS text_md5, len(l) AS n_lines, md5(array_to_string(l, chr(10))) AS lines_md5 FROM (
SELECT page_id, trim(regexp_replace({_DECODE.format(x=_STRIP.format(tags='<[^>]+>', sep=' '))}, '\s+', ' ', 'g')) AS t,
 list_filter(list_transform(string_split(trim(regexp_replace({_DECODE.format(x="regexp_replace(" + _STRIP.format(tags='<(?:br|/p|/div|/tr|/li|/h[1-6])[^>]*>', sep='␞') + ", '<[^>]+>', ' ', 'g')")}, '\s+', ' ', 'g')), '␞'),
  lambda x: trim(x)), lambda x: x <> '') AS l FROM pages)""")
def f04(v: Views):
    text, lines = S.strip_html(c("html")), S.html_to_lines(c("html"))
    return v.table("pages").select(
        "page_id", F.length(text).cast("bigint").alias("n_chars"), F.md5(text).alias("text_md5"),
        F.size(F.split(lines, "\n")).cast("bigint").alias("n_lines"), F.md5(lines).alias("lines_md5"),
    )


@query("F05_humanize_concept", r"""
SELECT DISTINCT concept, trim(regexp_replace(regexp_replace(concept, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_-]+', ' ', 'g')) AS label
FROM v_ledger""")
def f05(v: Views):
    return v.ledger().select("concept").distinct().withColumn("label", S.humanize_concept(c("concept")))


@query("F06_safe_key", "SELECT o_orderkey, regexp_replace(o_orderpriority || '#' || o_orderstatus, '[^A-Za-z0-9._-]', '_', 'g') AS safe FROM orders")
def f06(v: Views):
    return v.table("orders").select("o_orderkey", S.safe_key(F.concat("o_orderpriority", F.lit("#"), "o_orderstatus")).alias("safe"))


@query("F07_parse_compact_number", """
SELECT p_partkey, CAST(p_size AS DOUBLE) * CASE WHEN p_size < 10 THEN 1e3 WHEN p_size < 20 THEN 1e6 WHEN p_size < 30 THEN 1e9
 WHEN p_size < 40 THEN 1e12 ELSE 1 END AS value, CAST(NULL AS DOUBLE) AS junk FROM part""")
def f07(v: Views):
    size = c("p_size")
    suffix = F.when(size < 10, "K").when(size < 20, "M").when(size < 30, "B").when(size < 40, "T").otherwise("")
    return v.table("part").select(
        "p_partkey", N.parse_compact_number(F.concat(size.cast("string"), suffix)).alias("value"),
        N.parse_compact_number(c("p_name")).alias("junk"),
    )


@query("F08_parse_cell_number", """
SELECT s_suppkey, round(s_acctbal, 2) AS value, CAST(NULL AS DOUBLE) AS dash FROM supplier""")
def f08(v: Views):
    amount = F.format_number(F.abs("s_acctbal"), 2)
    cell = F.when(c("s_acctbal") < 0, F.concat(F.lit("($"), amount, F.lit(")"))).otherwise(F.concat(F.lit("$ "), amount))
    return v.table("supplier").select("s_suppkey", N.parse_cell_number(cell).alias("value"), N.parse_cell_number(F.lit("—")).alias("dash"))


@query("F09_parse_tagged_number", """
SELECT p_partkey, CASE WHEN p_size = 1 THEN NULL ELSE CAST(p_size AS DOUBLE) * 1000 * CASE WHEN p_type = 'ECONOMY' THEN -1 ELSE 1 END END AS value
FROM part""")
def f09(v: Views):
    return v.table("part").select(
        "p_partkey",
        N.parse_tagged_number(c("p_size").cast("string"), F.lit("3"), F.when(c("p_type") == "ECONOMY", "-"),
                              F.when(c("p_size") == 1, "true")).alias("value"),
    )


@query("F10_infer_units", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'USD' WHEN '2-HIGH' THEN 'EUR' WHEN '3-MEDIUM' THEN 'GBP' END AS currency,
 CASE o_orderpriority WHEN '1-URGENT' THEN 1e3 WHEN '2-HIGH' THEN 1e6 WHEN '3-MEDIUM' THEN 1e9 END AS scale FROM orders""")
def f10(v: Views):
    p = c("o_orderpriority")
    title = (
        F.when(p == "1-URGENT", "Reconciliation (USD in thousands)").when(p == "2-HIGH", "in EUR millions, unaudited")
        .when(p == "3-MEDIUM", "Amounts in GBP billions").when(p == "4-NOT SPECIFIED", "USD figures").otherwise("in millions of shares")
    )
    currency, scale = N.infer_units(title)
    return v.table("orders").select("o_orderkey", currency.alias("currency"), scale.alias("scale"))


@query("F11_iso_date", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed, CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS INTEGER) AS day_number,
 CAST(o_orderdate AS DATE) AS back, CAST(NULL AS DATE) AS impossible FROM orders""")
def f11(v: Views):
    day = D.iso_date(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return v.table("orders").select(
        "o_orderkey", day.alias("parsed"), D.epoch_day(day).alias("day_number"), D.from_epoch_day(D.epoch_day(day)).alias("back"),
        D.iso_date(F.concat(F.year("o_orderdate").cast("string"), F.lit("-02-30"))).alias("impossible"),
    )


@query("F12_inclusive_days", """
SELECT source_id, CAST(end_date - start_date AS INTEGER) + 1 AS days, CAST(NULL AS INTEGER) AS reversed FROM v_obs""")
def f12(v: Views):
    return v.obs().select("source_id", D.inclusive_days(c("start_date"), c("end_date")).alias("days"),
                          D.inclusive_days(c("filed"), c("start_date")).alias("reversed"))


@query("F13_day_after_shift_year", """
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 1 AS DATE) AS next_day, CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 YEAR AS DATE) AS year_before,
 CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 YEAR AS DATE) AS year_after FROM orders""")
def f13(v: Views):
    day = F.to_date("o_orderdate")
    return v.table("orders").select("o_orderkey", D.day_after(day).alias("next_day"), D.shift_year(day, -1).alias("year_before"),
                                    D.shift_year(day, 1).alias("year_after"))


@query("F14_shift_quarter_end", """
SELECT o_orderkey, CAST(CASE WHEN d = last_day(d) THEN last_day(d - INTERVAL 3 MONTH) ELSE d - INTERVAL 3 MONTH END AS DATE) AS q1,
 CAST(CASE WHEN d = last_day(d) THEN last_day(d - INTERVAL 9 MONTH) ELSE d - INTERVAL 9 MONTH END AS DATE) AS q3
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def f14(v: Views):
    day = F.to_date("o_orderdate")
    return v.table("orders").select("o_orderkey", D.shift_quarter_end(day, 1).alias("q1"), D.shift_quarter_end(day, 3).alias("q3"))


@query("F15_fiscal_ranges", """
SELECT DISTINCT ticker, fiscal_year, fiscal_quarter, CAST(last_day(make_date(fiscal_year - 1, fye_month, 1)) + 1 AS DATE) AS year_start,
 last_day(make_date(fiscal_year, fye_month, 1)) AS year_end, start_date AS quarter_start, end_date AS quarter_end FROM v_fiscal""")
def f15(v: Views):
    fiscal = v.fiscal().select("ticker", "fiscal_year", "fiscal_quarter", "fye_month").distinct()
    day = F.dayofmonth(F.last_day(F.make_date(F.lit(2001), c("fye_month"), F.lit(1))))
    year = D.fiscal_year_range(c("fiscal_year"), c("fye_month"), day)
    quarter = D.fiscal_quarter_range(c("fiscal_year"), c("fiscal_quarter"), c("fye_month"), day)
    return fiscal.select("ticker", "fiscal_year", "fiscal_quarter", year[0].alias("year_start"), year[1].alias("year_end"),
                         quarter[0].alias("quarter_start"), quarter[1].alias("quarter_end"))


@query("F16_parse_date_header", """
SELECT o_orderkey, CAST(CASE WHEN year(o_orderdate) >= 2000 THEN o_orderdate END AS DATE) AS month_first,
 CAST(CASE WHEN year(o_orderdate) >= 2000 THEN o_orderdate END AS DATE) AS day_first FROM orders""")
def f16(v: Views):
    return v.table("orders").select(
        "o_orderkey",
        D.parse_date_header(F.concat(F.lit("Three months ended "), F.date_format("o_orderdate", "MMMM d, yyyy"))).alias("month_first"),
        D.parse_date_header(F.concat(F.date_format("o_orderdate", "d MMM yyyy"), F.lit(" (unaudited)"))).alias("day_first"),
    )


@query("F17_near_boundary", """
SELECT source_id, coalesce(abs(end_date - make_date(year(end_date), 12, 31)) <= 7, FALSE) AS near_year_end FROM v_all_obs""")
def f17(v: Views):
    return v.all_obs().select("source_id", D.near_boundary(c("end_date"), F.make_date(F.year("end_date"), F.lit(12), F.lit(31))).alias("near_year_end"))


@query("F18_reference_targets", """
SELECT DISTINCT day, key, CAST(target AS DATE) AS target FROM (
 UNPIVOT (SELECT day, CAST(day - 7 AS TIMESTAMP) AS week, day - INTERVAL 1 MONTH AS month, day - INTERVAL 3 MONTH AS month3,
  day - INTERVAL 6 MONTH AS month6, CAST(date_trunc('year', day) AS TIMESTAMP) - INTERVAL 1 DAY AS ytd, day - INTERVAL 12 MONTH AS year,
  day - INTERVAL 18 MONTH AS month18, day - INTERVAL 24 MONTH AS year2, CAST(DATE '2000-01-03' AS TIMESTAMP) AS custom FROM v_lines)
 ON COLUMNS(* EXCLUDE (day)) INTO NAME key VALUE target)""")
def f18(v: Views):
    days = v.lines().select("day").distinct()
    return days.select("day", F.inline(D.reference_targets(c("day"), F.to_date(F.lit("2000-01-03")))))


@query("F19_range_start", """
SELECT DISTINCT day, range_key, CAST(CASE range_key WHEN 'ytd' THEN date_trunc('year', day) WHEN '1mo' THEN day - INTERVAL 1 MONTH
 WHEN '6mo' THEN day - INTERVAL 6 MONTH WHEN '2y' THEN day - INTERVAL 24 MONTH ELSE day - INTERVAL 1 DAY END AS DATE) AS start
FROM v_lines, (VALUES ('ytd'), ('1mo'), ('6mo'), ('2y'), ('1d')) AS r(range_key)""")
def f19(v: Views):
    keys = F.explode(F.array(*[F.lit(k) for k in ("ytd", "1mo", "6mo", "2y", "1d")]))
    return v.lines().select("day").distinct().select("day", keys.alias("range_key")).withColumn("start", D.range_start(c("range_key"), c("day")))


@query("F20_period_labels", """
SELECT o_orderkey, 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) AS calendar_label,
 CASE WHEN o_orderstatus = 'O' THEN 'half' ELSE 'quarter' END AS type,
 CASE WHEN o_orderstatus = 'O' THEN 'H1 ' ELSE 'Q' || quarter(o_orderdate) || ' ' END || year(o_orderdate) AS label,
 CAST(year(o_orderdate) AS INTEGER) AS year FROM orders""")
def f20(v: Views):
    title = F.concat(F.when(c("o_orderstatus") == "O", F.lit("Earnings Call: H1 ")).otherwise(
        F.concat(F.lit("Results q"), F.quarter("o_orderdate").cast("string"), F.lit(" "))), F.year("o_orderdate").cast("string"))
    p = D.parse_period_label(title)
    return v.table("orders").select("o_orderkey", D.calendar_quarter_label(c("o_orderdate")).alias("calendar_label"),
                                    p["type"].alias("type"), p["label"].alias("label"), p["year"].alias("year"))


@query("F21_growth", """
SELECT p.ticker, p.day, (p.close - p.adj_close) / abs(p.adj_close) AS g_abs, p.close / p.adj_close - 1 AS g_ratio,
 (p.close / p.adj_close - 1) * 100 AS g_pct FROM v_prices p WHERE adj_close <> 0""")
def f21(v: Views):
    a, b = c("close"), c("adj_close")
    return v.prices().where("adj_close <> 0").select("ticker", "day", N.growth_abs(a, b).alias("g_abs"), N.growth_ratio(a, b).alias("g_ratio"),
                                                     N.percent_change(a, b).alias("g_pct"))


@query("F22_close_enough", """
SELECT ticker, day, abs(close - adj_close) <= greatest(1.0, abs(close), abs(adj_close)) * 0.05 AS agree FROM v_prices""")
def f22(v: Views):
    return v.prices().select("ticker", "day", N.close_enough(c("close"), c("adj_close"), 0.05).alias("agree"))


@query("F23_enterprise_value", """
SELECT c_custkey, c_acctbal * 10 AS equity, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal * 10 + 500.5 + 0 + 0 - 20.25 + 0 END AS ev FROM customer""")
def f23(v: Views):
    debt = F.when(c("c_mktsegment") != "BUILDING", F.lit(500.5))
    equity, ev = N.enterprise_value(c("c_acctbal"), F.lit(10.0), debt, F.lit(20.25))
    return v.table("customer").select("c_custkey", equity.alias("equity"), ev.alias("ev"))


@query("F24_valuation_multiple", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 1e6 / c_acctbal END AS multiple FROM customer")
def f24(v: Views):
    return v.table("customer").select("c_custkey", N.valuation_multiple(F.lit(1e6), c("c_acctbal")).alias("multiple"))


@query("F25_margins", """
SELECT ticker, start_date, CASE WHEN revenue <> 0 THEN ebit / revenue END AS margin,
 CASE WHEN revenue <> 0 THEN 1000000.0 * (ebit / revenue) END AS forward FROM v_quarter_wide""")
def f25(v: Views):
    return v.quarter_wide().select("ticker", "start_date", N.margin(c("ebit"), c("revenue")).alias("margin"),
                                   N.forward_by_margin(F.lit(1000000.0), c("ebit"), c("revenue")).alias("forward"))


@query("F26_overlap_days", """
SELECT source_id, greatest(0, CAST(least(end_date, DATE '1999-06-30') - greatest(start_date, DATE '1998-07-01') AS INTEGER) + 1) AS days FROM v_all_obs""")
def f26(v: Views):
    lo, hi = F.to_date(F.lit("1998-07-01")), F.to_date(F.lit("1999-06-30"))
    return v.all_obs().select("source_id", D.overlap_days(c("start_date"), c("end_date"), lo, hi).alias("days"))


@query("F27_ntm_blend", """
SELECT a.ticker, a.metric, CASE WHEN d BETWEEN 0 AND 365 THEN a.value * (d / 365.0) + b.value * (1.0 - d / 365.0) END AS ntm
FROM (SELECT *, CAST(end_date - DATE '2001-09-30' AS DOUBLE) AS d FROM v_estimates WHERE period = '0y') a
JOIN v_estimates b ON a.ticker = b.ticker AND a.metric = b.metric AND b.period = '+1y'""")
def f27(v: Views):
    est = v.estimates()
    now = est.where("period = '0y'").select("ticker", "metric", c("value").alias("cur"), c("end_date").alias("fye"))
    after = est.where("period = '+1y'").select("ticker", "metric", c("value").alias("nxt"))
    left = F.datediff(c("fye"), F.to_date(F.lit("2001-09-30"))).cast("double")
    return now.join(after, ["ticker", "metric"]).select("ticker", "metric", N.ntm_blend(c("cur"), c("nxt"), left).alias("ntm"))


@query("F28_consensus_difference", """
SELECT ticker, day, abs(close - adj_close) / greatest(abs(close), abs(adj_close), 1.0) AS difference,
 CASE WHEN abs(close - adj_close) / greatest(abs(close), abs(adj_close), 1.0) > 0.02 THEN 'DIFFERENCE_ABOVE_TOLERANCE' ELSE 'AGREES' END AS warning
FROM v_prices""")
def f28(v: Views):
    return v.prices().select("ticker", "day", N.relative_difference(c("close"), c("adj_close")).alias("difference"),
                             N.consensus_warning(c("close"), c("adj_close")).alias("warning"))


@query("F29_array_helpers", """
SELECT conv_id, turn, CAST(list_unique(string_split(text, ' ')) AS BIGINT) AS n_distinct, string_split(text, ' ')[-1] AS last_word,
 coalesce(nullif(role, 'system'), 'none') AS first_role FROM conversations""")
def f29(v: Views):
    words = F.split("text", " ")
    return v.table("conversations").select(
        "conv_id", "turn", F.size(F.array_distinct(words)).cast("bigint").alias("n_distinct"), F.element_at(words, -1).alias("last_word"),
        F.coalesce(F.nullif(c("role"), F.lit("system")), F.lit("none")).alias("first_role"))


@query("F30_four_contiguous", """
SELECT ticker, metric, fiscal_year, count(*) = 4 AND max(end_date) - min(start_date) + 1 = sum(end_date - start_date + 1) AS contiguous
FROM v_fiscal GROUP BY ALL""")
def f30(v: Views):
    from tidemark.operators.periods import four_contiguous

    # one row per quarter of one fiscal year: at most four items per array
    periods = v.fiscal().groupBy("ticker", "metric", "fiscal_year").agg(
        F.sort_array(F.collect_list(F.struct("start_date", "end_date"))).alias("periods"))
    return periods.select("ticker", "metric", "fiscal_year", four_contiguous(c("periods")).alias("contiguous"))


@query("F31_record_hash", """
SELECT source_id, sha256(ticker || ':' || metric || ':' || strftime(start_date, '%Y-%m-%d') || ':' || coalesce(accession, '')) AS id,
 sha256('{"ticker":"' || ticker || '","metric":"' || metric || '","filed":"' || strftime(filed, '%Y-%m-%d') || '"}') AS content FROM v_all_obs""")
def f31(v: Views):
    return v.all_obs().select("source_id", S.record_id(c("ticker"), c("metric"), c("start_date"), c("accession")).alias("id"),
                              S.content_hash(c("ticker"), c("metric"), c("filed")).alias("content"))


@query("F32_definition_fingerprint", r"""
SELECT p_partkey, sha256(trim(regexp_replace(regexp_replace(lower(p_name || '|' || p_brand || '|' || p_type), '\d+(?:\.\d+)?', '#', 'g'),
 '[^a-z#]+', ' ', 'g'))) AS fingerprint FROM part""")
def f32(v: Views):
    return v.table("part").select("p_partkey", S.definition_fingerprint(c("p_name"), F.array("p_brand", "p_type")).alias("fingerprint"))


@query("F33_json_lookup", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing FROM events""")
def f33(v: Views):
    parsed = F.try_parse_json("props")
    return v.table("events").select("event_id", F.try_variant_get(parsed, "$.k", "bigint").alias("k"),
                                    F.try_variant_get(parsed, "$.missing.raw", "string").alias("missing"))


@query("F34_url_host", r"""
SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '') AS host,
 coalesce(lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1)), '') AS path FROM pages""")
def f34(v: Views):
    return v.table("pages").select("page_id", S.url_host(c("url")).alias("host"), S.url_path(c("url")).alias("path"))


_STOPS = ",".join(f"'{w}'" for w in S.STOP_WORDS)
GROUPS = [["and", "und"], ["oution", "shly", "wh"]]


@query("F35_tokenize", f"""
SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(list_sort(t), ' ')) AS tokens_md5,
 len(t) + CASE WHEN list_contains(t, 'und') THEN 1 ELSE 0 END + CASE WHEN len(list_intersect(t, ['oution', 'shly', 'wh'])) > 0
 THEN 3 - len(list_intersect(t, ['oution', 'shly', 'wh'])) ELSE 0 END AS n_expanded
FROM (SELECT doc_id, list_filter(list_distinct(string_split(trim(regexp_replace(lower(text), '[^a-z0-9.+-]+', ' ', 'g')), ' ')),
 lambda w: length(w) > 1 AND NOT list_contains([{_STOPS}], w)) AS t FROM documents)""")
def f35(v: Views):
    tokens = S.tokenize(c("text"))
    return v.table("documents").select("doc_id", tokens.alias("t")).select(
        "doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("tokens_md5"),
        F.size(S.expand_synonyms(c("t"), GROUPS)).cast("bigint").alias("n_expanded"))


_NUM_SQL = (r"list_filter(list_transform(regexp_extract_all({x}, '(?i)((?:[$€£¥]\s*)?\d[\d,.]*(?:\.\d+)?\s*"
            r"(?:%|x|bps?|basis points?|million|billion|thousand|m|bn|shares?)?)', 1), "
            r"lambda t: regexp_replace(regexp_replace(replace(lower(t), ',', ''), '\b([mbt])(?:illion|housand)\b', '\1', 'g'), '\s+', '', 'g')), "
            r"lambda t: t <> '' AND NOT regexp_full_match(t, '\d{{1,2}}'))")


@query("F36_number_tokens", f"""
SELECT doc_id, array_to_string({_NUM_SQL.format(x='text')}, '|') AS numbers FROM documents""")
def f36(v: Views):
    return v.table("documents").select("doc_id", F.array_join(S.number_tokens(c("text")), "|").alias("numbers"))


@query("F37_accounting_basis", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'non-GAAP' WHEN '2-HIGH' THEN 'GAAP' WHEN '3-MEDIUM' THEN 'non-GAAP' ELSE 'unspecified' END AS basis FROM orders""")
def f37(v: Views):
    p = c("o_orderpriority")
    text = (F.when(p == "1-URGENT", "Non-GAAP margin rose").when(p == "2-HIGH", "GAAP income fell").when(p == "3-MEDIUM", "Adjusted GAAP view")
            .otherwise(c("o_orderpriority")))
    return v.table("orders").select("o_orderkey", S.accounting_basis(text).alias("basis"))


@query("F38_labels", """
SELECT o_orderkey, CASE WHEN v < 0 THEN '(' ELSE '' END || '$' || CASE WHEN abs(v) >= 1e12 THEN printf('%.1f', round(abs(v) / 1e12, 1)) || 'T'
 WHEN abs(v) >= 1e9 THEN printf('%.1f', round(abs(v) / 1e9, 1)) || 'B' WHEN abs(v) >= 1e6 THEN printf('%.1f', round(abs(v) / 1e6, 1)) || 'M'
 ELSE printf('%.0f', round(abs(v))) END || CASE WHEN v < 0 THEN ')' ELSE '' END AS money, '+' || printf('%.1f', round(r * 100, 1)) || '%' AS percent,
 CASE WHEN o_orderstatus = 'F' THEN 'N/M' ELSE printf('%.1f', round(r, 1)) || 'x' END AS multiple
FROM (SELECT o_orderkey, o_orderstatus, floor(o_totalprice * CASE o_orderpriority WHEN '1-URGENT' THEN 1e3 WHEN '2-HIGH' THEN -1e6 WHEN '3-MEDIUM' THEN 1e9 ELSE 1 END) AS v,
 o_totalprice / 100000 AS r FROM orders)""")
def f38(v: Views):
    p = c("o_orderpriority")
    factor = F.when(p == "1-URGENT", 1e3).when(p == "2-HIGH", -1e6).when(p == "3-MEDIUM", 1e9).otherwise(1.0)
    amount = F.floor(c("o_totalprice") * factor).cast("double")
    ratio = c("o_totalprice") / 100000
    none = F.when(c("o_orderstatus") != "F", ratio)
    return v.table("orders").select("o_orderkey", N.money_label(amount, F.lit("USD")).alias("money"), N.percent_label(ratio).alias("percent"),
                                    N.multiple_label(none, F.lit(0)).alias("multiple"))


@query("F39_company_score", """
SELECT c_custkey, CASE WHEN lower(c_name) = 'customer#000000012' THEN 700.0 WHEN starts_with(lower(c_name), 'customer#00000001') THEN 600.0 - length(c_name) / 100
 WHEN contains(lower(c_name), '00012') THEN 400.0 - (instr(lower(c_name), '00012') - 1) ELSE 0.0 END AS score
FROM customer""")
def f39(v: Views):
    name = c("c_name")
    score = F.greatest(S.company_score(name, c("c_mktsegment"), F.lit("Customer#000000012")),
                       F.when(~F.lower(name).eqNullSafe("customer#000000012"), S.company_score(name, c("c_mktsegment"), F.lit("customer#00000001"))),
                       F.when(~F.lower(name).startswith("customer#00000001"), S.company_score(name, c("c_mktsegment"), F.lit("00012"))))
    return v.table("customer").select("c_custkey", score.alias("score"))


@query("F40_normalize_currency", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'GBP' ELSE o_orderstatus END AS currency FROM orders")
def f40(v: Views):
    code = F.when(c("o_orderstatus") == "F", "GBp").otherwise(c("o_orderstatus"))
    return v.table("orders").select("o_orderkey", N.normalize_currency(code).alias("currency"))
