"""Universe queries; regions act as maps, nations as layers, suppliers as companies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.views import Views
from tidemark.operators import universe as U

c = F.col


def maps(v: Views):
    """Nested map payloads: one row per map and layer page of at most a few hundred companies."""
    company = F.struct("company_pos", "ticker", "company", "type", "country")
    pages = v.universe().withColumn("page", F.floor(c("company_pos") / 500)).groupBy("map_pos", "map_name", "layer_pos", "layer", "page").agg(
        F.sort_array(F.collect_list(company)).alias("list"))
    members = F.transform("list", lambda x: F.struct(x["ticker"].alias("ticker"), x["company"].alias("company"), x["type"].alias("type"), x["country"].alias("country")))
    return pages.select("map_pos", "map_name", F.array(F.struct(c("layer").alias("name"), members.alias("companies"))).alias("layers"))


@query("S18_flatten_universe", "SELECT map_name, layer, ticker, company, country FROM v_universe WHERE type = 'Public'")
def s18(v: Views):
    return U.flatten_universe(maps(v)).select("map_name", "layer", "ticker", "company", "country")


_SUFFIXED = "ticker || CASE map_pos WHEN 0 THEN '.PA' WHEN 1 THEN '' WHEN 2 THEN '.T' WHEN 3 THEN '.DE' ELSE '.XX' END"


def suffixed():
    m = c("map_pos")
    return F.concat("ticker", F.when(m == 0, ".PA").when(m == 1, "").when(m == 2, ".T").when(m == 3, ".DE").otherwise(".XX"))


@query("P15_exchange_from_suffix", f"""
SELECT {_SUFFIXED} AS symbol, CASE map_pos WHEN 0 THEN 'Euronext Paris' WHEN 2 THEN 'Tokyo' WHEN 3 THEN 'Xetra' ELSE 'US listed' END AS exchange FROM v_universe""")
def p15(v: Views):
    return v.universe().select(suffixed().alias("symbol"), U.exchange_from_suffix(suffixed()).alias("exchange"))


@query("P16_is_tradable", "SELECT ticker, type = 'Public' AND country <> 'NATION_3' AS tradable FROM v_universe")
def p16(v: Views):
    return v.universe().select("ticker", U.is_tradable(c("type"), F.when(c("country") == "NATION_3", "N/A").otherwise(c("ticker"))).alias("tradable"))


@query("P14_classify_issuer", """
WITH flags AS (SELECT cik, bool_or(form = '6-K') AS k6, bool_or(form = '10-K') AS k10 FROM v_filings GROUP BY cik),
co AS (SELECT c_custkey, CASE WHEN c_mktsegment <> 'FURNITURE' THEN lpad(CAST(c_custkey AS VARCHAR), 10, '0') END AS cik, c_nationkey FROM customer)
SELECT c_custkey, CASE WHEN c_custkey IN (5, 9) THEN 'ETF' WHEN co.cik IS NULL AND c_nationkey < 5 THEN 'NON_SEC_SECURITY' WHEN co.cik IS NULL THEN 'OUT_OF_SEC_SCOPE'
 WHEN c_custkey = 12 THEN 'PRE_IPO_OR_REGISTRATION_HISTORY' WHEN c_custkey = 14 THEN 'SPINOFF_OR_PREDECESSOR' WHEN k6 AND NOT k10 THEN 'FOREIGN_PRIVATE_ISSUER' ELSE 'SEC_OPERATING_COMPANY' END AS classification,
 CASE WHEN c_custkey IN (5, 9) THEN 'ETF_NOT_APPLICABLE' WHEN co.cik IS NULL THEN 'OUT_OF_SEC_SCOPE' END AS financial_status
FROM co LEFT JOIN flags USING (cik)""")
def p14(v: Views):
    companies = v.table("customer").select("c_custkey", F.when(c("c_mktsegment") != "FURNITURE", F.lpad(c("c_custkey").cast("string"), 10, "0")).alias("cik"),
                                           F.concat(F.lit("C"), c("c_custkey").cast("string"), F.when(c("c_nationkey") < 5, ".HK").otherwise("")).alias("ticker"))
    bare = companies.withColumn("ticker", F.when(c("c_custkey").isin(5, 9, 12, 14), F.concat(F.lit("C"), c("c_custkey").cast("string"))).otherwise(c("ticker")))
    out = U.classify_issuers(bare, v.filings(), etfs=("C5", "C9"), pre_ipo=("C12",), spinoffs=("C14",))
    return out.select("c_custkey", "classification", "financial_status")


@query("J16_layer_peers", """
SELECT u.ticker, f.focal FROM v_universe u JOIN (SELECT layer, layer_pos, ticker AS focal, row_number() OVER (PARTITION BY layer ORDER BY company_pos) AS place FROM v_universe) f ON u.layer = f.layer WHERE u.ticker <> f.focal AND (place = 1 OR (place = 2 AND f.layer_pos = 0))""")
def j16(v: Views):
    # the first company of each layer, and the first two of the first layer
    place = F.row_number().over(Window.partitionBy("map_name", "layer").orderBy("company_pos", "ticker"))
    focal = v.universe().withColumn("place", place).where("place = 1 OR (place = 2 AND layer_pos = 0)")
    return U.layer_peers(v.universe(), focal).select("ticker", "focal")


@query("V09_peer_table", """
SELECT layer, u.ticker, company, last_close, volume FROM v_universe u LEFT JOIN (SELECT ticker, arg_max(close, day) AS last_close, CAST(sum(volume) AS BIGINT) AS volume FROM v_prices GROUP BY ticker) p
ON u.ticker = p.ticker WHERE type = 'Public'""")
def v09(v: Views):
    fundamentals = v.prices().groupBy("ticker").agg(F.max_by("close", "day").alias("last_close"), F.sum("volume").alias("volume"))
    return U.peer_table(v.universe(), fundamentals).select("layer", "ticker", "company", "last_close", "volume")


@query("J25_locate_company", """
SELECT map_name, ticker, layer, layer_pos FROM v_universe""")
def j25(v: Views):
    universe = v.universe()
    wanted = universe.select("map_name", "ticker", (c("layer_pos") + F.when(c("company_pos") < 50, 0).otherwise(1)).alias("preferred_layer"))
    return U.locate_company(wanted, universe).select("map_name", "ticker", "layer", "layer_pos")


@query("A27_map_stats", "SELECT map_name, count(*) AS companies, count(DISTINCT layer) AS layers FROM v_universe GROUP BY map_name")
def a27(v: Views):
    return U.map_stats(v.universe())


@query("U03_distinct_tickers", r"""
SELECT DISTINCT t AS ticker FROM (SELECT unnest(string_split_regex(upper(p_name || ', ' || p_type), '[,\s]+')) AS t FROM part) WHERE t <> ''""")
def u03(v: Views):
    return U.distinct_tickers(v.table("part").select(F.concat("p_name", F.lit(", "), "p_type").alias("text")), "text")


@query("U09_default_lists", "SELECT map_name, layer, count(*) AS members, min(layer_pos) AS layer_pos FROM v_universe GROUP BY map_name, layer")
def u09(v: Views):
    return U.default_lists(v.universe())


@query("P18_table_query", """
SELECT ticker, company, volume FROM (SELECT u.*, p.volume FROM v_universe u LEFT JOIN (SELECT ticker, CAST(sum(volume) AS BIGINT) AS volume FROM v_prices WHERE day < DATE '1995-03-01' GROUP BY ticker) p USING (ticker))
WHERE contains(lower(company), 'supplier#0000000') AND type = 'Public'""")
def p18(v: Views):
    volumes = v.prices().where("day < date'1995-03-01'").groupBy("ticker").agg(F.sum("volume").alias("volume"))
    table = v.universe().where("type = 'Public'").join(volumes, "ticker", "left")
    return U.table_query(table, "Supplier#0000000", sort="volume", ascending=False).select("ticker", "company", "volume")
