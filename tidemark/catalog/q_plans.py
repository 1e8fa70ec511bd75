"""Whole pipelines, streams and sinks."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import functions as F

from tidemark.catalog import q_text as QT
from tidemark.catalog.q_facts import with_metrics
from tidemark.catalog.q_periods import QUARTERS_SQL
from tidemark.catalog.q_prices import price_sets, quote_sets
from tidemark.catalog.q_rollups import AS_OF, CY_SQL, DIRECT_SQL, FOUR_SQL, RESOLVE_SQL, YEARS, _bridge
from tidemark.catalog.registry import query
from tidemark.catalog.views import OBS_COLS, Views
from tidemark.operators import completion as C
from tidemark.operators import prices as PR
from tidemark.operators.keyed import top_n_per_key
from tidemark.plans import commentary as PC
from tidemark.plans import history as PH
from tidemark.session import shared_folder
from tidemark.sources import keyed_store as KS
from tidemark.sources import sinks as SK
from tidemark.sources import snapshots as SN
from tidemark.streaming import jobs as J

c = F.col


@query("V06_canonical_history")
def v06(v: Views):
    return PH.canonical_history(v.obs(), v.provider(), YEARS, AS_OF)


#: Concepts that the pages of the test filings tag.
CONCEPTS = {"revenue": "Revenues", "costOfRevenue": "CostOfRevenue", "operatingCashFlow": "NetCashProvidedByUsedInOperatingActivities",
            "capitalExpenditures": "PaymentsToAcquirePropertyPlantAndEquipment", "ebit": "OperatingIncomeLoss"}


def tagged_filings(v: Views):
    """Filings of the observations, and their pages, in which every number is tagged."""
    rows = v.obs().join(v.issuers().select("ticker", "fye_month"), "ticker")
    bounds = [c("start_date"), c("end_date")]
    filings = rows.groupBy("ticker", "accession", "form", c("filed").alias("filing_date"), "fye_month").agg(F.max("end_date").alias("report_date")).withColumn(
        "fye_day", F.dayofmonth(F.last_day(F.make_date(F.lit(2001), c("fye_month"), F.lit(1)))))
    concept = F.lit(None).cast("string")
    for metric, name in CONCEPTS.items():
        concept = F.when(c("metric") == metric, name).otherwise(concept)
    tag = F.concat(F.lit('<p><ix:nonFraction name="us-gaap:'), concept, F.lit('" contextRef="c1" unitRef="u1">'), F.format_number("value", 0), F.lit("</ix:nonFraction></p>"))
    pages = rows.groupBy("accession", *bounds).agg(F.array_join(F.sort_array(F.collect_list(tag)), "").alias("tags"))
    body = F.concat(F.lit('<html><xbrli:context id="c1"><xbrli:period><xbrli:startDate>'), c("start_date").cast("string"), F.lit("</xbrli:startDate><xbrli:endDate>"), c("end_date").cast("string"),
                    F.lit('</xbrli:endDate></xbrli:period></xbrli:context><xbrli:unit id="u1"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit>'), "tags", F.lit("</html>"))
    return filings, pages.select("accession", F.lit("html").alias("kind"), body.alias("body"))


def _history_sql(held: str) -> str:
    """Yearly and trailing values of the observations but those ``held`` back, with gross profit and free cash flow."""
    base = re.sub(r"\b(win|sq)\b", r"\g<1>0", QUARTERS_SQL).replace("FROM v_obs", f"FROM (SELECT o.* FROM v_obs o JOIN v_issuers i USING (ticker) WHERE NOT ({held}))")
    derived = lambda t, more: f"""SELECT ticker, metric, period_type, start_date, end_date, fiscal_year, fiscal_quarter, value, source_id FROM {t}
 UNION ALL SELECT a.ticker, CASE a.metric WHEN 'revenue' THEN 'grossProfit' ELSE 'freeCashFlow' END, a.period_type, a.start_date, a.end_date, a.fiscal_year, a.fiscal_quarter, a.value - abs(b.value), a.source_id
 FROM {t} a JOIN {t} b USING (ticker, start_date, end_date, period_type) WHERE a.metric = 'revenue' AND b.metric = 'costOfRevenue' OR a.metric = 'operatingCashFlow' AND b.metric = 'capitalExpenditures'"""
    return f"""(WITH {base}, sq1 AS (SELECT *, 'STANDALONE_QUARTER' AS period_type FROM sq0), win AS ({derived('win0', '')}), sq AS ({derived('sq1', '')}),
{FOUR_SQL}, {DIRECT_SQL}, {_bridge('')}, {CY_SQL}, kept AS (SELECT * FROM bridge WHERE ltm_end <= DATE '{AS_OF}'), {RESOLVE_SQL.replace('FROM bridge)', 'FROM kept)')}
SELECT ticker, metric, year || 'A' AS period, value FROM cy UNION ALL SELECT ticker, metric, 'LTM', value FROM resolved)"""


#: Observations that are nowhere but in documents.
HELD = "i.region_key = 3 AND o.fiscal_year = 1997 AND o.metric <> 'adjustedEbitda'"


@query("V06_completed_history", f"""
SELECT f.ticker, f.metric, f.period, f.value, f.value IS NOT NULL AND p.ticker IS NOT NULL AND p.value IS NULL AS completed FROM {_history_sql('false')} f LEFT JOIN {_history_sql(HELD)} p USING (ticker, metric, period)""")
def v06_completed(v: Views):
    v.keep("obs")
    path = folder(v, "documents")
    filings, documents = tagged_filings(v)
    C.write_documents(documents, path)
    filed = v.obs().alias("o").join(v.issuers().alias("i"), "ticker").where(f"NOT ({HELD})").select(*OBS_COLS)
    out = PH.completed_history(filed, None, YEARS, AS_OF, filings, path, F.lit(False))
    return out.select("ticker", "metric", "period", "value", "completed")


@query("V17_revenue_history", f"""
WITH {QUARTERS_SQL}, {FOUR_SQL}, {DIRECT_SQL}, {_bridge('')}, {CY_SQL}, kept AS (SELECT * FROM bridge WHERE ltm_end <= DATE '{AS_OF}'), {RESOLVE_SQL.replace('FROM bridge)', 'FROM kept)')}
SELECT ticker, metric, year || 'A' AS period, value FROM cy WHERE metric = 'revenue' UNION ALL SELECT ticker, metric, 'LTM', value FROM resolved WHERE metric = 'revenue'""")
def v17(v: Views):
    return PH.metric_history(v.obs(), "revenue", YEARS, AS_OF).select("ticker", "metric", "period", "value")


@query("V16_provider_history", f"""
WITH pq AS (SELECT ticker, metric, end_date, value FROM v_provider UNION ALL SELECT a.ticker, 'freeCashFlow', a.end_date, a.value - b.value FROM v_provider a JOIN v_provider b ON a.ticker = b.ticker AND a.end_date = b.end_date
 AND a.metric = 'operatingCashFlow' AND b.metric = 'capitalExpenditures'),
l AS (SELECT *, row_number() OVER (PARTITION BY ticker, metric ORDER BY end_date DESC) AS back FROM pq WHERE end_date <= DATE '{AS_OF}')
SELECT ticker, metric, year(end_date) || 'A' AS period, CASE WHEN count(*) = 4 THEN sum(value) END AS value FROM pq WHERE year(end_date) BETWEEN 1996 AND 2000 GROUP BY ticker, metric, year(end_date)
UNION ALL SELECT ticker, metric, 'LTM', CASE WHEN count(*) = 4 THEN sum(value) END FROM l WHERE back <= 4 GROUP BY ticker, metric""")
def v16(v: Views):
    return PH.provider_history(v.provider(), YEARS, AS_OF).select("ticker", "metric", "period", "value")


@query("V10_ledger_build", f"""
WITH {QUARTERS_SQL}, m AS (SELECT ticker, metric, end_date, value FROM sq WHERE metric IN ('revenue', 'operatingCashFlow', 'capitalExpenditures')
 UNION ALL SELECT a.ticker, CASE a.metric WHEN 'revenue' THEN 'grossProfit' ELSE 'freeCashFlow' END, a.end_date, a.value - abs(b.value) FROM sq a JOIN sq b ON a.ticker = b.ticker AND a.start_date = b.start_date AND a.end_date = b.end_date
 AND (a.metric = 'revenue' AND b.metric = 'costOfRevenue' OR a.metric = 'operatingCashFlow' AND b.metric = 'capitalExpenditures')),
s AS (SELECT ticker, metric, year(end_date) AS year, count(*) AS n, sum(value) AS total FROM m WHERE year(end_date) BETWEEN 1996 AND 2000 GROUP BY ALL),
a AS (SELECT ticker, metric, year(end_date) AS year, value FROM win WHERE metric IN ('revenue', 'operatingCashFlow', 'capitalExpenditures') AND period_type = 'FISCAL_YEAR' AND strftime(start_date, '%m-%d') = '01-01' AND strftime(end_date, '%m-%d') = '12-31' AND year(end_date) BETWEEN 1996 AND 2000)
SELECT ticker, metric, CAST(year AS INTEGER) AS year, CASE WHEN n = 4 THEN total ELSE value END AS value, CASE WHEN n = 4 THEN 'CALENDAR_YEAR_DERIVED' WHEN value IS NOT NULL THEN 'CALENDAR_YEAR_REPORTED' ELSE 'PARTIAL_STANDALONE_QUARTER_COVERAGE' END AS method
FROM s FULL JOIN a USING (ticker, metric, year)""")
def v10(v: Views):
    return PH.ledger_build(with_metrics(v), YEARS)


@query("V12_call_commentary")
def v12(v: Views):
    return PC.call_commentary(v.blocks(), QT.GROUPS, QT.SUBJECTS, QT.TOPICS, QT.METRICS, QT.CUE, QT.HEADING, QT.FWD)


def folder(v: Views, name: str) -> str:
    """New shared folder of one run."""
    return shared_folder(v.spark, name)


def event_stream(v: Views):
    schema = v.table("events").schema
    raw = v.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(v.dir)
    return raw.select(c("user_id").cast("string").alias("ticker"), c("value").alias("price"), c("ts").cast("timestamp").alias("fetched_at"), "event_type")


@query("R01_stream_latest_quote", "SELECT CAST(user_id AS VARCHAR) AS ticker, max(ts) AS fetched_at, arg_max(value, {'t': ts, 'v': value}) AS price FROM events GROUP BY user_id")
def r01(v: Views):
    path = folder(v, "latest")
    J.stream_latest_quote(event_stream(v).select("ticker", "price", "fetched_at"), path)
    return J.latest_version(v.spark, f"{path}/state").withColumn("fetched_at", c("fetched_at").cast("timestamp_ntz"))


@query("R02_stream_price_history", "SELECT CAST(user_id AS VARCHAR) AS ticker, CAST(ts AS DATE) AS day, max(ts) AS fetched_at, arg_max(value, {'t': ts, 'v': value}) AS price FROM events GROUP BY 1, 2")
def r02(v: Views):
    path = folder(v, "history")
    J.stream_price_history(event_stream(v), path)
    return J.latest_version(v.spark, f"{path}/state").select("ticker", "day", c("fetched_at").cast("timestamp_ntz").alias("fetched_at"), "price")


@query("R04_stream_bars", """
SELECT CAST(user_id AS VARCHAR) AS ticker, date_trunc('day', ts) AS start, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS n FROM events GROUP BY 1, 2""")
def r04(v: Views):
    path = folder(v, "bars")
    J.stream_bars(event_stream(v), path)
    return J.bars(J.latest_version(v.spark, f"{path}/state")).withColumn("start", c("start").cast("timestamp_ntz"))


@query("R05_stream_promotion", """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS ticker, CAST(ts AS DATE) AS day, event_type = 'purchase' AS bought, max(value) AS value FROM events GROUP BY ALL),
j AS (SELECT coalesce(o.ticker, n.ticker) AS ticker, coalesce(o.day, n.day) AS day, o.value AS ov, n.value AS nv, o.ticker IS NOT NULL AS old, n.ticker IS NOT NULL AS new
  FROM (SELECT * FROM e WHERE NOT bought) o FULL JOIN (SELECT * FROM e WHERE bought) n ON o.ticker = n.ticker AND o.day = n.day),
t AS (SELECT ticker, (bool_or(old AND (NOT new OR nv <= 5)) OR NOT bool_or(new)) AND bool_or(old) AS keep FROM j GROUP BY ticker)
SELECT ticker, 'revenue' AS metric, strftime(day, '%Y-%m-%d') AS period, CASE WHEN keep THEN ov ELSE nv END AS value, CASE WHEN keep OR nv > 5 THEN 'VERIFIED_DERIVED' ELSE 'MISSING_SOURCE_DATA' END AS status,
  CAST(NULL AS VARCHAR) AS reason, day AS latest_end FROM j JOIN t USING (ticker) WHERE CASE WHEN keep THEN old ELSE new END""")
def r05(v: Views):
    path = folder(v, "promotion")
    stream = event_stream(v).where("event_type = 'purchase'")
    cell = lambda df, status: df.select("ticker", F.lit("revenue").alias("metric"), F.date_format("fetched_at", "yyyy-MM-dd").alias("period"), c("price").alias("value"), status.alias("status"),
                                        F.lit(None).cast("string").alias("reason"), F.to_date("fetched_at").alias("latest_end"))
    status = F.when(c("price") > 5, "VERIFIED_DERIVED").otherwise("MISSING_SOURCE_DATA")
    static = v.table("events").where("event_type <> 'purchase'").select(c("user_id").cast("string").alias("ticker"), c("value").alias("price"), c("ts").cast("timestamp").alias("fetched_at"))
    existing = top_n_per_key(cell(static, F.lit("VERIFIED_DERIVED")), ["ticker", "metric", "period"], [F.desc("value")])
    J.stream_promotion(cell(stream, status), existing, path)
    return J.promoted(J.latest_version(v.spark, f"{path}/state"), existing)


@query("S13_snapshots", "SELECT ticker, 'v2' AS engine_version, TIMESTAMP '2001-05-02 00:00:00' AS updated_at, close AS revenue FROM (SELECT ticker, arg_max(close, day) AS close FROM v_prices GROUP BY ticker)")
def s13(v: Views):
    path = folder(v, "snapshots")
    base = v.prices().groupBy("ticker").agg(F.max_by("close", "day").alias("revenue"), F.max("close").alias("price"))
    at = lambda text: F.lit(text).cast("timestamp")
    SK.save_snapshots(base.withColumns({"engine_version": F.lit("v1"), "updated_at": at("2001-05-01 00:00:00")}), path)
    SK.save_snapshots(base.withColumns({"engine_version": F.lit("v2"), "updated_at": at("2001-05-02 00:00:00")}), path)
    return SK.load_snapshots(v.spark, path, v.issuers()).select("ticker", "engine_version", c("updated_at").cast("timestamp_ntz").alias("updated_at"), "revenue")


_CELLS_OF = "SELECT ticker, min(region_key) AS region_key, max(value) FILTER (metric = 'revenue' AND year = 1997) AS revenue_1997 FROM v_cells WHERE metric IN ('revenue', 'ebit') GROUP BY ticker"


@query("S13_snapshot_store", f"""
WITH p AS ({_CELLS_OF}) SELECT ticker, 'v2' AS engine_version, region_key <> 1 AS migrated, revenue_1997, CASE WHEN region_key = 2 THEN 'INCOMPATIBLE' WHEN region_key = 1 THEN 'READY' ELSE 'STALE' END AS state,
 CASE WHEN region_key = 2 THEN 'ACTUAL_YEAR_SET_MISMATCH' ELSE '' END AS reasons, CAST(NULL AS DOUBLE) AS price, region_key = 1 AS current_in_store_before, true AS current_in_store_after FROM p""")
def s13_store(v: Views):
    path = folder(v, "snapshot-store")
    rows = v.cells().where("metric IN ('revenue', 'ebit')").groupBy("ticker", "metric").agg(F.min("region_key").alias("region_key"), F.map_from_entries(F.collect_list(F.struct("period", "value"))).alias("periods"))
    issuers = rows.groupBy("ticker").agg(F.min("region_key").alias("region_key"), F.map_from_entries(F.collect_list(F.struct("metric", "periods"))).alias("metrics"))
    at = lambda text: F.lit(text).cast("timestamp")
    years = F.when(c("region_key") == 2, F.array(F.lit(1996))).otherwise(F.array(*[F.lit(y) for y in YEARS]))
    base = issuers.withColumn("actual_years", years)
    # the earlier schema has its metrics at the top, the current one below a name; market fields are dropped from both
    inner = F.to_json(F.struct(c("metrics").alias("metrics"), F.lit(7).alias("price")))
    bare = F.to_json("metrics")
    old = base.select("ticker", F.lit("v1").alias("engine_version"), "actual_years", F.parse_json(bare).alias("snapshot"), at("2001-05-01 00:00:00").alias("updated_at"))
    new = base.where("region_key = 1").select("ticker", F.lit("v2").alias("engine_version"), "actual_years", F.parse_json(inner).alias("snapshot"), at("2001-06-20 00:00:00").alias("updated_at"))
    SN.save(old, path)
    SN.save(new, path)
    before = KS.read(v.spark, path).select("ticker", (c("engine_version") == "v2").alias("current_in_store_before"))
    loaded = SN.load(v.spark, path, v.issuers(), YEARS, at("2001-07-01 00:00:00"))
    after = KS.read(v.spark, path).select("ticker", (c("engine_version") == "v2").alias("current_in_store_after"))
    shown = loaded.select("ticker", "engine_version", "migrated", SN.metric("revenue", "1997A").alias("revenue_1997"), "state", F.array_join("reasons", ",").alias("reasons"), F.try_variant_get("snapshot", "$.price", "double").alias("price"))
    return shown.join(before, "ticker").join(after, "ticker")


@query("S11_quote_store", """
WITH n AS (SELECT CAST(user_id AS VARCHAR) AS ticker, value AS price, ts AS fetched_at, event_type IN ('view', 'click') AS early, event_id FROM events),
a AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY fetched_at DESC, event_id DESC) AS rn FROM n WHERE early), b AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY fetched_at DESC, event_id DESC) AS rn FROM n)
SELECT 1 AS version, ticker, price, fetched_at FROM a WHERE rn = 1 UNION ALL SELECT 2, ticker, price, fetched_at FROM b WHERE rn = 1""")
def s11_store(v: Views):
    path = folder(v, "quotes")
    store, new = quote_sets(v)
    versions = [KS.upsert(rows, path, ["ticker"], PR.upsert_quotes) for rows in (store, new)]
    return reduce(lambda a, b: a.unionByName(b), [KS.read(v.spark, path, n).select(F.lit(n).alias("version"), "ticker", "price", "fetched_at") for n in versions])


@query("S12_price_history_store", f"""
WITH store AS (SELECT ticker, day, close, adj_close, CASE WHEN day >= DATE '2001-10-25' THEN TIMESTAMP '2001-11-05 08:00:00' ELSE TIMESTAMP '2001-11-01 08:00:00' END AS fetched_at FROM v_prices WHERE volume < 40),
new AS (SELECT ticker, day, CASE WHEN volume <> 41 THEN close + 1 END AS close, adj_close, TIMESTAMP '2001-11-05 12:00:00' AS fetched_at FROM v_prices WHERE day >= DATE '2001-06-01'),
kept AS (SELECT * FROM new WHERE close IS NOT NULL AND ticker NOT IN (SELECT ticker FROM store WHERE fetched_at >= DATE '2001-11-05')),
both_ AS (SELECT 1 AS version, * FROM store UNION ALL SELECT 2, * FROM kept UNION ALL SELECT 2, * FROM store s WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.ticker = s.ticker AND k.day = s.day))
SELECT version, ticker, day, close, adj_close, CAST(fetched_at AS VARCHAR) AS fetched_at FROM both_""")
def s12_store(v: Views):
    path = folder(v, "price-history")
    store, new = price_sets(v)
    today = F.to_date(F.lit("2001-11-05"))
    first = KS.upsert(store, path, ["ticker"], lambda _, rows: rows)
    second = KS.upsert(new, path, ["ticker"], lambda a, b: PR.upsert_price_history(a, b, today))
    read = lambda number, n: KS.read(v.spark, path, n).select(F.lit(number).alias("version"), "ticker", "day", "close", "adj_close", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"))
    return read(1, first).unionByName(read(2, second))


@query("S14_write_ledger_snapshot", "SELECT ticker, 1 AS versions, count(*) AS records FROM v_ledger GROUP BY ticker")
def s14(v: Views):
    path = folder(v, "ledger")
    SK.write_ledger_snapshot(v.ledger(), path)
    # the second write of the same content adds nothing
    SK.write_ledger_snapshot(v.ledger(), path)
    stored = v.spark.read.parquet(path)
    return stored.groupBy("ticker").agg(F.count_distinct("content_hash").cast("int").alias("versions"), F.count("*").alias("records"))


@query("S16_write_audit", "SELECT ticker, metric, period, value, CASE WHEN year % 2 = 0 THEN status ELSE 'EARLIER_RUN' END AS status FROM v_cells")
def s16(v: Views):
    v.keep("cells")
    path = folder(v, "audit")
    cells = lambda rows: rows.select("ticker", "metric", "period", "value", "status")
    SK.write_audit(cells(v.cells().withColumn("status", F.lit("EARLIER_RUN"))), path)
    # the second run replaces what it has, and keeps the rest
    SK.write_audit(cells(v.cells().where("year % 2 = 0")), path)
    return SK.read_audit(v.spark, path)


@query("S22_export_table", """SELECT ticker, company || ', "' || layer || '"' AS label FROM v_universe""")
def s22(v: Views):
    path = folder(v, "export")
    rows = v.universe().select("ticker", F.concat("company", F.lit(', "'), "layer", F.lit('"')).alias("label"))
    SK.export_table(rows, f"{path}/csv")
    SK.export_table(rows, f"{path}/json", "json")
    # both forms hold the same rows
    text = v.spark.read.option("header", True).option("escape", '"').csv(f"{path}/csv")
    return text.intersect(v.spark.read.schema(text.schema).json(f"{path}/json"))


