"""Price queries over daily supplier prices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.views import Views
from tidemark.operators import prices as P
from tidemark.operators.keyed import top_n_per_key

AS_OF, CUSTOM = "2001-06-15", "2000-03-01"
c = F.col


def charts(v: Views):
    """Chart payloads: one row of parallel arrays per ticker and month (at most 31 points)."""
    point = F.struct(F.unix_timestamp(c("day").cast("timestamp")).alias("ts"), F.when(c("volume") != 7, c("close")).alias("close"),
                     F.when(c("volume") < 30, c("adj_close")).alias("adj"), c("volume").alias("volume"))
    packed = v.prices().groupBy("ticker", F.trunc("day", "month").alias("month")).agg(F.sort_array(F.collect_list(point)).alias("p"))
    return packed.select("ticker", c("p.ts").alias("timestamp"), c("p.close").alias("close"), c("p.adj").alias("adjclose"),
                         c("p.volume").alias("volume"))


@query("S08_read_price_chart", "SELECT ticker, day, close, volume FROM v_prices WHERE volume <> 7")
def s08(v: Views):
    return P.chart_points(charts(v))


@query("S09_read_adjusted_history", """
SELECT ticker, day, CASE WHEN volume <> 7 THEN close END AS close, CASE WHEN volume < 30 THEN adj_close ELSE close END AS adj_close, volume
FROM v_prices WHERE volume < 30 OR volume <> 7""")
def s09(v: Views):
    return P.adjusted_points(charts(v))


@query("J02_price_on_or_before", """
SELECT l.ticker, l.l_orderkey, l.l_linenumber, CAST(l.day - 10 AS DATE) AS target, p.day AS found_day, p.adj_close
FROM v_lines l ASOF LEFT JOIN v_prices p ON l.ticker = p.ticker AND CAST(l.day - 10 AS DATE) >= p.day""")
def j02(v: Views):
    targets = v.lines().select("ticker", "l_orderkey", "l_linenumber", F.date_sub("day", 10).alias("target"))
    return P.price_on_or_before(targets, v.prices())


@query("A16_range_extremes", f"""
SELECT ticker, max(CASE WHEN day >= DATE '{AS_OF}' - INTERVAL 12 MONTH THEN adj_close END) AS high52,
 min(CASE WHEN day >= DATE '{AS_OF}' - INTERVAL 12 MONTH THEN adj_close END) AS low52, max(adj_close) AS all_time_high
FROM v_prices GROUP BY ticker""")
def a16(v: Views):
    return P.range_extremes(v.prices(), F.to_date(F.lit(AS_OF)))


@query("A17_average_volume", """
SELECT ticker, avg(volume) AS avg_volume FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day DESC) AS rn FROM v_prices)
WHERE rn <= 30 GROUP BY ticker""")
def a17(v: Views):
    return P.average_volume(v.prices())


@query("W14_previous_close", """
SELECT ticker, close AS previous_close, day AS previous_day FROM (
 SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day DESC) AS rn FROM v_prices) WHERE rn = 2""")
def w14(v: Views):
    return P.previous_close(v.prices())


_REFS = {"week": f"DATE '{AS_OF}' - 7", "ytd": "DATE '2000-12-31'", "custom": f"DATE '{CUSTOM}'"}
_REFS |= {k: f"CAST(DATE '{AS_OF}' - INTERVAL {m} MONTH AS DATE)" for k, m in
          {"month": 1, "month3": 3, "month6": 6, "year": 12, "month18": 18, "year2": 24}.items()}


def _pct(x: str) -> str:
    return f"CASE WHEN {x} <> 0 THEN (price / {x} - 1) * 100 END"


V01_SQL = f"""
WITH known AS (SELECT * FROM v_prices WHERE day <= DATE '{AS_OF}'),
quotes AS (SELECT ticker, arg_max(close, day) AS price FROM known GROUP BY ticker),
prev AS (SELECT ticker, close AS ref_day, day AS ref_day_day FROM (
 SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day DESC) AS rn FROM known) WHERE rn = 2),
stats AS (SELECT ticker, max(CASE WHEN day >= DATE '{AS_OF}' - INTERVAL 12 MONTH THEN adj_close END) AS high52,
 min(CASE WHEN day >= DATE '{AS_OF}' - INTERVAL 12 MONTH THEN adj_close END) AS low52, max(adj_close) AS all_time_high,
 {", ".join(f"arg_max(adj_close, day) FILTER (day <= {t}) AS ref_{k}, max(day) FILTER (day <= {t}) AS ref_{k}_day" for k, t in _REFS.items())}
 FROM known GROUP BY ticker)
SELECT *, price - ref_day AS daily_change, {_pct('ref_day')} AS perf_day,
 {", ".join(f"{_pct('ref_' + k)} AS perf_{k}" for k in _REFS)},
 {_pct('high52')} AS below_high52, {_pct('low52')} AS above_low52, {_pct('all_time_high')} AS below_all_time_high
FROM quotes LEFT JOIN stats USING (ticker) LEFT JOIN prev USING (ticker)"""


def known_prices(v: Views):
    return v.prices().where(c("day") <= F.to_date(F.lit(AS_OF)))


@query("V01_watchlist_snapshot", V01_SQL)
def v01(v: Views):
    known = known_prices(v)
    quotes = known.groupBy("ticker").agg(F.max_by("close", "day").alias("price"))
    return P.watchlist_snapshot(known, quotes, AS_OF, CUSTOM)


_RANGES = {"1d": ("DATE '2001-06-14'", "INTERVAL 1 DAY"), "1mo": (None, "INTERVAL 1 MONTH"), "3mo": (None, "INTERVAL 3 MONTH"), "ytd": (None, None),
           "6mo": (None, "INTERVAL 6 MONTH"), "1y": (None, "INTERVAL 12 MONTH"), "18mo": (None, "INTERVAL 18 MONTH"), "2y": (None, "INTERVAL 24 MONTH")}


def _start(name: str, end: str) -> str:
    step = _RANGES[name][1]
    return f"CAST(date_trunc('year', {end}) AS DATE)" if step is None else f"CAST({end} - {step} AS DATE)"


_V02 = " UNION ALL ".join(f"""
SELECT ticker, '{name}' AS range, min(day) FILTER (day >= {_start(name, f"DATE '{AS_OF}'")}) AS first_day, max(day) AS last_day,
 {_start(name, 'max(day)')} AS expected, arg_max(close, day) FILTER (day < {_start(name, f"DATE '{AS_OF}'")}) AS prev
FROM v_prices WHERE day <= DATE '{AS_OF}' GROUP BY ticker""" for name in _RANGES)


@query("V02_performance_snapshot", f"""
SELECT ticker, range, CASE WHEN first_day - expected <= 7 THEN prev END AS price, first_day AS first_point_day,
 coalesce(first_day - expected <= 7, FALSE) AS has_full_history FROM ({_V02})""")
def v02(v: Views):
    return P.performance_snapshot(v.prices(), AS_OF)


@query("W22_full_history_anchor", """
SELECT ticker, '1y' AS range, CASE WHEN first_day - CAST(last_day - INTERVAL 12 MONTH AS DATE) <= 7 THEN prev END AS price,
 first_day AS first_point_day, first_day - CAST(last_day - INTERVAL 12 MONTH AS DATE) <= 7 AS has_full_history
FROM (SELECT ticker, min(day) AS first_day, max(day) AS last_day, arg_min(close, day) AS prev FROM v_prices WHERE day >= DATE '2000-11-15' GROUP BY ticker)""")
def w22(v: Views):
    recent = v.prices().where("day >= date'2000-11-15'")
    chart = recent.groupBy("ticker").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"),
                                         F.min_by("close", "day").alias("previous_close")).withColumn("range", F.lit("1y"))
    return P.full_history_anchor(chart)


@query("W17_rebase", """
SELECT ticker, day, close, volume, close / coalesce(a, first_value(close) OVER (PARTITION BY ticker ORDER BY day)) * 100 AS value
FROM v_prices LEFT JOIN (SELECT ticker, arg_min(adj_close, day) AS a FROM v_prices WHERE day >= DATE '2001-09-01' GROUP BY ticker) USING (ticker)
WHERE close > 0""")
def w17(v: Views):
    prices = v.prices()
    anchors = prices.where("day >= date'2001-09-01'").groupBy("ticker").agg(
        F.min_by("adj_close", "day").alias("anchor_price"), F.lit(0.0).alias("previous_close"))
    return P.rebase(prices.select("ticker", "day", "close", "volume"), anchors)


_RESAMPLE = """
WITH series AS (SELECT u.layer, p.ticker, p.day, p.close / first_value(p.close) OVER (PARTITION BY p.ticker ORDER BY p.day) * 100 AS value,
 row_number() OVER (PARTITION BY p.ticker ORDER BY p.day) - 1 AS i, count(*) OVER (PARTITION BY p.ticker) AS len
 FROM v_prices p JOIN v_universe u ON p.ticker = u.ticker WHERE p.close > 0),
sizes AS (SELECT layer, greatest(2, least(160, max(len))) AS n FROM series GROUP BY layer),
members AS (SELECT DISTINCT s.layer, s.ticker, s.len, z.n FROM series s JOIN sizes z ON s.layer = z.layer),
samples AS (SELECT layer, ticker, len, n, CAST(idx AS INTEGER) AS idx, CASE WHEN len > 1 THEN CAST(idx AS DOUBLE) / CAST(n - 1 AS DOUBLE) * CAST(len - 1 AS DOUBLE) ELSE 0.0 END AS t
 FROM (SELECT *, unnest(range(CASE WHEN len > 1 THEN n ELSE 1 END)) AS idx FROM members)),
sampled AS (SELECT m.layer, m.ticker, m.n, m.idx, a.value + (b.value - a.value) * (m.t - floor(m.t)) AS sample FROM samples m
 JOIN series a ON a.ticker = m.ticker AND a.i = floor(m.t) JOIN series b ON b.ticker = m.ticker AND b.i = least(m.len - 1, floor(m.t) + 1))"""


@query("W16_resample", _RESAMPLE + "SELECT layer, ticker, CAST(n AS INTEGER) AS n, idx, round(sample, 6) AS sample FROM sampled")
def w16(v: Views):
    series = P.rebase(v.prices().select("ticker", "day", "close").join(v.universe().select("ticker", "layer"), "ticker"))
    lengths = series.groupBy("layer", "ticker").agg(F.count("*").alias("len"))
    sizes = lengths.groupBy("layer").agg(F.greatest(F.lit(2), F.least(F.lit(160), F.max("len"))).cast("int").alias("n"))
    return P.resample(series.join(sizes, "layer"), "n").select("layer", "ticker", "n", "idx", F.round("sample", 6).alias("sample"))


@query("V08_layer_performance", _RESAMPLE + "SELECT layer, idx, round(avg(sample), 6) AS close FROM sampled GROUP BY layer, idx")
def v08(v: Views):
    index, _ = P.layer_performance(v.universe(), v.prices().select("ticker", "day", "close"))
    return index.select("layer", "idx", F.round("close", 6).alias("close"))


@query("A18_basket_index", """
WITH ends AS (SELECT u.layer, p.ticker, arg_max(p.close, p.day) / arg_min(p.close, p.day) * 100 - 100 AS pct FROM v_prices p
 JOIN v_universe u ON p.ticker = u.ticker WHERE p.close > 0 GROUP BY ALL)
SELECT layer, round(avg(pct + 100) - 100, 6) AS pct, count(*) AS valid_count, arg_max(ticker, pct) AS best, arg_min(ticker, pct) AS worst FROM ends GROUP BY layer""")
def a18(v: Views):
    _, summary = P.layer_performance(v.universe(), v.prices().select("ticker", "day", "close"))
    return summary.withColumn("pct", F.round("pct", 6))


def quote_sets(v: Views):
    rows = v.table("events").select(c("user_id").cast("string").alias("ticker"), c("value").alias("price"), c("ts").alias("fetched_at"),
                                    "event_id", "event_type")
    newest = lambda df: top_n_per_key(df, ["ticker"], [F.desc("fetched_at"), F.desc("event_id")]).select("ticker", "price", "fetched_at")
    return newest(rows.where("event_type IN ('view', 'click')")), newest(rows.where("event_type NOT IN ('view', 'click')"))


@query("S11_upsert_quotes", """
SELECT CAST(user_id AS VARCHAR) AS ticker, value AS price, ts AS fetched_at,
 ts <= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 15 MINUTE AS stale FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def s11(v: Views):
    store, new = quote_sets(v)
    merged = P.upsert_quotes(store, new)
    stale = P.stale_keys(merged, merged, F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")).withColumn("stale", F.lit(True))
    return merged.join(stale, "ticker", "left").withColumn("stale", F.coalesce("stale", F.lit(False)))


@query("S12_upsert_price_history", """
WITH store AS (SELECT ticker, day, close, adj_close, CASE WHEN day >= DATE '2001-10-25' THEN TIMESTAMP '2001-11-05 08:00:00' ELSE TIMESTAMP '2001-11-01 08:00:00' END AS fetched_at
 FROM v_prices WHERE volume < 40),
new AS (SELECT ticker, day, CASE WHEN volume <> 41 THEN close + 1 END AS close, adj_close, TIMESTAMP '2001-11-05 12:00:00' AS fetched_at FROM v_prices WHERE day >= DATE '2001-06-01'),
kept AS (SELECT * FROM new WHERE close IS NOT NULL AND ticker NOT IN (SELECT ticker FROM store WHERE fetched_at >= DATE '2001-11-05'))
SELECT * FROM kept UNION ALL SELECT * FROM store s WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.ticker = s.ticker AND k.day = s.day)""")
def s12(v: Views):
    store, new = price_sets(v)
    return P.upsert_price_history(store, new, F.to_date(F.lit("2001-11-05")))


def price_sets(v: Views):
    """Stored history, some of it loaded on the day, and new rows, some without a close."""
    prices = v.prices()
    stamp = lambda text: F.lit(text).cast("timestamp")
    store = prices.where("volume < 40").select("ticker", "day", "close", "adj_close", F.when(c("day") >= F.to_date(F.lit("2001-10-25")),
                                               stamp("2001-11-05 08:00:00")).otherwise(stamp("2001-11-01 08:00:00")).alias("fetched_at"))
    new = prices.where("day >= date'2001-06-01'").select("ticker", "day", F.when(c("volume") != 41, c("close") + 1).alias("close"), "adj_close",
                                                         stamp("2001-11-05 12:00:00").alias("fetched_at"))
    return store, new


@query("R03_freshness", """
WITH newest AS (SELECT CAST(user_id AS VARCHAR) AS ticker, max(ts) AS fetched_at FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT ticker, fetched_at, CASE WHEN fetched_at IS NULL THEN 'MISS' WHEN date_sub('second', fetched_at, TIMESTAMP '2024-01-31 00:00:00') <= 172800 THEN 'FRESH' ELSE 'STALE' END AS state
FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS ticker FROM events) LEFT JOIN newest USING (ticker)""")
def r03(v: Views):
    events = v.table("events").withColumn("ticker", c("user_id").cast("string"))
    store = events.where("event_type = 'purchase'").select("ticker", c("ts").alias("fetched_at"))
    return P.freshness(store, events, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), 172800)
