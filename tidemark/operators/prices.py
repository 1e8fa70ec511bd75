"""Price history, references, ranges and equal-weight group indexes.

All window operators work on one row per ticker and day, so the rows of one ticker are bounded by the
calendar. Anything that can be a plain aggregate is one, and is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import numbers as N
from tidemark.operators.keyed import as_of, latest_wins, top_n_per_key


def chart_points(charts: DataFrame) -> DataFrame:
    """Parallel arrays of a chart payload to rows; points without a usable close are dropped."""
    zipped = F.arrays_zip("timestamp", "close", "volume")
    rows = charts.select("ticker", F.inline(zipped))
    return rows.where(N.finite(F.col("close"))).select(
        "ticker", F.to_date(F.timestamp_seconds("timestamp")).alias("day"), "close", "volume")


def adjusted_points(charts: DataFrame) -> DataFrame:
    """Chart rows with an adjusted close that falls back to the raw close."""
    rows = charts.select("ticker", F.inline(F.arrays_zip("timestamp", "close", "adjclose", "volume")))
    return rows.select(
        "ticker", F.to_date(F.timestamp_seconds("timestamp")).alias("day"), "close",
        F.coalesce("adjclose", "close").alias("adj_close"), "volume",
    ).where(N.finite(F.col("adj_close")))


def price_on_or_before(targets: DataFrame, prices: DataFrame, target: str = "target", value: str = "adj_close") -> DataFrame:
    """Attach to each target the last price dated on or before it."""
    return as_of(targets, prices, "ticker", target, "day", [value])


def range_extremes(prices: DataFrame, as_of_day: Column, value: str = "adj_close") -> DataFrame:
    """52-week high and low and the all-time high per ticker."""
    inside = F.when(F.col("day") >= F.add_months(as_of_day, -12), F.col(value))
    return prices.groupBy("ticker").agg(
        F.max(inside).alias("high52"), F.min(inside).alias("low52"), F.max(value).alias("all_time_high"))


def average_volume(prices: DataFrame, days: int = 30) -> DataFrame:
    recent = top_n_per_key(prices.where(F.col("volume").isNotNull()), ["ticker"], [F.desc("day")], days)
    return recent.groupBy("ticker").agg(F.avg("volume").alias("avg_volume"))


def last_two(prices: DataFrame) -> DataFrame:
    """Latest bar and the bar before it."""
    two = top_n_per_key(prices, ["ticker"], [F.desc("day")], 2, rank="back")
    return two.groupBy("ticker").agg(
        F.max(F.when(F.col("back") == 1, F.col("close"))).alias("last_close"),
        F.max(F.when(F.col("back") == 2, F.col("close"))).alias("previous_close"),
        F.max(F.when(F.col("back") == 2, F.col("day"))).alias("previous_day"),
    )


def previous_close(prices: DataFrame) -> DataFrame:
    return last_two(prices).select("ticker", "previous_close", "previous_day")


def watchlist_snapshot(prices: DataFrame, quotes: DataFrame, as_of_day: str, custom_day: str) -> DataFrame:
    """One row per quoted ticker: daily change, references, ranges and performance.

    Every reference is the adjusted close at the largest day not after its target, which is a conditional
    ``max_by``; all of them and the ranges come from one partially aggregated pass over the prices.
    """
    today = F.to_date(F.lit(as_of_day))
    targets = {"week": F.date_sub(today, 7), "ytd": F.date_sub(F.trunc(today, "year"), 1), "custom": F.to_date(F.lit(custom_day))}
    targets |= {key: F.add_months(today, -months) for key, months in D.REFERENCE_MONTHS.items()}
    day, adj = F.col("day"), F.col("adj_close")
    inside = F.when(day >= F.add_months(today, -12), adj)
    aggregates = [F.max(inside).alias("high52"), F.min(inside).alias("low52"), F.max("adj_close").alias("all_time_high")]
    for key, target in targets.items():
        eligible = F.when(day <= target, day)
        aggregates += [F.max_by("adj_close", eligible).alias(f"ref_{key}"), F.max(eligible).alias(f"ref_{key}_day")]
    stats = prices.groupBy("ticker").agg(*aggregates)
    joined = quotes.select("ticker", "price").join(stats, "ticker", "left").join(previous_close(prices), "ticker", "left")
    price, base = F.col("price"), F.col("previous_close")
    out = joined.select(
        "*", (price - base).alias("daily_change"), N.percent_change(price, base).alias("perf_day"),
        *[N.percent_change(price, F.col(f"ref_{key}")).alias(f"perf_{key}") for key in targets],
        N.percent_change(price, F.col("high52")).alias("below_high52"),
        N.percent_change(price, F.col("low52")).alias("above_low52"),
        N.percent_change(price, F.col("all_time_high")).alias("below_all_time_high"),
    )
    return out.withColumnsRenamed({"previous_close": "ref_day", "previous_day": "ref_day_day"})


# Performance ranges of the snapshot.
PERFORMANCE_RANGES = {"d1": "1d", "m1": "1mo", "m3": "3mo", "ytd": "ytd", "m6": "6mo", "y1": "1y", "m18": "18mo", "y2": "2y"}


def full_history_anchor(chart: DataFrame) -> DataFrame:
    """Anchor price of each ticker and range, only when the first point is at most 7 days after the expected start.

    ``chart`` has one row per ticker and range: first_day, last_day, previous_close.
    """
    expected = D.range_start(F.col("range"), F.col("last_day"))
    full = F.coalesce(F.datediff("first_day", expected) <= 7, F.lit(False))
    return chart.select(
        "ticker", "range", F.when(full, F.col("previous_close")).alias("price"), F.col("first_day").alias("first_point_day"),
        full.alias("has_full_history"))


def performance_snapshot(prices: DataFrame, as_of_day: str) -> DataFrame:
    """Anchors of the eight performance ranges, long form, from one aggregate over the prices."""
    today = F.to_date(F.lit(as_of_day))
    known = prices.where(F.col("day") <= today)
    aggregates = [F.max("day").alias("last_day")]
    for key, name in PERFORMANCE_RANGES.items():
        start = D.range_start(F.lit(name), today)
        before = F.when(F.col("day") < start, F.col("day"))
        aggregates += [F.min(F.when(F.col("day") >= start, F.col("day"))).alias(f"first_{key}"),
                       F.max_by("close", before).alias(f"prev_{key}")]
    wide = known.groupBy("ticker").agg(*aggregates)
    rows = F.array(*[
        F.struct(F.lit(key).alias("key"), F.lit(name).alias("range"), F.col(f"first_{key}").alias("first_day"),
                 F.col(f"prev_{key}").alias("previous_close")) for key, name in PERFORMANCE_RANGES.items()])
    chart = wide.select("ticker", "last_day", F.inline(rows))
    return full_history_anchor(chart)


def rebase(points: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Series indexed to 100 at the stored anchor, else the previous close, else the first close."""
    usable = points.where(F.col("close") > 0)
    series = Window.partitionBy("ticker").orderBy("day")
    first = F.first("close").over(series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    if anchors is not None:
        usable = usable.join(anchors.select("ticker", "anchor_price", "previous_close"), "ticker", "left")
        # zero and missing anchors fall through to the next choice
        anchor = F.coalesce(F.nullif("anchor_price", F.lit(0.0)), F.nullif("previous_close", F.lit(0.0)), first)
    else:
        anchor = first
    indexed = usable.withColumn("__anchor", anchor).where(F.col("__anchor") > 0)
    return indexed.withColumn("value", F.col("close") / F.col("__anchor") * 100).drop("__anchor", "anchor_price", "previous_close")


def resample(series: DataFrame, n: str) -> DataFrame:
    """Linear interpolation of each ticker's series to the count in column ``n``.

    Each point emits the samples that fall between it and the next point, so no second pass over the
    series is needed. A series of one point gives one sample.
    """
    order = Window.partitionBy("ticker").orderBy("day")
    whole = Window.partitionBy("ticker")
    numbered = series.select(
        "*", (F.row_number().over(order) - 1).alias("__i"), F.count("*").over(whole).alias("__len"),
        F.lead("value").over(order).alias("__next"))
    last = (F.col("__len") - 1).cast("double")
    steps = (F.col(n) - 1).cast("double")
    low = F.greatest(F.floor(F.col("__i") * steps / last) - 1, F.lit(0))
    high = F.least(F.ceil((F.col("__i") + 1) * steps / last) + 1, F.col(n) - 1)
    samples = F.when(F.col("__len") > 1, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array(F.lit(0)))
    spread = numbered.withColumn("idx", F.explode(samples))
    target = F.when(F.col("__len") > 1, F.col("idx") / steps * last).otherwise(0.0)
    spread = spread.withColumn("__t", target).where(F.floor("__t") == F.col("__i"))
    weight = F.col("__t") - F.col("__i")
    right = F.coalesce(F.col("__next"), F.col("value"))
    return spread.withColumn("sample", F.col("value") + (right - F.col("value")) * weight).drop(
        "__i", "__len", "__next", "__t", "value", "day", "close")


def layer_performance(members: DataFrame, points: DataFrame, anchors: DataFrame | None = None, max_samples: int = 160):
    """Equal-weight index per layer: (index points, summary with end index, best and worst member)."""
    series = rebase(points.join(members.select("ticker", "layer"), "ticker"), anchors)
    ends = series.groupBy("layer", "ticker").agg(
        F.count("*").alias("len"), (F.max_by("value", "day") - 100).alias("pct"))
    sizes = ends.groupBy("layer").agg(
        F.greatest(F.lit(2), F.least(F.lit(max_samples), F.max("len").cast("int"))).alias("n"))
    sampled = resample(series.join(sizes, "layer").select("ticker", "layer", "day", "close", "value", "n"), "n")
    index = sampled.groupBy("layer", "idx").agg(F.avg("sample").alias("close"))
    ranked_up = F.struct(F.col("pct"), F.col("ticker"))
    summary = ends.groupBy("layer").agg(
        (F.avg(F.col("pct") + 100) - 100).alias("pct"), F.count("*").alias("valid_count"),
        F.max(ranked_up)["ticker"].alias("best"), F.min(ranked_up)["ticker"].alias("worst"))
    return index, summary


def stale_keys(keys: DataFrame, store: DataFrame, as_of_ts: Column, max_age: str = "15 minutes") -> DataFrame:
    """Keys with no stored quote younger than the limit."""
    fresh = store.where(F.col("fetched_at") > as_of_ts - F.expr(f"INTERVAL {max_age}"))
    return keys.select("ticker").distinct().join(fresh.select("ticker"), "ticker", "left_anti")


def upsert_quotes(store: DataFrame, new: DataFrame) -> DataFrame:
    return latest_wins(store, new, ["ticker"], "fetched_at")


def upsert_price_history(store: DataFrame, new: DataFrame, today: Column) -> DataFrame:
    """Add history of tickers not loaded today; both closes are required; the newest load of a day wins."""
    loaded = store.where(F.to_date("fetched_at") >= today).select("ticker").distinct()
    usable = new.where(N.finite(F.col("close")) & N.finite(F.col("adj_close"))).join(loaded, "ticker", "left_anti")
    return latest_wins(store, usable, ["ticker", "day"], "fetched_at")


def freshness(store: DataFrame, keys: DataFrame, as_of_ts: Column, ttl_seconds: int) -> DataFrame:
    """FRESH, STALE or MISS per key."""
    newest = store.groupBy("ticker").agg(F.max("fetched_at").alias("fetched_at"))
    joined = keys.select("ticker").distinct().join(newest, "ticker", "left")
    age = F.timestamp_diff("SECOND", F.col("fetched_at"), as_of_ts)
    return joined.withColumn(
        "state", F.when(age.isNull(), "MISS").when(age <= ttl_seconds, "FRESH").otherwise("STALE"))
