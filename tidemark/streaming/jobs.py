"""Structured Streaming forms of the quote, history, bar and promotion jobs.

A state table lies in buckets by hash of the ticker. A micro-batch is reduced to one row per key, merged with the buckets it
touches, and these are written under its number; a bucket's newest version counts. A batch that runs again merges
with versions older than itself and writes the same rows again. Every event counts, however late it comes. ``path`` is a
folder all executors share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import quality as Q
from tidemark.operators.keyed import top_n_per_key

# Bar length of each chart interval.
INTERVALS = {"5m": "5 minutes", "15m": "15 minutes", "1d": "1 day", "1wk": "7 days"}
BUCKETS = 64


def _bucket():
    return F.pmod(F.xxhash64("ticker"), F.lit(BUCKETS)).cast("int")


def _versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, list[str]]:
    """Folders of each bucket in complete versions older than ``before``, the newest last."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[int, list[str]] = {}
    if not fs.exists(folder):
        return found
    for version in sorted(fs.listStatus(folder), key=lambda s: s.getPath().getName()):
        number = int(version.getPath().getName().removeprefix("version="))
        if before is not None and number >= before or not fs.exists(jvm.org.apache.hadoop.fs.Path(version.getPath(), "_SUCCESS")):
            continue
        for part in fs.listStatus(version.getPath()):
            if part.isDirectory():
                found.setdefault(int(part.getPath().getName().removeprefix("bucket=")), []).append(part.getPath().toString())
    return found


def _prune(spark: SparkSession, found: dict[int, list[str]]) -> None:
    """Removes what two newer versions of a bucket have replaced; a batch that runs again needs the last but one."""
    jvm = spark.sparkContext._jvm
    for folders in found.values():
        for old in folders[:-2]:
            gone = jvm.org.apache.hadoop.fs.Path(old)
            gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)


def latest_version(spark: SparkSession, path: str) -> DataFrame | None:
    """Newest complete state of every bucket."""
    found = _versions(spark, path)
    return spark.read.parquet(*[folders[-1] for folders in found.values()]) if found else None


def _run(stream: DataFrame, path: str, reduce: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame | None, DataFrame], DataFrame]):
    """Drain what is available, folding each micro-batch, reduced to a row per key, into the buckets it touches."""

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        where = f"{path}/reduced/version={number:012d}"
        reduce(batch).withColumn("bucket", _bucket()).write.mode("overwrite").partitionBy("bucket").parquet(where)
        touched = [b for b, folders in _versions(spark, f"{path}/reduced").items() if f"version={number:012d}" in folders[-1]]
        if not touched:
            return
        fresh = spark.read.parquet(where).drop("bucket")
        older = _versions(spark, f"{path}/state", number)
        current = [older[b][-1] for b in touched if b in older]
        state = merge(spark.read.schema(fresh.schema).parquet(*current) if current else None, fresh)
        state.withColumn("bucket", _bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/state/version={number:012d}")
        _prune(spark, _versions(spark, f"{path}/state"))

    query = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(fold).start()
    query.awaitTermination()
    return query


def stream_latest_quote(events: DataFrame, path: str):
    """Newest quote per ticker, the higher price on a tie."""
    newest = lambda df: top_n_per_key(df, ["ticker"], [F.desc("fetched_at"), F.desc("price")])
    return _run(events, path, newest, lambda current, fresh: fresh if current is None else newest(current.unionByName(fresh)))


def stream_price_history(events: DataFrame, path: str):
    """Newest price per ticker and day, the higher one on a tie."""
    newest = lambda df: top_n_per_key(df, ["ticker", "day"], [F.desc("fetched_at"), F.desc("price")])
    daily = lambda df: newest(df.select("ticker", F.to_date("fetched_at").alias("day"), "fetched_at", "price"))
    return _run(events, path, daily, lambda current, fresh: fresh if current is None else newest(current.unionByName(fresh)))


def stream_bars(events: DataFrame, path: str, interval: str = "1d"):
    """Open, high, low, close and count per ticker and tumbling interval (months by truncation).

    State keeps the first and last (time, price) of a bar, so bars of any batches add up.
    """
    start = F.date_trunc("month", "fetched_at") if interval == "1mo" else F.window("fetched_at", INTERVALS[interval])["start"]

    def partial(batch):
        point = F.struct(F.col("fetched_at").alias("at"), "price")
        return batch.groupBy("ticker", start.alias("start")).agg(
            F.min(point).alias("first"), F.max(point).alias("last"), F.max("price").alias("high"), F.min("price").alias("low"), F.count("*").alias("n"))

    def merge(current, fresh):
        both = fresh if current is None else current.unionByName(fresh)
        return both.groupBy("ticker", "start").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("n").alias("n"))

    return _run(events, path, partial, merge)


def bars(state: DataFrame) -> DataFrame:
    """Bars out of the state of ``stream_bars``."""
    return state.select("ticker", "start", F.col("first.price").alias("open"), "high", "low", F.col("last.price").alias("close"), "n")


def stream_promotion(candidates: DataFrame, existing: DataFrame, path: str):
    """Apply the promotion gate to each micro-batch of candidate cells; tickers not in a batch keep their cells.

    ``existing`` is the store to begin with; the state holds the cells of tickers that a batch has touched.
    """
    cells = lambda df: top_n_per_key(df, ["ticker", "metric", "period"], [F.desc("latest_end"), F.desc("value"), F.desc("status")])

    def merge(current, fresh):
        own = fresh.select("ticker").distinct()
        known = existing.join(own, "ticker", "left_semi")
        if current is not None:
            seen = current.select("ticker").distinct()
            known = current.select(existing.columns).unionByName(known.join(seen, "ticker", "left_anti"))
        touched = known.join(own, "ticker", "left_semi")
        promoted = Q.promote_snapshot(touched, fresh).select(existing.columns)
        return known.join(own, "ticker", "left_anti").unionByName(promoted)

    return _run(candidates, path, cells, merge)


def promoted(state: DataFrame | None, existing: DataFrame) -> DataFrame:
    """Cells of all tickers: those of the state, and the existing ones of tickers no batch has touched."""
    if state is None:
        return existing
    return existing.join(state.select("ticker").distinct(), "ticker", "left_anti").unionByName(state.select(existing.columns))
