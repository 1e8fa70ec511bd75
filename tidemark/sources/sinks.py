"""Keyed tables, write-once ledgers, audit outputs and exports on a shared file system."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.keyed import top_n_per_key
from tidemark.session import written
from tidemark.sources import keyed_store


def save_snapshots(snapshots: DataFrame, path: str) -> None:
    """Snapshots without market columns, partitioned by engine version."""
    market = [c for c in ("price", "daily_change", "high52", "low52") if c in snapshots.columns]
    snapshots.drop(*market).write.mode("append").partitionBy("engine_version").parquet(path)


def load_snapshots(spark: SparkSession, path: str, tickers: DataFrame | None = None) -> DataFrame:
    """Newest stored snapshot per ticker, of the wanted tickers only; of equally new ones the higher version, then content."""
    store = spark.read.parquet(path)
    if tickers is not None:
        store = store.join(tickers.select("ticker").distinct(), "ticker", "left_semi")
    content = F.xxhash64(*[c for c in store.columns])
    return top_n_per_key(store, ["ticker"], [F.desc("updated_at"), F.desc("engine_version"), content])


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def group_hash(records: DataFrame, key: str) -> DataFrame:
    """Content hash per key that does not depend on row order and never collects a group."""
    row = F.xxhash64(F.to_json(F.struct(*[c for c in sorted(records.columns) if c != key])))
    sums = records.groupBy(key).agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s"), F.bit_xor(row).alias("x"))
    return sums.select(key, F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("s").cast("string"), F.col("x").cast("string")), 256).alias("content_hash"))


def write_ledger_snapshot(records: DataFrame, path: str, key: str = "ticker") -> DataFrame:
    """Append the records of every key whose content is not stored yet; returns the new (key, hash) rows."""
    spark = records.sparkSession
    hashes = group_hash(records, key)
    if exists(spark, path):
        stored = spark.read.parquet(path).select(key, "content_hash").distinct()
        hashes = hashes.join(stored, [key, "content_hash"], "left_anti")
    # written before the records, so that a plan made later does not see them as stored
    fresh_path = f"{path.rstrip('/')}-added-{uuid.uuid4().hex[:12]}"
    hashes.write.parquet(fresh_path)
    fresh = spark.read.parquet(fresh_path)
    records.join(fresh, key).withColumn("bucket", _bucket(key)).write.mode("append").partitionBy("bucket").parquet(path)
    return fresh


BUCKETS = 64
AUDIT_KEY = ["ticker", "metric", "period"]


def _bucket(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def read_audit(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The merged audit table, by default its newest version."""
    return keyed_store.read(spark, f"{path}/table", version)


def write_audit(records: DataFrame, path: str) -> int:
    """JSON and CSV of this run's records; the stored table, in which they replace those of their ticker, metric and period;
    and a manifest with a content hash per ticker of the run. Returns the table's version; a run that ends early leaves the table as it was."""
    # four outputs read the records
    records = written(records, "audit-records")
    records.write.mode("overwrite").json(f"{path}/json")
    export_table(records, f"{path}/csv")
    replaced = lambda old, new: old.join(new.select(*AUDIT_KEY).distinct(), AUDIT_KEY, "left_anti").unionByName(new)
    version = keyed_store.upsert(records, f"{path}/table", ["ticker"], replaced)
    group_hash(records, "ticker").write.mode("overwrite").json(f"{path}/manifest")
    return version


def export_table(df: DataFrame, path: str, form: str = "csv") -> None:
    """CSV with every value quoted and quotes doubled, or JSON lines."""
    if form == "json":
        df.write.mode("overwrite").json(path)
    else:
        df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
