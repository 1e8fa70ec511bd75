"""Financial snapshots as VARIANT: payloads of several schema versions side by side in one keyed store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.keyed import latest_wins
from tidemark.sources import keyed_store as K

# What belongs to the market and not to a snapshot.
MARKET_FIELDS = ["price", "dailyChange", "dailyPercent", "ranges", "multiples", "marketTimestamp", "refreshing"]
#: Payloads of this version have their metrics below ``metrics``; those of the one before have them at the top.
VERSION = "v2"
EARLIER = "v1"


def without_market(payload: Column) -> Column:
    """The payload without market fields; null and payloads that are no objects stay."""
    fields = F.try_variant_get(payload, "$", "map<string, variant>")
    kept = F.map_filter(fields, lambda name, _: ~name.isin(MARKET_FIELDS))
    return F.when(fields.isNotNull(), F.to_variant_object(kept)).otherwise(payload)


def save(snapshots: DataFrame, path: str) -> int:
    """Stores snapshots (ticker, engine_version, actual_years, snapshot VARIANT, updated_at), one per ticker, the newest; returns the version."""
    ticker = F.upper(F.trim("ticker"))
    rows = snapshots.select(ticker.alias("ticker"), "engine_version", F.array_sort(F.array_distinct("actual_years")).alias("actual_years"), without_market(F.col("snapshot")).alias("snapshot"), "updated_at")
    return K.upsert(rows, path, ["ticker"], lambda old, new: latest_wins(old, new, ["ticker"], "updated_at"))


def current(snapshots: DataFrame) -> DataFrame:
    """Snapshots in the current schema, with ``migrated`` for those that came in the earlier one."""
    earlier = F.col("engine_version") == EARLIER
    lifted = F.to_variant_object(F.struct(F.col("snapshot").alias("metrics")))
    return snapshots.withColumns({
        "snapshot": F.when(earlier, lifted).otherwise(F.col("snapshot")), "migrated": F.coalesce(earlier, F.lit(False)), "engine_version": F.when(earlier, F.lit(VERSION)).otherwise(F.col("engine_version"))})


def metric(name: str, period: str) -> Column:
    """A number of a payload by its path; null where it is missing or no number."""
    return F.try_variant_get("snapshot", f"$.metrics.{name}['{period}']", "double")


def load(spark: SparkSession, path: str, tickers: DataFrame, years: list[int], as_of: Column, days: int = 30, write_back: bool = True) -> DataFrame:
    """Stored snapshots of the wanted tickers in the current schema, with their state and its reasons.

    INCOMPATIBLE: another engine version, another set of years, or no metrics; STALE: older than ``days`` at ``as_of``; else READY.
    Migrated ones are written back, unless ``write_back`` is off.
    """
    c = F.col
    wanted = tickers.select(F.upper(F.trim("ticker")).alias("ticker")).distinct()
    rows = current(K.read(spark, path).join(wanted, "ticker", "left_semi"))
    if write_back:
        changed = rows.where("migrated").drop("migrated")
        K.upsert(changed, path, ["ticker"], lambda old, new: latest_wins(old, new, ["ticker"], "updated_at"))
    asked = F.array(*[F.lit(y) for y in sorted(set(years))]).cast("array<int>")
    reasons = F.array_compact(F.array(
        F.when(~c("engine_version").eqNullSafe(F.lit(VERSION)), F.lit("ENGINE_VERSION_MISMATCH")), F.when(~c("actual_years").eqNullSafe(asked), F.lit("ACTUAL_YEAR_SET_MISMATCH")),
        F.when(F.try_variant_get("snapshot", "$.metrics", "map<string, variant>").isNull(), F.lit("SNAPSHOT_SCHEMA_INVALID"))))
    old = F.coalesce(c("updated_at") < as_of - F.expr(f"INTERVAL {days} DAYS"), F.lit(True))
    return rows.withColumn("reasons", reasons).withColumn("state", F.when(F.size("reasons") > 0, "INCOMPATIBLE").when(old, "STALE").otherwise("READY"))
