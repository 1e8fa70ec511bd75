"""Analyst estimates on calendar years and the next twelve months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import numbers as N
from tidemark.operators import periods as P
from tidemark.operators.keyed import range_match, top_n_per_key

EQUAL = [0.25, 0.25, 0.25, 0.25]


def select_estimate(trends: DataFrame) -> DataFrame:
    """Current-year estimate per ticker and metric, the next year's only for revenue, with its label."""
    c = F.col
    usable = trends.where(c("value").isNotNull() & c("end_date").isNotNull())
    rank = F.when(c("period") == "0y", 0).when((c("period") == "+1y") & (c("metric") == "revenue"), 1)
    best = top_n_per_key(usable.where(rank.isNotNull()), ["ticker", "metric"], [rank, c("end_date")])
    return best.withColumn("label", F.concat(F.lit("FY"), F.year("end_date").cast("string"), F.lit("E")))


def seasonality(quarters: DataFrame) -> DataFrame:
    """Shares of the last four positive quarters per ticker, a quarter each when fewer are known."""
    recent = top_n_per_key(quarters.where(F.col("value") > 0), ["ticker"], [F.desc("end_date")], 4)
    shares = recent.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("end_date", "value"))).alias("q"), F.sum("value").alias("total"))
    known = shares.where((F.size("q") == 4) & (F.col("total") > 0)).select(
        "ticker", F.transform("q", lambda x: x["value"] / F.col("total")).alias("weights"))
    everyone = quarters.select("ticker").distinct().join(known, "ticker", "left")
    return everyone.withColumn("weights", F.coalesce("weights", F.array(*[F.lit(w) for w in EQUAL])))


def _plan(end: Column, value: Column, weights: Column) -> Column:
    """Four three-month quarters of the fiscal year that ends on ``end``."""
    start = F.date_add(F.add_months(end, -12), 1)
    bounds = [F.date_sub(F.add_months(start, 3 * k), 1) for k in (1, 2, 3)] + [end]
    starts = [start] + [F.date_add(b, 1) for b in bounds[:3]]
    return F.array(*[F.struct(F.lit(k + 1).alias("slot"), starts[k].alias("start_date"), bounds[k].alias("end_date"),
                              F.get(weights, F.lit(k)).alias("weight"), (value * F.get(weights, F.lit(k))).alias("value")) for k in range(4)])


def estimate_to_quarters(estimates: DataFrame, weights: DataFrame) -> DataFrame:
    """Annual estimate split over its fiscal quarters by seasonal weight."""
    joined = estimates.join(weights, "ticker", "left").withColumn("weights", F.coalesce("weights", F.array(*[F.lit(w) for w in EQUAL])))
    return joined.select("ticker", "metric", "period", F.col("value").alias("annual"), F.col("end_date").alias("fiscal_end"), F.inline(
        _plan(F.col("end_date"), F.col("value"), F.col("weights"))))


def assign_reported(planned: DataFrame, filed: DataFrame, as_of: str, share: float = 0.8) -> DataFrame:
    """Filed quarter of each planned quarter: best overlap of at least 80 %, each filed quarter used once."""
    c = F.col
    known = filed.where(c("end_date") <= F.to_date(F.lit(as_of))).select(
        "ticker", c("start_date").alias("filed_start"), c("end_date").alias("filed_end"), c("value").alias("filed_value"))
    pairs = range_match(planned, known, ["ticker"], "end_date", "filed_end", 60)
    overlap = D.overlap_days(c("start_date"), c("end_date"), c("filed_start"), c("filed_end"))
    fits = pairs.withColumn("overlap", overlap).where(c("overlap") / (F.datediff("end_date", "start_date") + 1) >= share)
    best = top_n_per_key(fits, ["ticker", "metric", "period", "slot"], [F.desc("overlap"), c("filed_end")])
    return top_n_per_key(best, ["ticker", "metric", "period", "filed_end"], [c("slot")])


def estimate_with_reported(planned: DataFrame, filed: DataFrame, as_of: str) -> DataFrame:
    """Planned quarters with filed ones put in and the remainder spread over the others by weight."""
    c = F.col
    key = ["ticker", "metric", "period"]
    actual = assign_reported(planned, filed, as_of).select(*key, "slot", "filed_start", "filed_end", "filed_value")
    rows = planned.join(actual, [*key, "slot"], "left")
    open_ = c("filed_value").isNull()
    totals = rows.groupBy(*key).agg(
        F.coalesce(F.sum("filed_value"), F.lit(0.0)).alias("filed_total"), F.aggregate(
            F.array_sort(F.collect_list(F.when(open_, F.struct("slot", "weight")))), F.lit(0.0), lambda t, x: t + x["weight"]).alias("open_weight"))
    joined = rows.join(totals, key)
    remainder = c("annual") - c("filed_total")
    spread = F.when(c("open_weight") > 0, remainder * (c("weight") / c("open_weight")))
    return joined.select(
        *key, "slot", "annual", F.coalesce("filed_start", "start_date").alias("start_date"), F.coalesce("filed_end", "end_date").alias("end_date"),
        F.coalesce("filed_value", spread).alias("value"), F.when(open_, "CONSENSUS").otherwise("FILED").alias("source"),
        F.when(remainder < 0, "Low").otherwise("Medium").alias("confidence"))


def merge_estimates(quarters: DataFrame, years: list[int]) -> DataFrame:
    """Allocated parts of all fiscal years added up per calendar year."""
    parts = P.allocate_to_years(quarters, years)
    return parts.groupBy("ticker", "metric", "year").agg(F.sum("contribution").alias("value"), F.count("*").alias("components"))


def ntm(quarters: DataFrame, as_of: str) -> DataFrame:
    """Next twelve months from the quarter plan; null when under 360 days are covered."""
    c = F.col
    start = F.date_add(F.to_date(F.lit(as_of)), 1)
    end = F.date_sub(F.add_months(start, 12), 1)
    usable = quarters.where(N.finite(c("value")))
    # the same quarter may sit in the plans of two fiscal years; the first plan counts
    once = usable.groupBy("ticker", "metric", "start_date", "end_date").agg(F.min(F.struct("period", "value"))["value"].alias("value"))
    days = D.overlap_days(c("start_date"), c("end_date"), start, end)
    parts = once.withColumn("days", days).where("days > 0")
    sums = parts.groupBy("ticker", "metric").agg(
        F.sum("days").alias("covered"), F.sum(c("value") * (c("days") / (F.datediff("end_date", "start_date") + 1))).alias("total"))
    enough = c("covered") >= 360
    return sums.select("ticker", "metric", F.when(enough, c("total")).alias("value"), c("covered").alias("covered_days"), F.when(
        c("covered") == 365, "Medium").otherwise("Low").alias("confidence"))
