"""Valuation table in long form: metrics, multiples, growth and margins per ticker and period."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import numbers as N
from tidemark.operators.keyed import top_n_per_key

# Denominator of each multiple, in display order.
MULTIPLES = {
    "evRevenue": "revenue", "evGrossProfit": "grossProfit", "evEbit": "ebit", "evEbitda": "adjustedEbitda", "evFreeCashFlow": "freeCashFlow",
}


def point_balance(facts: DataFrame, tags: dict[str, list[str]]) -> DataFrame:
    """Latest instant value of each item: the first tag that has any value, then its newest row."""
    item, rank = F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, names in tags.items():
        for position, tag in enumerate(names):
            item = F.when(F.col("tag") == tag, name).otherwise(item)
            rank = F.when(F.col("tag") == tag, position).otherwise(rank)
    wanted = facts.where(N.finite(F.col("value"))).withColumns({"item": item, "__rank": rank}).where("item IS NOT NULL AND end_date IS NOT NULL")
    return top_n_per_key(wanted, ["ticker", "item"], [F.col("__rank"), F.desc("end_date"), F.desc("filed")]).drop("__rank")


def capital_structure(balances: DataFrame, quotes: DataFrame) -> DataFrame:
    """One row per ticker: shares, debt, cash, equity value and enterprise value."""
    wide = balances.groupBy("ticker").agg(*[F.max(F.when(F.col("item") == n, F.col("value"))).alias(n) for n in ("cash", "debt", "shares")])
    joined = quotes.select("ticker", "price").join(wide, "ticker", "left")
    equity, ev = N.enterprise_value(F.col("price"), F.col("shares"), F.col("debt"), F.col("cash"))
    return joined.withColumns({"equity_value": equity, "enterprise_value": ev})


def multiples(cells: DataFrame, capital: DataFrame) -> DataFrame:
    """Enterprise value over every metric cell that serves as a denominator."""
    name = F.lit(None).cast("string")
    for multiple, metric in MULTIPLES.items():
        name = F.when(F.col("metric") == metric, multiple).otherwise(name)
    joined = cells.withColumn("item", name).where("item IS NOT NULL").join(capital.select("ticker", "enterprise_value"), "ticker", "left")
    return joined.select("ticker", "item", "period", N.valuation_multiple(F.col("enterprise_value"), F.col("value")).alias("value"))


def growth_and_margins(cells: DataFrame) -> DataFrame:
    """Revenue growth against the column before, gross margin and company-metric margin."""
    c = F.col
    wide = cells.groupBy("ticker", "period", "ordinal").agg(*[
        F.max(F.when(c("metric") == m, c("value"))).alias(m) for m in ("revenue", "grossProfit", "adjustedEbitda")])
    order = Window.partitionBy("ticker").orderBy("ordinal")
    rows = wide.withColumns({
        "revenueGrowth": N.growth_ratio(c("revenue"), F.lag("revenue").over(order)), "grossMargin": N.margin(c("grossProfit"), c("revenue")),
        "ebitdaMargin": N.margin(c("adjustedEbitda"), c("revenue"))})
    return rows.unpivot(["ticker", "period"], ["revenueGrowth", "grossMargin", "ebitdaMargin"], "item", "value").select("ticker", "item", "period", "value")


def forward_cells(revenue: DataFrame, ltm: DataFrame, metrics: list[str]) -> DataFrame:
    """Forward revenue and margin-based forward metrics; a missing basis gives an empty cell with a reason."""
    c = F.col
    base = ltm.groupBy("ticker").agg(*[F.max(F.when(c("metric") == m, c("value"))).alias(m) for m in ["revenue", *metrics]])
    joined = revenue.select("ticker", "period", "ordinal", c("value").alias("forward")).join(
        base.withColumnRenamed("revenue", "__ltm"), "ticker", "left")
    cells = joined.select("ticker", "period", "ordinal", c("forward").alias("revenue"), *[
        N.forward_by_margin(c("forward"), c(m), c("__ltm")).alias(m) for m in metrics])
    long = cells.unpivot(["ticker", "period", "ordinal"], ["revenue", *metrics], "metric", "value")
    return fail_closed_forward(long)


def fail_closed_forward(cells: DataFrame) -> DataFrame:
    missing = F.col("value").isNull()
    return cells.withColumns({
        "status": F.when(missing, "MISSING_SOURCE_DATA").otherwise("DERIVED_ESTIMATE"),
        "reason": F.when(missing, "FORWARD_BASIS_UNAVAILABLE")})


def valuation_table(actuals: DataFrame, forward: DataFrame, capital: DataFrame) -> DataFrame:
    """All items of the table in long form: capital, metrics, multiples, growth, margins."""
    columns = ["ticker", "metric", "period", "ordinal", "value"]
    cells = actuals.select(columns).unionByName(forward.select(columns))
    metrics = cells.select("ticker", F.col("metric").alias("item"), "period", "value")
    current = capital.unpivot(["ticker"], ["price", "equity_value", "debt", "cash", "enterprise_value"], "item", "value").select(
        "ticker", "item", F.lit("Current").alias("period"), "value")
    return metrics.unionByName(current).unionByName(multiples(cells, capital)).unionByName(growth_and_margins(cells))


def apply_market(cells: DataFrame, capital: DataFrame, quotes: DataFrame) -> DataFrame:
    """Reprice stored multiples with new quotes."""
    stored = capital.select("ticker", "shares", "debt", "cash")
    equity, ev = N.enterprise_value(F.col("price"), F.col("shares"), F.col("debt"), F.col("cash"))
    fresh = stored.join(quotes.select("ticker", "price"), "ticker", "left").withColumns({"equity_value": equity, "enterprise_value": ev})
    return multiples(cells, fresh)


def apply_consensus(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """Forward cells replaced by newly computed ones; cells without an update stay."""
    keys = ["ticker", "metric", "period"]
    return stored.join(updates.select(keys), keys, "left_anti").unionByName(updates.select(stored.columns))


def assemble(snapshots: DataFrame, quotes: DataFrame, history: DataFrame) -> DataFrame:
    """Snapshots with their quote and price range; both sides keep every snapshot."""
    ranges = history.groupBy("ticker").agg(F.max("close").alias("hi"), F.min("close").alias("lo"), F.max("day").alias("last_day"))
    joined = snapshots.join(quotes.select("ticker", "price"), "ticker", "left").join(ranges, "ticker", "left")
    high, low = F.greatest("hi", "price"), F.least("lo", "price")
    return joined.withColumns({
        "high52": high, "low52": low, "below_high52": N.growth_ratio(F.col("price"), high), "above_low52": N.growth_ratio(F.col("price"), low)}).drop("hi", "lo")


def valuation_columns(table: DataFrame, columns: list[str]) -> DataFrame:
    """Wide edge of the table: one column per item and period, in the given order."""
    return table.withColumn("column", F.concat_ws("_", "item", "period")).groupBy("ticker").pivot("column", columns).agg(F.max("value"))


def cell_value(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """Look up requested cells; an unknown cell stays empty."""
    return wanted.join(cells, ["ticker", "metric", "period"], "left")


def fundamentals_panel(annual: DataFrame, estimates: DataFrame, capital: DataFrame, years: list[int]) -> DataFrame:
    """Two fiscal years, growth, current estimate and enterprise value over it, one row per ticker and metric."""
    c = F.col
    keys = ["ticker", "metric"]
    wide = annual.groupBy(*keys).agg(*[F.max(F.when(c("year") == y, c("value"))).alias(f"y{i}") for i, y in enumerate(years)])
    joined = wide.join(estimates.select(*keys, c("value").alias("estimate"), "label"), keys, "left").join(
        capital.select("ticker", "enterprise_value"), "ticker", "left")
    return joined.select(*keys, *[f"y{i}" for i in range(len(years))], N.growth_abs(c(f"y{len(years) - 1}"), c("y0")).alias("growth"), "estimate", "label",
                         N.growth_abs(c("estimate"), c(f"y{len(years) - 1}")).alias("estimate_growth"),
                         N.valuation_multiple(c("enterprise_value"), c("estimate")).alias("ev_to_estimate"))
