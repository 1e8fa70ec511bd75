"""Audit of valuation cells, economic sanity, snapshot promotion and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import numbers as N
from tidemark.operators.keyed import top_n_per_key

CELL = ["ticker", "metric", "period"]
VERIFIED = ["VERIFIED_REPORTED", "VERIFIED_DERIVED"]

# Statuses that justify an empty cell, and those that leave it unresolved.
EXPLICIT_NULL = ["NOT_REPORTED", "LEGITIMATE_NA", "OUT_OF_SCOPE", "OUT_OF_SEC_SCOPE", "ETF_NOT_APPLICABLE", "DEFINITION_INCOMPATIBLE",
                 "OPERATION_SCOPE_INCOMPATIBLE"]
MANDATORY_FAILURE = ["MISSING_SOURCE_DATA", "INSUFFICIENT_PERIOD_COVERAGE", "STALE_SOURCE_COVERAGE", "REQUIRES_REVIEW"]
# Statuses of a refresh that prove a value wrong, and those that only say it could not be found.
AFFIRMATIVE = ["REQUIRES_REVIEW", "DEFINITION_INCOMPATIBLE", "OPERATION_SCOPE_INCOMPATIBLE", "OUT_OF_SCOPE", "NOT_REPORTED", "LEGITIMATE_NA"]
TRANSIENT = ["MISSING_SOURCE_DATA", "MISSING_BUT_AVAILABLE", "INSUFFICIENT_PERIOD_COVERAGE", "STALE_SOURCE_COVERAGE", "UNAVAILABLE", "UNVERIFIED"]
# Canonical result statuses and the statuses a cell may be shown with.
CANONICAL = [*VERIFIED, "NOT_REPORTED", "MISSING_SOURCE_DATA", "INSUFFICIENT_PERIOD_COVERAGE", "STALE_SOURCE_COVERAGE", "DEFINITION_INCOMPATIBLE",
             "REQUIRES_REVIEW", "OPERATION_SCOPE_INCOMPATIBLE", "OUT_OF_SCOPE", "LEGITIMATE_NA"]
DISPLAYABLE = ["VERIFIED", "VERIFIED_EXACT", "VERIFIED_RECONSTRUCTED", *VERIFIED, "MANUAL OVERRIDE"]
BASE_METRICS = ["revenue", "grossProfit", "ebit", "operatingCashFlow", "capitalExpenditures", "freeCashFlow"]
DERIVED_OUTPUTS = ["ebit", "evRevenue", "evGrossProfit", "evEbit", "evFreeCashFlow", "evEbitda", "revenueGrowth", "grossMargin", "ebitdaMargin"]


def _in(column: Column, values: list[str]) -> Column:
    return F.coalesce(column.isin(values), F.lit(False))


def audit_cells(cells: DataFrame) -> DataFrame:
    """Status of each cell from its source, raw-value and recomputation checks.

    Columns used: metric, period, value, recomputed, source_type, source_status, manual.
    """
    c = F.col
    has_value = N.finite(c("value"))
    calculated = c("recomputed").isNull() | F.coalesce(N.close_enough(c("value"), c("recomputed"), 1e-9), F.lit(False))
    sourced = F.coalesce(c("source_type"), F.lit("Unavailable")) != "Unavailable"
    remark = (
        F.when(~sourced, "NO_SOURCE").when(c("source_type").rlike("(?i)filed actual"), F.lit(None).cast("string"))
        .when(c("source_type").rlike("(?i)quote|trailing|consensus"), "SINGLE_PROVIDER").when(c("source_type").rlike("(?i)derived"), "DERIVED_INPUTS")
        .otherwise("SOURCE_CLASS_INCOMPLETE"))
    derived = _in(c("metric"), DERIVED_OUTPUTS)
    base = (_in(c("metric"), BASE_METRICS) & c("period").rlike(r"^(?:LTM|\d{4}A)$")) | (
        (c("metric") == "adjustedEbitda") & (~has_value | _in(c("source_status"), VERIFIED)))
    kept = F.when(base & _in(c("source_status"), CANONICAL), c("source_status"))
    inherited = F.when(derived & _in(c("source_status"), CANONICAL) & ~_in(c("source_status"), VERIFIED), c("source_status"))
    chosen = (
        F.when(~calculated | ~sourced, "FAILED").when(c("manual"), "MANUAL OVERRIDE").when(derived, "VERIFIED_DERIVED")
        .when(_in(c("source_status"), ["VERIFIED_EXACT", "VERIFIED_RECONSTRUCTED", "VERIFIED WITH WARNING"]), c("source_status"))
        .when(remark.isNull(), "VERIFIED").otherwise("VERIFIED WITH WARNING"))
    empty = F.when(_in(c("source_status"), ["MISMATCH", "FAILED", "MISSING_BUT_AVAILABLE", "ETF_NOT_APPLICABLE", "OUT_OF_SEC_SCOPE", "UNAVAILABLE", *CANONICAL[2:]]),
                   c("source_status")).otherwise("UNVERIFIED")
    status = F.coalesce(kept, inherited, F.when(has_value, chosen).otherwise(empty))
    return cells.withColumns({"check_calculation": calculated, "check_source": sourced, "remark": remark, "audit_status": status}).withColumn(
        "displayable", _in(F.col("audit_status"), DISPLAYABLE))


INCOMPLETE = ["UNAVAILABLE", "UNVERIFIED", "FAILED", "MISMATCH", "MISSING_BUT_AVAILABLE", *CANONICAL[2:]]


def audit_summary(audited: DataFrame) -> DataFrame:
    """One row of counters over all cells."""
    c = F.col
    reason = F.coalesce("reason", F.lit(""))
    return audited.agg(
        F.count("*").alias("total"), F.count_if(reason.rlike("(?i)stale")).alias("stale"), F.count_if(reason.rlike("(?i)conflict|disagree")).alias("conflicts"),
        F.count_if(~c("check_calculation")).alias("mismatches"), F.count_distinct(F.when(_in(c("audit_status"), INCOMPLETE), c("ticker"))).alias("incomplete_companies"))


def strictly_displayable(status: Column, historical: Column) -> Column:
    """Historical cells need a verified status; other cells any displayable one."""
    return F.when(historical, _in(status, VERIFIED)).otherwise(_in(status, DISPLAYABLE))


def status_summary(cells: DataFrame) -> DataFrame:
    """Cells per status, by ticker and over all tickers (null ticker)."""
    return cells.rollup("ticker", "status").agg(F.count("*").alias("n"), F.grouping_id().alias("gid")).where("gid IN (0, 3)").select(
        "ticker", "status", "n").unionByName(cells.groupBy("status").agg(F.count("*").alias("n")).select(F.lit(None).cast("string").alias("ticker"), "status", "n"))


# Wording of a reason and the root cause reported for it, first match wins.
ROOT_CAUSES = [
    (r"annual-reconciliation", "Annual reconciliation failure"), (r"incomplete-quarter", "Incomplete quarter coverage"),
    (r"conflict", "Restated or conflicting SEC fact"), (r"depreciation|amortization", "Missing D&A component"), (r"capital", "Missing capex component"),
    (r"incomplete[_-]cfo[_-]or[_-]capex", "Missing compatible CFO or capex component"),
    (r"four[_-]exact[_-]calendar[_-]quarters", "Four exact company-defined quarters are unavailable"),
    (r"definition[_-]incompatible", "Company Adjusted EBITDA definition changed"), (r"no[_-]compatible[_-]consolidated", "No compatible consolidated SEC fact"),
    (r"partial[_-]standalone", "Partial standalone-quarter coverage"),
]


def root_causes(cells: DataFrame) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "reason", "method"))
    cause = F.lit("Unavailable source coverage")
    for pattern, name in reversed(ROOT_CAUSES):
        cause = F.when(text.rlike(pattern), name).otherwise(cause)
    return cells.groupBy(cause.alias("cause")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cause")


def completeness_grid(tickers: DataFrame, cells: DataFrame, metrics: list[str], periods: list[str]) -> DataFrame:
    """Missing and duplicate cells. The grid is unfolded from each ticker row; no cross join is needed."""
    wanted = tickers.select("ticker", F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric")).select(
        "ticker", "metric", F.explode(F.array(*[F.lit(p) for p in periods])).alias("period"))
    counts = cells.groupBy(*CELL).agg(F.count("*").alias("n"))
    joined = wanted.join(counts, CELL, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.where("n <> 1").withColumn("reason", F.when(F.col("n") == 0, "MISSING_AUDIT_CELL").otherwise("DUPLICATE_AUDIT_CELL")).drop("n")


def fill_cell_grid(tickers: DataFrame, cells: DataFrame, metrics: list[str], periods: list[str], status: str) -> DataFrame:
    """One cell for every ticker, metric and period; absent ones carry the placeholder status."""
    wanted = tickers.select("ticker", F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric")).select(
        "ticker", "metric", F.explode(F.array(*[F.lit(p) for p in periods])).alias("period"))
    return wanted.join(cells.select(*CELL, "value", "status"), CELL, "left").withColumn("status", F.coalesce("status", F.lit(status)))


def audit_issues(records: DataFrame) -> DataFrame:
    """Issues of audited cells with component lineage; one row per issue."""
    c = F.col
    complete = lambda x: (x["provider"].isNotNull() & x["source_id"].isNotNull() & x["end_date"].isNotNull()
                          & (x["start_date"].isNotNull() | (x["fiscal_year"].isNotNull() & x["fiscal_quarter"].between(1, 4))))
    parts = c("components")
    lineage = F.forall(parts, complete)
    several = (F.size(parts) >= 2) & lineage
    distinct = lambda field: F.size(F.array_distinct(F.array_compact(F.transform(parts, lambda x: x[field]))))
    filled = lambda field: F.forall(parts, lambda x: x[field].isNotNull())
    evidence = (
        F.when(c("status") == "DEFINITION_INCOMPATIBLE", several & filled("definition") & (distinct("definition") > 1))
        .when(c("status") == "OPERATION_SCOPE_INCOMPATIBLE", several & filled("op_scope") & (distinct("op_scope") > 1))
        .when(c("status") == "NOT_REPORTED", F.coalesce(c("search_completed"), F.lit(False)))
        .when(c("status") == "LEGITIMATE_NA", F.coalesce(c("search_completed"), F.lit(False)) & several).otherwise(F.lit(True)))
    empty = c("value").isNull()
    rules = [
        (c("status").isNull(), "MISSING_VALIDATION_STATUS"),
        (c("status").isNotNull() & empty & _in(c("status"), MANDATORY_FAILURE), "MANDATORY_CELL_UNRESOLVED"),
        (c("status").isNotNull() & empty & ~_in(c("status"), MANDATORY_FAILURE) & ~_in(c("status"), EXPLICIT_NULL), "UNJUSTIFIED_NULL"),
        (empty & _in(c("status"), EXPLICIT_NULL) & ~evidence, "NULL_WITHOUT_POSITIVE_EVIDENCE"),
        (c("status").isNotNull() & empty & (F.coalesce("reason", F.lit("")) == ""), "NULL_WITHOUT_EXPLICIT_REASON"),
        (c("status").isNotNull() & ~empty & ~N.finite(c("value")), "NON_NUMERIC_VALUE"),
        (c("status").isNotNull() & ~empty & ~_in(c("status"), VERIFIED), "VALUE_NOT_VERIFIED"),
        (c("status").isNotNull() & ~empty & (F.coalesce(F.size(parts), F.lit(0)) <= 0), "VALUE_WITHOUT_COMPONENT_LINEAGE"),
        (c("status").isNotNull() & ~empty & (F.size(parts) > 0) & ~lineage, "INCOMPLETE_COMPONENT_PROVENANCE"),
    ]
    found = F.array_compact(F.array(*[F.when(condition, name) for condition, name in rules]))
    return records.select(*CELL, "status", F.explode(found).alias("issue"))


def economic_sanity(cells: DataFrame) -> DataFrame:
    """Flags of yearly cells whose margins, changes or signs look wrong: one row per flag."""
    c = F.col
    metrics = ["revenue", "grossProfit", "adjustedEbitda", "freeCashFlow", "operatingCashFlow"]
    wide = cells.groupBy("ticker", "year").agg(*[F.max(F.when(c("metric") == m, c("value"))).alias(m) for m in metrics])
    order = Window.partitionBy("ticker").orderBy("year")
    before = {m: F.when(F.lag("year").over(order) == c("year") - 1, F.lag(m).over(order)) for m in ("revenue", "grossProfit", "adjustedEbitda")}
    rows = wide.withColumns({f"p_{m}": column for m, column in before.items()})
    revenue, prior = c("revenue"), c("p_revenue")
    ratio = lambda m: F.when(revenue != 0, c(m) / revenue)
    jump = lambda m: F.abs(ratio(m) - F.when(prior != 0, c(f"p_{m}") / prior)) > 0.75
    change = F.when(prior != 0, revenue / prior - 1)
    outside = lambda m, low, high: (ratio(m) < low) | (ratio(m) > high)
    above = c("freeCashFlow") > c("operatingCashFlow") + F.greatest(F.lit(1.0), F.abs("operatingCashFlow")) * 0.001
    rules = [
        ("grossProfit", c("grossProfit") < 0, "NEGATIVE_GROSS_PROFIT"), ("grossProfit", outside("grossProfit", -0.25, 1.1), "EXTREME_GROSS_MARGIN"),
        ("adjustedEbitda", outside("adjustedEbitda", -2, 1.5), "EXTREME_ADJ_EBITDA_MARGIN"), ("freeCashFlow", outside("freeCashFlow", -2, 2), "EXTREME_FCF_MARGIN"),
        ("revenue", (change < -0.75) | (change > 3), "LARGE_YOY_REVENUE_CHANGE"), ("grossProfit", jump("grossProfit"), "LARGE_YOY_MARGIN_CHANGE"),
        ("adjustedEbitda", jump("adjustedEbitda"), "LARGE_YOY_MARGIN_CHANGE"), ("freeCashFlow", above, "FCF_DIRECTION_INCONSISTENT_WITH_CFO"),
    ]
    flags = F.array_compact(F.array(*[F.when(condition, F.struct(F.lit(m).alias("metric"), F.lit(flag).alias("flag"))) for m, condition, flag in rules]))
    return rows.select("ticker", "year", F.inline(flags))


def result_sanity(cells: DataFrame, factor: float = 1.01) -> DataFrame:
    """Negative revenue and gross profit above revenue are withdrawn for review."""
    c = F.col
    revenue = cells.where("metric = 'revenue'").select("ticker", "period", c("value").alias("__revenue"))
    joined = cells.join(revenue, ["ticker", "period"], "left")
    reason = (
        F.when((c("metric") == "revenue") & (c("value") < 0), "NEGATIVE_REVENUE")
        .when((c("metric") == "grossProfit") & (c("value") > c("__revenue") * factor), "GROSS_PROFIT_EXCEEDS_REVENUE"))
    bad = reason.isNotNull()
    return joined.withColumns({
        "value": F.when(~bad, c("value")), "status": F.when(bad, "REQUIRES_REVIEW").otherwise(c("status")), "reason": F.coalesce(reason, c("reason"))}).drop("__revenue")


def apply_derivation_failures(cells: DataFrame, failures: DataFrame) -> DataFrame:
    """Free-cash-flow years whose sources mix operation scopes lose their value."""
    bad = failures.where("reason = 'OPERATION_SCOPE_INCOMPATIBLE'").select("ticker", F.concat(F.year("end_date").cast("string"), F.lit("A")).alias("period")).distinct()
    joined = cells.join(bad.withColumn("__bad", F.lit(True)), ["ticker", "period"], "left")
    hit = F.coalesce(F.col("__bad") & (F.col("metric") == "freeCashFlow"), F.lit(False))
    return joined.withColumns({
        "value": F.when(~hit, F.col("value")), "status": F.when(hit, "OPERATION_SCOPE_INCOMPATIBLE").otherwise(F.col("status")),
        "reason": F.when(hit, "OPERATION_SCOPE_INCOMPATIBLE").otherwise(F.col("reason"))}).drop("__bad")


def metric_health(status: Column, value: Column) -> Column:
    """Company-metric cell: HEALTHY or REPAIR_REQUIRED."""
    legitimate = _in(status, ["NOT_REPORTED", "LEGITIMATE_NA", "OUT_OF_SCOPE", "INSUFFICIENT_PERIOD_COVERAGE", "DEFINITION_INCOMPATIBLE", "REQUIRES_REVIEW"])
    good = F.when(value.isNotNull(), _in(status, VERIFIED)).otherwise(legitimate)
    return F.when(good, "HEALTHY").otherwise("REPAIR_REQUIRED")


def snapshot_state(snapshots: DataFrame, version: str, years: list[int], as_of: Column, days: int = 30) -> DataFrame:
    """READY, STALE or INCOMPATIBLE with the reasons.

    Columns used: engine_version, actual_years, updated_at, valid, healthy.
    """
    c = F.col
    wanted = F.array(*[F.lit(y) for y in sorted(years)])
    problems = F.array_compact(F.array(
        F.when(~c("engine_version").eqNullSafe(version), "ENGINE_VERSION_MISMATCH"),
        F.when(~F.array_sort(F.array_distinct("actual_years")).eqNullSafe(wanted), "ACTUAL_YEAR_SET_MISMATCH"), F.when(~c("valid"), "SNAPSHOT_SCHEMA_INVALID")))
    age = F.datediff(as_of, F.to_date("updated_at"))
    stale = c("updated_at").isNull() | (age > days) | ~c("healthy")
    return snapshots.withColumn("reasons", problems).withColumn(
        "state", F.when(F.size("reasons") > 0, "INCOMPATIBLE").when(stale, "STALE").otherwise("READY"))


def promote_snapshot(existing: DataFrame, candidate: DataFrame) -> DataFrame:
    """Cells to keep after a refresh: per ticker either all candidate cells or all existing ones.

    A verified cell that became empty for a transient reason rejects the whole candidate of its ticker, unless
    the candidate proves the value wrong or has newer trailing evidence.
    """
    c = F.col
    pack = lambda df, name: df.select(*CELL, F.struct("value", "status", "reason", "latest_end").alias(name))
    both = pack(existing, "old").join(pack(candidate, "new"), CELL, "full")
    was = N.finite(c("old.value")) & _in(c("old.status"), VERIFIED)
    still = N.finite(c("new.value")) & _in(c("new.status"), VERIFIED)
    newer = (c("period") == "LTM") & c("new.latest_end").isNotNull() & (c("old.latest_end").isNull() | (c("new.latest_end") > c("old.latest_end")))
    transient = c("new").isNull() | c("new.status").isNull() | _in(c("new.status"), TRANSIENT) | F.coalesce(
        c("new.reason").rlike("(?i)TIMEOUT|EXTRACTION|PARSER|MISSING_SOURCE|INSUFFICIENT.*COVERAGE|SOURCE.*UNAVAILABLE"), F.lit(False))
    company = c("metric") == "adjustedEbitda"
    proven = F.when(company, _in(c("new.status"), ["REQUIRES_REVIEW", "DEFINITION_INCOMPATIBLE"])).otherwise(_in(c("new.status"), AFFIRMATIVE))
    degraded = was & ~still & ~proven & ~F.coalesce(newer, F.lit(False)) & (company | transient)
    marked = both.withColumn("__degraded", degraded)
    # a ticker has a bounded number of cells; the verdict is a combined aggregate joined back
    verdict = marked.groupBy("ticker").agg(
        F.bool_or("__degraded").alias("rejected"), F.bool_or(c("new").isNotNull()).alias("__offered"), F.bool_or(c("old").isNotNull()).alias("__stored"))
    joined = marked.join(verdict, "ticker")
    retain = (c("rejected") | ~c("__offered")) & c("__stored")
    side = F.when(retain, c("old")).otherwise(c("new"))
    out = joined.select(*CELL, side.alias("r"), F.when(retain, "RETAINED").otherwise("ACCEPTED").alias("decision"), c("__degraded").alias("degraded"))
    return out.where("r IS NOT NULL").select(*CELL, "r.value", "r.status", "r.reason", "r.latest_end", "decision", "degraded")


def shadow_compare(legacy: DataFrame, canonical: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Cell by cell difference of two constructions with its cause."""
    c = F.col
    left = legacy.select(*CELL, c("value").alias("legacy_value"))
    right = canonical.select(*CELL, c("value").alias("canonical_value"), "status", "reason", "classification")
    joined = left.join(right, CELL, "full")
    difference = c("canonical_value") - c("legacy_value")
    relative = F.when(c("legacy_value") != 0, difference / F.abs("legacy_value"))
    missing = c("canonical_value").isNull()
    different = ~missing & (c("legacy_value").isNull() | (F.abs(F.coalesce(relative, difference)) > tolerance))
    cause = (
        F.when(c("status").isin("STALE_SOURCE_COVERAGE", "INSUFFICIENT_PERIOD_COVERAGE"), c("status")).when(c("reason") == "VALUE_CONFLICT", "SOURCE_VALUE_CONFLICT")
        .when(c("reason") == "NON_CONSOLIDATED_SCOPE", "SCOPE_CONFLICT").when(c("classification") == "CALENDARIZED_ESTIMATE", "CALENDARIZATION_METHOD_CHANGED")
        .when(missing, "MISSING_PROVIDER_PERIOD").otherwise("PERIOD_CLASSIFICATION_DIFFERENCE"))
    return joined.withColumns({"different": different, "unavailable": missing}).withColumn("cause", F.when(different | missing, cause))


def comparison_summary(compared: DataFrame) -> DataFrame:
    c = F.col
    return compared.agg(
        F.count_if(~c("different") & ~c("unavailable")).alias("matching"), F.count_if(c("different")).alias("different"), F.count_if(c("unavailable")).alias("unavailable"),
        F.count_if(c("status") == "STALE_SOURCE_COVERAGE").alias("stale"), F.count_if(c("status") == "REQUIRES_REVIEW").alias("requires_review"),
        F.count_if(c("status") == "DEFINITION_INCOMPATIBLE").alias("definition_incompatible"),
        F.count_if(c("status").isin("INSUFFICIENT_PERIOD_COVERAGE", "MISSING_SOURCE_DATA")).alias("insufficient_coverage"),
        F.count_if(c("status") == "OPERATION_SCOPE_INCOMPATIBLE").alias("operation_scope_incompatible"))


def audit_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """RECOVERED, REGRESSED, REMAINING or STABLE per cell of two audit runs."""
    c = F.col
    joined = before.select(*CELL, c("status").alias("before_status")).join(after.select(*CELL, c("status").alias("after_status")), CELL, "full")
    was, now = _in(c("before_status"), VERIFIED), _in(c("after_status"), VERIFIED)
    return joined.withColumn("change", F.when(now & ~was, "RECOVERED").when(~now & was, "REGRESSED").when(~now, "REMAINING").otherwise("STABLE"))


def exception_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cells that changed or stay open, with value and reason of the later run."""
    changes = audit_diff(before, after).where("change <> 'STABLE'")
    return changes.join(after.select(*CELL, "value", "reason"), CELL, "left")


def golden_compare(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Expected against produced values with the reason of a difference."""
    c = F.col
    joined = expected.select(*keys, c("value").alias("expected")).join(actual.select(*keys, c("value").alias("actual"), "method"), keys, "left")
    match = F.when(c("expected").isNull(), c("actual").isNull()).otherwise(
        F.coalesce(F.abs(c("actual") - c("expected")) <= F.greatest(F.lit(1.0), F.abs("expected") * 1e-9), F.lit(False)))
    cause = (
        F.when(c("actual").isNull(), F.coalesce("method", F.lit("PRODUCTION_VALUE_MISSING")))
        .when(c("expected").isNull(), "PRODUCTION_VALUE_PRESENT_WHERE_GOLDEN_IS_NA").otherwise("VALUE_MISMATCH"))
    return joined.withColumn("match", match).withColumn("root_cause", F.when(~F.col("match"), cause))


def read_audited_cells(per_ticker: DataFrame, latest: DataFrame) -> DataFrame:
    """Audited cells of a ticker from its own run when that has a usable record, else from the latest run."""
    c = F.col
    usable = lambda df: df.groupBy("ticker").agg(F.bool_or(c("value").isNotNull() & _in(c("status"), VERIFIED)).alias("u")).where("u").select("ticker")
    own = per_ticker.join(usable(per_ticker), "ticker", "left_semi")
    rest = latest.join(usable(latest), "ticker", "left_semi").join(usable(per_ticker), "ticker", "left_anti")
    return own.unionByName(rest)


def company_metric_complete(cells: DataFrame, periods: list[str]) -> DataFrame:
    """Tickers whose company metric is verified in every wanted period."""
    ok = N.finite(F.col("value")) & _in(F.col("status"), VERIFIED)
    wanted = cells.where((F.col("metric") == "adjustedEbitda") & F.col("period").isin(periods))
    return wanted.groupBy("ticker").agg((F.count_distinct(F.when(ok, F.col("period"))) == len(periods)).alias("complete"))


def provider_metadata_audit(rows: DataFrame) -> DataFrame:
    """How many provider rows carry each piece of period metadata."""
    present = {
        "with_start": "start_date", "with_fiscal_year": "fiscal_year", "with_fiscal_quarter": "fiscal_quarter", "with_filing_date": "filed",
        "with_accession": "accession", "with_scope": "scope", "with_source": "source_id"}
    only_end = F.count_if(F.col("start_date").isNull() & F.col("end_date").isNotNull()).alias("with_only_end")
    return rows.groupBy("provider").agg(F.count("*").alias("observations"), *[F.count(column).alias(name) for name, column in present.items()], only_end)


def audit_records(cells: DataFrame) -> DataFrame:
    """Batch audit rows: a cell that breaks an invariant fails closed with the reason."""
    broken = F.col("invariant_failure").isNotNull()
    return cells.select(
        *CELL, F.when(~broken, F.col("value")).alias("displayed_value"), F.when(broken, "REQUIRES_REVIEW").otherwise(F.col("status")).alias("validation_status"),
        F.coalesce("invariant_failure", F.when(F.col("value").isNull(), F.coalesce("reason", F.lit("UNEXPLAINED_NULL")))).alias("failure_reason"))


def replace_rows(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of the incoming tickers replace theirs in the current table."""
    return current.join(incoming.select("ticker").distinct(), "ticker", "left_anti").unionByName(incoming)


def conflict_candidates(obs: DataFrame) -> DataFrame:
    """Observations under review with the values they clash with; conflicts of one period are few."""
    c = F.col
    review = obs.where("dedup_status = 'REQUIRES_REVIEW'")
    return review.groupBy("ticker", "economic_period_key", "metric").agg(
        F.max("conflict").alias("type"), F.sort_array(F.collect_set(F.struct("source_id", "value"))).alias("values"))


def latest_snapshots(store: DataFrame, keys: list[str], by: str = "updated_at") -> DataFrame:
    return top_n_per_key(store, keys, [F.desc(by)])
