"""Periods: deduplication, standalone quarters, coverage and allocation.

Window functions run on rows already reduced to one per series, bounds, provider and authority. A series then
holds a number of rows bounded by the calendar, so one very large issuer cannot make one very large task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import numbers as N
from tidemark.operators.facts import SERIES
from tidemark.operators.keyed import once

REMAINDER = "FISCAL_YEAR_MINUS_YTD_9M"
# Trust in period dates, best first, and in providers.
AUTHORITY_RANK = {"REPORTED": 3, "DERIVED_FROM_REPORTED_BOUNDARIES": 2, "INFERRED": 1, "UNKNOWN": 0}
PROVIDER_RANK = {"STANDARDIZED": 300, "FILED": 200}
TOLERANCE_DAYS = 7


def _lookup(column: Column, values: dict, missing: int) -> Column:
    out = F.lit(missing)
    for key, rank in values.items():
        out = F.when(column == key, rank).otherwise(out)
    return out


def four_contiguous(periods: Column) -> Column:
    """Four periods in order, each starting the day after the one before ends."""
    steps = F.zip_with(F.slice(periods, 1, 3), F.slice(periods, 2, 3), lambda a, b: F.datediff(b["start_date"], a["end_date"]) == 1)
    return (F.size(periods) == 4) & F.forall(steps, lambda s: s)


def fold_filings(obs: DataFrame) -> DataFrame:
    """One row per series, bounds, provider, authority and method: the latest filing.

    Two values in the latest filing that differ by more than 0.1 % both stay, marked as a conflict. Combined
    before the shuffle, so any number of copies of a fact costs one row per task.
    """
    keys = [*SERIES, "period_type", "start_date", "end_date", "provider", "authority", "method"]
    rest = [c for c in obs.columns if c not in (*keys, "filed", "value", "accession", "source_id")]
    tail = [F.col(x) for x in ("accession", "source_id", *rest)]
    high = F.max(F.struct("filed", F.col("value").alias("ord"), "value", *tail)).alias("high")
    low = F.max(F.struct("filed", (-F.col("value")).alias("ord"), "value", *tail)).alias("low")
    folded = obs.groupBy(keys).agg(high, low, F.count("*").alias("copies"))
    clash = ~N.close_enough(F.col("high.value"), F.col("low.value"), 0.001)
    spread = folded.select(*keys, "copies", clash.alias("filing_conflict"), F.explode(
        F.when(clash, F.array("high", "low")).otherwise(F.array("high"))).alias("r"))
    return spread.select(*keys, "copies", "filing_conflict", *[F.col(f"r.{x}").alias(x) for x in ("filed", "value", "accession", "source_id", *rest)])


def dedupe_economic_periods(obs: DataFrame) -> DataFrame:
    """One observation per economic period; conflicting values stay side by side and need review.

    Ends at most 7 days apart form a cluster. Inside it, in order: a year-minus-nine-months quarter that was
    filed last, better date authority, the later filing of the same provider, a restated row, and the better
    provider. Rows of equal authority that differ by more than 0.1 % and are not restated all stay.

    After ``fold_filings`` a cluster holds one row per provider and bounds, so its few rows are compared as an
    array; clusters are found by the only ordered window of the plan.
    """
    c = F.col
    if "dedup_status" not in obs.columns:
        obs = obs.withColumns({"dedup_status": F.lit(None).cast("string"), "conflict": F.lit(None).cast("string")})
    columns = [x for x in obs.columns if x not in ("economic_period_key", "alternatives", "selection_reason")]
    series = [*SERIES, "period_type"]
    by_end = Window.partitionBy(*series).orderBy("end_date", "filed", "source_id")
    rows = fold_filings(obs).withColumn(
        "__new", F.coalesce(F.datediff("end_date", F.lag("end_date").over(by_end)) > TOLERANCE_DAYS, F.lit(True)).cast("int"))
    island = F.sum("__new").over(by_end.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    label = F.concat_ws(":", "calendar_id", c("fiscal_year").cast("string"), c("fiscal_quarter").cast("string"))
    rows = rows.withColumn("__cluster", F.when(c("end_date").isNotNull(), island.cast("string")).otherwise(label))
    labelled = Window.partitionBy(*series, "calendar_id", "fiscal_year", "fiscal_quarter")
    row = F.struct(
        *[c(x) for x in columns if x not in series], c("copies"), _lookup(c("authority"), AUTHORITY_RANK, 0).alias("auth"),
        (_lookup(c("provider"), PROVIDER_RANK, 100) + F.when(c("accession").isNotNull(), 20).otherwise(0)).alias("rank"),
        (c("fiscal_quarter").isNotNull() & (F.min("__cluster").over(labelled) != F.max("__cluster").over(labelled))).alias("split"))
    clusters = rows.select(*series, "__cluster", row.alias("row")).groupBy(*series, "__cluster").agg(F.collect_list("row").alias("xs"))
    highest = lambda items, field: F.array_max(F.transform(items, lambda x: x[field]))
    # most clusters hold one row; the comparison columns stay null for them
    several_rows = F.size("xs") > 1
    clusters = clusters.withColumns({
        "__filed": F.when(several_rows, highest(c("xs"), "filed")), "__auth": F.when(several_rows, highest(c("xs"), "auth")),
        "__copies": F.when(several_rows, F.aggregate("xs", F.lit(0).cast("bigint"), lambda total, x: total + x["copies"])).otherwise(
            F.get("xs", F.lit(0))["copies"]),
    })
    clusters = clusters.withColumns({
        "__last": F.when(several_rows, F.filter("xs", lambda x: x["filed"] == c("__filed"))),
        "__top": F.when(several_rows, F.filter("xs", lambda x: x["auth"] == c("__auth"))),
    })
    clusters = clusters.withColumns({
        # the remainder wins only when nothing else in the cluster was filed as late
        "__remainder": F.filter("__last", lambda x: (x["method"] == REMAINDER) & (F.size("__last") == 1)),
        "__rivals": F.filter("__top", lambda x: ~F.exists("__top", lambda y: (y["provider"] == x["provider"]) & (y["filed"] > x["filed"]))),
    })
    values = F.transform("__rivals", lambda x: x["value"])
    several = F.size(F.array_distinct(F.transform("__rivals", lambda x: x["provider"]))) > 1
    clusters = clusters.withColumns({
        "__settled": F.when(several_rows, several & F.exists("__rivals", lambda x: x["restated"])),
        "__differ": F.when(several_rows, ~F.coalesce(N.close_enough(F.array_max(values), F.array_min(values), 0.001), F.lit(True))),
    })
    order = lambda x: F.struct((c("__settled") & x["restated"]).alias("a"), F.when(x["restated"], x["filed"]).alias("b"), x["rank"].alias("c"),
                               x["filed"].alias("d"), x["value"].alias("e"), x["source_id"].alias("f"), x.alias("row"))
    best = F.array(F.array_max(F.transform("__rivals", order))["row"])
    clash = F.coalesce((F.size("__remainder") == 0) & c("__differ") & ~c("__settled"), F.lit(False))
    reason = F.when(several_rows & ((F.size("__remainder") > 0) | c("__settled")), "LATEST_AUTHORITATIVE_RESTATEMENT").when(
        c("__copies") > 1, "PREFERRED_SOURCE").otherwise("ONLY_SOURCE")
    kept = clusters.select(
        *series, "__cluster", clash.alias("__clash"), (c("__copies") - 1).alias("alternatives"), reason.alias("selection_reason"),
        F.array_min(F.transform("xs", lambda x: x["start_date"])).alias("__key_start"),
        F.explode(F.when(~several_rows, c("xs")).when(F.size("__remainder") > 0, c("__remainder")).when(clash, c("__rivals")).otherwise(best)).alias("r"))
    conflict = F.when(c("__clash"), "VALUE_CONFLICT").when(c("r.split"), "PERIOD_IDENTITY_CONFLICT")
    key = F.concat_ws(":", "ticker", "op_scope", "period_type", c("__key_start").cast("string"), "__cluster")
    fields = {x: c(x) if x in series else c(f"r.{x}") for x in columns}
    fields["dedup_status"] = F.coalesce("r.dedup_status", F.when(conflict.isNotNull(), "REQUIRES_REVIEW"))
    fields["conflict"] = F.coalesce("r.conflict", conflict)
    return kept.select(*[column.alias(x) for x, column in fields.items()], key.alias("economic_period_key"), "alternatives", "selection_reason")


def dedupe_provider_quarters(rows: DataFrame) -> DataFrame:
    """Provider form of the same idea: fiscal label first, then ends within 7 days; provider priority decides."""
    c = F.col
    priority = _lookup(c("provider"), PROVIDER_RANK, 100) + F.when(c("filed").isNotNull(), 20).otherwise(10)
    label = F.when(c("fiscal_year").isNotNull() & c("fiscal_quarter").isNotNull(),
                   F.concat_ws(":", c("fiscal_year").cast("string"), c("fiscal_quarter").cast("string")))
    keys = ["ticker", "metric", "__label"]
    ranked = rows.withColumn("__label", F.coalesce(label, c("end_date").cast("string")))
    best = ranked.groupBy(keys).agg(
        F.max(F.struct(priority.alias("p"), "filed", "source_id", "value", "provider", "start_date", "end_date", "fiscal_year", "fiscal_quarter",
                       "currency", "unit", "scope", "period_type")).alias("r"), F.count("*").alias("sources"))
    return best.select("ticker", "metric", F.concat_ws(":", "ticker", "__label").alias("economic_quarter_id"), "sources", *[
        F.col(f"r.{x}").alias(x) for x in ("source_id", "value", "provider", "filed", "start_date", "end_date", "fiscal_year", "fiscal_quarter", "currency", "unit",
                                             "scope", "period_type")])


def cumulative_to_quarters(facts: DataFrame) -> DataFrame:
    """Legacy chain: a direct quarter wins; else each cumulative period minus the one before it in its cohort.

    A cohort is a run of starts at most 7 days apart. One row per series and end is kept before any window.
    """
    c = F.col
    series = ["ticker", "metric", "currency"]
    days = F.datediff("end_date", "start_date") + 1
    typed = facts.where(N.finite(c("value"))).withColumn("days", days)
    once = typed.groupBy(*series, "start_date", "end_date", "days").agg(F.max(F.struct("filed", "value"))["value"].alias("value"))
    by_start = Window.partitionBy(*series).orderBy("start_date", "end_date")
    fresh = F.coalesce(F.datediff("start_date", F.lag("start_date").over(by_start)) > 7, F.lit(True)).cast("int")
    rows = once.withColumn("__new", fresh).withColumn("__cohort", F.sum("__new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    chain = Window.partitionBy(*series, "__cohort").orderBy("end_date", "start_date")
    rows = rows.withColumns({"__prior_end": F.lag("end_date").over(chain), "__prior": F.lag("value").over(chain)})
    direct = c("days") <= 130
    start = F.when(direct, c("start_date")).otherwise(F.date_add("__prior_end", 1))
    value = F.when(direct, c("value")).otherwise(c("value") - c("__prior"))
    rows = rows.select(*series, start.alias("start_date"), "end_date", value.alias("value"), direct.alias("__direct"),
                       F.when(direct, "reported-quarter").otherwise("normalized-cumulative-ytd").alias("derivation"))
    length = F.datediff("end_date", "start_date") + 1
    fits = rows.where(c("value").isNotNull() & (c("__direct") | length.between(45, 130)))
    best = fits.groupBy(*series, "end_date").agg(F.max(F.struct("__direct", "start_date", "value", "derivation")).alias("r"))
    return best.select(*series, "r.start_date", "end_date", "r.value", "r.derivation")


def derive_standalone_quarters(obs: DataFrame | None, resolved: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Q2 = 6M - Q1, Q3 = 9M - 6M, Q4 = year - 9M: (observations, failures).

    ``resolved`` takes observations that are deduplicated already, so a pipeline need not do it twice.

    Each cohort is one aggregated row of at most a few resolved periods per role; the three steps are unfolded
    from it, and a step that cannot be taken becomes a failure row.
    """
    c = F.col
    resolved = dedupe_economic_periods(obs) if resolved is None else resolved
    cohort = [*SERIES, "fiscal_year"]
    fields = ["source_id", "value", "start_date", "end_date", "authority", "calendar_id", "filed", "accession", "form", "scope", "restated",
              "dedup_status", "conflict", "provider"]
    item = F.struct(*fields)
    kind = c("period_type")

    def role(name, condition):
        return F.collect_list(F.when(condition, item)).alias(name)

    grouped = resolved.where(c("fiscal_year").isNotNull()).groupBy(cohort).agg(
        role("q1", (kind == "STANDALONE_QUARTER") & (c("fiscal_quarter") == 1)), role("six", kind == "YTD_6M"),
        role("nine", kind == "YTD_9M"), role("years", kind == "FISCAL_YEAR"))

    def clean(name):
        """(observation, reason) of a role: one clean row, or why not."""
        items = c(name)
        review = F.filter(items, lambda x: x["dedup_status"] == "REQUIRES_REVIEW")
        reason = F.when(F.size(review) > 0, F.coalesce(F.get(review, F.lit(0))["conflict"], F.lit("UNRESOLVED_SOURCE_PERIOD_CONFLICT"))).when(
            F.size(items) > 1, "AMBIGUOUS_CUMULATIVE_SOURCE_PERIOD")
        return F.when(reason.isNull() & (F.size(items) == 1), F.get(items, F.lit(0))), reason

    def resolve(df, name):
        obs_column, reason_column = clean(name)
        return df.withColumns({f"{name}_reason": reason_column}).withColumn(f"{name}_obs", obs_column)

    for name in ("q1", "six", "nine"):
        grouped = resolve(grouped, name)
    fits = lambda y: (y["start_date"] == c("nine_obs")["start_date"]) & F.datediff(y["end_date"], c("nine_obs")["end_date"]).between(75, 110)
    grouped = resolve(grouped.withColumn("year", F.when(c("nine_obs").isNotNull(), F.filter("years", fits)).otherwise(c("years"))), "year")
    steps = [("six", "q1", 2, "YTD_6M_MINUS_Q1"), ("nine", "six", 3, "YTD_9M_MINUS_YTD_6M"), ("year", "nine", 4, REMAINDER)]
    unfolded = F.array(*[F.struct(
        F.lit(q).alias("quarter"), F.lit(method).alias("step"), c(f"{cur}_obs").alias("cur"), c(f"{pri}_obs").alias("pri"),
        F.coalesce(f"{cur}_reason", f"{pri}_reason").alias("blocked")) for cur, pri, q, method in steps])
    sources = F.array(*[F.struct(F.lit(name).alias("role"), c(f"{name}_reason").alias("reason")) for name in ("q1", "six", "nine", "year")])
    taken = grouped.select(*cohort, F.inline(unfolded))
    cur, pri = c("cur"), c("pri")
    authoritative = cur["authority"].isin(D.AUTHORITATIVE) & pri["authority"].isin(D.AUTHORITATIVE)
    calendars = cur["calendar_id"].isNull() | pri["calendar_id"].isNull() | (cur["calendar_id"] == pri["calendar_id"])
    cohort_ok = F.coalesce(cur["start_date"] == pri["start_date"], F.lit(False)) & (authoritative | calendars)
    length = F.datediff(cur["end_date"], pri["end_date"])
    both = cur.isNotNull() & pri.isNotNull()
    reason = (
        F.when(~both, c("blocked")).when(~cohort_ok, "INCOMPATIBLE_FISCAL_COHORT").when(length <= 0, "INVALID_DERIVED_PERIOD_ORDER")
        .when(~length.between(45, 130), "INVALID_DERIVED_QUARTER_DURATION"))
    taken = once(taken, {"reason": reason})
    derived = taken.where(both & c("reason").isNull()).select(
        F.concat_ws("|", cur["source_id"], F.lit("MINUS"), pri["source_id"]).alias("source_id"), "ticker", "metric",
        F.lit("STANDALONE_QUARTER").alias("period_type"), F.date_add(pri["end_date"], 1).alias("start_date"), cur["end_date"].alias("end_date"),
        F.when(authoritative, "DERIVED_FROM_REPORTED_BOUNDARIES").otherwise("UNKNOWN").alias("authority"), "fiscal_year",
        c("quarter").alias("fiscal_quarter"), cur["calendar_id"].alias("calendar_id"), (cur["value"] - pri["value"]).alias("value"), "currency", "unit",
        F.lit("DERIVED").alias("provider"), cur["filed"].alias("filed"), cur["accession"].alias("accession"), cur["form"].alias("form"), "scope", "op_scope",
        F.lit("DERIVED").alias("basis"), c("step").alias("method"), "definition", cur["restated"].alias("restated"))
    failures = taken.where("reason IS NOT NULL").select(*cohort, c("step").alias("method"), c("quarter").alias("fiscal_quarter"), "reason").unionByName(
        grouped.select(*cohort, F.inline(sources)).where("reason IS NOT NULL").select(
            *cohort, F.lit("RESOLVE_CUMULATIVE_SOURCE").alias("method"), F.when(c("role") == "q1", 1).alias("fiscal_quarter"), "reason"))
    derived = derived.withColumns({"dedup_status": F.lit(None).cast("string"), "conflict": F.lit(None).cast("string")})
    direct = resolved.where("period_type = 'STANDALONE_QUARTER'").select(derived.columns)
    return dedupe_economic_periods(direct.unionByName(derived)), failures


def consecutive(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """b follows a: by bounds when both are authoritative, else by fiscal index, else by sequence."""
    bounded = D.has_authoritative_bounds(a["start"], a["end"], a["authority"]) & D.has_authoritative_bounds(b["start"], b["end"], b["authority"])
    calendars = a["calendar"].isNull() | b["calendar"].isNull() | (a["calendar"] == b["calendar"])
    fiscal = a["year"].isNotNull() & b["year"].isNotNull() & a["quarter"].isNotNull() & b["quarter"].isNotNull() & calendars
    return F.when(bounded, F.datediff(b["start"], a["end"]) == 1).when(
        fiscal, b["year"] * 4 + b["quarter"] == a["year"] * 4 + a["quarter"] + 1).otherwise(F.lit(False))


def follows_previous(window) -> Column:
    """Whether a row follows the row before it in the window; true for the first row."""
    here = {"start": F.col("start_date"), "end": F.col("end_date"), "authority": F.col("authority"), "calendar": F.col("calendar_id"),
            "year": F.col("fiscal_year"), "quarter": F.col("fiscal_quarter")}
    before = {key: F.lag(column).over(window) for key, column in here.items()}
    return F.lag("end_date").over(window).isNull() | consecutive(before, here)


def allocate_to_years(periods: DataFrame, years: list[int]) -> DataFrame:
    """Pro-rata share of each period in each calendar year it touches."""
    c = F.col
    usable = periods.where(N.finite(c("value")) & (c("start_date") <= c("end_date")))
    touched = F.filter(F.array(*[F.lit(y) for y in years]), lambda y: (y >= F.year("start_date")) & (y <= F.year("end_date")))
    spread = usable.withColumn("year", F.explode(touched))
    first, last = F.make_date(c("year"), F.lit(1), F.lit(1)), F.make_date(c("year"), F.lit(12), F.lit(31))
    total = F.datediff("end_date", "start_date") + 1
    overlap = D.overlap_days(c("start_date"), c("end_date"), first, last)
    return spread.withColumns({"overlap_days": overlap, "total_days": total, "contribution": c("value") * (overlap / total)}).withColumn(
        "clipped", c("overlap_days") != c("total_days"))


def coverage(intervals: DataFrame, years: list[int]) -> DataFrame:
    """Days covered per series and year, gap and overlap counts, and whether each day is covered once."""
    c = F.col
    parts = allocate_to_years(intervals.withColumn("value", F.coalesce(c("value"), F.lit(0.0))), years)
    first, last = F.make_date(c("year"), F.lit(1), F.lit(1)), F.make_date(c("year"), F.lit(12), F.lit(31))
    parts = parts.withColumns({"lo": F.greatest("start_date", first), "hi": F.least("end_date", last)})
    key = ["ticker", "metric", "year"]
    before = Window.partitionBy(*key).orderBy("lo", "hi", "source_id").rowsBetween(Window.unboundedPreceding, -1)
    cursor = F.coalesce(F.date_add(F.max("hi").over(before), 1), first)
    marked = parts.withColumns({"gap": F.greatest(F.datediff("lo", cursor), F.lit(0)), "over": c("lo") < cursor})
    total = F.datediff(F.make_date(c("year"), F.lit(12), F.lit(31)), F.make_date(c("year"), F.lit(1), F.lit(1))) + 1
    out = marked.groupBy(*key).agg(
        F.count("*").alias("intervals"), F.sum("overlap_days").alias("covered_days"), F.count_if(c("over")).alias("overlaps"),
        F.count_if(c("gap") > 0).alias("inner_gaps"), F.max("hi").alias("__last"))
    end_gap = (c("__last") < F.make_date(c("year"), F.lit(12), F.lit(31))).cast("bigint")
    return out.select(*key, "intervals", "covered_days", "overlaps", (c("inner_gaps") + end_gap).alias("gaps"), (
        (c("overlaps") == 0) & (c("covered_days") == total)).alias("complete"))


def bridge_kind(period_type: Column, days: Column) -> Column:
    return F.when(period_type.isin("YTD_6M", "YTD_9M"), period_type).when(
        (period_type == "STANDALONE_QUARTER") & days.between(75, 110), "YTD_3M")


# Derivations that keep an annual value exact.
EXACT_METHODS = ["REVENUE_MINUS_COST_OF_REVENUE", "CFO_MINUS_CAPEX", "ADDITIVE_NON_OVERLAPPING_CASH_CAPEX_COMPONENTS"]


def exact_derived(inputs: Column, row: dict[str, Column]) -> Column:
    """A derived row is exact when every one of at least two inputs has its series, bounds and clean dates."""
    equal = lambda x: ((x["ticker"] == row["ticker"]) & (x["scope"] == row["scope"]) & (x["op_scope"] == row["op_scope"])
                       & (x["currency"] == row["currency"]) & (x["unit"] == row["unit"]) & (x["start_date"] == row["start_date"])
                       & (x["end_date"] == row["end_date"]) & x["authority"].isin(D.AUTHORITATIVE)
                       & ~F.coalesce(x["dedup_status"] == "REQUIRES_REVIEW", F.lit(False)))
    return (row["basis"] == "DERIVED") & row["method"].isin(EXACT_METHODS) & (F.size(inputs) >= 2) & F.forall(inputs, equal)

