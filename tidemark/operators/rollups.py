"""Calendar years and trailing twelve months from deduplicated observations.

Inputs have passed ``dedupe_economic_periods``; a ticker and metric then hold rows bounded by the calendar, so
self joins on dates and short ordered windows stay small whatever the size of an issuer. Every result row
carries a status and a reason, and a value only when the evidence supports it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import numbers as N
from tidemark.operators import periods as P
from tidemark.operators.keyed import top_n_per_key

KEY = ["ticker", "metric"]
ANNUAL = ["FISCAL_YEAR", "CALENDAR_YEAR"]


def _authoritative() -> Column:
    return D.has_authoritative_bounds(F.col("start_date"), F.col("end_date"), F.col("authority"))


def _days() -> Column:
    return F.datediff("end_date", "start_date") + 1


def series_compatible(rows: DataFrame, group: list[str]) -> DataFrame:
    """Whether the rows of a group share issuer, metric, scopes, currency and unit, and name one definition at most."""
    one = lambda name: F.min(name).eqNullSafe(F.max(name)) & ((F.count(name) == F.count("*")) | (F.count(name) == 0))
    same = one("scope") & one("op_scope") & one("currency") & one("unit")
    return rows.groupBy(*group).agg(
        same.alias("same_series"), F.coalesce(F.min("definition") == F.max("definition"), F.lit(True)).alias("same_definition"))


def _review(name: str = "dedup_status") -> Column:
    return F.coalesce(F.col(name) == "REQUIRES_REVIEW", F.lit(False))


def _checks() -> list[Column]:
    """Aggregates over the rows chosen for one result."""
    one = lambda name: F.min(name).eqNullSafe(F.max(name))
    return [
        F.count("*").alias("n"), F.sum("value").alias("total"), F.min("start_date").alias("start"), F.max("end_date").alias("end"),
        (one("scope") & one("op_scope") & one("currency") & one("unit")).alias("same_series"), F.bool_and(F.col("scope") == "CONSOLIDATED").alias("whole"),
        F.bool_or(F.col("review")).alias("review"), F.max("conflict").alias("conflict"),
        F.coalesce(F.min("definition") == F.max("definition"), F.lit(True)).alias("same_definition"),
    ]


def _quarter_groups(quarters: DataFrame, as_of: str) -> DataFrame:
    """One row per economic quarter known by the date; a quarter with any row under review is under review."""
    known = quarters.where((F.col("period_type") == "STANDALONE_QUARTER") & (F.col("end_date") <= F.to_date(F.lit(as_of))))
    rest = ["source_id", "value", "scope", "op_scope", "currency", "unit", "definition", "start_date", "end_date", "authority", "calendar_id",
            "fiscal_year", "fiscal_quarter"]
    grouped = known.groupBy(*KEY, "economic_period_key").agg(
        F.min(F.struct("source_id", *[x for x in rest if x != "source_id"])).alias("r"), F.bool_or(_review()).alias("review"),
        F.max("conflict").alias("conflict"))
    return grouped.select(*KEY, "economic_period_key", "review", "conflict", *[F.col(f"r.{x}").alias(x) for x in rest])


def ltm_four_quarters(quarters: DataFrame, as_of: str, reported: DataFrame | None = None) -> DataFrame:
    """Sum of the latest four consecutive compatible quarters.

    With a latest reported period per ticker and metric, the four quarters are those that end within 10 days of
    the reported end and the three quarter ends before it.
    """
    c = F.col
    groups = _quarter_groups(quarters, as_of)
    last_four = top_n_per_key(groups, KEY, [F.desc("end_date"), F.desc("economic_period_key")], 4)
    order = Window.partitionBy(*KEY).orderBy("end_date", "economic_period_key")

    def summarize(rows):
        marked = rows.withColumn("__follows", P.follows_previous(order))
        return marked.groupBy(*KEY).agg(*_checks(), F.bool_and("__follows").alias("contiguous"))

    latest = summarize(last_four)
    if reported is None:
        chosen = latest.withColumn("reported_end", F.lit(None).cast("date")).withColumn("stale", F.lit(False))
    else:
        ends = F.array(*[F.struct(F.lit(i).alias("back"), D.shift_quarter_end(c("reported_end"), i).alias("target")) for i in range(4)])
        wanted = reported.select(*KEY, F.col("period_end").alias("reported_end"))
        targets = wanted.select(*KEY, "reported_end", F.inline(ends))
        near = groups.join(targets, KEY).where(F.abs(F.datediff("end_date", "target")) <= 10)
        picked = top_n_per_key(near, [*KEY, "back"], [c("end_date"), c("economic_period_key")]).drop("back", "target", "reported_end")
        stale = latest.where("n = 4 AND same_series AND same_definition AND contiguous").select(*KEY, c("end").alias("__latest"))
        found = summarize(picked)
        unreported = latest.join(wanted.select(*KEY), KEY, "left_anti")
        named = latest.select(*KEY).join(wanted, KEY)
        chosen = named.join(found, KEY, "left").join(stale, KEY, "left").withColumn(
            "stale", F.coalesce(c("__latest") < c("reported_end"), F.lit(False))).drop("__latest").unionByName(
            unreported.withColumns({"reported_end": F.lit(None).cast("date"), "stale": F.lit(False)}))
    n = F.coalesce(c("n"), F.lit(0))
    reason = (
        F.when(c("stale"), "LATEST_REPORTED_PERIOD_NOT_INGESTED").when(n != 4, "FOUR_CONSECUTIVE_QUARTERS_UNAVAILABLE")
        .when(~c("same_series"), "INCOMPATIBLE_SERIES").when(~c("whole"), "NON_CONSOLIDATED_SCOPE")
        .when(c("review"), F.coalesce("conflict", F.lit("DEDUPLICATION_CONFLICT"))).when(~c("same_definition"), "DEFINITION_INCOMPATIBLE")
        .when(~c("contiguous"), "LTM_PERIOD_GAP").when(c("end") < c("reported_end"), "LATEST_REPORTED_PERIOD_NOT_INGESTED"))
    status = (
        F.when(c("reason").isNull(), "VERIFIED_DERIVED").when(c("reason") == "LATEST_REPORTED_PERIOD_NOT_INGESTED", "STALE_SOURCE_COVERAGE")
        .when(c("reason").isin("FOUR_CONSECUTIVE_QUARTERS_UNAVAILABLE", "LTM_PERIOD_GAP"), "INSUFFICIENT_PERIOD_COVERAGE")
        .when(c("reason") == "DEFINITION_INCOMPATIBLE", "DEFINITION_INCOMPATIBLE").otherwise("REQUIRES_REVIEW"))
    out = chosen.withColumn("reason", reason).withColumn("status", status)
    ok = c("reason").isNull()
    return out.select(*KEY, F.when(ok, c("total")).alias("value"), "status", "reason", F.when(ok, c("start")).alias("ltm_start"),
                      F.when(ok, c("end")).alias("ltm_end"))


def ltm_simple(quarters: DataFrame) -> DataFrame:
    """Latest four quarters by end; value only when they follow each other to the day."""
    latest = top_n_per_key(quarters.where(N.finite(F.col("value"))), KEY, [F.desc("end_date")], 4)
    order = Window.partitionBy(*KEY).orderBy("end_date")
    step = F.coalesce(F.datediff("start_date", F.lag("end_date").over(order)) == 1, F.lag("end_date").over(order).isNull())
    sums = latest.withColumn("__step", step).groupBy(*KEY).agg(
        F.sum("value").alias("total"), ((F.count("*") == 4) & F.bool_and("__step")).alias("ok"), F.max("end_date").alias("ltm_end"))
    return sums.select(*KEY, F.when(F.col("ok"), F.col("total")).alias("value"), "ltm_end", F.when(F.col("ok"), "VERIFIED_DERIVED").otherwise(
        "MISSING_BUT_AVAILABLE").alias("status"))


def _structural(rows: DataFrame, group: list[str]) -> DataFrame:
    """Sum of a group of provider quarters with the list of rules it breaks."""
    c = F.col
    order = Window.partitionBy(*group).orderBy("end_date")
    prior = {x: F.lag(x).over(order) for x in ("end_date", "fiscal_year", "fiscal_quarter")}
    fiscal = (c("fiscal_year") * 4 + c("fiscal_quarter")) - (prior["fiscal_year"] * 4 + prior["fiscal_quarter"]) == 1
    by_end = F.datediff("end_date", prior["end_date"]).between(70, 120)
    marked = rows.withColumn("__step", prior["end_date"].isNull() | F.coalesce(fiscal, F.lit(False)) | F.coalesce(by_end, F.lit(False)))
    sums = marked.groupBy(*group).agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.count_distinct("economic_quarter_id").alias("ids"),
        F.bool_and(c("period_type") == "STANDALONE_QUARTER").alias("standalone"), F.bool_and(c("scope") == "CONSOLIDATED").alias("whole"),
        F.count_distinct("currency").alias("currencies"), F.count_distinct("unit").alias("units"), F.bool_and("__step").alias("steps"),
        F.count("source_id").alias("sources"), F.max("end_date").alias("last_end"))
    rules = [
        (c("n") != 4, "UNIQUE_QUARTER_COUNT_NOT_FOUR"), (c("ids") != c("n"), "DUPLICATE_ECONOMIC_QUARTER"),
        (~c("standalone"), "NON_STANDALONE_OR_UNKNOWN_PERIOD"), (~c("whole"), "REPORTING_SCOPE_NOT_COMPARABLE"),
        (c("currencies") != 1, "INCONSISTENT_OR_UNKNOWN_CURRENCY"), (c("units") != 1, "INCONSISTENT_OR_UNKNOWN_NORMALIZED_UNITS"),
        (c("sources") != c("n"), "MISSING_SOURCE_PROVENANCE"), (~c("steps"), "NON_CONSECUTIVE_ECONOMIC_QUARTERS")]
    failures = F.array_compact(F.array(*[F.when(condition, name) for condition, name in rules]))
    out = sums.withColumn("failures", failures)
    return out.select(*group, F.when(F.size("failures") == 0, c("total")).alias("value"), "failures", "last_end")


def ltm_provider(quarters: DataFrame, as_of: str) -> DataFrame:
    known = quarters.where((F.col("end_date") <= F.to_date(F.lit(as_of))) & (F.col("period_type") == "STANDALONE_QUARTER"))
    return _structural(top_n_per_key(known, KEY, [F.desc("end_date")], 4), KEY)


def calendar_year_by_quarter_end(quarters: DataFrame) -> DataFrame:
    """Calendar year from exactly four quarters that end in it."""
    return _structural(quarters.withColumn("year", F.year("end_date")), [*KEY, "year"])


def ltm_direct_annual(obs: DataFrame, as_of: str, reported: DataFrame | None = None) -> DataFrame:
    """The latest full year, when nothing newer has been observed."""
    c = F.col
    known = obs.where(c("end_date") <= F.to_date(F.lit(as_of)))
    exact = (c("basis") == "DERIVED") & c("exact") if "exact" in obs.columns else F.lit(False)
    full = known.where(c("period_type").isin(ANNUAL) & _authoritative() & _days().between(350, 378) & ((c("basis") == "REPORTED") | exact))
    newest = known.groupBy(*KEY).agg(F.max("end_date").alias("__newest"))
    ends = full.groupBy(*KEY).agg(F.max("end_date").alias("end"))
    at_end = full.join(ends, KEY).where("end_date = end").groupBy(*KEY, "end").agg(
        F.count("*").alias("n"), F.max("value").alias("v"), F.bool_and(c("scope") == "CONSOLIDATED").alias("whole"), F.bool_or(_review()).alias("review"),
        F.max("conflict").alias("conflict"), F.min("start_date").alias("start"), F.max("basis").alias("basis"))
    joined = newest.join(at_end, KEY, "left")
    if reported is not None:
        joined = joined.join(reported.select(*KEY, c("period_end").alias("__reported")), KEY, "left")
        stale = F.coalesce(c("end") < c("__reported"), F.lit(False))
    else:
        stale = F.lit(False)
    reason = (
        F.when(c("end").isNull(), "LATEST_VERIFIED_FULL_YEAR_UNAVAILABLE").when(c("end") < c("__newest"), "LATEST_FULL_YEAR_PRECEDES_LATEST_OBSERVATION")
        .when(stale, "LATEST_REPORTED_PERIOD_NOT_INGESTED").when(c("n") != 1, "DUPLICATE_LATEST_FULL_YEAR").when(~c("whole"), "NON_CONSOLIDATED_SCOPE")
        .when(c("review"), F.coalesce("conflict", F.lit("DEDUPLICATION_CONFLICT"))))
    ok = c("reason").isNull()
    return joined.withColumn("reason", reason).select(
        *KEY, F.when(ok, c("v")).alias("value"), "reason", F.when(ok, c("start")).alias("ltm_start"), F.when(ok, c("end")).alias("ltm_end"),
        F.when(ok, F.when(c("basis") == "REPORTED", "VERIFIED_REPORTED").otherwise("VERIFIED_DERIVED")).alias("status"))


def prior_year_match(obs: DataFrame) -> DataFrame:
    """Pairs of comparable periods: equal kind, both bounds on the same month and day one year apart."""
    c = F.col
    kinds = obs.withColumn("kind", P.bridge_kind(c("period_type"), _days())).where(c("kind").isNotNull() & _authoritative() & c("value").isNotNull())
    marks = lambda prefix, shift: [
        (F.year("start_date") + shift).alias(f"{prefix}sy"), F.date_format("start_date", "MM-dd").alias(f"{prefix}sd"),
        (F.year("end_date") + shift).alias(f"{prefix}ey"), F.date_format("end_date", "MM-dd").alias(f"{prefix}ed")]
    fields = ["source_id", "value", "start_date", "end_date", "scope", "op_scope", "currency", "unit", "definition", "dedup_status", "conflict"]
    current = kinds.select(*KEY, "kind", F.struct(*fields).alias("cur"), *marks("m_", 0))
    prior = kinds.select(*KEY, "kind", F.struct(*fields).alias("pri"), *marks("m_", 1))
    pairs = current.join(prior, [*KEY, "kind", "m_sy", "m_sd", "m_ey", "m_ed"])
    length = lambda x: F.datediff(x["end_date"], x["start_date"])
    return pairs.where(F.abs(length(c("cur")) - length(c("pri"))) <= 1).drop("m_sy", "m_sd", "m_ey", "m_ed")


def fy_ytd_bridge(obs: DataFrame, as_of: str | None = None, reported: DataFrame | None = None) -> DataFrame:
    """Full year + current period - comparable prior period: every candidate with status and reason."""
    c = F.col
    known = obs if as_of is None else obs.where(c("end_date") <= F.to_date(F.lit(as_of)))
    pairs = prior_year_match(known).withColumns({"__start": c("pri.start_date"), "__end": F.date_sub(c("cur.start_date"), 1)})
    fields = ["source_id", "value", "start_date", "end_date", "scope", "op_scope", "currency", "unit", "definition", "dedup_status", "conflict"]
    years = known.where(c("period_type").isin(ANNUAL) & _authoritative() & c("value").isNotNull()).select(
        *KEY, c("start_date").alias("__start"), c("end_date").alias("__end"), F.struct(*fields).alias("fy"))
    rows = pairs.join(years, [*KEY, "__start", "__end"]).drop("__start", "__end")
    if reported is not None:
        rows = rows.join(reported.select(*KEY, c("period_end").alias("__reported")), KEY, "left")
        stale = F.coalesce(c("cur.end_date") < c("__reported"), F.lit(False))
    else:
        stale = F.lit(False)
    three = [c("fy"), c("cur"), c("pri")]
    any_ = lambda test: test(three[0]) | test(three[1]) | test(three[2])
    equal = lambda name: three[0][name].eqNullSafe(three[1][name]) & three[0][name].eqNullSafe(three[2][name])
    review = any_(lambda x: F.coalesce(x["dedup_status"] == "REQUIRES_REVIEW", F.lit(False)))
    defined = F.array_compact(F.array(*[x["definition"] for x in three]))
    reason = (
        F.when(review, F.coalesce(*[x["conflict"] for x in three], F.lit("DEDUPLICATION_CONFLICT")))
        .when(any_(lambda x: x["scope"] != "CONSOLIDATED"), "NON_CONSOLIDATED_SCOPE").when(~equal("op_scope"), "OPERATION_SCOPE_INCOMPATIBLE")
        .when(~(equal("currency") & equal("unit")), "INCOMPATIBLE_SERIES").when(F.size(F.array_distinct(defined)) > 1, "DEFINITION_INCOMPATIBLE")
        .when(stale, "LATEST_REPORTED_PERIOD_NOT_INGESTED"))
    out = rows.withColumn("reason", reason)
    status = (
        F.when(c("reason").isNull(), "VERIFIED_DERIVED").when(c("reason").isin("OPERATION_SCOPE_INCOMPATIBLE", "DEFINITION_INCOMPATIBLE"), c("reason"))
        .when(c("reason") == "LATEST_REPORTED_PERIOD_NOT_INGESTED", "STALE_SOURCE_COVERAGE").otherwise("REQUIRES_REVIEW"))
    value = c("fy.value") + c("cur.value") - c("pri.value")
    return out.select(*KEY, "kind", F.when(c("reason").isNull(), value).alias("value"), status.alias("status"), "reason",
                      F.date_add(c("pri.end_date"), 1).alias("ltm_start"), c("cur.end_date").alias("ltm_end"), c("cur.source_id").alias("current_id"),
                      c("pri.source_id").alias("prior_id"), c("fy.source_id").alias("year_id"))


# Which blocked bridge explains a missing value first.
FAILURE_ORDER = ["DEFINITION_INCOMPATIBLE", "OPERATION_SCOPE_INCOMPATIBLE", "REQUIRES_REVIEW", "STALE_SOURCE_COVERAGE"]


def best_bridge(bridges: DataFrame, group: list[str]) -> DataFrame:
    """Newest valid bridge of a group, else its most telling failure."""
    rank = F.array_position(F.array(*[F.lit(x) for x in FAILURE_ORDER]), F.col("status"))
    order = [F.col("reason").isNotNull(), F.when(F.col("reason").isNotNull(), rank), F.desc("ltm_end"), F.col("current_id"), F.col("year_id")]
    return top_n_per_key(bridges, group, order)


def ltm_resolve(obs: DataFrame, quarters: DataFrame, as_of: str, reported: DataFrame | None = None) -> DataFrame:
    """One trailing-twelve-months result per ticker and metric from the three constructions."""
    c = F.col
    direct = ltm_direct_annual(obs, as_of, reported)
    four = ltm_four_quarters(quarters, as_of, reported)
    bridge = best_bridge(fy_ytd_bridge(obs, as_of, reported), KEY)
    pack = lambda df, name: df.select(*KEY, F.struct("value", "status", "reason", "ltm_start", "ltm_end").alias(name))
    keys = obs.select(*KEY).distinct()
    rows = keys.join(pack(direct, "d"), KEY, "left").join(pack(four, "q"), KEY, "left").join(pack(bridge, "b"), KEY, "left")
    none = lambda status, reason: F.struct(
        F.lit(None).cast("double").alias("value"), F.lit(status).alias("status"), F.lit(reason).alias("reason"), F.lit(None).cast("date").alias("ltm_start"),
        F.lit(None).cast("date").alias("ltm_end"))
    rows = rows.withColumns({
        "q": F.coalesce("q", none("MISSING_SOURCE_DATA", "FOUR_CONSECUTIVE_QUARTERS_UNAVAILABLE")),
        "b": F.when(c("b").isNull(), none("INSUFFICIENT_PERIOD_COVERAGE", "FY_CURRENT_YTD_PRIOR_YTD_BRIDGE_UNAVAILABLE")).otherwise(
            F.struct("b.value", "b.status", "b.reason", "b.ltm_start", "b.ltm_end"))})
    has_q, has_b = c("q.value").isNotNull(), c("b.value").isNotNull()
    agree = F.abs(c("q.value") - c("b.value")) <= F.greatest(F.lit(1.0), F.abs("b.value") * 0.005)
    both = F.when(c("q.ltm_end") > c("b.ltm_end"), c("q")).when(c("q.ltm_end") < c("b.ltm_end"), c("b")).when(agree, c("q")).otherwise(
        none("REQUIRES_REVIEW", "LTM_CONSTRUCTION_MISMATCH"))
    hard = c("b.status").isin("DEFINITION_INCOMPATIBLE", "OPERATION_SCOPE_INCOMPATIBLE", "REQUIRES_REVIEW")
    neither = (
        F.when(hard, c("b")).when((c("q.status") == "MISSING_SOURCE_DATA") & (c("b.status") == "INSUFFICIENT_PERIOD_COVERAGE"), c("b"))
        .when(c("q.status") == "STALE_SOURCE_COVERAGE", c("q")).when(c("b.status") == "STALE_SOURCE_COVERAGE", c("b")).otherwise(c("q")))
    construction = (
        F.when(c("d.value").isNotNull(), "FULL_YEAR").when(has_q & (~has_b | (c("q.ltm_end") >= c("b.ltm_end"))), "FOUR_QUARTERS")
        .when(has_b, "FY_YTD_BRIDGE"))
    chosen = F.when(c("d.value").isNotNull(), F.struct("d.value", "d.status", "d.reason", "d.ltm_start", "d.ltm_end")).when(
        has_q & has_b, both).when(has_q, c("q")).when(has_b, c("b")).otherwise(neither)
    out = rows.select(*KEY, chosen.alias("r"), construction.alias("how"))
    return out.select(*KEY, "r.value", "r.status", "r.reason", "r.ltm_start", "r.ltm_end", F.when(c("r.value").isNotNull(), c("how")).alias("construction"))


def calendar_year(obs: DataFrame, quarters: DataFrame, years: list[int]) -> DataFrame:
    """Calendar-year value per ticker, metric and year with class, status and reason.

    Order: a reported calendar year, an exact derived one, a bridge that ends on 31 December, and quarters that
    cover every day of the year once.
    """
    c = F.col
    year_list = F.array(*[F.lit(y) for y in years])
    first, last = F.make_date(c("year"), F.lit(1), F.lit(1)), F.make_date(c("year"), F.lit(12), F.lit(31))
    full = obs.where(_authoritative() & c("period_type").isin(ANNUAL)).withColumn("year", F.explode(F.filter(
        year_list, lambda y: (y == F.year("end_date")) | (y == F.year("end_date") - 1))))
    exact_bounds = (c("start_date") == first) & (c("end_date") == last)
    close = _days().between(350, 378) & D.near_boundary(c("start_date"), first) & D.near_boundary(c("end_date"), last)
    fits = F.when(c("period_type") == "CALENDAR_YEAR", exact_bounds).otherwise(close)
    annual = full.where(fits)
    reported = annual.where((c("authority") == "REPORTED") & (c("basis") == "REPORTED"))
    derived = annual.where((c("basis") == "DERIVED") & c("exact") & ~_review()) if "exact" in obs.columns else annual.where(F.lit(False))
    group = [*KEY, "year"]

    def single(rows, name):
        return rows.groupBy(*group).agg(F.struct(
            F.count("*").alias("n"), F.max("value").alias("value"), F.bool_and(c("scope") == "CONSOLIDATED").alias("whole"),
            F.bool_or(_review()).alias("review"), F.max("conflict").alias("conflict")).alias(name))

    bridges = fy_ytd_bridge(obs.where(~_review())).withColumn("year", F.year("ltm_end"))
    bridges = bridges.where((c("ltm_end") == last) & (c("ltm_start") == first) & c("year").isin(years))
    bridge = best_bridge(bridges, group).select(*group, F.struct("value", "status", "reason").alias("b"))
    bounded = quarters.where((c("period_type") == "STANDALONE_QUARTER") & _authoritative())
    parts = P.allocate_to_years(bounded, years).withColumns({"lo": F.greatest("start_date", first), "hi": F.least("end_date", last), "review": _review()})
    before = Window.partitionBy(*group).orderBy("lo", "hi", "source_id").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__over", F.coalesce(c("lo") <= F.max("hi").over(before), F.lit(False)))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("lo", "source_id", "contribution"))), lambda x: x["contribution"])
    days = F.datediff(F.make_date(c("year"), F.lit(12), F.lit(31)), F.make_date(c("year"), F.lit(1), F.lit(1))) + 1
    cover = parts.groupBy(*group).agg(
        *_checks(), F.bool_or("__over").alias("overlap"), F.sum("overlap_days").alias("covered"), F.bool_or("clipped").alias("clipped"),
        (F.count_distinct("economic_period_key") == F.count("*")).alias("unique"),
        F.aggregate(ordered, F.lit(0.0), lambda total, x: total + x).alias("allocated"))
    cover = cover.withColumn("complete", ~c("overlap") & (c("covered") == days))
    exact = (c("q.n") == 4) & ~c("q.clipped")
    cells = obs.select(*KEY).distinct().withColumn("year", F.explode(year_list))
    rows = cells.join(single(reported, "d"), group, "left").join(single(derived, "e"), group, "left").join(bridge, group, "left").join(
        cover.select(*group, F.struct(*[x for x in cover.columns if x not in group]).alias("q")), group, "left")
    result = lambda value, klass, status, reason: F.struct(
        value.cast("double").alias("value"), F.lit(klass).alias("classification") if isinstance(klass, (str, type(None))) else klass.alias("classification"),
        (F.lit(status) if isinstance(status, str) else status).alias("status"),
        (F.lit(reason) if isinstance(reason, (str, type(None))) else reason).cast("string").alias("reason"))
    null = F.lit(None)
    fail = lambda status, reason: result(null, F.lit(None).cast("string"), status, reason)
    chosen = (
        F.when(c("d.n") > 1, fail("REQUIRES_REVIEW", "DUPLICATE_REPORTED_CALENDAR_YEAR"))
        .when(c("d.n").isNotNull() & ~c("d.whole"), fail("REQUIRES_REVIEW", "NON_CONSOLIDATED_SCOPE"))
        .when(c("d.review"), fail("REQUIRES_REVIEW", F.coalesce("d.conflict", F.lit("DEDUPLICATION_CONFLICT"))))
        .when(c("d.n") == 1, result(c("d.value"), F.lit("REPORTED_CALENDAR_YEAR"), "VERIFIED_REPORTED", F.lit(None)))
        .when(c("e.n") > 1, fail("REQUIRES_REVIEW", "DUPLICATE_EXACT_DERIVED_CALENDAR_YEAR"))
        .when(c("e.n").isNotNull() & ~c("e.whole"), fail("REQUIRES_REVIEW", "NON_CONSOLIDATED_SCOPE"))
        .when(c("e.n") == 1, result(c("e.value"), F.lit("EXACT_DERIVED_CALENDAR_YEAR"), "VERIFIED_DERIVED", F.lit(None)))
        .when(c("b.value").isNotNull(), result(c("b.value"), F.lit("EXACT_DERIVED_CALENDAR_YEAR"), "VERIFIED_DERIVED", F.lit(None)))
        .when(c("q.review"), fail("REQUIRES_REVIEW", F.coalesce("q.conflict", F.lit("DEDUPLICATION_CONFLICT"))))
        .when(c("q.overlap"), fail("REQUIRES_REVIEW", "OVERLAPPING_PERIOD_COVERAGE"))
        .when(~F.coalesce(c("q.complete"), F.lit(False)) & c("b.status").isNotNull(), fail(c("b.status"), c("b.reason")))
        .when(~F.coalesce(c("q.complete"), F.lit(False)), fail("INSUFFICIENT_PERIOD_COVERAGE", "INSUFFICIENT_PERIOD_COVERAGE"))
        .when(~c("q.same_series"), fail("REQUIRES_REVIEW", "INCOMPATIBLE_SERIES")).when(~c("q.whole"), fail("REQUIRES_REVIEW", "NON_CONSOLIDATED_SCOPE"))
        .when(~c("q.same_definition"), fail("DEFINITION_INCOMPATIBLE", "DEFINITION_INCOMPATIBLE"))
        .when(~c("q.unique"), fail("REQUIRES_REVIEW", "DUPLICATE_ECONOMIC_PERIOD_CONTRIBUTION"))
        .when(exact, result(c("q.total"), F.lit("EXACT_FROM_CALENDAR_QUARTERS"), "VERIFIED_DERIVED", F.lit(None)))
        .otherwise(result(c("q.allocated"), F.lit("CALENDARIZED_ESTIMATE"), "VERIFIED_DERIVED", F.lit(None))))
    return rows.select(*group, chosen.alias("r")).select(*group, "r.*")


def calendar_year_ledger(quarters: DataFrame, annuals: DataFrame, years: list[int]) -> DataFrame:
    """Legacy ledger year: four valid quarters ending in the year, else the exact calendar-year fact."""
    c = F.col
    group = [*KEY, "year"]
    sums = quarters.withColumn("year", F.year("end_date")).where(c("year").isin(years)).groupBy(*group).agg(
        F.count("*").alias("n"), F.count_distinct("end_date").alias("ends"), F.sum("value").alias("total"),
        F.bool_or(c("validation") == "FAILED").alias("invalid"))
    exact = annuals.where((F.date_format("start_date", "MM-dd") == "01-01") & (F.date_format("end_date", "MM-dd") == "12-31")
                          & (F.year("start_date") == F.year("end_date"))).groupBy(*KEY, F.year("end_date").alias("year")).agg(F.max("value").alias("annual"))
    rows = sums.join(exact.where(c("year").isin(years)), group, "full")
    covered = F.coalesce((c("n") == 4) & (c("ends") == 4) & ~c("invalid"), F.lit(False))
    value = F.when(covered, c("total")).otherwise(c("annual"))
    method = (
        F.when(covered, "CALENDAR_YEAR_DERIVED").when(c("annual").isNotNull(), "CALENDAR_YEAR_REPORTED")
        .when(c("invalid"), "SOURCE_OR_RECONCILIATION_REQUIRES_REVIEW").otherwise("PARTIAL_STANDALONE_QUARTER_COVERAGE"))
    return rows.select(*group, value.alias("value"), method.alias("method"))


def allocated_year_sum(periods: DataFrame, years: list[int]) -> DataFrame:
    """Pro-rata year totals; flagged derived when a part is clipped or already derived."""
    parts = P.allocate_to_years(periods, years)
    return parts.groupBy(*KEY, "year").agg(F.sum("contribution").alias("value"), F.bool_or("clipped").alias("derived"), F.count("*").alias("components"))


def annual_reconciliation(quarters: DataFrame, annuals: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Four contiguous quarters that fill a filed year, their sum, and whether it agrees with the filed value."""
    c = F.col
    year = annuals.select(*KEY, c("start_date").alias("__start"), c("end_date").alias("__end"), c("value").alias("annual"))
    inside = quarters.join(year, KEY).where((c("start_date") >= c("__start")) & (c("end_date") <= c("__end")))
    sums = inside.groupBy(*KEY, "__start", "__end", "annual").agg(
        F.count("*").alias("n"), F.min("start_date").alias("lo"), F.max("end_date").alias("hi"), F.sum("value").alias("quarter_sum"),
        F.sum(F.datediff("end_date", "start_date") + 1).alias("days"))
    filled = (c("n") == 4) & (c("lo") == c("__start")) & (c("hi") == c("__end")) & (c("days") == F.datediff("__end", "__start") + 1)
    return sums.where(filled).select(
        *KEY, c("__start").alias("start_date"), c("__end").alias("end_date"), "annual", "quarter_sum",
        N.close_enough(c("quarter_sum"), c("annual"), tolerance).alias("reconciles"))


def mark_reconciled(quarters: DataFrame, reconciliation: DataFrame) -> DataFrame:
    """Quarters of a year that does not reconcile are marked failed."""
    failed = reconciliation.where("NOT reconciles").select(*KEY, F.col("start_date").alias("__start"), F.col("end_date").alias("__end"))
    bad = quarters.join(failed, KEY).where("start_date >= __start AND end_date <= __end").select(*KEY, "start_date", "end_date").distinct()
    marked = quarters.join(bad.withColumn("__bad", F.lit(True)), [*KEY, "start_date", "end_date"], "left")
    return marked.withColumn("validation", F.when(F.col("__bad"), "FAILED").otherwise("VALID")).drop("__bad")


def rolling_four_quarters(quarters: DataFrame) -> DataFrame:
    """Every run of four quarters with its sum and the reason it cannot be used."""
    c = F.col
    order = Window.partitionBy(*KEY).orderBy("end_date")
    four = order.rowsBetween(-3, 0)
    step = F.coalesce(F.datediff("start_date", F.lag("end_date").over(order)) == 1, F.lit(False))
    rows = quarters.withColumn("__step", step)
    late = order.rowsBetween(-2, 0)
    rows = rows.select(
        *KEY, c("end_date").alias("ltm_end"), F.first("start_date").over(four).alias("ltm_start"), F.count("*").over(four).alias("n"),
        F.sum("value").over(four).alias("total"), F.min("__step").over(late).alias("contiguous"),
        (F.min("currency").over(four) == F.max("currency").over(four)).alias("one_currency"),
        (F.min("definition").over(four) == F.max("definition").over(four)).alias("one_definition"))
    reason = (F.when(~c("contiguous"), "LTM_QUARTERS_NOT_CONTIGUOUS").when(~c("one_definition"), "DEFINITION_INCOMPATIBLE")
              .when(~c("one_currency"), "CURRENCY_INCOMPATIBLE"))
    full = rows.where("n = 4").withColumn("reason", reason)
    return full.select(*KEY, "ltm_start", "ltm_end", F.when(c("reason").isNull(), c("total")).alias("value"), "reason")


def choose_ltm(direct: DataFrame, rolling: DataFrame, bridges: DataFrame) -> DataFrame:
    """Newest end first, then direct, four quarters, bridge; a newer blocking failure is remembered."""
    c = F.col
    pick = lambda df, how, quality: df.select(*KEY, "ltm_start", "ltm_end", "value", F.lit(how).alias("derivation"), F.lit(quality).alias("quality"))
    valid = pick(direct, "DIRECT_REPORTED_LTM", 3).unionByName(pick(rolling.where("reason IS NULL"), "SUM_OF_FOUR_QUARTERS", 2)).unionByName(
        pick(bridges.where("reason IS NULL"), "FY_PLUS_CURRENT_YTD_MINUS_PRIOR_YTD", 1))
    best = top_n_per_key(valid, KEY, [F.desc("ltm_end"), F.desc("quality")]).drop("quality")
    blocked = rolling.select(*KEY, "ltm_end", "reason").unionByName(bridges.select(*KEY, "ltm_end", "reason")).where(
        c("reason").isin("DEFINITION_INCOMPATIBLE", "CURRENCY_INCOMPATIBLE"))
    newest = blocked.groupBy(*KEY).agg(F.max(F.struct("ltm_end", "reason")).alias("f"))
    joined = best.join(newest, KEY, "left")
    newer = c("f.ltm_end") > c("ltm_end")
    return joined.select(*best.columns, F.when(newer, c("f.reason")).alias("stale_reason"), F.when(newer, c("f.ltm_end")).alias("stale_end"))


def period_growth(cells: DataFrame, ordinal: str = "year") -> DataFrame:
    """Current over prior column minus one, in column order."""
    order = Window.partitionBy(*KEY).orderBy(ordinal)
    return cells.withColumn("growth", N.growth_ratio(F.col("value"), F.lag("value").over(order)))


def ltm_freshness(ltm: DataFrame, expected: DataFrame) -> DataFrame:
    """A value older than the latest reported quarter is withdrawn."""
    joined = ltm.join(expected, "ticker", "left")
    stale = F.col("value").isNotNull() & F.coalesce(F.col("ltm_end") < F.col("expected_end"), F.lit(False))
    return joined.withColumns({
        "value": F.when(~stale, F.col("value")), "status": F.when(stale, "REQUIRES_REVIEW").otherwise(F.col("status")),
        "reason": F.when(stale, "STALE_LTM_MISSING_LATEST_REPORTED_QUARTER").otherwise(F.col("reason"))}).drop("expected_end")


def required_gaps(cells: DataFrame) -> DataFrame:
    """Distinct missing ranges that more filings could fill, from unavailable calendar years and trailing values."""
    c = F.col
    missing = cells.where(c("value").isNull() & c("status").isin("INSUFFICIENT_PERIOD_COVERAGE", "MISSING_SOURCE_DATA", "STALE_SOURCE_COVERAGE"))
    return missing.select(*KEY, "purpose", "gap_start", "gap_end").distinct()
