"""Reported facts: scanning, metric policies, candidate selection, and pairing of metrics.

Selections are rank filters (group limit before the shuffle) or combined aggregates. Joins of two metrics run
on rows already reduced to one per series and period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import numbers as N
from tidemark.functions import strings as S
from tidemark.operators.filings import EXHIBIT_FORMS, DIRECT_FORMS, FINANCIAL_FORMS, SUPPORTED_FORMS, form_supports_period
from tidemark.operators.keyed import once, range_match, top_n_per_key

SERIES = ["ticker", "metric", "scope", "op_scope", "currency", "unit", "definition"]

# Concepts of each metric in order of preference, label pattern of company extensions, excluded wording.
METRIC_POLICY = {
    "revenue": (
        ["Revenues", "SalesRevenueNet", "RevenueFromContractWithCustomerExcludingAssessedTax",
         "RevenueFromContractWithCustomerIncludingAssessedTax", "RevenueFromContractsWithCustomers", "Revenue"],
        r"^(?:total |net )?revenues?$",
        r"segment|product|service|related part|deferred|remaining performance|pro forma"),
    "grossProfit": (
        ["GrossProfit"], r"^(?:total )?gross profit(?: \(loss\))?$", r"segment|product|service|margin|percentage"),
    "costOfRevenue": (
        ["CostOfRevenue", "CostOfGoodsAndServicesSold", "CostOfGoodsSold", "CostOfSales"],
        r"^(?:total )?cost of (?:revenue|revenues|sales|goods and services sold)$", r"segment|product|service|percentage"),
    "ebit": (
        ["OperatingIncomeLoss", "ProfitLossFromOperatingActivities"],
        r"^(?:(?:total )?operating (?:income|profit|loss)(?: \(loss\))?|(?:income|profit|loss) from operations)$",
        r"segment|adjusted|margin|percentage"),
    "depreciationAmortization": (
        ["DepreciationDepletionAndAmortization", "DepreciationAndAmortization", "OtherDepreciationAndAmortization",
         "DepreciationDepletionAndAmortizationPropertyPlantAndEquipment"],
        r"^(?:total )?depreciation(?:, depletion)? and amortization(?: expense)?$",
        r"accumulated|expected|right-of-use|debt|financing"),
    "depreciation": (
        ["Depreciation", "DepreciationExpense", "AdjustmentForDepreciation"], r"^depreciation(?: expense)?$",
        r"accumulated|expected|right-of-use"),
    "amortization": (
        ["AmortizationOfIntangibleAssets", "AdjustmentForAmortization"],
        r"^amortization of intangible assets$|^intangible amortization$", r"debt|financing|expected|right-of-use"),
    "operatingCashFlow": (
        ["NetCashProvidedByUsedInOperatingActivities", "CashFlowsFromUsedInOperatingActivities",
         "NetCashProvidedByUsedInContinuingOperations"],
        r"^net cash (?:provided by|used in|provided by\s*/\s*\(used in\)|provided by \(used in\)) operating activities"
        r"(?:(?:,? | from )continuing operations)?$", r"discontinued"),
    "capitalExpenditures": (
        ["PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets",
         "PurchaseOfPropertyPlantAndEquipment", "PaymentsForAdditionsToPropertyPlantAndEquipment",
         "PaymentsToAcquireOtherPropertyPlantAndEquipment", "PaymentsToAcquireOtherProductiveAssets",
         "PurchaseOfPropertyPlantAndEquipmentClassifiedAsInvestingActivities"],
        r"^(?:payments|purchases|capital expenditures).*(?:property|plant|equipment|computer hardware)|^purchases of property and equipment$",
        r"business|subsidiar|affiliate|investment|proceeds|unpaid|incurred but not"),
    "adjustedEbitda": (
        ["AdjustedEBITDA", "AdjustedEbitda", "ConsolidatedAdjustedEBITDA", "ConsolidatedAdjustedEbitda"],
        r"^(?:consolidated )?adjusted ebitda(?: attributable to .+)?$",
        r"margin|percentage|guidance|forecast|reconciliation adjustment"),
}

# Concepts of standard adjustments.
ADJUSTMENT_POLICY = {
    "stockBasedCompensation": ["ShareBasedCompensation", "AllocatedShareBasedCompensationExpense", "ShareBasedPaymentExpense"],
    "restructuring": ["RestructuringCharges", "RestructuringCostsAndAssetImpairmentCharges", "OtherRestructuringCosts"],
    "impairment": ["AssetImpairmentCharges", "GoodwillAndIntangibleAssetImpairment", "GoodwillImpairmentLoss",
                   "ImpairmentOfIntangibleAssetsFinitelived"],
    "acquisitionTransaction": ["BusinessCombinationTransactionCosts", "AcquisitionRelatedCosts", "AcquisitionAndIntegrationCosts"],
    "integration": ["IntegrationCosts", "BusinessIntegrationCosts"],
    "severance": ["SeveranceCosts1", "SeveranceAndRelatedCosts"],
}

# Order in which forms are trusted for annual and for shorter periods.
ANNUAL_FORM_ORDER = ["10-K/A", "10-K", "20-F/A", "20-F", "40-F/A", "40-F", "S-1/A", "S-1", "F-1/A", "F-1", "10/A", "10",
                     "10-12B/A", "10-12B", "6-K", "10-Q/A", "10-Q", "8-K/A", "8-K"]
QUARTER_FORM_ORDER = ["10-Q/A", "10-Q", "6-K", "10-K/A", "10-K", "20-F/A", "20-F", "S-1/A", "S-1", "F-1/A", "F-1", "8-K/A", "8-K"]

# Provider metric names.
PROVIDER_METRICS = {
    "revenue": "revenue", "gross_profit": "grossProfit", "net_cash_from_operating_activities": "operatingCashFlow",
    "total_capex": "capitalExpenditures", "free_cash_flow": "providerFreeCashFlow",
}


def position(values: list[str], item: Column, missing: int) -> Column:
    """Zero-based place of an item in a fixed list."""
    at = F.array_position(F.array(*[F.lit(x) for x in values]), item) - 1
    return F.when(at >= 0, at).otherwise(missing).cast("int")


def metric_candidates(namespace: Column, concept: Column, label: Column) -> Column:
    """Metrics a concept may stand for: listed concepts, or a company extension whose label fits."""
    standard = namespace.isin("us-gaap", "ifrs-full")
    wording = F.coalesce(F.nullif(label, F.lit("")), concept)
    searchable = F.concat_ws(" ", concept, label)
    out = []
    for metric, (concepts, extension, exclude) in METRIC_POLICY.items():
        fits = ~standard & wording.rlike(f"(?i){extension}") & ~searchable.rlike(f"(?i){exclude}")
        out.append(F.when(concept.isin(concepts) | fits, metric))
    out += [F.when(concept.isin(concepts), f"adjustment:{name}") for name, concepts in ADJUSTMENT_POLICY.items()]
    return F.array_compact(F.array(*out))


def explode_company_facts(facts: DataFrame) -> DataFrame:
    """Nested facts (namespace -> concept -> unit -> items) to rows, skipping concepts no metric asks for."""
    spaces = facts.select("ticker", F.explode("facts").alias("namespace", "concepts"))
    concepts = spaces.select("ticker", "namespace", F.explode("concepts").alias("concept", "body"))
    named = concepts.withColumn("label", F.coalesce("body.label", "concept"))
    wanted = once(named, {"metrics": metric_candidates(F.col("namespace"), F.col("concept"), F.col("label"))}).where(F.size("metrics") > 0)
    units = wanted.select("ticker", "namespace", "concept", "label", "metrics", F.explode("body.units").alias("currency", "items"))
    return units.where(F.col("currency").rlike("^[A-Z]{3}$")).select(
        "ticker", "namespace", "concept", "label", "metrics", "currency", F.inline("items"))


def read_company_facts(facts: DataFrame) -> DataFrame:
    """Raw ledger: monetary duration facts of supported forms lasting 45 to 400 days."""
    rows = explode_company_facts(facts)
    start, end = F.col("start").try_cast("date"), F.col("end").try_cast("date")
    dated = rows.withColumns({"start_date": start, "end_date": end, "form": F.upper("form")})
    days = D.inclusive_days(F.col("start_date"), F.col("end_date"))
    kept = dated.where(N.finite(F.col("val")) & F.col("form").isin(FINANCIAL_FORMS) & days.between(45, 400))
    return kept.withColumns({
        "duration_days": days,
        "id": S.record_id(F.col("ticker"), F.col("namespace"), F.col("concept"), F.col("currency"), F.col("start"), F.col("end"),
                          F.col("accn"), F.col("segment")),
        "company_extension": ~F.col("namespace").isin("us-gaap", "ifrs-full", "dei"),
    })


def available_as_of(filed: Column, end: Column, as_of: str | None) -> Column:
    """Known at the date: open-ended without a date, else ended and filed by then."""
    if as_of is None:
        return F.lit(True)
    day = F.to_date(F.lit(as_of))
    return F.coalesce((end.isNull() | (end <= day)) & (filed <= day), F.lit(False))


def company_fact_candidates(facts: DataFrame, fye_month: DataFrame, metrics: list[str], as_of: str | None) -> DataFrame:
    """One row per fact and wanted metric for the canonical path: no segments, known at the date, typed period."""
    rows = read_company_facts(facts).where(F.col("segment").isNull() & F.col("form").isin(SUPPORTED_FORMS))
    filed = F.col("filed").try_cast("date")
    known = rows.withColumn("filed", filed).where(available_as_of(F.col("filed"), F.col("end_date"), as_of))
    typed = once(known, {"period_type": D.classify_period(F.col("start_date"), F.col("end_date"))})
    fits = typed.where((F.col("period_type") != "UNKNOWN") & form_supports_period(F.col("form"), F.col("period_type")))
    wanted = F.array_intersect("metrics", F.array(*[F.lit(m) for m in metrics]))
    spread = fits.withColumn("metric", F.explode(wanted)).join(fye_month, "ticker", "left")
    value = F.when(F.col("metric") == "capitalExpenditures", F.abs("val")).otherwise(F.col("val"))
    return spread.select(
        "ticker", "metric", "namespace", "concept", "label", F.col("val").alias("raw_value"), value.alias("value"), "currency",
        operation_scope(F.col("concept"), F.col("label")).alias("op_scope"), "start_date", "end_date", "period_type",
        D.fiscal_year(F.col("end_date"), F.col("fye_month")).alias("fiscal_year"),
        D.fiscal_quarter(F.col("end_date"), F.col("fye_month"), F.col("fp")).alias("fiscal_quarter"),
        "form", "filed", F.col("accn").alias("accession"), F.lit("REPORTED").alias("authority"))


def supplemental_candidates(records: DataFrame, metrics: list[str], as_of: str | None) -> DataFrame:
    """Document facts as candidates; an inferred start is dropped when only the end is stated."""
    end_only = F.coalesce(F.col("explicit_mapping") & F.col("end_date").isNotNull() & F.col("period_type").isNotNull(), F.lit(False))
    kept = records.where(
        F.upper("form").isin(SUPPORTED_FORMS) & F.col("segment").isNull() & (F.col("start_date").isNotNull() | end_only)
        & F.col("end_date").isNotNull() & N.finite(F.col("value")) & F.col("currency").rlike("^[A-Z]{3}$")
        & available_as_of(F.col("filed"), F.col("end_date"), as_of))
    start = F.when(~((F.col("authority") == "INFERRED") & end_only), F.col("start_date"))
    bounded = kept.withColumn("start_date", start).withColumn(
        "authority", F.when(F.col("start_date").isNotNull(), F.coalesce("authority", F.lit("REPORTED"))).otherwise("UNKNOWN"))
    stated = bounded.withColumnRenamed("period_type", "__stated")
    typed = once(stated, {"period_type": D.classify_period(
        F.col("start_date"), F.col("end_date"), F.col("__stated"), F.col("authority"))}).drop("__stated")
    fits = typed.where((F.col("period_type") != "UNKNOWN") & form_supports_period(F.upper("form"), F.col("period_type")))
    return fits.where(F.col("metric").isin(metrics)).withColumn(
        "value", F.when(F.col("metric") == "capitalExpenditures", F.abs("value")).otherwise(F.col("value")))


def operation_scope(concept: Column, label: Column, context: Column | None = None) -> Column:
    spaced = F.regexp_replace(F.coalesce(concept, F.lit("")), r"([a-z])([A-Z])", "$1 $2")
    text = F.concat_ws(" ", spaced, label, *([context] if context is not None else []))
    return (
        F.when(text.rlike("(?i)continuing operations"), "CONTINUING_OPERATIONS")
        .when(text.rlike(r"(?i)including (?:disposal group and )?discontinued operations|including discontinued|total.*discontinued"),
              "TOTAL_INCLUDING_DISCONTINUED")
        .otherwise("UNSPECIFIED"))


def split_operation_evidence(facts: DataFrame) -> DataFrame:
    """Filing periods that report continuing and discontinued operating cash flow side by side."""
    text = F.concat_ws(" ", F.regexp_replace("concept", r"([a-z])([A-Z])", "$1 $2"), "label")
    operating = text.rlike("(?i)operating activities")
    going = operating & text.rlike("(?i)continuing operations")
    gone = operating & ~text.rlike("(?i)continuing operations") & text.rlike("(?i)discontinued operations")
    keys = ["ticker", "accession", "start_date", "end_date"]
    return facts.groupBy(keys).agg(F.bool_or(going).alias("a"), F.bool_or(gone).alias("b")).where("a AND b").select(keys)


def apply_split_evidence(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """Unspecified operating cash flow is the total where both parts are reported."""
    keys = ["ticker", "accession", "start_date", "end_date"]
    marked = candidates.join(evidence.withColumn("__split", F.lit(True)), keys, "left")
    total = F.col("__split") & (F.col("metric") == "operatingCashFlow") & (F.col("op_scope") == "UNSPECIFIED")
    return marked.withColumn("op_scope", F.when(total, "TOTAL_INCLUDING_DISCONTINUED").otherwise(F.col("op_scope"))).drop("__split")


# provider rows ------------------------------------------------------------------------------------------------


def provider_scope(raw: Column) -> Column:
    text = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(text.rlike("SEGMENT|GEOGRAPH|PRODUCT|DIVISION"), text).otherwise("CONSOLIDATED")


def reporting_scope(raw: Column, trusted_provider: Column) -> tuple[Column, Column]:
    """Scope and whether rows of it may be compared."""
    text = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    part = text.rlike("SEGMENT|GEOGRAPH|PRODUCT|DIVISION")
    whole = text.rlike("CONSOLIDATED|COMPANY|TOTAL") | trusted_provider
    scope = F.when(part, text).when(whole, "CONSOLIDATED").otherwise("UNKNOWN")
    return scope, ~part & whole


def map_period_type(explicit: Column, start: Column, end: Column, authority: Column, quarter: Column, frequency: str) -> Column:
    """Explicit label, else duration, else a quarter label of a quarterly feed."""
    labelled = F.when(quarter.isNotNull(), "STANDALONE_QUARTER") if frequency == "QUARTERLY" else F.lit(None).cast("string")
    return F.coalesce(
        F.when(explicit.isNotNull(), D.classify_period(start, end, explicit, authority)),
        F.when(start.isNotNull() & end.isNotNull(), D.classify_period(start, end)), labelled, F.lit("UNKNOWN"))


def repair_units(rows: DataFrame) -> DataFrame:
    """Borrow the currency of another row of the same ticker and period when a row has none."""
    own = N.currency_of(F.col("currency"), F.col("units"))
    # one row per ticker and period end: the lookup table is a combined aggregate, not a window over raw rows
    known = rows.select("ticker", "end_date", "fiscal_year", "fiscal_quarter", own.alias("c")).where("c IS NOT NULL")
    peers = known.groupBy("ticker", "end_date", "fiscal_year", "fiscal_quarter").agg(F.min("c").alias("__peer"))
    joined = rows.join(peers, ["ticker", "end_date", "fiscal_year", "fiscal_quarter"], "left")
    repaired = own.isNull() & F.col("__peer").isNotNull()
    return joined.withColumns({"unit_repaired": repaired, "currency": F.coalesce(own, F.col("__peer"))}).drop("__peer")


def adapt_provider_rows(rows: DataFrame, frequency: str = "QUARTERLY") -> DataFrame:
    """Standardized provider rows as observations; ``reason`` tells why a row cannot be used."""
    metric = F.lit(None).cast("string")
    for name, canonical in PROVIDER_METRICS.items():
        metric = F.when(F.col("provider_metric") == name, canonical).otherwise(metric)
    authority = F.when(F.col("start_date").isNotNull(), F.coalesce("date_authority", F.lit("INFERRED"))).otherwise("UNKNOWN")
    scaled = F.col("raw_value") * N.unit_scale(F.col("units"))
    reason = (
        F.when(metric.isNull(), "UNSUPPORTED_PROVIDER_METRIC")
        .when(F.col("ticker").isNull() | ~N.finite(F.col("raw_value")) | F.col("end_date").isNull(), "INVALID_PROVIDER_OBSERVATION")
        .when(F.col("currency").isNull(), "UNKNOWN_PROVIDER_MONETARY_UNITS"))
    return rows.withColumns({
        "metric": metric, "authority": authority, "reason": reason,
        "value": F.when(metric == "capitalExpenditures", F.abs(scaled)).otherwise(scaled),
        "period_type": map_period_type(F.lit(None).cast("string"), F.col("start_date"), F.col("end_date"), authority, F.col("fiscal_quarter"), frequency),
        "scope": provider_scope(F.col("scope")),
    })


def normalize_quarters(rows: DataFrame) -> DataFrame:
    """Legacy provider normalisation: scaled value, scope validity, confidence."""
    scope, valid = reporting_scope(F.col("scope"), F.lit(True))
    scaled = F.col("raw_value") * N.unit_scale(F.col("units"))
    return rows.where(N.finite(F.col("raw_value")) & F.col("end_date").isNotNull()).withColumns({
        "value": F.when(F.col("provider_metric") == "total_capex", F.abs(scaled)).otherwise(scaled),
        "currency": N.currency_of(F.col("currency"), F.col("units")), "scope_valid": valid, "scope": scope,
        "confidence": F.upper(F.coalesce("confidence", F.when(F.col("source_url").isNotNull(), "HIGH").otherwise("MEDIUM"))),
        "period_type": D.classify_period(F.col("start_date"), F.col("end_date")),
    })


def last_quarters(rows: DataFrame, n: int = 20) -> DataFrame:
    """Newest quarters of the supported provider metrics."""
    wanted = rows.where(F.col("provider_metric").isin(list(PROVIDER_METRICS)))
    return top_n_per_key(wanted, ["ticker", "provider_metric"], [F.desc("end_date")], n)


# validity -----------------------------------------------------------------------------------------------------


def observation_failures() -> Column:
    """Names of the rules an observation breaks."""
    c = F.col
    blank = lambda name: F.coalesce(c(name), F.lit("")) == ""
    authoritative = D.has_authoritative_bounds(c("start_date"), c("end_date"), c("authority"))
    days = D.inclusive_days(c("start_date"), c("end_date"))
    rules = [
        (blank("ticker"), "MISSING_TICKER"), (blank("metric"), "MISSING_METRIC"), (~N.finite(c("value")), "INVALID_NORMALIZED_VALUE"),
        (blank("currency"), "MISSING_CURRENCY"), (blank("unit"), "MISSING_NORMALIZED_UNITS"),
        (blank("provider") | blank("source_id"), "MISSING_SOURCE_PROVENANCE"), (blank("scope"), "MISSING_SCOPE"),
        (~F.coalesce(c("op_scope").isin("CONTINUING_OPERATIONS", "TOTAL_INCLUDING_DISCONTINUED", "UNSPECIFIED"), F.lit(False)), "INVALID_OPERATION_SCOPE"),
        (c("period_type").isNull(), "MISSING_PERIOD_IDENTITY"),
        (~F.coalesce(c("basis").isin("REPORTED", "DERIVED"), F.lit(False)), "INVALID_OBSERVATION_BASIS"),
        (c("start_date") > c("end_date"), "INVALID_PERIOD_RANGE"),
        (c("start_date").isNotNull() & c("end_date").isNull(), "INCOMPLETE_PERIOD_RANGE"),
        (c("end_date").isNotNull() & c("start_date").isNull() & (c("authority") != "UNKNOWN"), "INCOMPLETE_AUTHORITATIVE_PERIOD_RANGE"),
        (authoritative & ~D.type_matches_duration(c("period_type"), days), "PERIOD_TYPE_DURATION_CONFLICT"),
    ]
    return F.array_compact(F.array(*[F.when(condition, name) for condition, name in rules]))


# selection ----------------------------------------------------------------------------------------------------


def latest_filed_per_period(facts: DataFrame) -> DataFrame:
    """Last filed value of each issuer, tag and period."""
    return top_n_per_key(facts, ["ticker", "concept", "start_date", "end_date"], [F.desc("filed"), F.desc("accession")])


def ledger_order(metric: str) -> list[Column]:
    concepts = METRIC_POLICY[metric][0]
    extension = ~F.col("namespace").isin("us-gaap", "ifrs-full", "dei")
    concept = F.when(F.col("concept").isin(concepts), position(concepts, F.col("concept"), 0)).otherwise(F.when(extension, 100).otherwise(500))
    annual = F.datediff("end_date", "start_date") + 1 >= 330
    form = F.when(annual, position(ANNUAL_FORM_ORDER, F.col("form"), 999)).otherwise(position(QUARTER_FORM_ORDER, F.col("form"), 999))
    quality = F.lit(0)
    if metric == "adjustedEbitda":
        kinds = ["RECONCILIATION_TABLE", "SUMMARY_TABLE", "INLINE", "COMPANY_FACTS"]
        quality = position(kinds, F.col("source_kind"), 10)
    return [quality, concept, form, F.desc("filed"), F.desc("accession")]


def select_source_fact(ledger: DataFrame, metric: str, currency: str = "USD") -> DataFrame:
    """Best consolidated fact per period, with the number of losers and whether its concept was recast."""
    c = F.col
    candidates = ledger.where(F.array_contains("metrics", metric) & c("segment").isNull())
    # the preferred currency when an issuer has it, else its first in alphabetical order
    choice = candidates.groupBy("ticker").agg(
        F.coalesce(F.max(F.when(c("currency") == currency, c("currency"))), F.min("currency")).alias("currency"))
    rows = candidates.join(choice, ["ticker", "currency"])
    key = ["ticker", "start_date", "end_date"]
    best = top_n_per_key(rows, key, ledger_order(metric))
    # spread of the chosen concept: aggregated per concept first, so no period has to be held whole
    spread = rows.groupBy(*key, "concept").agg(F.max("value").alias("hi"), F.min("value").alias("lo"), F.count("*").alias("of_concept"))
    totals = rows.groupBy(*key).agg((F.count("*") - 1).alias("alternatives"))
    joined = best.join(spread, [*key, "concept"]).join(totals, key)
    recast = ~(N.close_enough(c("hi"), c("value"), 1e-6) & N.close_enough(c("lo"), c("value"), 1e-6))
    extension = ~c("namespace").isin("us-gaap", "ifrs-full", "dei")
    decision = F.when(recast, "LATEST_AUTHORITATIVE_COMPARABLE_RECAST").when(extension, "COMPANY_EXTENSION_ECONOMIC_CONCEPT").otherwise(
        "HIGHEST_PRIORITY_STANDARD_CONCEPT")
    return joined.withColumns({"metric": F.lit(metric), "restated": recast, "decision": decision}).drop("hi", "lo", "of_concept")


AUTHORITY_ORDER = ["REPORTED", "DERIVED_FROM_REPORTED_BOUNDARIES", "INFERRED", "UNKNOWN"]


def select_candidate_period(candidates: DataFrame, metric: str) -> DataFrame:
    """Winner per (start, end, currency, operation scope): newest filing of each concept, then rank; conflicts flagged."""
    c = F.col
    rows = candidates.where(c("metric") == metric)
    key = ["ticker", "start_date", "end_date", "currency", "op_scope"]
    newest = top_n_per_key(rows, [*key, "namespace", "concept"], [F.desc("filed"), F.desc("accession")])
    concepts = METRIC_POLICY[metric][0]
    standard = c("namespace").isin("us-gaap", "ifrs-full")
    concept_rank = F.when(c("concept").isin(concepts), position(concepts, c("concept"), 0)).otherwise(F.when(standard, 500).otherwise(100))
    annual = c("period_type").isin("FISCAL_YEAR", "CALENDAR_YEAR")
    form_rank = F.when(annual, position(ANNUAL_FORM_ORDER, c("form"), 999)).otherwise(position(QUARTER_FORM_ORDER, c("form"), 999))
    ranked = newest.withColumns({"__authority": position(AUTHORITY_ORDER, c("authority"), 4), "__concept": concept_rank, "__form": form_rank})
    # concepts of one metric are a short list, so a period holds few rows here
    order = Window.partitionBy(*key).orderBy("__authority", "__concept", "__form", F.desc("filed"), F.desc("accession"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = ranked.withColumns({
        "__rn": F.row_number().over(order), "__best": F.first("value").over(whole),
        "__best_authority": F.first("__authority").over(whole), "__best_concept": F.first("__concept").over(whole),
    })
    same = c("__authority") == c("__best_authority")
    if metric not in ("costOfRevenue", "capitalExpenditures"):
        same = same & (c("__concept") == c("__best_concept"))
    clash = same & ~N.close_enough(c("value"), c("__best"), 0.001)
    clashes = F.sum(clash.cast("int")).over(Window.partitionBy(*key))
    out = marked.withColumns({"conflicts": clashes.cast("int"), "competing": (F.count("*").over(Window.partitionBy(*key)) - 1).cast("int")})
    out = out.where("__rn = 1").drop("__rn", "__best", "__best_authority", "__best_concept", "__authority", "__concept", "__form")
    return out.withColumn("confidence", F.when(c("conflicts") > 0, "LOW").otherwise("HIGH"))


SCOPE_ORDER = ["CONTINUING_OPERATIONS", "UNSPECIFIED", "TOTAL_INCLUDING_DISCONTINUED"]


def prefer_operation_scope(rows: DataFrame) -> DataFrame:
    """One row per economic period: better dated first, then continuing, unspecified, total."""
    label = F.concat_ws(":", "calendar_id", F.col("fiscal_year").cast("string"), F.col("fiscal_quarter").cast("string"))
    bounds = F.concat_ws(":", F.col("start_date").cast("string"), F.col("end_date").cast("string"))
    known = F.col("fiscal_year").isNotNull() & F.col("fiscal_quarter").isNotNull()
    keyed = rows.withColumn("__period", F.when(known, label).otherwise(bounds))
    order = [position(AUTHORITY_ORDER, F.col("authority"), 4), position(SCOPE_ORDER, F.col("op_scope"), 2), F.desc("filed"), F.desc("source_id")]
    return top_n_per_key(keyed, ["ticker", "metric", "period_type", "__period", "currency", "unit"], order).drop("__period")


def reporting_currency(candidates: DataFrame) -> DataFrame:
    """Currency of the newest annual row, else of the newest row, per ticker."""
    annual = F.col("period_type").isin("FISCAL_YEAR", "CALENDAR_YEAR")
    return candidates.groupBy("ticker").agg(
        F.max(F.struct(annual.alias("a"), F.col("end_date"), F.col("filed"), F.col("currency")))["currency"].alias("currency"))


def latest_reported_period(observations: DataFrame, filings: DataFrame, as_of: str | None) -> DataFrame:
    """Newest period end per ticker and metric that a report form or an explicitly mapped exhibit proves."""
    c = F.col
    seen = observations.where(available_as_of(c("filed"), c("end_date"), as_of) & (c("end_date") <= c("filed"))).where(
        c("form").isin(DIRECT_FORMS) | (c("form").isin(EXHIBIT_FORMS) & F.coalesce(c("explicit_mapping"), F.lit(False))))
    from_facts = seen.groupBy("ticker", "metric").agg(F.max("end_date").alias("a"))
    reports = filings.where(c("form").isin(DIRECT_FORMS) & c("report_date").isNotNull() & available_as_of(c("filing_date"), c("report_date"), as_of))
    from_forms = reports.groupBy("ticker").agg(F.max("report_date").alias("b"))
    return from_facts.join(from_forms, "ticker", "left").select("ticker", "metric", F.greatest("a", "b").alias("period_end"))


def reported_period_valid(form: Column, evidence: Column, explicit: Column, end: Column) -> Column:
    """Whether a form, or an exhibit with explicit mapping, proves a reported period end."""
    by_form = form.isin(DIRECT_FORMS) & (evidence == "FORM_REPORT_PERIOD")
    by_exhibit = form.isin(EXHIBIT_FORMS + ["20-F", "20-F/A", "40-F", "40-F/A"]) & (evidence == "EARNINGS_EXHIBIT_PERIOD") & explicit
    return end.isNotNull() & F.coalesce(by_form | by_exhibit, F.lit(False))


def latest_expected_quarter(filings: DataFrame, revenue_quarters: DataFrame) -> DataFrame:
    reports = filings.where(F.col("form").isin("10-Q", "10-Q/A")).groupBy("ticker").agg(F.max("report_date").alias("a"))
    facts = revenue_quarters.groupBy("ticker").agg(F.max("end_date").alias("b"))
    return reports.join(facts, "ticker", "full").select("ticker", F.greatest("a", "b").alias("expected_end"))


# pairing ------------------------------------------------------------------------------------------------------


def match_provider_to_filed(provider: DataFrame, filed: DataFrame, days: int = 7, by: list[str] | None = None) -> DataFrame:
    """Provider quarters with their filed quarter when exactly one filed quarter fits.

    ``by`` names a provider quarter, its source id unless told otherwise; with the ticker, rows that lie by ticker need not be moved.
    """
    by = by or ["source_id"]
    keys = ["ticker", "metric", "scope", "currency", "unit"]
    right = filed.where("period_type = 'STANDALONE_QUARTER'").select(
        *keys, F.col("source_id").alias("filed_id"), F.col("end_date").alias("filed_end"), F.col("start_date").alias("filed_start"),
        F.col("value").alias("filed_value"), F.col("fiscal_year").alias("__fy"), F.col("fiscal_quarter").alias("__fq"), F.col("authority").alias("filed_authority"))
    pairs = range_match(provider, right, keys, "end_date", "filed_end", days)
    same = lambda a, b: a.isNull() | b.isNull() | (a == b)
    fits = pairs.where(same(F.col("fiscal_year"), F.col("__fy")) & same(F.col("fiscal_quarter"), F.col("__fq"))).drop("__fy", "__fq")
    counts = fits.groupBy(*by).agg(F.count("*").alias("__n")).where("__n = 1").select(*by)
    return fits.join(counts, by)


def enrich_with_period_evidence(provider: DataFrame, filed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Provider values with filed bounds; a value that does not reconcile within 0.1 % needs review. ``by`` as in the match."""
    by = by or ["source_id"]
    matched = match_provider_to_filed(provider, filed, by=by).select(*by, "filed_id", "filed_start", "filed_end", "filed_value", "filed_authority")
    joined = provider.join(matched, by, "left").select(*provider.columns, *[x for x in matched.columns if x not in by])
    found = F.col("filed_id").isNotNull()
    agrees = N.close_enough(F.col("value"), F.col("filed_value"), 0.001)
    return joined.withColumns({
        "start_date": F.coalesce("filed_start", "start_date"), "end_date": F.coalesce("filed_end", "end_date"),
        "authority": F.coalesce("filed_authority", "authority"),
        "evidence": F.when(~found, "NONE").when(agrees, "FILED_PERIOD_ATTACHED").otherwise("VALUE_MISMATCH"),
        "dedup_status": F.when(found & ~agrees, "REQUIRES_REVIEW"),
        "conflict": F.when(found & ~agrees, "VALUE_CONFLICT"),
    }).drop("filed_start", "filed_end", "filed_authority")


def fill_missing_quarters(primary: DataFrame, secondary: DataFrame, days: int = 7) -> DataFrame:
    """Secondary quarters only where the primary side has no quarter that ends within the tolerance."""
    marks = primary.select("ticker", "metric", F.col("end_date").alias("__end")).distinct()
    missing = range_match(secondary, marks, ["ticker", "metric"], "end_date", "__end", days, "left_anti")
    return primary.unionByName(missing.select(primary.columns))


def cash_flow_minus_capex(cash: DataFrame, capex: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Free cash flow per cash-flow period with exactly one compatible capex period; other rows carry a reason.

    ``by`` names a cash-flow row, its source id unless told otherwise.
    """
    c, by = F.col, by or ["source_id"]
    right = capex.select(
        "ticker", c("source_id").alias("capex_id"), c("value").alias("capex_value"), c("start_date").alias("__start"),
        c("end_date").alias("__end"), c("period_type").alias("__type"), c("op_scope").alias("__op"), c("scope").alias("__scope"),
        c("currency").alias("__currency"), c("unit").alias("__unit"), c("fiscal_year").alias("__fy"), c("fiscal_quarter").alias("__fq"),
        c("calendar_id").alias("__cal"), c("dedup_status").alias("__review"))
    pairs = range_match(cash, right, ["ticker"], "end_date", "__end", 7)
    same = lambda a, b: a.isNull() | b.isNull() | (a == b)
    bounds = (F.abs(F.datediff("start_date", "__start")) <= 14) & (
        F.abs(F.datediff("end_date", "start_date") - F.datediff("__end", "__start")) <= 14)
    near = pairs.where((c("period_type") == c("__type")) & same(c("fiscal_year"), c("__fy")) & same(c("fiscal_quarter"), c("__fq"))
                       & same(c("calendar_id"), c("__cal")) & bounds)
    full = (c("op_scope") == c("__op")) & (c("scope") == c("__scope")) & (c("currency") == c("__currency")) & (c("unit") == c("__unit"))
    per_cash = near.groupBy(*by).agg(
        F.count("*").alias("periods"), F.count_if(full).alias("matches"), F.count_if(c("op_scope") == c("__op")).alias("same_op"),
        F.max(F.when(full, F.struct("capex_value", "capex_id", c("__review").alias("review"),
                                    ((c("start_date") == c("__start")) & (c("end_date") == c("__end"))).alias("exact")))).alias("m"))
    joined = cash.join(per_cash, by, "left")
    review = (c("dedup_status") == "REQUIRES_REVIEW") | (c("m.review") == "REQUIRES_REVIEW")
    reason = (
        F.when(c("periods").isNull(), "MISSING_MATCHED_CAPEX_PERIOD").when(c("matches") > 1, "AMBIGUOUS_CAPEX_PERIOD_MATCH")
        .when((c("matches") == 0) & (c("same_op") == 0), "OPERATION_SCOPE_INCOMPATIBLE").when(c("matches") == 0, "INCOMPATIBLE_FCF_SOURCE_SERIES")
        .when(F.coalesce(review, F.lit(False)), "SOURCE_VALUE_CONFLICT"))
    ok = reason.isNull()
    return joined.withColumns({
        "reason": reason, "failure_status": F.when(reason == "OPERATION_SCOPE_INCOMPATIBLE", reason).when(~ok, "REQUIRES_REVIEW"),
        "value": F.when(ok, c("value") - c("m.capex_value")), "metric": F.lit("freeCashFlow"), "basis": F.lit("DERIVED"),
        "method": F.when(ok, "CFO_MINUS_CAPEX"), "exact": F.coalesce(c("m.exact"), F.lit(False)), "provider": F.lit("DERIVED"),
        "definition": F.lit("DEF_freeCashFlow"),
        "source_id": F.when(ok, F.concat_ws("|", "source_id", F.lit("CFO_MINUS_CAPEX"), "m.capex_id")).otherwise(c("source_id")),
    }).drop("periods", "matches", "same_op", "m")


def paired_metric(left: DataFrame, right: DataFrame, sign: int, metric: str, method: str) -> DataFrame:
    """left ± right on equal series bounds."""
    keys = ["ticker", "start_date", "end_date"]
    other = right.select(*keys, F.col("value").alias("__other"), F.col("source_id").alias("__other_id"))
    return left.join(other, keys).withColumns({
        "value": F.col("value") + F.lit(float(sign)) * F.col("__other"), "metric": F.lit(metric), "method": F.lit(method),
        "basis": F.lit("DERIVED"), "source_id": F.concat_ws("|", "source_id", F.lit(method), "__other_id"),
    }).drop("__other", "__other_id")


def revenue_minus_cost(revenue: DataFrame, cost: DataFrame, direct: DataFrame) -> DataFrame:
    """Gross profit for periods without a reported one and exactly one cost row of equal series and bounds."""
    period = ["ticker", "start_date", "end_date", "currency"]
    open_rows = revenue.join(direct.select(period).distinct(), period, "left_anti")
    keys = [*period, "scope", "op_scope", "unit", "period_type"]
    costs = cost.groupBy(keys).agg(
        F.count("*").alias("__n"), F.max("value").alias("__cost"), F.max("source_id").alias("__cost_id"), F.max("dedup_status").alias("__review"))
    joined = open_rows.join(costs, keys)
    review = (F.col("dedup_status") == "REQUIRES_REVIEW") | (F.col("__review") == "REQUIRES_REVIEW")
    reason = F.when(F.col("__n") > 1, "AMBIGUOUS_COST_OF_REVENUE").when(F.coalesce(review, F.lit(False)), "SOURCE_VALUE_CONFLICT")
    ok = reason.isNull()
    return joined.withColumns({
        "reason": reason, "value": F.when(ok, F.col("value") - F.abs("__cost")), "metric": F.lit("grossProfit"), "basis": F.lit("DERIVED"),
        "method": F.lit("REVENUE_MINUS_COST_OF_REVENUE"), "exact": F.lit(True), "provider": F.lit("DERIVED"), "definition": F.lit("DEF_grossProfit"),
        "source_id": F.concat_ws("|", "source_id", F.lit("REVENUE_MINUS_COST_OF_REVENUE"), "__cost_id"),
    }).drop("__n", "__cost", "__cost_id", "__review")


def additive_capex(candidates: DataFrame) -> DataFrame:
    """Sum of property purchases net of hardware plus hardware purchases of one filing, checked against totals.

    ``conflict`` is set when another capex row of the period agrees with neither the sum nor a component.
    """
    c = F.col
    text = F.regexp_replace(F.lower(F.concat_ws(" ", "concept", "label")), r"[^a-z0-9]+", " ")
    broad = text.rlike(r"\btotal\s+(?:capital expenditures?|capex)\b") | F.lower("label").rlike(r"^\s*(?:capital expenditures?|capex)(?:\s+for\s+.+)?\s*$")
    hardware = r"(?:(?:computer|mining)\s+)?hardware(?:\s+prepayments?)?"
    property_ = text.rlike(r"\bproperty\s+plant\s+(?:and\s+)?equipment\b|\bproperty\s+and\s+equipment\b") & text.rlike(
        rf"\b(?:net\s+of|excluding|exclusive\s+of)\s+(?:purchases?\s+of\s+)?{hardware}\b")
    klass = F.when(broad, F.lit(None).cast("string")).when(property_, "PROPERTY").when(
        text.rlike(r"\b(?:(?:computer|mining)\s+hardware|hardware\s+prepayments?)\b"), "HARDWARE")
    key = ["ticker", "start_date", "end_date"]
    rows = candidates.where("metric = 'capitalExpenditures'").withColumn("klass", klass)

    def part(name, fn):
        return fn(F.when(c("klass") == name, c("value")))

    groups = rows.where(c("klass").isNotNull() & c("accession").isNotNull()).groupBy(*key, "accession").agg(
        F.max("filed").alias("filed"), part("PROPERTY", F.max).alias("p_hi"), part("PROPERTY", F.min).alias("p_lo"),
        part("HARDWARE", F.max).alias("h_hi"), part("HARDWARE", F.min).alias("h_lo"))
    complete = groups.where(N.close_enough(c("p_hi"), c("p_lo"), 0.001) & N.close_enough(c("h_hi"), c("h_lo"), 0.001)).withColumn(
        "value", c("p_hi") + c("h_hi"))
    best = top_n_per_key(complete, key, [F.desc("filed"), F.desc("accession")])
    rivals = complete.select(*key, c("value").alias("__rival")).groupBy(*key).agg(F.max("__rival").alias("hi"), F.min("__rival").alias("lo"))
    out = best.join(rivals, key)
    others = rows.where(c("klass").isNull()).select(*key, c("value").alias("__v"))
    picked = best.select(*key, c("value").alias("__sum"), c("p_hi").alias("__p"), c("h_hi").alias("__h"))
    clash = others.join(picked, key).groupBy(*key).agg(F.count_if(
        ~N.close_enough(c("__v"), c("__sum"), 0.001) & ~N.close_enough(c("__v"), c("__p"), 0.001) & ~N.close_enough(c("__v"), c("__h"), 0.001)).alias("clashes"))
    joined = out.join(clash, key, "left")
    rival = ~(N.close_enough(c("hi"), c("value"), 0.001) & N.close_enough(c("lo"), c("value"), 0.001))
    conflict = rival | (F.coalesce("clashes", F.lit(0)) > 0)
    return joined.select(*key, "accession", "value", F.when(conflict, "SOURCE_VALUE_CONFLICT").alias("conflict"))


def lineage(prefix: str = "lineage") -> Column:
    """Source columns kept inside a derived row."""
    return F.struct("metric", "provider", "source_id", "accession", "filed", "value", "currency", "unit", "scope", "op_scope",
                    "period_type", "start_date", "end_date", "basis", "definition").alias(prefix)


def source_shape(form: Column, derived: Column) -> Column:
    """Label of where a fact comes from."""
    return F.when(derived, "Derived standardized metric").when(form.isin(FINANCIAL_FORMS), "Filed actual").otherwise("Provider actual")


def component(allocated_days: Column | None = None) -> Column:
    """Lineage of a contribution: bounds, share of the period and signed amount."""
    total = F.datediff("end_date", "start_date") + 1
    days = total if allocated_days is None else allocated_days
    share = days / total
    return F.struct("source_id", "start_date", "end_date", F.col("value").alias("source_value"), days.alias("overlap_days"),
                    total.alias("total_days"), share.alias("share"), (F.col("value") * share).alias("contribution"))


def compact_components(components: Column, limit: int = 8) -> Column:
    """Components distinct by identity, first ``limit`` of them."""
    identity = F.transform(components, lambda x: F.struct(x["source_id"], x["start_date"], x["end_date"], x["source_value"], x["contribution"]))
    return F.slice(F.array_distinct(identity), 1, limit)

