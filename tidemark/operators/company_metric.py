"""Company-defined metric: eligibility, authority, definitions, invariants and its yearly and trailing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import numbers as N
from tidemark.operators import rollups as R
from tidemark.operators.filings import FINANCIAL_FORMS
from tidemark.operators.keyed import top_n_per_key

ANNUAL = ["CALENDAR_YEAR", "FISCAL_YEAR"]


def is_eligible_recon_fact() -> Column:
    """Every piece of cell provenance is there and the value is whole and unsegmented."""
    c = F.col
    filled = ["table_title", "row_label", "column_label", "raw_text", "source_id", "source_hash", "filing_url", "accession", "period_type", "start_date",
              "end_date", "reported_units"]
    present = F.lit(True)
    for name in filled:
        present = present & c(name).isNotNull()
    return F.coalesce(
        present & (c("source_kind") == "RECONCILIATION_TABLE") & F.upper("form").isin(FINANCIAL_FORMS) & N.finite(c("scale")) & N.finite(c("number"))
        & N.finite(c("value")) & c("currency").rlike("^[A-Z]{3}$") & c("segment").isNull(), F.lit(False))


def select_authoritative_recon(facts: DataFrame) -> DataFrame:
    """One fact per period: annual ones by smallest scale, then earliest filing; others by latest filing."""
    c = F.col
    total = c("row_label").rlike(r"(?i)^total segment adjusted ebitda (?:loss|profit)$")
    period = ["ticker", "period_type", "start_date", "end_date"]
    flags = facts.groupBy(*period).agg(F.bool_or(total).alias("__total"), (F.count("*") - 1).alias("alternatives"))
    rows = facts.join(flags, period)
    early = c("period_type").isin(ANNUAL) & ~c("__total")
    day = F.unix_date("filed")
    order = [F.when(early, c("scale")), F.when(early, day).otherwise(-day), F.when(early, c("accession")), F.desc(F.when(~early, c("accession")))]
    return top_n_per_key(rows, period, order).drop("__total")


_TERM_NOISE = [r"\b(?:add back|add|less|deduct)\s*:?", r"(?:\s*\([a-f]\))+\s*$",
               r"\b(?:expense|expenses|income|loss|losses|gain|gains|provision|provisions|benefit|benefits|net)\b"]
# Labels that are not part of a definition, and terms every definition has.
IGNORED_TERMS = r"(?i)^(?:adjusted ebitda|adjusted net profit|revenue|net (?:income|loss|profit)|q[1-4]'?\d{2}|three months ended)"
GENERIC_TERMS = r"\b(?:depreciation|amortization|interest|financial charges?|income taxes?|taxes?)\b"


def definition_terms(row_labels: Column) -> Column:
    """Normalised wording of the rows that define the metric."""
    def clean(label):
        text = F.lower(label)
        for pattern in _TERM_NOISE:
            text = F.regexp_replace(text, pattern, "")
        text = F.trim(F.regexp_replace(text, r"[^a-z]+", " "))
        return F.trim(F.regexp_replace(text, r"\s+[a-f](?:\s+[a-f])?\s*$", ""))

    short = F.filter(row_labels, lambda x: F.length(x) <= 180)
    return F.array_distinct(F.filter(F.transform(short, clean), lambda x: (F.length(x) > 1) & ~x.rlike(IGNORED_TERMS)))


def fuzzy_compatible(left: Column, right: Column) -> Column:
    """Term sets of at least five that share enough, at least two of the shared being substantive."""
    shared = F.array_intersect(left, right)
    a, b, s = F.size(left), F.size(right), F.size(shared)
    substantive = F.size(F.filter(shared, lambda x: ~x.rlike(GENERIC_TERMS)))
    return (a >= 5) & (b >= 5) & (substantive >= 2) & (s / F.least(a, b) >= 0.85) & (s / F.greatest(a, b) >= 0.75) & (s / F.size(F.array_union(left, right)) >= 0.75)


def definitions_compatible(facts: DataFrame, group: list[str]) -> DataFrame:
    """Whether every two definitions of a group fit: equal fingerprints, or wordings of theirs that are fuzzy compatible.

    A group is the three or four facts a value is built from. Fuzzy matches do not carry over: A fits B and B fits C says
    nothing about A and C. A missing fingerprint fits only itself.
    """
    known = F.collect_set(F.struct(F.coalesce("fingerprint", F.lit("")).alias("f"), F.coalesce("terms", F.array().cast("array<string>")).alias("t")))

    def fit(left, right, all_):
        of = lambda name: F.filter(all_, lambda z: z["f"] == name)
        return F.exists(of(left["f"]), lambda u: F.exists(of(right["f"]), lambda w: fuzzy_compatible(u["t"], w["t"])))

    defined = facts.groupBy(*group).agg(known.alias("__d"))
    pairs = F.forall("__d", lambda x: F.forall(F.col("__d"), lambda y: (x["f"] >= y["f"]) | fit(x, y, F.col("__d"))))
    return defined.select(*group, pairs.alias("compatible"))


def lineage_identity(entry: dict[str, Column], components: Column) -> Column:
    """Hash of a value and the sources it was built from, in period order."""
    parts = F.array_sort(F.transform(components, lambda x: F.struct(x["source_start"], x["source_end"], x["source_id"], x["normalized_value"])))
    return F.when(entry["value"].isNotNull(), F.sha2(F.to_json(F.struct(*[v.alias(k) for k, v in entry.items()], parts.alias("components"))), 256))


def assert_company_metric(rows: DataFrame) -> DataFrame:
    """Invariants a yearly or trailing entry breaks.

    Columns: value, derivation, requested, ltm_start, ltm_end and components ordered by role or period.
    """
    c = F.col
    parts = c("components")
    n = F.size(parts)
    total = F.aggregate(parts, F.lit(0.0), lambda t, x: t + x["normalized_value"])
    steps = F.zip_with(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), F.slice(parts, 2, F.greatest(n - 1, F.lit(0))),
                       lambda a, b: F.datediff(b["source_start"], a["source_end"]) == 1)
    contiguous = F.forall(steps, lambda s: s)
    lineage = F.forall(parts, lambda x: x["source_id"].isNotNull() & x["source_start"].isNotNull() & x["source_end"].isNotNull() & x["normalized_value"].isNotNull())
    currencies = F.size(F.array_distinct(F.transform(parts, lambda x: x["currency"])))
    four, bridge, direct = c("derivation") == "SUM_OF_FOUR_QUARTERS", c("derivation") == "FY_PLUS_CURRENT_YTD_MINUS_PRIOR_YTD", c("derivation") == "DIRECT"
    role = lambda name: F.get(F.filter(parts, lambda x: x["role"] == name), F.lit(0))
    fy, cur, pri = role("YEAR"), role("CURRENT"), role("PRIOR")
    bounds = (fy["source_start"] == pri["source_start"]) & (F.datediff(cur["source_start"], fy["source_end"]) == 1)
    arithmetic = c("value") == fy["normalized_value"] + cur["normalized_value"] - pri["normalized_value"]
    first, last = F.get(parts, F.lit(0)), F.element_at(parts, -1)
    no = lambda condition: ~F.coalesce(condition, F.lit(False))
    rules = [
        (no(n > 0) | no(lineage), "LINEAGE_INCOMPLETE"), (no(currencies == 1), "CURRENCY_MIXED"),
        (no(direct | four | bridge), "UNSUPPORTED_CONSTRUCTION"), (four & no(n == 4), "QUARTER_COUNT"), (four & no(contiguous), "QUARTERS_NOT_CONTIGUOUS"),
        (four & no(c("value") == total), "QUARTER_SUM_MISMATCH"), (bridge & no(n == 3), "BRIDGE_COUNT"), (bridge & no(bounds), "BRIDGE_PERIODS"),
        (bridge & no(arithmetic), "BRIDGE_ARITHMETIC"), (direct & no((n == 1) & (c("value") == first["normalized_value"])), "DIRECT_MISMATCH"),
        ((c("requested") == "LTM") & four & no((c("ltm_start") == first["source_start"]) & (c("ltm_end") == last["source_end"])), "LTM_BOUNDS"),
    ]
    found = F.array_compact(F.array(*[F.when(condition, name) for condition, name in rules]))
    return rows.withColumn("failures", F.when(c("value").isNull(), F.slice(found, 1, 0)).otherwise(found))


def negative_search_status(cells: DataFrame, searches: DataFrame) -> DataFrame:
    """NOT_REPORTED and LEGITIMATE_NA only after a completed search of the issuer and period."""
    c = F.col
    joined = cells.join(searches, ["ticker", "period"], "left")
    done = F.coalesce(c("completed"), F.lit(False))
    nothing = done & (F.coalesce("eligible_found", F.lit(0)) == 0)
    empty = c("value").isNull()
    legitimate = empty & (c("status") == "INSUFFICIENT_PERIOD_COVERAGE") & done & (F.coalesce("eligible_found", F.lit(0)) > 0) & (c("components") >= 2) & c("period").rlike(r"^\d{4}A$")
    status = (
        F.when(legitimate, "LEGITIMATE_NA").when(empty & c("status").isin("INSUFFICIENT_PERIOD_COVERAGE", "NOT_REPORTED") & nothing, "NOT_REPORTED")
        .when(empty & (c("status") == "NOT_REPORTED"), F.when(done, "INSUFFICIENT_PERIOD_COVERAGE").otherwise("MISSING_SOURCE_DATA")).otherwise(c("status")))
    return joined.withColumn("status", status).drop("completed", "eligible_found")


def evidence_count(facts: DataFrame, years: list[int]) -> DataFrame:
    """Eligible facts overlapping each year."""
    touched = F.filter(F.array(*[F.lit(y) for y in years]), lambda y: (y >= F.year("start_date")) & (y <= F.year("end_date")))
    return facts.select("ticker", F.explode(touched).alias("year")).groupBy("ticker", "year").agg(F.count("*").alias("facts"))


def company_metric_years(facts: DataFrame, years: list[int]) -> DataFrame:
    """Calendar years: a direct fact, else four exact calendar quarters, else a bridge over exactly that year."""
    c = F.col
    year = F.year("end_date")
    exact = facts.where((F.date_format("start_date", "MM-dd") == "01-01") & (F.date_format("end_date", "MM-dd") == "12-31") & (F.year("start_date") == year))
    direct = exact.where(c("period_type").isin(ANNUAL)).groupBy("ticker", year.alias("year")).agg(F.max("value").alias("direct"))
    quarters = facts.where((c("period_type") == "STANDALONE_QUARTER") & (F.trunc("start_date", "quarter") == c("start_date"))
                           & (F.last_day(F.add_months("start_date", 2)) == c("end_date")))
    four = quarters.groupBy("ticker", year.alias("year")).agg(
        F.count("*").alias("n"), F.count_distinct("start_date").alias("starts"), F.sum("value").alias("total"), F.count_distinct("currency").alias("currencies"),
        F.count_distinct("definition").alias("definitions"))
    bridges = R.fy_ytd_bridge(facts).where((F.date_format("ltm_start", "MM-dd") == "01-01") & (F.date_format("ltm_end", "MM-dd") == "12-31") & (c("reason").isNull()))
    bridge = bridges.groupBy("ticker", F.year("ltm_end").alias("year")).agg(F.max("value").alias("bridge"), F.count("*").alias("bridges"))
    cells = facts.select("ticker").distinct().withColumn("year", F.explode(F.array(*[F.lit(y) for y in years])))
    rows = cells.join(direct, ["ticker", "year"], "left").join(four, ["ticker", "year"], "left").join(bridge, ["ticker", "year"], "left")
    whole = F.coalesce((c("n") == 4) & (c("starts") == 4), F.lit(False))
    usable = whole & (c("currencies") == 1) & (c("definitions") <= 1)
    value = F.coalesce("direct", F.when(usable, c("total")), F.when(c("bridges") == 1, c("bridge")))
    derivation = F.when(c("direct").isNotNull(), "DIRECT").when(usable, "SUM_OF_FOUR_QUARTERS").when(c("bridges") == 1, "FY_PLUS_CURRENT_YTD_MINUS_PRIOR_YTD")
    status = (
        F.when(c("direct").isNotNull(), "VERIFIED_REPORTED").when(value.isNotNull(), "VERIFIED_DERIVED").when(c("bridges") > 1, "REQUIRES_REVIEW")
        .when(whole & (c("definitions") > 1), "DEFINITION_INCOMPATIBLE").when(whole & (c("currencies") > 1), "REQUIRES_REVIEW").otherwise("INSUFFICIENT_PERIOD_COVERAGE"))
    return rows.select("ticker", "year", value.alias("value"), derivation.alias("derivation"), status.alias("status"))


def migrate_ltm(cells: DataFrame, version: str) -> DataFrame:
    """Version step that repairs missing trailing bounds from the stored components."""
    c = F.col
    parts = c("components")
    by_role = lambda name: F.get(F.filter(parts, lambda x: x["role"] == name), F.lit(0))
    bridge = c("derivation") == "FY_PLUS_CURRENT_YTD_MINUS_PRIOR_YTD"
    start = F.when(bridge, F.date_add(by_role("PRIOR")["source_end"], 1)).otherwise(F.get(parts, F.lit(0))["source_start"])
    end = F.when(bridge, by_role("CURRENT")["source_end"]).otherwise(F.element_at(parts, -1)["source_end"])
    repairable = c("value").isNotNull() & c("ltm_end").isNull() & start.isNotNull() & end.isNotNull()
    return cells.withColumns({
        "migrated": repairable, "ltm_start": F.when(repairable, start).otherwise(c("ltm_start")), "ltm_end": F.when(repairable, end).otherwise(c("ltm_end")),
        "version": F.when(repairable, version).otherwise(c("version"))})
