"""Filing inventories: reading, grouping, ranking and choosing filings to read.

Per-issuer choices are rank filters with a bound, so the group limit before the shuffle holds for issuers of
any size. Date-window joins carry a bucket of days in their equality.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import strings as S
from tidemark.operators.keyed import range_match, top_n_per_key

# Filing groups in display order and their forms.
FILING_GROUPS = {
    "10-K": ["10-K", "10-K/A", "10-KT", "10-KT/A"],
    "10-Q": ["10-Q", "10-Q/A", "10-QT", "10-QT/A"],
    "8-K": ["8-K", "8-K/A"],
    "DEF 14A": ["DEF 14A", "DEFA14A", "DEFM14A", "PRE 14A"],
    "Ownership": ["3", "3/A", "4", "4/A", "5", "5/A", "SC 13D", "SC 13D/A", "SC 13G", "SC 13G/A"],
    "Other": [],
}

# Forms that carry financial statements.
FINANCIAL_FORMS = [
    "10-K", "10-K/A", "10-Q", "10-Q/A", "8-K", "8-K/A", "20-F", "20-F/A", "40-F", "40-F/A", "6-K",
    "S-1", "S-1/A", "F-1", "F-1/A", "10", "10/A", "10-12B", "10-12B/A",
]

# Form families used to weigh a filing.
DIRECT_FORMS = ["10-Q", "10-Q/A", "10-K", "10-K/A", "20-F", "20-F/A", "40-F", "40-F/A"]
EXHIBIT_FORMS = ["6-K", "6-K/A", "8-K", "8-K/A"]
ANNUAL_FORMS = ["10-K", "10-K/A", "20-F", "20-F/A", "40-F", "40-F/A", "S-1", "S-1/A", "F-1", "F-1/A"]
SUPPORTED_FORMS = DIRECT_FORMS + EXHIBIT_FORMS + ["S-1", "S-1/A", "F-1", "F-1/A"]
REGISTRATION_FORMS = ["10", "10/A", "10-12B", "10-12B/A"]
CURRENT_FORMS = ["8-K", "8-K/A", "6-K"]
CALL_FORM_ORDER = ["8-K", "6-K", "10-Q", "10-K", "20-F"]


def filing_category(form: Column) -> Column:
    out = F.lit("Other")
    for group, forms in FILING_GROUPS.items():
        if forms:
            out = F.when(F.upper(F.trim(form)).isin(forms), group).otherwise(out)
    return out


def category_rank(category: Column) -> Column:
    return F.array_position(F.array(*[F.lit(g) for g in FILING_GROUPS]), category)


def form_supports_period(form: Column, period_type: Column) -> Column:
    """Annual periods need an annual or exhibit form; shorter periods accept any."""
    annual = period_type.isin("FISCAL_YEAR", "CALENDAR_YEAR")
    return ~annual | form.isin(ANNUAL_FORMS + EXHIBIT_FORMS)


def is_amendment(form: Column) -> Column:
    return form.rlike("/A$")


def company_index(payload: DataFrame) -> DataFrame:
    """fields[] and data[][] of a company list to rows; incomplete rows are dropped."""
    rows = payload.select("fields", F.explode("data").alias("row"))

    def field(name):
        return F.try_element_at("row", F.array_position("fields", name).cast("int"))

    out = rows.select(
        F.when(field("cik").isNotNull(), S.pad_cik(field("cik"))).alias("cik"), F.trim(field("name")).alias("name"),
        F.upper(F.trim(field("ticker"))).alias("ticker"), F.trim(field("exchange")).alias("exchange"))
    return out.where("cik <> '' AND name <> '' AND ticker <> ''")


def submission_rows(submissions: DataFrame, key: str = "cik") -> DataFrame:
    """Parallel filing arrays to one row per filing; rows without accession or form are dropped."""
    names = ["accession", "form", "filing_date", "report_date", "primary_document"]
    rows = submissions.select(key, F.inline(F.arrays_zip(*[F.col(f"recent.{n}").alias(n) for n in names])))
    kept = rows.where("coalesce(accession, '') <> '' AND coalesce(form, '') <> ''")
    return kept.dropDuplicates([key, "accession", "primary_document"]).withColumn("category", filing_category(F.col("form")))


def financial_filings(*inventories: DataFrame) -> DataFrame:
    """Financial forms of the recent and archived inventories, one row per accession."""
    rows = reduce(lambda a, b: a.unionByName(b), [
        df.withColumn("__part", F.lit(i)) for i, df in enumerate(inventories)])
    chosen = rows.withColumn("form", F.upper("form")).where(F.col("form").isin(FINANCIAL_FORMS) & (F.col("accession") != ""))
    once = top_n_per_key(chosen, ["cik", "accession"], [F.col("__part"), F.col("primary_document")]).drop("__part")
    return once.withColumns({
        "amendment": is_amendment(F.col("form")),
        "source_id": F.concat_ws(":", F.lit("FILED"), "cik", "accession"),
        "source_hash": F.sha2(F.concat_ws(":", "cik", "accession", "primary_document"), 256),
    })


def inventory_complete(submissions: DataFrame) -> DataFrame:
    """Whether form, accession and report-date arrays are aligned and filled, and all archives are loaded."""
    forms, accessions, dates = F.col("recent.form"), F.col("recent.accession"), F.col("recent.report_date")
    aligned = (F.size(forms) == F.size(accessions)) & (F.size(forms) == F.size(dates))
    filled = F.forall(F.arrays_zip(forms.alias("f"), accessions.alias("a"), dates.alias("d")),
                      lambda r: r["f"].isNotNull() & r["a"].isNotNull() & r["d"].isNotNull())
    present = F.coalesce(aligned & filled, F.lit(False))
    return submissions.select(
        "cik", present.alias("recent_present"), (present & (F.col("archives_loaded") == F.col("archives_listed"))).alias("complete"))


def filter_filings(df: DataFrame, categories=None, start=None, end=None, text: str = "") -> DataFrame:
    if categories:
        df = df.where(filing_category(F.col("form")).isin(categories))
    if start:
        df = df.where(F.col("filing_date") >= F.to_date(F.lit(start)))
    if end:
        df = df.where(F.col("filing_date") <= F.to_date(F.lit(end)))
    if text.strip():
        columns = [c for c in ("form", "filing_date", "report_date", "description", "accession", "title", "quarter", "provider")
                   if c in df.columns]
        needle = text.strip().lower()
        found = reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c).cast("string")).contains(needle), F.lit(False)) for c in columns])
        df = df.where(found)
    return df


def filings_from_year(df: DataFrame, year: int) -> DataFrame:
    seen = F.year(F.coalesce("report_date", "filing_date"))
    return df.where(F.col("form").isin(FINANCIAL_FORMS) & (seen.isNull() | (seen >= year)))


def order_filings(df: DataFrame) -> DataFrame:
    return df.orderBy(category_rank(filing_category(F.col("form"))), F.desc("filing_date"))


def order_inventory(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("filing_date"), F.desc("accession"))


def category_counts(df: DataFrame) -> DataFrame:
    """Filings per issuer and group, zero where an issuer has none."""
    counts = df.groupBy("cik").agg(*[
        F.count_if(filing_category(F.col("form")) == g).alias(g) for g in FILING_GROUPS])
    return counts.unpivot(["cik"], list(FILING_GROUPS), "category", "n")


def latest_by_category(df: DataFrame, category: str) -> DataFrame:
    return top_n_per_key(df.where(filing_category(F.col("form")) == category), ["cik"], [F.desc("filing_date"), F.desc("accession")])


def latest_annual_and_later_quarters(df: DataFrame) -> DataFrame:
    annual = latest_by_category(df, "10-K")
    start = annual.select("cik", F.col("filing_date").alias("__from"))
    quarters = df.where(filing_category(F.col("form")) == "10-Q").join(start, "cik").where("filing_date >= __from").drop("__from")
    return annual.unionByName(quarters)


def attach_filing(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """Left join of facts with their filing; the join strategy is left to the optimizer and its size statistics."""
    side = filings.select("accession", F.col("report_date").alias("filing_report_date"), F.col("url").alias("filing_url"),
                          F.col("source_id").alias("filing_source_id"))
    return facts.join(side, "accession", "left")


def search_companies(companies: DataFrame, query: str, limit: int = 12) -> DataFrame:
    """Best matches of one query by score, then name."""
    scored = companies.withColumn("score", S.company_score(F.col("name"), F.col("ticker"), F.lit(query.strip())))
    return scored.where("score > 0").orderBy(F.desc("score"), "name").limit(limit)


def resolve_company(companies: DataFrame, queries: list[str]) -> DataFrame:
    """One company per query: exact ticker or id first, else the best score. Linear in the companies."""
    asked = F.explode(F.array(*[F.lit(q.strip()) for q in queries])).alias("query")
    pairs = companies.select("*", asked)
    q = F.col("query")
    exact = (F.lower("ticker") == F.lower(q)) | (q.rlike(r"^\d+$") & (F.col("cik") == S.pad_cik(q)))
    scored = pairs.withColumns({"exact": exact, "score": S.company_score(F.col("name"), F.col("ticker"), q)})
    return top_n_per_key(scored.where("exact OR score > 0"), ["query"], [F.desc("exact"), F.desc("score"), F.col("name"), F.col("cik")])


def filing_eligible(filings: DataFrame, existing: DataFrame, metrics: list[str]) -> DataFrame:
    """Filings that can bring something newer than the facts already known per issuer and metric."""
    # one row per issuer: a conditional maximum per metric keeps this a single combined aggregate
    latest = existing.groupBy("ticker").agg(
        F.max("period_end").alias("__end"), F.max("filing_date").alias("__filed"),
        *[F.max(F.when(F.col("metric") == m, F.col("period_end"))).alias(f"__end_{m}") for m in metrics])
    joined = filings.where(F.col("form").isin(SUPPORTED_FORMS)).join(latest, "ticker", "left")
    newer = reduce(lambda a, b: a | b, [
        F.when(F.col(f"__end_{m}").isNotNull(), F.col("report_date") > F.col(f"__end_{m}")).otherwise(F.col("report_date") >= F.col("__end"))
        for m in metrics])
    direct = F.col("report_date").isNotNull() & (F.col("__end").isNull() | newer)
    other = F.col("__filed").isNull() | (F.col("filing_date") >= F.col("__filed"))
    keep = F.when(F.col("form").isin(DIRECT_FORMS), direct).otherwise(other)
    return joined.where(keep).drop("__end", "__filed", *[f"__end_{m}" for m in metrics])


def filings_near_gap(filings: DataFrame, gaps: DataFrame, width: int = 120) -> DataFrame:
    """Filings that may fill a missing range of the same issuer.

    The report date lies within 35 days before to 130 after the gap or within 130 days of its end, or the
    filing came within 190 days (280 for trailing twelve months) after it. Both date windows are cut into
    buckets that join by equality.
    """
    allowed = F.when(F.col("purpose") == "LTM", 280).otherwise(190)
    low = F.least(F.date_sub("gap_start", 35), F.date_sub("gap_end", 130))

    def buckets(a, b):
        return F.sequence(F.floor(F.unix_date(a) / width), F.floor(F.unix_date(b) / width))

    windows = F.array(
        F.struct(F.lit("report").alias("kind"), buckets(low, F.date_add("gap_end", 130)).alias("b")),
        F.struct(F.lit("filed").alias("kind"), buckets(F.col("gap_end"), F.date_add("gap_end", allowed)).alias("b")))
    wanted = gaps.select("*", F.inline(windows)).select("*", F.explode("b").alias("bucket")).drop("b")
    dated = F.array(
        F.struct(F.lit("report").alias("kind"), F.col("report_date").alias("__day")),
        F.struct(F.lit("filed").alias("kind"), F.col("filing_date").alias("__day")))
    offered = filings.select("*", F.inline(dated)).where("__day IS NOT NULL").withColumn("bucket", F.floor(F.unix_date("__day") / width))
    day = F.col("__day")
    by_report = (F.col("kind") == "report") & day.between(low, F.date_add("gap_end", 130)) & (
        day.between(F.date_sub("gap_start", 35), F.date_add("gap_end", 130)) | (F.abs(F.datediff(day, "gap_end")) <= 130))
    by_filed = (F.col("kind") == "filed") & day.between(F.col("gap_end"), F.date_add("gap_end", allowed))
    pairs = offered.join(wanted, ["ticker", "kind", "bucket"]).where(by_report | by_filed)
    return pairs.drop("kind", "bucket", "__day").dropDuplicates(["gap_id", "accession"])


def filing_gap_score(earnings_evidence: Column) -> Column:
    """Lower is better: days from the gap, with bonuses for forms that usually hold the missing period."""
    distance = F.coalesce(
        F.abs(F.datediff("report_date", "gap_end")), F.abs(F.datediff("filing_date", "gap_end")) + 60, F.lit(10_000))
    form = F.col("form")
    long_gap = F.coalesce(F.datediff("gap_end", "gap_start") > 180, F.lit(False))

    def bonus(condition, points):
        return F.when(condition, points).otherwise(0)

    return (distance - bonus(form.isin(DIRECT_FORMS), 80) - bonus(form.isin(ANNUAL_FORMS) & long_gap, 35)
            - bonus(form.isin(EXHIBIT_FORMS) & earnings_evidence, 70) - bonus(is_amendment(form), 5))


def rank_targeted_filings(filings: DataFrame, gaps: DataFrame, evidence: Column, k: int = 6) -> DataFrame:
    near = filings_near_gap(filings, gaps).withColumn("score", filing_gap_score(evidence))
    return top_n_per_key(near, ["gap_id"], [F.col("score"), F.desc("filing_date"), F.desc("accession")], k, rank="pick")


def companion_reports(filings: DataFrame, years: list[int]) -> DataFrame:
    """Current reports that go with a quarterly, an annual, or the first quarter after a year."""
    newest = [F.desc("filing_date"), F.desc("accession")]
    annual = top_n_per_key(filings.where(F.col("form").isin(ANNUAL_FORMS + REGISTRATION_FORMS)), ["cik"], newest, 4, rank="bucket")
    quarterly = top_n_per_key(filings.where(F.col("form").isin("10-Q", "10-Q/A")), ["cik"], newest, 4, rank="bucket")
    current = filings.where(F.col("form").isin(CURRENT_FORMS)).select("cik", "accession", "filing_date")

    def anchor(df):
        return df.select("cik", F.col("accession").alias("anchor"), F.col("filing_date").alias("anchor_date"),
                         F.col("report_date").alias("anchor_report"), "bucket")

    near = range_match(current, anchor(quarterly), ["cik"], "filing_date", "anchor_date", 2)
    own = F.when(F.col("accession").startswith(F.col("cik")), 0).otherwise(1)
    q = top_n_per_key(near, ["cik", "anchor"], [own, *newest], 2, rank="pick").withColumn("kind", F.lit("quarterly"))
    # at most four annual filings per issuer meet its current reports
    inside = current.join(anchor(annual), "cik").where("filing_date > anchor_report AND filing_date <= anchor_date")
    a = top_n_per_key(inside, ["cik", "anchor"], [F.datediff("anchor_date", "filing_date"), *newest], 4, rank="pick").withColumn("kind", F.lit("annual"))
    first_quarter = current.where(F.month("filing_date").between(1, 3) & (F.year("filing_date") - 1).isin(years)).withColumn(
        "bucket", F.array_position(F.array(*[F.lit(y) for y in years]), F.year("filing_date") - 1).cast("int"))
    y = top_n_per_key(first_quarter, ["cik", "bucket"], newest, 2, rank="pick").withColumn("kind", F.lit("year")).withColumn(
        "anchor", F.lit(None).cast("string"))
    columns = ["cik", "kind", "anchor", "bucket", "pick", "accession"]
    return q.select(columns).unionByName(a.select(columns)).unionByName(y.select(columns))


def interleave_buckets(rows: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """Round robin over buckets: all first picks, then all second picks, up to the cap per key."""
    return top_n_per_key(rows, keys, [F.col("pick"), F.col("bucket"), F.col("accession")], cap, rank="position")


def select_supplemental_filings(filings: DataFrame, years: list[int], cap: int = 36) -> DataFrame:
    """Filings worth reading per issuer, best first, at most ``cap``.

    Every list of candidates gets a class and a rank; an accession keeps its best place.
    """
    eligible = filings.where(
        F.col("form").isin(FINANCIAL_FORMS) & (F.year(F.coalesce("report_date", "filing_date")) >= min(years) - 1))
    newest = [F.desc("filing_date"), F.desc("accession")]

    def place(df, klass, first, second=F.lit(0)):
        return df.select("cik", "accession", F.struct(F.lit(klass).alias("c"), first.cast("bigint").alias("a"), second.cast("bigint").alias("b")).alias("place"))

    age = -F.unix_date("filing_date")
    current = eligible.where(F.col("form").isin(CURRENT_FORMS))
    quarterly = top_n_per_key(eligible.where(F.col("form").isin("10-Q", "10-Q/A")), ["cik"], newest, 4, rank="r")
    annual = top_n_per_key(eligible.where(F.col("form").isin(ANNUAL_FORMS + REGISTRATION_FORMS)), ["cik"], newest, min(4, cap), rank="r")
    companions = companion_reports(eligible, years)

    def of(kind):
        return companions.where(F.col("kind") == kind)

    places = [
        place(quarterly, 1, F.col("r")), place(of("quarterly"), 2, F.col("bucket"), F.col("pick")),
        place(top_n_per_key(current, ["cik"], newest, 6, rank="r"), 3, F.col("r")), place(annual, 4, F.col("r")),
        place(of("annual"), 5, F.col("pick"), F.col("bucket")), place(of("year"), 6, F.col("pick"), F.col("bucket")),
        place(current, 7, age), place(eligible, 8, age),
    ]
    best = reduce(lambda a, b: a.unionByName(b), places).groupBy("cik", "accession").agg(F.min("place").alias("place"))
    return top_n_per_key(best, ["cik"], [F.col("place"), F.desc("accession")], cap, rank="position").drop("place")


def search_completeness(filings: DataFrame, examined: DataFrame, years: list[int]) -> DataFrame:
    """Per issuer and year: relevant and examined filings, and whether the search covered all of them."""
    seen = F.year(F.coalesce("report_date", "filing_date"))
    eligible = filings.where(F.col("form").isin(FINANCIAL_FORMS) & (seen >= min(years) - 1))
    marked = eligible.join(examined.select("cik", "accession", F.lit(True).alias("__done")), ["cik", "accession"], "left")
    spread = marked.withColumn("year", F.explode(F.filter(F.array(*[F.lit(y) for y in years]), lambda y: F.abs(y - seen) <= 1)))
    return spread.groupBy("cik", "year").agg(
        F.count("*").alias("relevant"), F.count("__done").alias("examined"),
        (F.count("*") - F.count("__done")).alias("excluded"), (F.count("*") == F.count("__done")).alias("completed"))


def filings_for_call(calls: DataFrame, filings: DataFrame, days: int = 18, k: int = 4) -> DataFrame:
    """Filings nearest to a call, one per form, at most ``k``."""
    near = range_match(calls, filings, ["ticker"], "call_date", "filing_date", days).withColumn(
        "distance", F.abs(F.datediff("call_date", "filing_date")))
    rank = F.array_position(F.array(*[F.lit(f) for f in CALL_FORM_ORDER]), F.col("form"))
    per_form = top_n_per_key(near, ["call_id", "form"], [F.col("distance"), F.col("accession")])
    return top_n_per_key(per_form, ["call_id"], [F.col("distance"), rank, F.col("accession")], k, rank="pick")
