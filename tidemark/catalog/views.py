"""Shared views over the test tables, shaped like the data the operators expect."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import written

METRICS = ["revenue", "costOfRevenue", "operatingCashFlow", "capitalExpenditures", "ebit", "adjustedEbitda"]

OBS_COLS = [
    "source_id", "ticker", "metric", "period_type", "start_date", "end_date", "authority", "fiscal_year",
    "fiscal_quarter", "calendar_id", "value", "currency", "unit", "provider", "filed", "accession", "form",
    "scope", "op_scope", "basis", "method", "definition", "restated",
]


def cache(view: Callable) -> Callable:
    """Remembers a view's DataFrame for as long as its ``Views`` object lives."""

    @wraps(view)
    def remembered(self, *args):
        key = (view.__name__, *args)
        if key not in self.known:
            self.known[key] = view(self, *args)
        return self.known[key]

    return remembered


class Views:
    """Views of one scale-factor folder; every view is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir
        self.known: dict[tuple, DataFrame] = {}
        self.counts: dict[str, int] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def dealt(self, df: DataFrame, key: str, per_task: int = 200_000) -> DataFrame:
        """Rows made from line items, by key, on a number of tasks in proportion to the line items that the files' footers count."""
        if "lines" not in self.counts:
            self.counts["lines"] = self.table("lineitem").count()
        return df.repartition(max(self.spark.sparkContext.defaultParallelism, -(-self.counts["lines"] // per_task)), key)

    def keep(self, view: str) -> None:
        """Writes the rows of a view once, for a query that asks for it several times; call it before views that rest on it."""
        if ("kept", view) not in self.known:
            self.known[("kept", view)] = self.known[(view,)] = written(getattr(self, view)(), view)

    @staticmethod
    def _key(col: str, prefix: str = "S"):
        return F.concat(F.lit(prefix), F.lpad(F.col(col).cast("string"), 10, "0"))

    @cache
    def lines(self) -> DataFrame:
        money = "decimal(18,2)"
        return self.table("lineitem").select(
            self._key("l_suppkey").alias("ticker"), "l_orderkey", "l_partkey", "l_linenumber",
            F.to_date("l_shipdate").alias("day"),
            F.col("l_extendedprice").cast(money).alias("ext"), F.col("l_discount").cast(money).alias("disc"),
            F.col("l_quantity").cast(money).alias("qty"), F.col("l_tax").cast(money).alias("tax"),
            "l_returnflag", "l_linestatus",
        )

    @cache
    def prices(self) -> DataFrame:
        daily = self.lines().groupBy("ticker", "day").agg(
            F.sum("ext").cast("double").alias("sum_ext"), F.sum("qty").cast("double").alias("sum_qty"),
            F.sum("disc").cast("double").alias("sum_disc"), F.count("*").cast("double").alias("n"),
            F.floor(F.sum("qty")).cast("bigint").alias("volume"),
        )
        close = F.col("sum_ext") / F.col("sum_qty")
        return daily.select(
            "ticker", "day", close.alias("close"),
            (close * (F.lit(1.0) - F.col("sum_disc") / F.col("n"))).alias("adj_close"), "volume",
        )

    @cache
    def universe(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        # nation and region have one row per country and continent
        return (
            self.table("supplier")
            .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("r_regionkey").alias("map_pos"), F.col("r_name").alias("map_name"),
                F.col("n_nationkey").alias("layer_pos"), F.col("n_name").alias("layer"),
                F.col("s_suppkey").alias("company_pos"), F.col("s_name").alias("company"),
                self._key("s_suppkey").alias("ticker"),
                F.when(F.col("s_acctbal") < 0, "Private").otherwise("Public").alias("type"),
                F.col("n_name").alias("country"),
            )
        )

    @cache
    def issuers(self) -> DataFrame:
        return (
            self.table("supplier")
            .join(F.broadcast(self.table("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                self._key("s_suppkey").alias("ticker"), F.col("n_regionkey").alias("region_key"),
                F.when(F.col("n_regionkey") == 1, 3).when(F.col("n_regionkey") == 2, 6)
                .when(F.col("n_regionkey") == 3, 9).otherwise(12).alias("fye_month"),
            )
        )

    @cache
    def quarter_wide(self) -> DataFrame:
        zero = F.lit(0).cast("decimal(18,2)")

        def total(expr):
            return F.floor(F.sum(expr)).cast("double")

        ext = F.col("ext")
        return (
            self.lines()
            .groupBy("ticker", F.trunc("day", "quarter").alias("start_date"))
            .agg(
                total(ext * (F.lit(1).cast("decimal(18,2)") - F.col("disc"))).alias("revenue"),
                total(F.when(F.col("l_linestatus") == "F", ext).otherwise(zero)).alias("costOfRevenue"),
                total(F.when(F.col("l_returnflag") != "A", ext).otherwise(zero)).alias("operatingCashFlow"),
                total(F.when(F.col("l_returnflag") == "A", ext).otherwise(zero)).alias("capitalExpenditures"),
                total(ext * F.col("disc")).alias("ebit"), total(ext * F.col("tax")).alias("adjustedEbitda"),
                F.count("*").alias("n"),
            )
        )

    @cache
    def quarters(self) -> DataFrame:
        return (
            self.quarter_wide()
            .unpivot(["ticker", "start_date", "n"], METRICS, "metric", "value")
            .select(
                "ticker", "metric", "start_date",
                F.date_sub(F.add_months("start_date", 3), 1).alias("end_date"), "value", "n",
            )
        )

    @cache
    def fiscal(self) -> DataFrame:
        month, fye = F.month("end_date"), F.col("fye_month")
        # narrow rows here become wide ones without another shuffle, so tasks are counted by rows, not by bytes
        return self.dealt(self.quarters().join(self.issuers(), "ticker"), "ticker").select(
            "ticker", "metric", "start_date", "end_date", "value", "n", "fye_month", "region_key",
            (F.year("end_date") + F.when(month > fye, 1).otherwise(0)).alias("fiscal_year"),
            F.when(month == fye, 4).otherwise(((month - fye + 12) % 12 / 3)).cast("int").alias("fiscal_quarter"),
        )

    @cache
    def cumulative(self) -> DataFrame:
        w = (
            Window.partitionBy("ticker", "metric", "fiscal_year").orderBy("fiscal_quarter")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        return self.fiscal().select(
            "ticker", "metric", "fye_month", "region_key", "fiscal_year", "fiscal_quarter", "end_date",
            F.min("start_date").over(w).alias("start_date"), F.sum("value").over(w).alias("value"),
            F.sum("n").over(w).alias("n"), F.count("*").over(w).alias("filled"),
        ).where("filled = fiscal_quarter")

    @staticmethod
    def _calendar():
        return F.concat(F.lit("FYE"), F.lpad(F.col("fye_month").cast("string"), 2, "0"))

    @cache
    def obs(self) -> DataFrame:
        cum = self.cumulative()
        fq = F.col("fiscal_quarter")

        def filing(period_type, days, suffix, form, value, restated):
            return F.struct(
                period_type.alias("period_type"), F.date_add("end_date", days).alias("filed"), suffix.alias("suffix"),
                form.alias("form"), value.alias("value"), F.lit(restated).alias("restated"),
            )

        first = filing(
            F.when(fq == 1, "STANDALONE_QUARTER").when(fq == 2, "YTD_6M").when(fq == 3, "YTD_9M").otherwise("FISCAL_YEAR"),
            F.when(fq == 4, 75).otherwise(40), fq, F.when(fq == 4, "10-K").otherwise("10-Q"), F.col("value"), False,
        )
        again = filing(F.lit("FISCAL_YEAR"), F.lit(440), F.lit(9), F.lit("10-K/A"), F.col("value") + F.col("n"), True)
        # the later filing of some years comes out of the same pass
        filings = F.array_compact(F.array(first, F.when((fq == 4) & F.col("region_key").isin(1, 2), again)))
        rows = cum.select(
            "ticker", "metric", "fye_month", "fiscal_year", "fiscal_quarter", "start_date", "end_date", F.inline(filings))
        accession = F.concat(
            F.substring("ticker", 2, 10), F.lit("-"), F.date_format("filed", "yy"), F.lit("-"),
            F.lpad((F.col("fiscal_year") * 10 + F.col("suffix")).cast("string"), 6, "0"),
        )
        return rows.withColumn("accession", accession).select(
            F.concat(F.lit("FILED:"), "accession", F.lit(":"), "metric").alias("source_id"), "ticker", "metric", "period_type",
            "start_date", "end_date", F.lit("REPORTED").alias("authority"), "fiscal_year", "fiscal_quarter",
            self._calendar().alias("calendar_id"), "value", F.lit("USD").alias("currency"), F.lit("USD").alias("unit"),
            F.lit("FILED").alias("provider"), "filed", "accession", "form", F.lit("CONSOLIDATED").alias("scope"),
            F.lit("UNSPECIFIED").alias("op_scope"), F.lit("REPORTED").alias("basis"), F.lit(None).cast("string").alias("method"),
            F.concat(F.lit("DEF_"), "metric").alias("definition"), "restated",
        ).select(*OBS_COLS)

    @cache
    def provider(self) -> DataFrame:
        shift = F.dayofweek("end_date") - 1
        return self.fiscal().select(
            F.concat(F.lit("STD:"), F.col("ticker"), F.lit(":"), F.col("metric"), F.lit(":"),
                     F.date_format("end_date", "yyyy-MM-dd")).alias("source_id"),
            "ticker", "metric", F.lit("STANDALONE_QUARTER").alias("period_type"),
            F.date_sub("start_date", shift).alias("start_date"), F.date_sub("end_date", shift).alias("end_date"),
            F.lit("INFERRED").alias("authority"), "fiscal_year", "fiscal_quarter", self._calendar().alias("calendar_id"),
            F.when(F.col("fiscal_quarter") == 3, F.floor(F.col("value") * 1.25).cast("double"))
            .otherwise(F.col("value")).alias("value"),
            F.lit("USD").alias("currency"), F.lit("USD").alias("unit"), F.lit("STANDARDIZED").alias("provider"),
            F.date_add("end_date", 50).alias("filed"), F.lit(None).cast("string").alias("accession"),
            F.lit(None).cast("string").alias("form"), F.lit("CONSOLIDATED").alias("scope"),
            F.lit("UNSPECIFIED").alias("op_scope"), F.lit("REPORTED").alias("basis"),
            F.lit(None).cast("string").alias("method"), F.concat(F.lit("DEF_"), F.col("metric")).alias("definition"),
            F.lit(False).alias("restated"),
        ).select(*OBS_COLS)

    @cache
    def all_obs(self) -> DataFrame:
        return self.obs().unionByName(self.provider())

    @cache
    def ledger(self) -> DataFrame:
        obs = self.obs()
        concept = (
            F.when(F.col("metric") == "revenue", F.when(F.col("form") == "10-K", "SalesRevenueNet").otherwise("Revenues"))
            .when(F.col("metric") == "costOfRevenue", "CostOfRevenue")
            .when(F.col("metric") == "operatingCashFlow", "NetCashProvidedByUsedInOperatingActivities")
            .when(F.col("metric") == "capitalExpenditures", "PaymentsToAcquirePropertyPlantAndEquipment")
            .when(F.col("metric") == "ebit", "OperatingIncomeLoss").otherwise("AdjustedEBITDA")
        )

        def fact(namespace, concept, label, value, filed, segment):
            return F.struct(
                F.lit(namespace).alias("namespace"), concept.alias("concept"), label.alias("label"), value.alias("value"),
                filed.alias("filed"), F.lit(segment).cast("string").alias("segment"),
            )

        revenue = F.col("metric") == "revenue"
        facts = F.array_compact(F.array(
            fact("us-gaap", concept, F.col("metric"), F.col("value"), F.col("filed"), None),
            F.when(revenue, fact("company", F.lit("TotalRevenues"), F.lit("Total revenues"), F.col("value") + 7, F.date_add("filed", 10), None)),
            F.when(revenue & (F.col("form") == "10-K"), fact("us-gaap", F.lit("Revenues"), F.lit("revenue"), F.floor(F.col("value") / 2).cast("double"), F.col("filed"), "ProductLine")),
        ))
        return obs.select("ticker", "start_date", "end_date", F.lit("USD").alias("currency"), "form", "accession", F.inline(facts)).select(
            "ticker", "namespace", "concept", "label", "start_date", "end_date", "value", "currency", "form", "filed", "accession", "segment")

    @cache
    def filings(self) -> DataFrame:
        priority = F.col("o_orderpriority")
        form = (
            F.when(priority == "1-URGENT", "8-K").when(priority == "2-HIGH", "10-Q").when(priority == "3-MEDIUM", "10-K")
            .when(priority == "4-NOT SPECIFIED", "6-K").otherwise("DEF 14A")
        )
        amended = F.when((F.col("o_orderstatus") == "P") & (priority != "5-LOW"), "/A").otherwise("")
        day = F.to_date("o_orderdate")
        return self.table("orders").select(
            F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"), self._key("o_custkey", "C").alias("ticker"),
            F.concat(form, amended).alias("form"), day.alias("filing_date"),
            F.date_sub(F.trunc(day, "quarter"), 1).alias("report_date"),
            F.concat(F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.lit("-"), F.date_format(day, "yy"),
                     F.lit("-"), F.date_format(day, "yyMMdd")).alias("accession"),
            F.concat(F.lit("doc"), F.col("o_orderkey").cast("string"), F.lit(".htm")).alias("primary_document"),
            "o_orderkey",
        )

    @cache
    def cells(self) -> DataFrame:
        """Yearly metric cells, some of them empty with a status and a reason."""
        c = F.col
        years = self.cumulative().where("fiscal_quarter = 4").select("ticker", "metric", c("fiscal_year").alias("year"), "value", "region_key")

        own = lambda metric: F.max(F.when(c("metric") == metric, c("value"))).alias(metric)
        # six metrics at most meet in a group; the two differences come out of the same pass
        wide = years.groupBy("ticker", "year", "region_key").agg(
            F.collect_list(F.struct("metric", "value")).alias("reported"), own("revenue"), own("costOfRevenue"), own("operatingCashFlow"), own("capitalExpenditures"))

        def minus(left, right, name):
            value = c(left) - c(right)
            return F.when(value.isNotNull(), F.struct(F.lit(name).alias("metric"), value.alias("value")))

        derived = F.array_compact(F.array(minus("revenue", "costOfRevenue", "grossProfit"), minus("operatingCashFlow", "capitalExpenditures", "freeCashFlow")))
        rows = wide.select("ticker", "year", "region_key", F.inline(F.concat("reported", derived)))
        status = (
            F.when((c("metric") == "ebit") & (c("year") == 1997), "REQUIRES_REVIEW")
            .when((c("metric") == "adjustedEbitda") & (c("year") == 1998), "INSUFFICIENT_PERIOD_COVERAGE")
            .when(c("region_key").isin(1, 2), "VERIFIED_REPORTED").otherwise("VERIFIED_DERIVED"))
        marked = rows.withColumn("status", status)
        return marked.select(
            "ticker", "metric", "year", F.concat(c("year").cast("string"), F.lit("A")).alias("period"),
            F.when(c("status").startswith("VERIFIED"), c("value")).alias("value"), "status",
            F.when(c("status") == "REQUIRES_REVIEW", "VALUE_CONFLICT").when(c("status") == "INSUFFICIENT_PERIOD_COVERAGE", "LTM_PERIOD_GAP").alias("reason"), "region_key")

    @cache
    def estimates(self) -> DataFrame:
        back = Window.partitionBy("ticker", "metric").orderBy(F.desc("end_date"))
        forth = Window.partitionBy("ticker", "metric").orderBy("end_date")
        years = self.cumulative().where("fiscal_quarter = 4").withColumn("back", F.row_number().over(back)).where("back <= 2")
        rn = F.row_number().over(forth)
        return years.withColumn("rn", rn).select(
            "ticker", "metric", F.when(F.col("rn") == 1, "0y").otherwise("+1y").alias("period"),
            F.add_months("end_date", 12).alias("end_date"),
            F.floor(F.col("value") * F.when(F.col("rn") == 1, 1.25).otherwise(1.5)).cast("double").alias("value"),
        )

    @cache
    def blocks(self) -> DataFrame:
        role = F.col("role")
        return self.table("conversations").select(
            F.col("conv_id").alias("call_id"), F.col("turn").alias("seq"),
            F.when(role == "user", "Dana Reed").when(role == "assistant", "Kim Sato").otherwise("Operator").alias("speaker"),
            F.when(role == "user", "Analyst - Northfield Research").when(role == "assistant", "Chief Executive Officer")
            .otherwise("Operator").alias("role"), "text",
        )

    @cache
    def paragraphs(self) -> DataFrame:
        return (
            self.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
            .where(F.length(F.trim("text")) > 0)
            .select("doc_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "text")
        )
