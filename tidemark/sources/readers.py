"""Readers of raw payloads: fixed schemas, one row per element, nothing inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import strings as S
from tidemark.operators import facts, filings, prices

INDEX_SCHEMA = "fields array<string>, data array<array<string>>"
CHART_SCHEMA = "ticker string, timestamp array<bigint>, close array<double>, adjclose array<double>, volume array<bigint>"
FACTS_SCHEMA = (
    "ticker string, facts map<string, map<string, struct<label:string, units:map<string, array<struct<start:string, `end`:string, val:double, "
    "form:string, filed:string, accn:string, fp:string, segment:string>>>>>>")
SUBMISSIONS_SCHEMA = (
    "cik string, recent struct<accession:array<string>, form:array<string>, filing_date:array<date>, report_date:array<date>, "
    "primary_document:array<string>>")
SERIES_SCHEMA = "ticker string, series map<string, array<struct<asOfDate:string, reportedValue:struct<raw:double>>>>"
RESULTS_SCHEMA = "query string, results array<struct<title:string, url:string, content:string, score:double, publishedDate:string>>"


def read_company_index(spark: SparkSession, path: str) -> DataFrame:
    return filings.company_index(spark.read.schema(INDEX_SCHEMA).json(path))


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    return filings.submission_rows(spark.read.schema(SUBMISSIONS_SCHEMA).json(path))


def read_company_facts(spark: SparkSession, path: str) -> DataFrame:
    return facts.read_company_facts(spark.read.schema(FACTS_SCHEMA).json(path))


def read_price_chart(spark: SparkSession, path: str) -> DataFrame:
    return prices.chart_points(spark.read.schema(CHART_SCHEMA).json(path))


def fundamental_series(payload: DataFrame) -> DataFrame:
    """Type-keyed series to (ticker, type, as_of, value) rows."""
    types = payload.select("ticker", F.explode("series").alias("type", "points"))
    rows = types.select("ticker", "type", F.inline("points"))
    return rows.select("ticker", "type", F.col("asOfDate").try_cast("date").alias("as_of"), F.col("reportedValue.raw").alias("value"))


def latest_compatible_ledger(store: DataFrame, version: int, as_of: Column, hours: int = 24) -> DataFrame:
    """Newest snapshot per ticker of the wanted version and age, extracted facts only."""
    age = F.timestamp_diff("SECOND", F.col("fetched"), as_of)
    fits = store.where((F.col("schema_version") == version) & age.between(-hours * 3600, hours * 3600) & (F.col("source_kind") != "COMPANY_FACTS"))
    newest = fits.groupBy("ticker").agg(F.max("fetched").alias("fetched"))
    return fits.join(newest, ["ticker", "fetched"], "left_semi")


def search_results(payload: DataFrame) -> DataFrame:
    """Result rows with host and score; the default score falls with the position."""
    rows = payload.select("query", F.posexplode("results").alias("pos", "r"))
    score = F.coalesce("r.score", F.greatest(F.lit(10) - F.col("pos"), F.lit(0)).cast("double"))
    host = S.url_host(F.col("r.url"))
    return rows.where(host.isNotNull()).select("query", "pos", "r.title", "r.url", F.col("r.content").alias("snippet"), host.alias("host"), score.alias("score"),
                                               F.col("r.publishedDate").try_cast("date").alias("published"))


def sections(files: DataFrame) -> DataFrame:
    """Markdown files (file, text) to one row per heading with its level and content."""
    parts = files.select("file", F.posexplode(F.split(F.concat(F.lit("\n"), "text"), r"\n(?=#{1,2} )")).alias("pos", "part"))
    heading = F.regexp_extract("part", r"^\s*(#{1,2}) ([^\n]*)", 2)
    level = F.length(F.regexp_extract("part", r"^\s*(#{1,2}) ", 1))
    body = F.trim(F.regexp_replace("part", r"^\s*#{1,2} [^\n]*\n?", ""))
    return parts.select("file", "pos", F.trim(heading).alias("heading"), level.alias("level"), body.alias("content")).where("level > 0")


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    return sections(files)
