"""Company universe: flattening, issuer classes, peers and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.keyed import top_n_per_key

# Exchange of a ticker suffix.
EXCHANGES = {
    "PA": "Euronext Paris", "L": "London", "T": "Tokyo", "DE": "Xetra", "ST": "Stockholm", "SZ": "Shenzhen",
    "SS": "Shanghai", "HK": "Hong Kong",
}
# Suffixes of listings outside the filing system.
FOREIGN_SUFFIXES = "KS|KQ|TW|T|SZ|SS|HK|L|PA|DE|SW|ST|MI|AS"


def flatten_universe(maps: DataFrame) -> DataFrame:
    """map -> layers[] -> companies[] to rows; public companies, first occurrence per ticker."""
    layers = maps.select("map_pos", "map_name", F.posexplode("layers").alias("layer_pos", "layer"))
    rows = layers.select("map_pos", "map_name", "layer_pos", F.col("layer.name").alias("layer"),
                         F.posexplode("layer.companies").alias("company_pos", "c"))
    public = rows.where("c.type = 'Public' AND coalesce(c.ticker, '') <> ''").select(
        "map_pos", "map_name", "layer_pos", "layer", "company_pos", "c.*")
    return top_n_per_key(public, ["ticker"], [F.col("map_pos"), F.col("layer_pos"), F.col("company_pos")])


def exchange_from_suffix(ticker: Column) -> Column:
    suffix = F.substring_index(ticker, ".", -1)
    out = F.lit("US listed")
    for key, name in EXCHANGES.items():
        out = F.when(ticker.contains(".") & (suffix == key), name).otherwise(out)
    return out


def is_tradable(kind: Column, ticker: Column) -> Column:
    return F.coalesce((kind == "Public") & (ticker != "") & ~ticker.isin("N/A", "Private"), F.lit(False))


def classify_issuers(companies: DataFrame, filings: DataFrame, etfs=(), pre_ipo=(), spinoffs=()) -> DataFrame:
    """Issuer class from lists, the registrant id and the forms filed."""
    forms = F.upper("form")
    flags = filings.groupBy("cik").agg(
        F.bool_or(forms.isin("20-F", "20-F/A", "40-F")).alias("foreign_annual"),
        F.bool_or(forms == "6-K").alias("has_6k"), F.bool_or(forms == "10-K").alias("has_10k"))
    ticker = F.upper(F.trim("ticker"))

    def listed(names):
        return ticker.isin(list(names)) if names else F.lit(False)

    foreign = F.coalesce(F.col("foreign_annual") | (F.col("has_6k") & ~F.col("has_10k")), F.lit(False))
    label = (
        F.when(listed(etfs), "ETF")
        .when(F.col("cik").isNull() & ticker.rlike(rf"(?i)\.(?:{FOREIGN_SUFFIXES})$"), "NON_SEC_SECURITY")
        .when(F.col("cik").isNull(), "OUT_OF_SEC_SCOPE")
        .when(listed(pre_ipo), "PRE_IPO_OR_REGISTRATION_HISTORY").when(listed(spinoffs), "SPINOFF_OR_PREDECESSOR")
        .when(foreign, "FOREIGN_PRIVATE_ISSUER").otherwise("SEC_OPERATING_COMPANY"))
    status = F.when(label == "ETF", "ETF_NOT_APPLICABLE").when(label.isin("NON_SEC_SECURITY", "OUT_OF_SEC_SCOPE"), "OUT_OF_SEC_SCOPE")
    out = companies.join(flags, "cik", "left").withColumn("classification", label)
    return out.withColumn("financial_status", status).drop("foreign_annual", "has_6k", "has_10k")


def layer_peers(universe: DataFrame, focal: DataFrame) -> DataFrame:
    """Peers of every given focal company in its layer. The output grows with focal companies times layer size, so ask for few."""
    centre = focal.select("map_name", "layer", F.col("ticker").alias("focal"))
    return universe.join(centre, ["map_name", "layer"]).where("ticker <> focal")


def peer_table(universe: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """All tradable companies of each layer with their fundamentals, empty where unknown."""
    members = universe.where(is_tradable(F.col("type"), F.col("ticker")))
    return members.join(fundamentals, "ticker", "left")


def locate_company(wanted: DataFrame, universe: DataFrame) -> DataFrame:
    """Place of each wanted ticker in a map: the preferred layer if it is there, else the first layer."""
    pairs = wanted.join(universe, ["map_name", "ticker"])
    preferred = F.when(F.col("layer_pos") == F.col("preferred_layer"), 0).otherwise(1)
    return top_n_per_key(pairs, ["map_name", "ticker"], [preferred, F.col("layer_pos"), F.col("company_pos")])


def map_stats(universe: DataFrame) -> DataFrame:
    return universe.groupBy("map_name").agg(F.count("*").alias("companies"), F.count_distinct("layer").alias("layers"))


def distinct_tickers(texts: DataFrame, column: str) -> DataFrame:
    """Tickers typed into a box: split on commas and blanks, upper case, distinct."""
    return texts.select(F.explode(F.split(F.upper(F.col(column)), r"[,\s]+")).alias("ticker")).where("ticker <> ''").distinct()


def default_lists(universe: DataFrame) -> DataFrame:
    """Named lists: one row per list and category with its size and first position; members stay rows."""
    return universe.groupBy("map_name", "layer").agg(
        F.count("*").alias("members"), F.min(F.struct("layer_pos", "company_pos"))["layer_pos"].alias("layer_pos"))


def table_query(df: DataFrame, text: str = "", category: str = "all", country: str = "all", exchange: str = "all",
                sort: str = "ticker", ascending: bool = True) -> DataFrame:
    """Filter and sort of the table; empty cells come last in either direction."""
    if text.strip():
        needle = text.strip().lower()
        df = df.where(F.lower("company").contains(needle) | F.lower("ticker").contains(needle))
    for column, wanted in (("layer", category), ("country", country), ("exchange", exchange)):
        if wanted != "all":
            df = df.where(F.col(column) == wanted)
    order = F.asc_nulls_last(sort) if ascending else F.desc_nulls_last(sort)
    return df.orderBy(order, "ticker")
