"""Keyed helpers shared by the operators.

``top_n_per_key`` keeps a rank filter right above its window, so Spark puts a group limit before the
shuffle: no map task sends more than n rows of a key, and a key that holds a third of the table costs no
more than any other. ``range_match`` turns a day-distance join into an equi join on day buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("__rank", F.row_number().over(window)).where(F.col("__rank") <= n)
    return ranked.withColumnRenamed("__rank", rank) if rank else ranked.drop("__rank")


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed exactly once per row.

    A filter on a computed column is pushed below its projection and takes the whole expression along, column by
    column; long chains grow without bound. A generator over one struct stops that.
    """
    return df.select("*", F.inline(F.array(F.struct(*[column.alias(name) for name, column in columns.items()]))))


def prefer(preferred: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which a key present in the preferred side hides the fallback rows of that key."""
    both = preferred.withColumn("__side", F.lit(0)).unionByName(fallback.withColumn("__side", F.lit(1)))
    return top_n_per_key(both, keys, [F.col("__side")]).drop("__side")


def latest_wins(store: DataFrame, new: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Merge of two versions of a keyed table; the newer row of a key stays, the new side on a tie."""
    both = store.withColumn("__side", F.lit(1)).unionByName(new.withColumn("__side", F.lit(0)))
    return top_n_per_key(both, keys, [F.desc(by), F.col("__side")]).drop("__side")


def first_true(*cases: tuple[Column, Column | str]) -> Column:
    """Value of the first condition that holds."""
    return reduce(lambda acc, case: acc.when(case[0], case[1]), cases[1:], F.when(cases[0][0], cases[0][1]))


def range_match(
    left: DataFrame, right: DataFrame, keys: list[str], left_day: str, right_day: str, days: int, how: str = "inner"
) -> DataFrame:
    """Join rows with equal keys whose days lie at most ``days`` apart.

    Days go into buckets of ``days + 1``. Every left row looks into its own and both neighbouring buckets,
    so the join has an equality on the bucket and each pair meets exactly once.
    """
    width = days + 1
    right_renamed = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    bucketed = right_renamed.withColumn("__bucket", F.floor(F.unix_date(right_day) / width))
    own = F.floor(F.unix_date(F.col(left_day)) / width)
    if how == "inner":
        probe = left.withColumn("__bucket", F.explode(F.array(own - 1, own, own + 1)))
        match = [F.col(k) == F.col(f"__r_{k}") for k in keys]
        match += [probe["__bucket"] == bucketed["__bucket"], F.abs(F.datediff(F.col(left_day), F.col(right_day))) <= days]
        return probe.join(bucketed, reduce(lambda a, b: a & b, match)).drop("__bucket", *[f"__r_{k}" for k in keys])
    # left, left_semi and left_anti: replicate the right side instead, so that a left row stays one row
    probe = left.withColumn("__lbucket", own)
    spread = bucketed.withColumn("__bucket", F.explode(F.array(F.col("__bucket") - 1, F.col("__bucket"), F.col("__bucket") + 1)))
    match = [F.col(k) == F.col(f"__r_{k}") for k in keys]
    match += [F.col("__lbucket") == F.col("__bucket"), F.abs(F.datediff(F.col(left_day), F.col(right_day))) <= days]
    joined = probe.join(spread, reduce(lambda a, b: a & b, match), how).drop("__lbucket")
    return joined.drop("__bucket", *[f"__r_{k}" for k in keys])


def as_of(
    targets: DataFrame, facts: DataFrame, key: str, target: str, day: str, values: list[str], found_day: str = "found_day"
) -> DataFrame:
    """Last fact on or before each target day.

    ``facts`` holds one row per key and day. Targets are reduced to distinct key-days first, so the window of a
    key never holds more than two rows per calendar day, however many rows ask for the same day.
    """
    asked = targets.select(F.col(key), F.col(target).alias("__day")).distinct()
    none = F.lit(None)
    point = F.struct(F.col(day).alias(found_day), *[F.col(v) for v in values])
    known = facts.select(F.col(key), F.col(day).alias("__day"), point.alias("__point"), F.lit(0).alias("__asks"))
    marks = asked.select(key, "__day", none.cast(known.schema["__point"].dataType).alias("__point"), F.lit(1).alias("__asks"))
    window = Window.partitionBy(key).orderBy("__day", "__asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (
        known.unionByName(marks)
        .withColumn("__point", F.last("__point", ignorenulls=True).over(window))
        .where("__asks = 1")
        .select(F.col(key), F.col("__day").alias(target), "__point.*")
    )
    return targets.join(found, [key, target], "left")


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int = 10_000) -> DataFrame:
    """Running sum per key in the order of an integer column.

    Positions are cut into ranges of ``width``; the ranges of a key are summed apart and their totals carried over,
    so a key that holds a large part of the table is still spread over many tasks.
    """
    rows = df.withColumns({"__v": value.cast("bigint"), "__range": F.floor(F.col(order) / width)})
    totals = rows.groupBy(*keys, "__range").agg(F.sum("__v").alias("__total"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "__range", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__carried"))
    inside = Window.partitionBy(*keys, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("__inside", F.sum("__v").over(inside)).join(carried, [*keys, "__range"])
    return summed.withColumn(name, F.col("__inside") + F.col("__carried")).drop("__v", "__range", "__inside", "__carried")
