"""Helpers shared by the operators: words, stage tables, numbering of rows inside groups, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of every operator here: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    """Words of a text: runs of characters other than white space; an empty array without words."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))


def squeezed(text: Column) -> Column:
    """The text without any white space."""
    return F.translate(text, SPACE, "")


def row_key(df: DataFrame, *seed: int) -> Column:
    """64-bit digest of all columns of a row."""
    return F.xxhash64(*[F.lit(s) for s in seed], *[F.col(f"`{c}`") for c in df.columns])


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that the session names in ``spark.checkpoint.dir``.

    Only a session inside one process may lack the setting (tests, notebooks); it gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), f"tidemark-checkpoints-{os.getpid()}")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read from there: computed once, and safe against lost executors."""
    return staged_at(df, name)[0]


def staged_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``staged``, and the folder, for tables that are removed before the work is done."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    # Spark removes the shuffle files of a finished job when the driver collects garbage, by itself twice an hour
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a staged table that no plan will read again."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def numbered(df: DataFrame, keys: list[str], by: str, ties: list[Column], out: str, bits: int = 8) -> DataFrame:
    """Gapless numbers from 0 inside each group of ``keys``, in the order of the 64-bit column ``by``, then of ``ties``.

    A group is cut into 2^bits ranges of ``by``; each range is numbered in a task of its own and moved by the rows
    of the ranges below it. ``by`` is a hash, so ranges are even and no task holds a whole group.
    """
    part = f"__{out}_part"
    cut = df.withColumn(part, F.shiftright(F.col(by), 64 - bits))
    sizes = cut.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("__n"))
    below = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, part, F.coalesce(F.sum("__n").over(below), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*keys, part).orderBy(F.col(by), *ties)
    ranked = cut.withColumn("__rank", F.row_number().over(inside) - F.lit(1))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, part]]
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    return ranked.alias("r").join(starts.alias("s"), condition).select(*[F.col(f"r.`{c}`") for c in df.columns], (F.col("__start") + F.col("__rank")).cast("long").alias(out))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected edges (u, v), where root is the smallest node of its component.

    Rounds of large and small stars: every node hands its larger, then its smaller neighbours to the smallest node it
    knows, until only stars are left. A round is a few joins and combined minima over the edges and is written to the
    shared folder; rounds grow with the logarithm of the nodes.
    """
    smaller = F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")
    spark = edges.sparkSession
    edges, path = staged_at(edges.where("u != v").select(*smaller).distinct().select("u", "v"), "components")
    while True:
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        known = ways.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = ways.join(known, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(least, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        fresh, fresh_path = staged_at(small.select("e.u", "e.v").where("u != v").distinct(), "components")
        moved = fresh.join(edges, ["u", "v"], "left_anti").limit(1).count()
        removed(spark, path)
        edges, path = fresh, fresh_path
        if not moved:
            break
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
