"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in blocks. A uniform permutation of the whole table sends a random number of a block's rows to each shard;
these numbers follow the multivariate hypergeometric law. They are drawn first, for all blocks, so that every column of
the matrix sums to its shard's exact size. Then each block is permuted and cut by its row of the matrix, rows move to
their shards, and each shard is permuted again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import numbered, row_key


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also inside lambda functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) out of 53 bits of a hash."""
    return (F.xxhash64(*parts).bitwiseAND(F.lit(2**53 - 1)).cast("double") + 0.5) / F.lit(float(2**53))


def hypergeometric(population: Column, marked: Column, draws: Column, u: Column) -> Column:
    """Marked items among ``draws`` taken from ``population``, by inversion of the distribution function at ``u``.

    Weights are summed over mean ± (9 standard deviations + 16), all that a double can tell from zero; neighbouring
    weights differ by a rational factor, so no factorials are needed.
    """
    mean = F.when(population > 0, draws * marked.cast("double") / population).otherwise(F.lit(0.0))
    spread = F.when(population > 1, F.sqrt(mean * (1 - marked / population) * (population - draws) / (population - 1))).otherwise(F.lit(0.0))

    def inside(x):
        def factor(i):
            return (x["k"] - i) * (x["d"] - i) / ((i + 1) * (x["rest"] + i))

        def weights(extra, last, finish):
            start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"), *extra)
            return F.aggregate(x["steps"], start, lambda s, i: F.struct((s["w"] * factor(i)).alias("w"), (s["sum"] + s["w"] * factor(i)).alias("sum"), *last(s)), finish)

        total = weights([], lambda s: [], lambda s: s["sum"])
        return _let(total * u, lambda target: weights([x["low"].alias("at")], lambda s: [(s["at"] + F.when(s["sum"] < target, 1.0).otherwise(0.0)).alias("at")], lambda s: s["at"].cast("long")))

    low = F.greatest(F.lit(0).cast("long"), draws + marked - population, F.floor(mean - 9 * spread - 16))
    high = F.least(draws, marked, F.ceil(mean + 9 * spread + 16))
    steps = F.when(low < high, F.transform(F.sequence(low, high - 1), lambda i: i.cast("double"))).otherwise(F.array().cast("array<double>"))
    parts = F.struct(low.cast("double").alias("low"), steps.alias("steps"), marked.cast("double").alias("k"), draws.cast("double").alias("d"), (population - marked - draws + 1).cast("double").alias("rest"))
    return _let(parts, inside)


def _matrix_rows(items: Column, capacity: Column, size, label, seed: int, level: int) -> Column:
    """For each item of an array, how many of its rows go to each shard; items share ``capacity`` exactly."""

    def row(item, free, left):
        return F.aggregate(
            F.sequence(F.lit(1), F.size(free)),
            F.struct(size(item).alias("draws"), left.alias("left"), F.array().cast("array<bigint>").alias("row")),
            lambda s, j: _let(
                hypergeometric(s["left"], F.element_at(free, j), s["draws"], _uniform(F.lit(seed), F.lit(level), label(item), j)),
                lambda x: F.struct((s["draws"] - x).alias("draws"), (s["left"] - F.element_at(free, j)).alias("left"), F.concat(s["row"], F.array(x)).alias("row")),
            ),
            lambda s: s["row"],
        )

    start = F.struct(capacity.alias("free"), F.aggregate(capacity, F.lit(0).cast("long"), lambda a, b: a + b).alias("left"), F.array().cast("array<array<bigint>>").alias("rows"))
    return F.aggregate(
        items, start,
        lambda s, item: _let(row(item, s["free"], s["left"]), lambda r: F.struct(F.zip_with(s["free"], r, lambda a, b: a - b).alias("free"), (s["left"] - size(item)).alias("left"), F.concat(s["rows"], F.array(r)).alias("rows"))),
        lambda s: s["rows"],
    )


def communication_matrix(sizes: DataFrame, shards: int, seed: int, fan: int) -> DataFrame:
    """(block, row): the rows that each block sends to each shard. ``sizes`` has block and n.

    The matrix is drawn as a tree of two levels: first for ``fan`` groups of blocks, then inside each group on its own.
    The first row holds one entry per block, at most fan * fan.
    """
    groups = sizes.groupBy(F.expr(f"block div {fan}").alias("grp")).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("block", "n"))).alias("blocks"))
    root = groups.groupBy().agg(F.array_sort(F.collect_list(F.struct("grp", "n", "blocks"))).alias("items"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    capacity = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.expr(f"total div {shards}") + F.when(s < F.col("total") % shards, 1).otherwise(0))
    first = root.withColumn("capacity", capacity).withColumn("rows", _matrix_rows(F.col("items"), F.col("capacity"), lambda x: x["n"], lambda x: x["grp"], seed, 1))
    spread = first.select(F.explode(F.arrays_zip("items", "rows")).alias("x")).select("x.items.grp", "x.items.blocks", F.col("x.rows").alias("capacity")).repartition("grp")
    second = spread.withColumn("rows", _matrix_rows(F.col("blocks"), F.col("capacity"), lambda x: x["n"], lambda x: x["block"], seed, 2))
    return second.select(F.explode(F.arrays_zip("blocks", "rows")).alias("x")).select("x.blocks.block", F.col("x.rows").alias("row"))


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 0, fan: int = 32, split_bits: int = 8) -> DataFrame:
    """All rows and columns of ``df`` plus ``shard`` and ``slot``: a uniform shuffle with shard sizes at most one apart.

    A row's block and its random order follow from a digest of all its columns and the seed, so a task that runs again
    makes the same rows. There are fan * fan blocks; a block's rows are sorted in one task, so raise ``fan`` with the
    table. Slots are gapless from 0 in each shard; a shard is numbered in 2^split_bits ranges.

    Nulls are values like any other. Rows equal in every column are each placed; which is which cannot be told. An
    empty table gives no rows. ``df`` must not have columns named shard, slot or with two leading underscores.
    """
    blocks = fan * fan
    keyed = df.withColumn("__r1", row_key(df, seed, 1)).withColumn("__r2", row_key(df, seed, 2)).withColumn("__block", F.pmod(row_key(df, seed, 3), F.lit(blocks)))
    sizes = keyed.groupBy(F.col("__block").alias("block")).agg(F.count(F.lit(1)).alias("n"))
    matrix = communication_matrix(sizes, shards, seed, fan)
    cuts = matrix.select(F.col("block").alias("__b"), F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda j: F.aggregate(F.slice("row", F.lit(1), j), F.lit(0).cast("long"), lambda a, b: a + b)).alias("__cuts"))
    order = Window.partitionBy("__block").orderBy("__r1", *[F.col(f"`{c}`") for c in df.columns])
    placed = (
        keyed.withColumn("__at", F.row_number().over(order))
        .join(cuts, F.col("__block") == F.col("__b"))
        .withColumn("shard", F.size(F.filter("__cuts", lambda c: c < F.col("__at"))))
        .select(*[F.col(f"`{c}`") for c in df.columns], "shard", "__r2")
    )
    return numbered(placed, ["shard"], "__r2", [F.col(f"`{c}`") for c in df.columns], "slot", split_bits).drop("__r2")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its rows in slot order over as many files as the session has shuffle partitions."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def placed_documents(documents: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """doc_id, size in bytes plus 8, checksum of the text, shard and slot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = documents.select("doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shuffle_into_shards(narrow, shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
