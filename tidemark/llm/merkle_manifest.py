"""Merkle manifest of a table: a tree per group over its ordered rows, a tree over the groups, and a proof for every row.

Rows get gapless ranks inside their group. A rank is a number of base 3 digits; the digits below a block are columns, and grouping
them away one after the other, the last one first, turns rows into structs nested in their parents. All of it happens behind one
exchange by block, since a block's rows lie together for every grouping. Blocks hold at most ``3 ** digits`` rows, whatever the size
of a group, so no row of any stage grows with the table. The hashes of the blocks are the rows of the next, far smaller round, until
every group is one block. A last transform unfolds a nested block with the siblings met on the way down, and an explode emits the
proofs; leaves are never joined with hashes of inner nodes. Only the rounds above a block hand their proofs down, one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import staged

FAN = 3
#: Base 3 digits inside a block: at most 243 leaves, about 50 KB, in a nested row.
DIGITS = 5


def sha256_of(*parts: Column) -> Column:
    """Lowercase hex digest of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as ``length:value`` with its length in UTF-8 bytes, ``-`` for null; no two rows of fields read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` plus rank, gapless from 0 inside each group (null is one) in the given order, nulls first, and n, the group's rows.

    Rows are dealt by ranges of (group, order) and written once, so a range is a fixed set; it is numbered in a task of its own and
    moved by the rows of its group in the ranges below. A group of any size spreads over ranges. Rows that tie are numbered in any order.
    """
    by = [F.col(f"`{c}`").asc_nulls_first() for c in [group, *order]]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = staged(rows.repartitionByRange(parts, *by).withColumn("__part", F.spark_partition_id()), name)
    # one row per group and range
    sizes = cut.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    of_group = Window.partitionBy(group)
    below = of_group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "__part", F.coalesce(F.sum("__n").over(below), F.lit(0)).alias("__start"), F.sum("__n").over(of_group).alias("__all"))
    numbered = cut.withColumn("__rank", F.row_number().over(Window.partitionBy(group, "__part").orderBy(*by[1:])) - F.lit(1))
    same = F.col(f"r.`{group}`").eqNullSafe(F.col(f"s.`{group}`")) & (F.col("r.__part") == F.col("s.__part"))
    columns = [F.col(f"r.`{c}`") for c in rows.columns]
    return numbered.alias("r").join(starts.alias("s"), same).select(*columns, (F.col("__start") + F.col("__rank")).cast("long").alias("rank"), F.col("__all").cast("long").alias("n"))


def _nested(leaves: DataFrame, digits: int) -> DataFrame:
    """(k, block, n, node) of each block of ``FAN ** digits`` ranks; ``node`` is a struct (digit, hash, kids), a leaf (digit, hash, load).

    ``leaves`` has k, rank, n (leaves of k), hash and load.
    """
    ranks = [F.expr(f"rank div {FAN**d} AS r{d}") for d in range(1, digits)]
    leaf = F.struct((F.col("rank") % FAN).cast("int").alias("digit"), "hash", "load").alias("node")
    rows = leaves.select("k", F.expr(f"rank div {FAN**digits} AS block"), "n", *ranks, leaf)
    # every grouping below has the block among its keys, so this is the only exchange
    rows = rows.repartition("k", "block")
    for d in range(1, digits + 1):
        upper = [f"r{e}" for e in range(d, digits)]
        digit = (F.col(upper[0] if upper else "block") % FAN).cast("int").alias("digit")
        rows = rows.groupBy("k", "block", "n", *upper).agg(F.array_sort(F.collect_list("node")).alias("kids"))
        # where the whole group has one node left, that is its root and passes through
        hashed = F.when(F.col("n") <= FAN ** (d - 1), F.col("kids")[0]["hash"]).otherwise(F.sha2(F.array_join(F.col("kids.hash"), ""), 256)).alias("hash")
        rows = rows.select("k", "block", "n", *upper, F.struct(digit, hashed, "kids").alias("node"))
    return rows


def raised(leaves: DataFrame, digits: int = DIGITS, name: str = "merkle") -> list[DataFrame]:
    """The nested blocks (k, block, n, node) of each round from the leaves up; in the last, every group is one block, and node.hash its root.

    ``leaves`` has k (the group, null is one), rank (gapless from 0 in it), n (leaves of the group), hash (hex) and load (any value that
    travels with the leaf). While a level of a group has several nodes, every three consecutive ones, at the end fewer, become the
    digest of their concatenated hashes; the root of a lone leaf is its hash. Rounds grow with the logarithm of the largest group.
    """
    width, rounds = FAN**digits, []
    while True:
        rounds.append(staged(_nested(leaves, digits), name))
        blocks = rounds[-1]
        if blocks.where(F.col("n") > width).limit(1).count() == 0:
            return rounds
        leaves = blocks.select("k", F.col("block").alias("rank"), F.expr(f"(n + {width - 1}) div {width} AS n"), F.col("node.hash").alias("hash"), F.col("block").alias("load"))


def _lower(passed: Column):
    """From (node, path) to its children's; a level that ``passed`` one node through has no siblings."""

    def lower(x: Column) -> Column:
        hashes = x["node"]["kids"]["hash"]

        def child(kid: Column, i: Column) -> Column:
            sides = F.struct(F.slice(hashes, F.lit(1), i).alias("left"), F.slice(hashes, i + 2, F.lit(FAN)).alias("right"))
            return F.struct(kid.alias("node"), F.when(passed, x["path"]).otherwise(F.concat(F.array(sides), x["path"])).alias("path"))

        return F.transform(x["node"]["kids"], child)

    return lower


def _unfolded(blocks: DataFrame, digits: int) -> DataFrame:
    """(k, hash, load, path, above) of every leaf of the blocks (k, n, node, path, above); ``path`` has, per level with several nodes, the
    siblings to the left and right, the lowest level first, and continues the block's own."""
    at = F.array(F.struct("node", "path"))
    for d in range(digits, 0, -1):
        at = F.flatten(F.transform(at, _lower(F.col("n") <= FAN ** (d - 1))))
    return blocks.select("k", "above", F.explode(at).alias("x")).select("k", "x.node.hash", "x.node.load", "x.path", "above")


def lowered(rounds: list[DataFrame], tops: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(k, hash, load, path, above) of every leaf of the rounds that ``raised`` gave.

    ``tops`` is the last round with path, the siblings above each group's root, and above, any value handed down to the group's leaves.
    A round hands both to the one below it, one row per block.
    """
    found = _unfolded(tops, digits)
    for blocks in rounds[-2::-1]:
        same = F.col("b.k").eqNullSafe(F.col("u.k")) & (F.col("b.block") == F.col("u.load"))
        found = _unfolded(blocks.alias("b").join(found.alias("u"), same).select("b.*", "u.path", "u.above"), digits)
    return found


def folded(hash_: Column, path: Column) -> Column:
    """The root that a leaf's hash and its siblings lead to."""
    return F.aggregate(path, hash_, lambda acc, x: F.sha2(F.concat(F.array_join(x["left"], ""), acc, F.array_join(x["right"], "")), 256))


def siblings(path: Column) -> Column:
    """All siblings of a proof, the lowest level first, from left to right."""
    return F.flatten(F.transform(path, lambda x: F.concat(x["left"], x["right"])))


def manifest(leaves: DataFrame, group: str, order: list[str], digits: int = DIGITS) -> DataFrame:
    """(``group``, hash, load, subroot, root, path) of every leaf, with the whole way from the leaf over its subroot to the root.

    ``leaves`` has the columns of ``group`` and ``order``, hash and load. Groups stand in the bytewise order of their UTF-8 text,
    null first; leaves inside one by ``order``, nulls first, then by hash, so repeated rows are leaves of their own. The tree over the
    groups is built like those inside them. An empty table gives no rows.
    """
    # leaves are narrow: ranges are found from them, and the rows they digest are read once
    rows = staged(leaves.select(F.col(f"`{group}`").alias("k"), *[F.col(f"`{c}`") for c in order], "hash", "load"), "merkle-leaves")
    rows = ranked(rows, "k", [*order, "hash"], "merkle-ranks")
    inner = raised(rows.select("k", "rank", "n", "hash", "load"), digits, "merkle-inner")
    roots = ranked(inner[-1].select(F.lit(0).alias("all"), "k", F.col("node.hash").alias("hash")), "all", ["k"], "merkle-groups")
    outer = raised(roots.select(F.col("all").alias("k"), "rank", "n", "hash", F.struct("k").alias("load")), digits, "merkle-outer")
    none = F.array().cast("array<struct<left: array<string>, right: array<string>>>")
    groups = lowered(outer, outer[-1].select("*", none.alias("path"), F.col("node.hash").alias("above")), digits)
    # one row per group on both sides
    same = F.col("b.k").eqNullSafe(F.col("g.load.k"))
    tops = inner[-1].alias("b").join(groups.alias("g"), same).select("b.*", "g.path", F.struct(F.col("b.node.hash").alias("subroot"), F.col("g.above").alias("root")).alias("above"))
    return lowered(inner, tops, digits).select(F.col("k").alias(group), "hash", "load", "above.subroot", "above.root", "path")


def row_leaf(text: Column) -> Column:
    """Digest of a row of documents with the given text."""
    return sha256_of(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(F.col("n_chars")), field(text))


def proven_documents(docs: DataFrame, digits: int = DIGITS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``docs``.

    Rows whose crc32 of the decimal doc_id is even are checked after their text lost its line feeds; with a null text or none in it,
    nothing is lost and the row verifies. A null doc_id has no crc32 and stays untampered; null values are part of a leaf, and a null
    source is a group of its own, the first. Repeated rows are leaves of their own. An empty table gives no rows. Further columns, also
    such as rank, hash or path, are ignored.
    """
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False)) & F.coalesce(F.contains("text", F.lit("\n")), F.lit(False))
    found = F.when(tampered, row_leaf(F.translate("text", "\n", "")))
    leaves = docs.select("doc_id", "source", "lang", "n_chars", "text").select("doc_id", "source", row_leaf(F.col("text")).alias("hash"), F.struct("doc_id", found.alias("found")).alias("load"))
    out = manifest(leaves, "source", ["doc_id"], digits)
    return out.select(
        "load.doc_id", F.col("hash").alias("leaf"), "subroot", "root", F.sha2(F.array_join(siblings(F.col("path")), ""), 256).alias("proof_sha256"),
        folded(F.coalesce("load.found", "hash"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
