"""Passages repeated across documents: windows of three lines, hashed, found again anywhere, and removed but the first.

Lines are the parts between line feeds. Windows run over the lines that have a word, compared without the white space at
their ends; blank lines neither form windows nor break them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, row_key

WIDTH = 3


def _keyed(docs: DataFrame) -> DataFrame:
    """Two 64-bit digests of the row as its key; a null doc_id and repeated rows need no care then."""
    return docs.withColumn("__k1", row_key(docs, 1)).withColumn("__k2", row_key(docs, 2))


def _windows(keyed: DataFrame) -> DataFrame:
    """A row per window: its hash (128 bits), its document, its number and the first and last line it covers."""
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.struct(F.btrim(line, F.lit(SPACE)).alias("line"), i.alias("i")))
    full = F.transform(F.filter(lines, lambda x: x["line"] != ""), lambda x: F.struct(F.xxhash64(x["line"]).alias("a"), F.xxhash64(F.lit(7), x["line"]).alias("b"), x["i"].alias("i")))

    def window(j):
        parts = [F.get(F.col("__full"), j + k) for k in range(WIDTH)]
        return F.struct(F.xxhash64(*[p["a"] for p in parts]).alias("h1"), F.xxhash64(*[p["b"] for p in parts]).alias("h2"), j.alias("number"), parts[0]["i"].alias("first"), parts[-1]["i"].alias("last"))

    spread = keyed.select("doc_id", "__k1", "__k2", full.alias("__full")).where(F.size("__full") >= WIDTH)
    return spread.select("doc_id", "__k1", "__k2", F.explode(F.transform(F.sequence(F.lit(0), F.size("__full") - WIDTH), window)).alias("w")).select("doc_id", "__k1", "__k2", "w.*")


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.col("number").alias("number"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with every later occurrence of a window of three lines removed, plus n_lines and n_removed.

    Of equal windows the one with the smallest doc_id (null last), then the first in its text, stays; all lines that
    later ones cover, with blank lines between them, go, also where they overlap an earlier one in the same text. Rows
    equal in every column count as one document. Texts without a repeated window are returned unchanged, null as null;
    a text that loses all lines becomes empty. A column n_chars, if there is one, follows the text.
    """
    keyed = _keyed(docs)
    windows = _windows(keyed)
    repeated = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(_place()).alias("place")).where("n > 1").select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "place")
    later = windows.join(repeated, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2"))).where(~_place().eqNullSafe(F.col("place")))
    covered = later.groupBy("__k1", "__k2").agg(F.flatten(F.collect_set(F.sequence("first", "last"))).alias("__gone")).select(F.col("__k1").alias("__g1"), F.col("__k2").alias("__g2"), "__gone")
    joined = keyed.join(covered, (F.col("__k1") == F.col("__g1")) & (F.col("__k2") == F.col("__g2")), "left")
    lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    cut = joined.withColumn("__lines", lines).withColumn("__stay", F.when(F.col("__gone").isNotNull(), stay))
    text = F.when(F.col("__stay").isNull(), F.col("text")).otherwise(F.array_join(F.transform("__stay", lambda i: F.get(F.col("__lines"), i)), "\n"))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars", "n_lines", "n_removed")]
    out = cut.select(
        *others, text.alias("text"), *[F.col("n_chars").alias("__n_chars")] * ("n_chars" in docs.columns), "__stay",
        F.coalesce(F.size("__lines"), F.lit(0)).alias("n_lines"), F.when(F.col("__stay").isNull(), 0).otherwise(F.size("__lines") - F.size("__stay")).alias("n_removed"),
    )
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__stay").isNull(), F.col("__n_chars")).otherwise(F.length("text")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")


def cleaned_documents(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).select(*[F.col(f"`{c}`") for c in docs.columns])
