"""Licence notices found by MinHash bands over overlapping text windows, and verified by exact shingle containment.

For each template, windows run over a text at a stride that lets at least one window hold any occurrence whole. A band is one
MinHash value; a window is a candidate when it agrees with the template in at least one of the template's bands. The number
of bands follows from the least Jaccard similarity that a window with enough of the template's shingles can have, so that a
candidate is missed with a probability of at most MISS.

A band of a window can agree only where the window holds the very shingle that gives the template's value. So texts are
searched for these few shingles, and MinHash values are computed for the windows around them alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import row_key, text_of, words
from tidemark.operators.keyed import once

SHINGLE = 5
#: Share of a template's shingles that a window must hold, in percent.
PERCENT = 80
MISS = 1e-6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Deleted before words are compared.
MARKS = ".,;:!?()[]\"'"

#: Notices and opening sentences of licences.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0-notice": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
    "either version 3 of the License, or (at your option) any later version",
    "BSD-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
}


@dataclass(frozen=True)
class Setting:
    """Stride and length of windows, in shingles, and bands of one row each."""

    stride: int
    length: int
    bands: int


def needed(shingles: int) -> int:
    return -(-PERCENT * shingles // 100)


def setting(shingles: int, miss: float = MISS) -> Setting:
    """Settings for a template of so many shingles."""
    stride = max(1, shingles // 4)
    length = shingles + stride - 1
    least = needed(shingles) / (length + shingles - needed(shingles))
    bands = 1 if least >= 1 else math.ceil(math.log(miss) / math.log(1 - least))
    return Setting(stride, length, bands)


def normal_words(text: Column) -> Column:
    return words(F.translate(text, UPPER + MARKS, LOWER))


def _hashes(df: DataFrame, of: str, out: str) -> DataFrame:
    """Adds the hash of the shingle at each position."""

    def pair(column: str, gap: int) -> Column:
        left = F.greatest(F.size(column) - gap, F.lit(0))
        return F.zip_with(F.slice(column, F.lit(1), left), F.slice(column, F.lit(1 + gap), left), lambda a, b: F.xxhash64(a, b))

    steps = df.withColumn("__h1", F.transform(of, lambda w: F.xxhash64(w))).withColumn("__h2", pair("__h1", 1)).withColumn("__h4", pair("__h2", 2))
    left = F.greatest(F.size("__h1") - (SHINGLE - 1), F.lit(0))
    joined = F.zip_with(F.slice("__h4", F.lit(1), left), F.slice("__h1", F.lit(SHINGLE), left), lambda a, b: F.xxhash64(a, b))
    return once(steps, {out: joined}).drop("__h1", "__h2", "__h4")


def _strings(of: str) -> Column:
    """Distinct shingles as text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(of) - (SHINGLE - 1)), lambda i: F.array_join(F.slice(of, i, F.lit(SHINGLE)), " ")))


def template_bands(spark: SparkSession, templates: dict[str, str], miss: float) -> list:
    """For each template and band the shingle that gives its MinHash value, and the value; as many rows as bands."""
    table = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in templates.items()])))
    split = _hashes(table.withColumn("t", normal_words(F.col("text"))), "t", "hashes").where(F.size("hashes") > 0)
    rows = split.select("license", F.array_distinct("hashes").alias("hashes"), _strings("t").alias("shingles")).collect()
    if len(rows) < len(templates):
        raise ValueError(f"a template needs at least {SHINGLE} words")
    sizes = {r["license"]: setting(len(r["shingles"]), miss) for r in rows}
    most = max(s.bands for s in sizes.values())
    values = split.select("license", F.explode(F.array_distinct("hashes")).alias("hash")).select("license", "hash", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("band"))
    least = values.groupBy("license", "band").agg(F.min(F.struct(F.xxhash64("band", "hash").alias("value"), "hash")).alias("m")).collect()
    shingles = {r["license"]: r["shingles"] for r in rows}
    return [(r["license"], r["band"], r["m"]["hash"], r["m"]["value"], sizes[r["license"]], shingles[r["license"]]) for r in least if r["band"] < sizes[r["license"]].bands]


def scanned(docs: DataFrame, templates: dict[str, str] | None = None, miss: float = MISS) -> DataFrame:
    """A row per document, licence and window that holds enough of it: the row's columns but text, license, start, matched, shingles.

    ``start`` is the window's first word. Case and the characters MARKS do not count. Null, empty and too short texts hold
    nothing. Rows equal in every column are one document. Templates need five words; each is compared on its own, so a text can
    hold several. An empty table gives no rows. Columns named like the new ones are replaced.
    """
    templates = TEMPLATES if templates is None else templates
    bands = template_bands(docs.sparkSession, templates, miss)
    keys = F.array(*[F.lit(h) for h in sorted({b[2] for b in bands})])
    found = {}
    for name, band, shingle, value, size, _ in bands:
        entry = F.struct(F.lit(name).alias("license"), F.lit(band).alias("band"), F.lit(value).alias("value"), F.lit(size.stride).alias("stride"), F.lit(size.length).alias("length"))
        found.setdefault(shingle, []).append(entry)
    lookup = F.create_map(*[x for shingle, entries in found.items() for x in (F.lit(shingle), F.array(*entries))])
    text_of_template = F.create_map(*[x for name, shingles in {b[0]: b[5] for b in bands}.items() for x in (F.lit(name), F.array(*map(F.lit, shingles)))])

    names = [c for c in docs.columns if c not in ("text", "license", "start", "matched", "shingles")]
    others = [F.col(f"`{c}`") for c in names]
    split = _hashes(docs.select(*others, row_key(docs, 1).alias("__k1"), row_key(docs, 2).alias("__k2"), normal_words(text_of("text")).alias("__words")), "__words", "__hashes")
    near = split.where(F.arrays_overlap("__hashes", keys))
    hits = F.filter(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))), lambda x: x["h"].isin([b[2] for b in bands]))
    bound = near.select(*others, "__k1", "__k2", "__words", "__hashes", F.explode(hits).alias("__hit"))
    bound = bound.select(*others, "__k1", "__k2", "__words", "__hashes", F.col("__hit.i").alias("__i"), F.explode(lookup[F.col("__hit.h")]).alias("__band"))
    stride, length = F.col("__band.stride"), F.col("__band.length")
    first = F.greatest(F.ceil((F.col("__i") - length + 1) / stride), F.lit(0)).cast("int") * stride
    starts = F.sequence(first, F.floor(F.col("__i") / stride).cast("int") * stride, stride)
    windows = bound.select(*others, "__k1", "__k2", "__words", "__hashes", "__band", F.explode(starts).alias("start")).select(
        *others, "__k1", "__k2", "__band", "start", F.slice("__hashes", F.col("start") + 1, length).alias("__hashes"), F.slice("__words", F.col("start") + 1, length + (SHINGLE - 1)).alias("__words"),
    )
    agree = F.array_min(F.transform("__hashes", lambda h: F.xxhash64(F.col("__band.band"), h))) == F.col("__band.value")
    candidates = windows.where(agree).withColumn("license", F.col("__band.license"))
    template = text_of_template[F.col("license")]
    checked = candidates.withColumn("matched", F.size(F.array_intersect(_strings("__words"), template))).withColumn("shingles", F.size(template))
    enough = checked.where(100 * F.col("matched") >= PERCENT * F.col("shingles"))
    return enough.dropDuplicates(["__k1", "__k2", "license", "start"]).select(*others, "license", "start", "matched", "shingles")


def licensed_documents(docs: DataFrame) -> DataFrame:
    """doc_id, license, windows, first_word, and the most shingles matched with the share they are of the template."""
    rows = scanned(docs.select("doc_id", "text"))
    out = rows.groupBy("doc_id", "license").agg(F.count(F.lit(1)).alias("windows"), F.min("start").alias("first_word"), F.max("matched").alias("matched"), F.max(F.col("matched") / F.col("shingles")).alias("containment"))
    return out
