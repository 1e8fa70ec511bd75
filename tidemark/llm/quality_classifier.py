"""Quality score from how well a text compresses with a dictionary of good text and with one of bad text.

Two zstandard dictionaries are trained on labelled texts of either kind. A text is cut into pieces of PIECE bytes, so that
the dictionary matters as much at its end as at its start, and all pieces are compressed with both. Size differences and
sizes, relative to the length, and the mean size of a piece feed a logistic curve that is fitted on labelled texts the dictionaries have not seen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of

PIECE = 1024
LEVEL = 3
DICTIONARY_BYTES = 1 << 16


@dataclass
class Model:
    """Dictionaries, and the fitted curve: centre and scale of each feature, weights with the constant first."""

    good: bytes
    bad: bytes
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    @property
    def usable(self) -> bool:
        return bool(self.good and self.bad)


def _pieces(data: bytes) -> list[bytes]:
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


def _dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; too few texts to train on serve as they are."""
    samples = [piece for text in texts for piece in _pieces(text.encode())]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[:DICTIONARY_BYTES]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)


def features(text: str, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> list[float]:
    data = text.encode() or b" "
    size = len(data)
    g = b = 0
    pieces = _pieces(data)
    for piece in pieces:
        g += len(good.compress(piece))
        b += len(bad.compress(piece))
    return [(b - g) / size, (b - g) / (b + g), g / size, b / size, math.log(size / len(pieces)), (g / size) ** 2, (b / size) ** 2]


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by damped Newton steps on standardised features."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - centre) / scale])
    penalty = ridge * len(x) * np.diag([0.0] + [1.0] * x.shape[1])
    w = np.zeros(z.shape[1])

    def loss(w):
        m = z @ w
        return np.logaddexp(0, m).sum() - (y * m).sum() + w @ penalty @ w / 2

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(w)), z.T @ (p - y) + penalty @ w)
        rate = 1.0
        while rate > 1e-4 and loss(w - rate * step) > loss(w):
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-7:
            break
    return centre, scale, w


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, chars: int) -> list:
    """Up to ``rows`` labelled texts for each label and each use, and of a text longer than ``chars`` one stretch of it.

    Rows are drawn by a hash of doc_id, first from the narrow labels, so at most 4 * ``rows`` identifiers are broadcast. Of rows
    with one doc_id the least stretch is taken, so 4 * ``rows`` * ``chars`` characters reach the driver. Held-out rows are never drawn.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out()).select("doc_id", "quality")
    once = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("__high")).where("quality = __high").drop("__high")
    drawn = once.withColumn("use", F.pmod(F.xxhash64(F.lit("use"), "doc_id"), F.lit(2))).withColumn("__h", F.xxhash64("doc_id"))
    parts = [drawn.where((F.col("quality") == q) & (F.col("use") == u)).orderBy("__h", "doc_id").limit(rows) for q in (0, 1) for u in (0, 1)]
    ids = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    start = F.pmod(F.xxhash64(F.lit("from"), "doc_id"), F.greatest(F.length("text") - chars, F.lit(0)) + 1) + 1
    cut = F.when(F.length("text") > chars, F.expr("substring(text, start, chars)")).otherwise(F.col("text"))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    out = texts.withColumn("start", start.cast("int")).withColumn("chars", F.lit(chars)).select("doc_id", "quality", "use", "__h", cut.alias("text"))
    single = out.groupBy("doc_id", "quality", "use", "__h").agg(F.min("text").alias("text"))
    return sorted(single.collect(), key=lambda r: (r["__h"], r["doc_id"], r["text"]))


def train(docs: DataFrame, labels: DataFrame, rows: int = 2500, chars: int = 8192) -> Model:
    """Fits on a bounded sample of labelled rows (see ``labelled_sample``). Inputs are texts alone."""
    sample = labelled_sample(docs, labels, rows, chars)
    share = float(np.mean([r["quality"] for r in sample])) if sample else 0.5
    good, bad = (_dictionary([r["text"] for r in sample if r["use"] == 0 and r["quality"] == q]) for q in (1, 0))
    rest = [r for r in sample if r["use"] == 1]
    model = Model(good, bad, np.zeros(7), np.ones(7), np.zeros(8), share)
    if not model.usable or len({r["quality"] for r in rest}) < 2:
        model.good = b""
        return model
    with_good, with_bad = _compressor(good), _compressor(bad)
    x = np.array([features(r["text"], with_good, with_bad) for r in rest])
    model.centre, model.scale, model.weights = _fit(x, np.array([float(r["quality"]) for r in rest]))
    return model


def score(model: Model):
    """A Column function of a text column: the probability of label 1."""

    @F.pandas_udf("double")
    def quality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with_good, with_bad = (_compressor(model.good), _compressor(model.bad)) if model.usable else (None, None)
        for batch in batches:
            if not model.usable or not len(batch):
                yield pd.Series([model.prior] * len(batch), dtype="float64")
                continue
            x = (np.array([features(t, with_good, with_bad) for t in batch]) - model.centre) / model.scale
            yield pd.Series(1 / (1 + np.exp(-np.clip(model.weights[0] + x @ model.weights[1:], -35, 35))))

    return quality


def scored(docs: DataFrame, labels: DataFrame, limit: float = 0.7, rows: int = 2500, chars: int = 8192) -> DataFrame:
    """``docs`` plus held_out, score and predicted (1 where score >= ``limit``).

    Null and empty texts are scored as one space. Rows with equal texts get equal scores. Labels that are null, neither 0
    nor 1, without a document or contradictory are not learned from; without texts of both labels every row gets the share
    of label 1 among those that there are, or 0.5. An empty table gives no rows. Columns named like the new ones are replaced.
    """
    model = train(docs, labels, rows, chars)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("held_out", "score", "predicted")]
    out = docs.select(*kept, held_out().alias("held_out"), score(model)(text_of("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= limit).cast("int"))


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, labels).select("doc_id", "held_out", "score", "predicted")


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are predicted good, with their own columns."""
    model = train(docs, labels)
    return docs.where(score(model)(text_of("text")) >= 0.7)
