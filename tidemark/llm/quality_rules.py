"""Quality rules: base limits on each text, then robust multivariate outliers inside each language and source.

The minimum covariance determinant looks for the subset of a group's rows, here three quarters of them, whose
statistic vectors have the covariance matrix of least determinant. Concentration steps find it: measure all rows by the
current centre and matrix, keep the nearest part, estimate again. Rows far from the centre of that subset go.

Vectors are fixed-point integers and a step gathers exact sums per distance bin, so neither the order of rows nor a task
that runs again changes a verdict, and no group is ever brought together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, squeezed, staged, text_of, words
from tidemark.operators.keyed import once

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Fixed-point steps of a vector's unit.
UNIT = 2048
#: Least spread of each coordinate (log of mean word length, log of symbols per 100 characters, repeated lines, repeated
#: words): a group that is nearly constant in one of them does not make ordinary texts outliers.
LEAST_SPREAD = (0.15, 0.35, 0.12, 0.06)
COORDINATES = len(LEAST_SPREAD)
#: Distance bins per factor e.
BINS = 32
#: A group's rows meet its estimate in so many tasks, and only sums per bin leave them.
SALTS = 32


def _paired(column: str, gap: int) -> Column:
    """Hash of each element with the one ``gap`` further on."""
    left = F.greatest(F.size(column) - gap, F.lit(0))
    return F.zip_with(F.slice(column, F.lit(1), left), F.slice(column, F.lit(1 + gap), left), lambda a, b: F.xxhash64(a, b))


def _covered(column: str) -> Column:
    """Positions that equal windows cover, where at least two windows of the array are equal."""
    ranked = F.array_sort(F.transform(column, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(s):
        same = F.transform(F.sequence(F.lit(1), F.size(s)), lambda j: F.when(
            ((j > 1) & (F.get(s, j - 2)["h"] == F.get(s, j - 1)["h"])) | (F.get(s, j)["h"] == F.get(s, j - 1)["h"]), F.get(s, j - 1)["i"]))
        return F.array_sort(F.filter(same, lambda x: x.isNotNull()))

    found = F.element_at(F.transform(F.array(ranked), positions), 1)
    steps = F.element_at(F.transform(F.array(found), lambda p: F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))), 1)
    return F.aggregate(steps, F.lit(0), lambda a, b: a + b)


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (long) and base_failed."""
    text = text_of("text")
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    steps = docs.withColumn("__words", words(text)).withColumn("__lines", lines)
    steps = steps.withColumn("__h1", F.transform("__words", lambda w: F.xxhash64(w)))
    steps = steps.withColumn("__h2", _paired("__h1", 1)).withColumn("__h4", _paired("__h2", 2)).withColumn("__h8", _paired("__h4", 4))
    repeats = F.size(F.array_distinct("__h8")) < F.size("__h8")
    n_words = F.size("__words").cast("long")
    # a filter on these must not take their expressions below the steps
    out = once(steps, {
        "n_words": n_words, "word_chars": F.length(squeezed(text)).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.when(repeats, _covered("__h8")).otherwise(0).cast("long"), "n_lines": F.size("__lines").cast("long"),
    }).drop("__words", "__lines", "__h1", "__h2", "__h4", "__h8")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def vectors(stats: DataFrame) -> DataFrame:
    """Adds x1 to x4, the transformed statistics in steps of 1 / UNIT."""

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    shapes = [F.log(F.greatest(share("word_chars", "n_words"), F.lit(1.0))), F.log1p(100 * share("n_symbols", "word_chars")), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]
    return stats.withColumns({f"x{i + 1}": F.round(x * UNIT).cast("long") for i, x in enumerate(shapes)})


def _chi_square_tail(x: float, freedom: int) -> float:
    """Upper tail for an even number of degrees of freedom."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(freedom // 2))


def chi_square_limit(tail: float, freedom: int = COORDINATES) -> float:
    low, high = 0.0, 400.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi_square_tail(mid, freedom) > tail else (low, mid)
    return high


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(1, COORDINATES + 1) for j in range(1, i + 1)]


def _factored(matrix: DataFrame, scale: float) -> DataFrame:
    """Cholesky factor l_ij of the covariance columns c_ij, times ``scale`` plus the least spread; ``det`` of it."""
    out = matrix
    for i, j in _pairs():
        value = F.col(f"c{i}{j}") * scale + (LEAST_SPREAD[i - 1] ** 2 if i == j else 0.0)
        for k in range(1, j):
            value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(value) if i == j else value / F.col(f"l{j}{j}"))
    det = F.lit(1.0)
    for i in range(1, COORDINATES + 1):
        det = det * F.col(f"l{i}{i}")
    return out.withColumn("det", det).drop(*[f"c{i}{j}" for i, j in _pairs()])


def _distance(rows: DataFrame, out: str = "d2") -> DataFrame:
    """Squared Mahalanobis distance by the columns m_i and l_ij."""
    for i in range(1, COORDINATES + 1):
        value = F.col(f"x{i}") / F.lit(float(UNIT)) - F.col(f"m{i}")
        for k in range(1, i):
            value = value - F.col(f"l{i}{k}") * F.col(f"__y{k}")
        rows = rows.withColumn(f"__y{i}", value / F.col(f"l{i}{i}"))
    total = F.lit(0.0)
    for i in range(1, COORDINATES + 1):
        total = total + F.col(f"__y{i}") * F.col(f"__y{i}")
    return rows.withColumn(out, total).drop(*[f"__y{i}" for i in range(1, COORDINATES + 1)])


def grouped(rows: DataFrame, least_rows: int) -> DataFrame:
    """Adds grp_lang and grp_source: a language and source with at least ``least_rows`` good rows is a group of its own;
    the small sources of a language are one group, and the rows of small languages another."""
    good = F.sum(F.when(F.col("base_failed"), 0).otherwise(1))
    cells = rows.groupBy("lang", "source").agg(good.alias("n"))
    cells = cells.withColumn("grp_source", F.when(F.col("n") >= least_rows, F.concat(F.lit("="), F.coalesce("source", F.lit("")))).otherwise("*"))
    pool = Window.partitionBy("lang", "grp_source")
    cells = cells.withColumn("grp_lang", F.when(F.sum("n").over(pool) >= least_rows, F.concat(F.lit("="), F.coalesce("lang", F.lit("")))).otherwise("*"))
    cells = cells.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), "grp_lang", "grp_source")
    return rows.join(cells, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))).drop("__lang", "__source")


KEYS = ["grp_lang", "grp_source"]


def _start(good: DataFrame) -> DataFrame:
    """Two starts per group: medians with quartile ranges, and plain means with the full covariance matrix."""
    # distinct fixed-point values are few, so exact percentiles stay small
    quartiles = good.groupBy(*KEYS).agg(*[F.percentile(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i in range(1, COORDINATES + 1)])
    middle = {f"m{i}": F.col(f"q{i}")[1] / UNIT for i in range(1, COORDINATES + 1)}
    spread = {f"c{i}{j}": F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / UNIT / 1.349, 2) if i == j else F.lit(0.0) for i, j in _pairs()}
    robust = _factored(quartiles.withColumns(middle | spread), 1.0).withColumn("start", F.lit(0))
    plain = _moments(good.groupBy(*KEYS).agg(*_sums())).withColumn("start", F.lit(1))
    plain = _factored(plain, 1.0)
    return robust.select(plain.columns).unionByName(plain)


def _sums() -> list[Column]:
    first = [F.sum(f"x{i}").alias(f"s{i}") for i in range(1, COORDINATES + 1)]
    return [F.count(F.lit(1)).alias("n"), *first, *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in _pairs()]]


def _moments(sums: DataFrame) -> DataFrame:
    """Means m_i and covariances c_ij out of exact sums."""
    mean = {f"m{i}": F.col(f"s{i}") / F.col("n") / UNIT for i in range(1, COORDINATES + 1)}
    cov = {f"c{i}{j}": F.col(f"s{i}{j}") / F.col("n") / UNIT**2 - F.col(f"m{i}") * F.col(f"m{j}") for i, j in _pairs()}
    return sums.withColumns(mean).withColumns(cov).drop("n", *[f"s{i}" for i in range(1, COORDINATES + 1)], *[f"s{i}{j}" for i, j in _pairs()])


def _concentrate(good: DataFrame, estimate: DataFrame, part: float) -> DataFrame:
    """One concentration step for every group and start."""
    salted = estimate.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    measured = _distance(good.join(salted, [*KEYS, "salt"]))
    bins = measured.withColumn("__bin", F.floor(F.log(F.greatest(F.col("d2"), F.lit(1e-6))) * BINS)).groupBy(*KEYS, "start", "__bin").agg(*_sums())
    upto = Window.partitionBy(*KEYS, "start").orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*KEYS, "start")
    names = ["n", *[f"s{i}" for i in range(1, COORDINATES + 1)], *[f"s{i}{j}" for i, j in _pairs()]]
    running = bins.select(*KEYS, "start", "__bin", *[F.sum(c).over(upto).alias(c) for c in names], F.sum("n").over(whole).alias("__all"))
    enough = running.where(F.col("n") >= part * F.col("__all"))
    first = Window.partitionBy(*KEYS, "start").orderBy("__bin")
    nearest = enough.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k", "__bin", "__all")
    return _factored(_moments(nearest), 1.0)


def estimates(rows: DataFrame, part: float = 0.75, steps: int = 4) -> DataFrame:
    """Centre m_i and factor l_ij per group, of the start with the least determinant, for good rows with vectors."""
    salt = F.pmod(F.xxhash64("doc_id", "word_chars", "n_words"), F.lit(SALTS)).alias("salt")
    good = rows.where(~F.col("base_failed")).select(*KEYS, salt, *[f"x{i}" for i in range(1, COORDINATES + 1)])
    current = _start(good)
    for _ in range(steps):
        current = _concentrate(good, current, part)
    best = Window.partitionBy(*KEYS).orderBy("det", "start")
    return current.withColumn("__k", F.row_number().over(best)).where("__k = 1").drop("__k", "start", "det")


def rejected_as_outlier(rows: DataFrame, estimate: DataFrame, part: float, tail: float) -> DataFrame:
    """Adds d2, the squared distance made consistent for normal data, and outlier."""
    inside = chi_square_limit(1 - part)
    consistency = part / (1 - _chi_square_tail(inside, COORDINATES + 2))
    measured = _distance(rows.join(estimate, KEYS, "left")).withColumn("d2", F.col("d2") / consistency)
    return measured.withColumn("outlier", F.coalesce(F.col("d2") > chi_square_limit(tail), F.lit(False)))


def judged(docs: DataFrame, part: float = 0.75, steps: int = 4, tail: float = 1e-4, least_rows: int = 50, keep_text: bool = False) -> DataFrame:
    """doc_id, lang, source (or all columns of ``docs`` where ``keep_text``), statistics, base_failed, d2, outlier, kept.

    Null text is empty and fails the base limits. Null lang or source is a value like any other. A group of fewer than
    ``least_rows`` good rows is pooled; if even the pool of all is empty, d2 is null and base limits decide alone. Equal
    rows get equal verdicts; an empty table gives no rows.
    """
    narrow = vectors(with_statistics(docs.select("doc_id", "lang", "source", "text"))).drop("text")
    rows = staged(narrow, "quality-statistics")
    placed = grouped(rows, least_rows)
    cells = placed.select("lang", "source", *KEYS).distinct()
    estimate = estimates(placed, part, steps)
    if keep_text:
        # both small tables are written, so that Spark knows their size when it plans the join with whole texts
        wide = vectors(with_statistics(docs)).alias("w").join(staged(cells, "quality-groups").alias("c"), F.col("w.lang").eqNullSafe(F.col("c.lang")) & F.col("w.source").eqNullSafe(F.col("c.source")))
        placed, estimate = wide.select("w.*", *[f"c.{k}" for k in KEYS]), staged(estimate, "quality-estimates")
    out = rejected_as_outlier(placed, estimate, part, tail).withColumn("kept", ~F.col("base_failed") & ~F.col("outlier"))
    return out.drop(*KEYS, *[f"m{i}" for i in range(1, COORDINATES + 1)], *[f"l{i}{j}" for i, j in _pairs()], *[f"x{i}" for i in range(1, COORDINATES + 1)])


def statistics_and_verdicts(docs: DataFrame) -> DataFrame:
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("d2", 6).alias("d2"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns."""
    return judged(docs, keep_text=True).where("kept").select(*[F.col(f"`{c}`") for c in docs.columns])
