"""Length buckets that need the least padding, and batches of a token budget inside them.

The histogram of lengths is taken over all rows; dynamic programming over it picks the bucket lengths for which padding
every row up to its bucket costs least in total. Lengths are exact: texts of d distinct lengths have at least d * (d - 1) / 2
words together, so the histogram grows with the root of the corpus at most. Each bucket is then cut into batches of as many rows as the budget
holds at its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import numbered, row_key, text_of, words

#: Leading bits of ``on_grid``.
FINE = 12


def on_grid(length: Column) -> Column:
    """The length, rounded up to FINE leading bits. Boundaries do not use it; they are real lengths."""
    step = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(length)) - FINE, F.lit(0))).cast("long")
    return ((length + step - 1) / step).cast("long") * step


def best_boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Bucket lengths with the least padding for a sorted histogram of (length, rows), at most ``buckets`` of them.

    cost[j] = min over i < j of cost[i] + length[j] * (rows in i..j); for growing j these are lines of falling slope asked at
    growing points, so a hull with a moving front answers each in constant time.
    """
    lengths = [length for length, _ in histogram]
    below = [0]
    for _, rows in histogram:
        below.append(below[-1] + rows)
    size = len(lengths)
    if not size:
        return []
    cost: list[int | None] = [0] + [None] * size
    choices = []
    for _ in range(min(buckets, size)):
        fresh: list[int | None] = [None] * (size + 1)
        chosen = [0] * (size + 1)
        hull: list[int] = []
        front = 0
        for j in range(1, size + 1):
            i = j - 1
            if cost[i] is not None:
                while len(hull) - front >= 2 and _useless(hull[-2], hull[-1], i, cost, below):
                    hull.pop()
                hull.append(i)
            if front < len(hull):
                x = lengths[j - 1]
                while front + 1 < len(hull) and cost[hull[front + 1]] - x * below[hull[front + 1]] <= cost[hull[front]] - x * below[hull[front]]:
                    front += 1
                chosen[j] = hull[front]
                fresh[j] = cost[chosen[j]] + x * (below[j] - below[chosen[j]])
        choices.append(chosen)
        cost = fresh
    ends, j = [], size
    for chosen in reversed(choices):
        ends.append(lengths[j - 1])
        j = chosen[j]
    return ends[::-1]


def _useless(a: int, b: int, c: int, cost: list, below: list[int]) -> bool:
    """Line b is nowhere below both a and c."""
    return (cost[c] - cost[a]) * (below[b] - below[a]) <= (cost[b] - cost[a]) * (below[c] - below[a])


def length_histogram(rows: DataFrame, length: str) -> list[tuple[int, int]]:
    """Rows per length."""
    counts = rows.groupBy(F.col(length).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    return sorted((r["length"], r["n"]) for r in counts.collect())


def packed(rows: DataFrame, length: str, buckets: int = 16, token_budget: int = 16384, seed: int = 0, split_bits: int = 8) -> DataFrame:
    """``rows`` plus bucket_len, batch, slot and padding.

    ``length`` is a long column without nulls; length 0 goes to the shortest bucket. A batch is named by (bucket_len, batch),
    holds max(1, budget div bucket_len) rows in hash order, and only the last of a bucket may hold fewer; a row longer than
    the budget is a batch of its own. Equal rows take slots of their own. An empty table gives no rows. Columns named like
    the new ones are replaced.
    """
    taken = ("bucket_len", "batch", "slot", "padding")
    rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in taken])
    ends = best_boundaries(length_histogram(rows, length), buckets)
    bucket = F.lit(ends[-1] if ends else 0).cast("long")
    for end in reversed(ends[:-1]):
        bucket = F.when(F.col(length) <= end, F.lit(end).cast("long")).otherwise(bucket)
    placed = rows.withColumn("bucket_len", bucket).withColumn("__r", row_key(rows, seed))
    at = numbered(placed, ["bucket_len"], "__r", [F.col(f"`{c}`") for c in rows.columns], "__at", split_bits)
    room = F.greatest(F.lit(1).cast("long"), F.expr(f"{token_budget} div greatest(bucket_len, 1)"))
    out = at.withColumn("__room", room).withColumn("batch", F.expr("__at div __room")).withColumn("slot", F.col("__at") % F.col("__room"))
    return out.withColumn("padding", F.col("bucket_len") - F.col(length)).drop("__r", "__at", "__room")


def packed_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, bucket_len, batch, slot, padding; tokens are the words of the text."""
    counted = docs.select("doc_id", F.size(words(text_of("text"))).cast("long").alias("n_tokens"))
    return packed(counted, "n_tokens")
