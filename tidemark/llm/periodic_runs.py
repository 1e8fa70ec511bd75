"""Maximal repetitions of words: every stretch of a text that repeats with a period, by suffix trees and Lyndon roots.

A run of at least ``least`` words and twice its period consists of words that stand in a gram of ``(least + 1) // 2`` words found
twice in the text: two neighbouring periods share at least half the run. Words outside such grams are cut out first, a stretch of them
becoming one separator that occurs nowhere else, which loses no run and joins none. Over what is left two suffix trees are built by
Ukkonen's algorithm, of the words and of their reversal. A tour of a tree keeps, between any two neighbouring leaves, the depth of the
node where it turns, so the lowest common ancestor of two leaves, and with it their longest common extension, is a range minimum over
blocks. The longest Lyndon word from each position, under the order of the words and under its inverse, is the only candidate of a
root there; extended in both directions it gives every run with its smallest period.

All of it takes time and memory in proportion to the text's words; a text is one row, so one task holds it. Rows stay in the tasks
that read them: there is no exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import text_of, words

#: Words of a run at least.
LEAST = 12
#: Rows handed on at once.
LOT = 64
#: Entries of a range-minimum block.
SPAN = 16


class Tree:
    """Suffix tree of numbers above 0, ended by a 0 that sorts before all of them."""

    def __init__(self, numbers: list[int], width: int) -> None:
        """``width`` is above every number. Edges are keyed by node * width + first number."""
        text = [*numbers, 0]
        size = len(text)
        start, end, link, edges = [0], [0], [0], {}
        leaves = []
        node = along = at = open_ = 0
        for i, c in enumerate(text):
            open_ += 1
            fresh = 0
            while open_:
                if not along:
                    at = i
                key = node * width + text[at]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(start)
                    leaves.append(len(start))
                    start.append(i)
                    end.append(size)
                    link.append(0)
                    if fresh:
                        link[fresh] = node
                        fresh = 0
                else:
                    first = start[child]
                    reach = end[child] - first
                    if along >= reach:
                        node, at, along = child, at + reach, along - reach
                        continue
                    if text[first + along] == c:
                        along += 1
                        if fresh:
                            link[fresh] = node
                        break
                    middle = len(start)
                    edges[key] = middle
                    edges[middle * width + c] = middle + 1
                    edges[middle * width + text[first + along]] = child
                    leaves.append(middle + 1)
                    start += (first, i)
                    end += (first + along, size)
                    link += (0, 0)
                    start[child] = first + along
                    if fresh:
                        link[fresh] = middle
                    fresh = middle
                open_ -= 1
                if node:
                    node = link[node]
                elif along:
                    along -= 1
                    at = i - open_ + 1
        self.size, self.width, self.leaves = size, width, leaves
        self.keys = np.fromiter(edges.keys(), np.int64, len(edges))
        self.children = np.fromiter(edges.values(), np.int64, len(edges))
        self.lengths = np.array(end) - np.array(start)

    def _sorted(self, down: bool) -> tuple[list[int], list[int]]:
        """Children by parent and first number, with the end of the text first; where each parent's begin."""
        parents, numbers = np.divmod(self.keys, self.width)
        order = np.lexsort((np.where(numbers, -numbers, -self.width) if down else numbers, parents))
        begins = np.searchsorted(parents[order], np.arange(len(self.lengths) + 1))
        return self.children[order].tolist(), begins.tolist()

    def tour(self, down: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes in the order of the tour, ascending by numbers (``down``: by their inverse), and the depth of the node
        where the tour turns from the leaf before each to it."""
        children, begins = self._sorted(down)
        lengths = self.lengths.tolist()
        suffix = dict(zip(self.leaves, range(self.size), strict=True))
        order, turns = [], []
        depth, turn = [0] * len(lengths), [-1] * len(lengths)
        turned = 0
        stack = [0]
        while stack:
            node = stack.pop()
            if turn[node] >= 0:
                turned = turn[node]
            a, b = begins[node], begins[node + 1]
            if a == b:
                order.append(suffix[node])
                turns.append(turned)
                continue
            below = depth[node]
            for child in children[b - 1 : a : -1]:
                depth[child] = below + lengths[child]
                turn[child] = below
                stack.append(child)
            child = children[a]
            depth[child] = below + lengths[child]
            stack.append(child)
        return np.array(order), np.array(turns)


class Extension:
    """Longest common extensions of suffixes: the depth of the lowest common ancestor of two leaves, in constant time."""

    def __init__(self, order: np.ndarray, turns: np.ndarray) -> None:
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        padded = np.full(-(-len(turns) // SPAN) * SPAN, np.iinfo(np.int32).max, np.int32)
        padded[: len(turns)] = turns
        blocks = padded.reshape(-1, SPAN)
        self.turns = padded
        self.ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        self.behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [blocks.min(axis=1)]
        while (1 << len(self.levels)) <= len(self.levels[0]):
            half = 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-half], self.levels[-1][half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of different suffixes."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        left, right = low // SPAN, high // SPAN
        out = np.minimum(self.behind[low], self.ahead[high])
        same = np.flatnonzero(left == right)
        if len(same):
            inside = self.turns[low[same]]
            for k in range(1, SPAN):
                inside = np.minimum(inside, self.turns[np.minimum(low[same] + k, high[same])])
            out[same] = inside
        far = np.flatnonzero(right - left > 1)
        if len(far):
            a, n = left[far] + 1, right[far] - left[far] - 1
            level = np.frexp(n.astype(np.float64))[1] - 1
            for k in np.unique(level):
                some = level == k
                table = self.levels[k]
                out[far[some]] = np.minimum(out[far[some]], np.minimum(table[a[some]], table[a[some] + n[some] - (1 << int(k))]))
        return out.astype(np.int64)


def _next_smaller(rank: list[int]) -> np.ndarray:
    """For each place the next one with a smaller rank; the last place has the smallest."""
    found, stack = [0] * len(rank), []
    for i in range(len(rank) - 1, -1, -1):
        value = rank[i]
        while stack and rank[stack[-1]] > value:
            stack.pop()
        found[i] = stack[-1] if stack else i
        stack.append(i)
    return np.array(found)


def _repeated(numbers: np.ndarray, least: int) -> np.ndarray:
    """Places covered by grams of ``(least + 1) // 2`` numbers that occur twice; equal hashes may let a few others stay."""
    gram = (least + 1) // 2
    count = len(numbers) - gram + 1
    values = numbers.astype(np.uint64)
    hashes = np.zeros(count, np.uint64)
    for k in range(gram):
        hashes = (hashes ^ values[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    order = np.argsort(hashes, kind="stable")
    equal = hashes[order[1:]] == hashes[order[:-1]]
    twice = np.zeros(count, bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    edges = np.zeros(len(numbers) + 1, np.int64)
    begins = np.flatnonzero(twice)
    np.add.at(edges, begins, 1)
    np.add.at(edges, begins + gram, -1)
    return np.cumsum(edges[:-1]) > 0


def runs_of(tokens: list, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of the runs of a sequence, by start, then period.

    A run has its smallest period, at least ``least`` tokens and twice the period, and no neighbouring token extends it.
    """
    none = np.zeros((0, 3), np.int64)
    least = max(least, 2)
    if len(tokens) < least:
        return none
    known: dict = {}
    numbers = np.array([known.setdefault(t, len(known)) for t in tokens], np.int64)
    covered = _repeated(numbers, least)
    if not covered.any():
        return none
    # one separator, with a number of its own, stands for each stretch between covered ones
    kept = covered.copy()
    kept[1:] |= covered[:-1]
    places = np.flatnonzero(kept)
    apart = np.flatnonzero(~covered[places])
    distinct, text = np.unique(numbers[places], return_inverse=True)
    text = text + 1
    text[apart] = len(distinct) + 1 + np.arange(len(apart))
    text = text.tolist()
    width, size = len(distinct) + len(apart) + 2, len(text)
    tree = Tree(text, width)
    order, turns = tree.tour()
    inverse, _ = tree.tour(down=True)
    del tree
    right = Extension(order, turns)
    left = Extension(*Tree(text[::-1], width).tour())
    found = []
    for ranks in (order, inverse):
        rank = np.empty(size + 1, np.int64)
        rank[ranks] = np.arange(size + 1)
        i = np.arange(size)
        ahead = _next_smaller(rank.tolist())[:-1]
        period = ahead - i
        begin = i - left(size - i, size - ahead)
        length = ahead + right(i, ahead) - begin
        good = (length >= 2 * period) & (length >= least)
        found.append(np.stack([begin[good], length[good], period[good]], axis=1))
    rows = np.unique(np.concatenate(found), axis=0)
    rows[:, 0] = places[rows[:, 0]]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def collapsed(tokens: list, runs: np.ndarray) -> list:
    """The tokens without those that a run contains after its first period."""
    edges = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return [t for t, inside in zip(tokens, np.cumsum(edges[:-1]).tolist(), strict=True) if not inside] if len(runs) else tokens


RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def with_runs(docs: DataFrame, least: int = LEAST, keep_text: bool = True) -> DataFrame:
    """``docs`` plus runs, the periodic runs (start, length, period) of the text's words by start and period, and collapsed, the words left
    when each run is cut to its first period, joined by spaces.

    Words are runs of characters other than ``[\\x20\\x09-\\x0D]``. Null, empty and blank texts have no runs and an empty collapsed text.
    Rows are taken one by one: repeated rows give repeated results, an empty table none. Columns named like the new ones are
    replaced, all others kept; the text itself is left out unless ``keep_text``.
    """
    kept = [c for c in docs.columns if c not in ("runs", "collapsed") and (keep_text or c != "text")]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    arrow = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, LOT):
                lot = batch.slice(begin, LOT)
                runs, texts, ends = [], [], [0]
                for text in lot.column("text").to_pylist():
                    tokens = (text or "").encode().split()
                    runs.append(runs_of(tokens, least))
                    texts.append(b" ".join(collapsed(tokens, runs[-1])).decode())
                    ends.append(ends[-1] + len(runs[-1]))
                rows = np.concatenate(runs)
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], fields=list(arrow.value_type)))
                yield pa.RecordBatch.from_arrays([*[lot.column(c) for c in kept], listed, pa.array(texts, pa.string())], [*kept, "runs", "collapsed"])

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c in kept or c == "text"]).mapInArrow(find, schema)


def looped(text: Column, number: Column) -> Column:
    """The text; where number % 10 is 0 and it has words, its words from one place on repeat as a loop whose length the number decides."""
    g = F.floor(number / 10)

    def loop(x: Column) -> Column:
        a, p = x["a"], 1 + F.floor((F.size(x["w"]) - x["a"]) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(x["w"]) - 1), lambda i: F.get(x["w"], F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    # arrays of one element bind what the innermost step needs, so it is not computed for every word
    found = F.transform(F.array(words(text)), lambda w: F.struct(w.alias("w"), (g % F.size(w)).alias("a")))
    turned = F.transform(F.filter(found, lambda x: F.size(x["w"]) > 0), loop)
    return F.when(number % 10 == 0, F.coalesce(F.get(turned, 0), text)).otherwise(text)


def runs_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period and exponent_milli, runs_sha256 and collapsed_sha256 of every row of ``docs``.

    A tenth of the documents, by the crc32 of the decimal doc_id, is looped first; a null doc_id has no crc32 and its text stays. Of
    equally long runs the one with the smallest start, then period, is reported; without runs the four are null and both digests are
    those of what is there, the empty text included. Null, empty and blank texts have no runs. Repeated rows give repeated results, an
    empty table none; further columns are ignored.
    """
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    texts = docs.select("doc_id", "text").select("doc_id", F.when(number.isNull(), text_of("text")).otherwise(looped(text_of("text"), number)).alias("text"))
    found = with_runs(texts, keep_text=False)
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    best = found.withColumn("best", F.when(F.size("runs") > 0, longest))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.p").alias("period"),
        F.expr("(-1000 * best.l) div best.p").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
