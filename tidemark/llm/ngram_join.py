"""Near duplicates by a prefix-tree join over sets of word 5-grams.

1. Every text becomes the set of its shingles' 64-bit hashes; texts with one set are a class, named by 128 bits of it.
2. A class that links to another lacks at most ``misses(n)`` of its n shingles there, so of any part of the hash space with
   a of its shingles at least a - misses(n) occur in another class. A quarter of the space is counted; what passes is read
   again and counted with all its shingles. The test loses no link, it only drops classes that cannot have one.
3. Shingles are put into one global order by their exact frequency, common ones last. Linked sets share one of the first
   misses(n) + 1 shingles; classes joined by such a shingle form a cluster (edges per shingle lead to its smallest class, so
   they stay linear). A cluster larger than a block is taken apart into its stars: a class and all that meet at it by an edge.
4. Each cluster or star is joined in a trie of its sets. A query walks it with the overlap so far, shared by all sets below a node,
   and leaves a subtree when overlap plus what both sides have left cannot reach the needed size. Only links between
   different components are looked for: a cluster needs its connected parts, not all pairs.
5. A star larger than a task is cut into blocks. Each block is joined with itself and with block 0; then sets outside the
   largest component of the star are joined with every block. Near copies fall into one component in the first step, so
   the work stays in proportion to the rows and no task holds a whole star.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, removed, staged, staged_at, text_of, words
from tidemark.operators.keyed import once

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Share of the hash space whose shingles serve the first, cheap filter.
SAMPLED = 0.25
#: Shingles of at least this frequency are equally common.
COMMON = 1 << 16
#: A set counts as its shingles plus SET_COST; a block holds BLOCK of that, about 1,500 sets of ordinary length.
SET_COST = 512
BLOCK = 1 << 20
#: Shingles that a task gathers before it hands them on.
GATHERED = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _paired(column: str, gap: int) -> Column:
    left = F.greatest(F.size(column) - gap, F.lit(0))
    return F.zip_with(F.slice(column, F.lit(1), left), F.slice(column, F.lit(1 + gap), left), lambda a, b: F.xxhash64(a, b))


def with_shingles(docs: DataFrame, out: str = "shingles") -> DataFrame:
    """Adds the sorted array of 64-bit hashes of a document's distinct shingles."""
    steps = docs.withColumn("__h1", F.transform(words(F.translate(text_of("text"), UPPER, LOWER)), lambda w: F.xxhash64(w)))
    steps = steps.withColumn("__h2", _paired("__h1", 1)).withColumn("__h4", _paired("__h2", 2))
    full = F.zip_with("__h4", F.slice("__h1", F.lit(SHINGLE), F.size("__h4")), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    few = F.when(F.size("__h1") > 0, F.array(F.xxhash64(F.size("__h1"), "__h1"))).otherwise(F.array().cast("array<bigint>"))
    long = F.slice(full, F.lit(1), F.greatest(F.size("__h1") - (SHINGLE - 1), F.lit(0)))
    chosen = F.when(F.size("__h1") >= SHINGLE, F.sort_array(F.array_distinct(long))).otherwise(few)
    return once(steps, {out: chosen}).drop("__h1", "__h2", "__h4")


def misses(n: Column) -> Column:
    """How many shingles of a set a linked set may lack."""
    return n - F.floor((PERCENT * n + 99) / 100).cast("int")


def _needed(n: int) -> int:
    return (PERCENT * n + 99) // 100


def _keyed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Adds two 64-bit digests of the row's ``columns``, nulls told apart by their place."""
    values = [F.col(f"`{c}`") for c in columns]
    nulls = F.array(*[v.isNull() for v in values])
    return docs.withColumn("__k1", F.xxhash64(F.lit(1), nulls, *values)).withColumn("__k2", F.xxhash64(F.lit(2), nulls, *values))


def _chosen_rows(keyed: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``keyed`` whose digests are in ``chosen`` (k1, k2, single); of rows equal by them one, where ``single`` holds."""

    def among(keys: DataFrame) -> DataFrame:
        return keyed.join(keys, (F.col("__k1") == F.col("k1")) & (F.col("__k2") == F.col("k2")), "left_semi")

    # mostly none; once written, Spark sees that and does not move all texts for them
    repeated = staged(chosen.where("single").select("k1", "k2"), "join-repeated")
    return among(chosen.where("not single").select("k1", "k2")).unionByName(among(repeated).dropDuplicates(["__k1", "__k2"]))


def shingle_sets(keyed: DataFrame) -> DataFrame:
    """doc_id, the row's digests, node (16 bytes of the set, equal for equal sets), key, n and shingles."""
    sets = with_shingles(keyed.select("doc_id", "text", "__k1", "__k2"))
    first, second = F.xxhash64("shingles"), F.xxhash64(F.lit(1), "shingles")
    node = F.unhex(F.concat(F.lpad(F.hex(first), 16, "0"), F.lpad(F.hex(second), 16, "0")))
    return sets.select("doc_id", "__k1", "__k2", node.alias("node"), first.alias("key"), F.size("shingles").alias("n"), "shingles")


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def shared_shingles(sets: DataFrame, buckets: int) -> DataFrame:
    """(key, shared): how many of a class's shingles occur in another class. ``sets`` has key and shingles.

    Shingles travel as packed arrays, a row per bucket of the hash space and gathering, with copies of a class inside a
    gathering sent once. A shingle is told by its bucket and 32 more bits; what collides is counted as shared, which only lets
    more classes pass.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, keys, size, seen = [], [], 0, set()

        def send():
            tokens, owners = np.concatenate(values), np.concatenate(keys)
            mixed = tokens.view(np.uint64)
            # the low 32 bits tell shingles apart inside a bucket; the bucket comes from the bits above them
            part = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, low, owners = part[order], (mixed[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32), owners[order]
            ends = np.flatnonzero(np.diff(part)) + 1
            pieces = list(zip(np.r_[0, ends], np.r_[ends, len(part)], strict=True))
            return pa.record_batch([
                pa.array([int(part[a]) for a, _ in pieces], pa.int32()),
                pa.array([low[a:b].tobytes() for a, b in pieces], pa.binary()),
                pa.array([owners[a:b].tobytes() for a, b in pieces], pa.binary()),
            ], ["bucket", "tokens", "owners"])

        for batch in batches:
            owners = batch.column("key").to_numpy(zero_copy_only=False)
            tokens, lengths = _flat(batch.column("shingles"))
            fresh = np.zeros(len(owners), bool)
            for i, key in enumerate(owners.tolist()):
                if key not in seen:
                    seen.add(key)
                    fresh[i] = True
            taken = np.repeat(fresh, lengths)
            values.append(tokens[taken])
            keys.append(np.repeat(owners[fresh], lengths[fresh]))
            size += len(values[-1])
            if size >= GATHERED:
                yield send()
                values, keys, size, seen = [], [], 0, set()
        if size:
            yield send()

    def count(group: pa.Table) -> pa.Table:
        tokens = np.concatenate([np.frombuffer(b, np.uint32) for b in group.column("tokens").to_pylist()])
        owners = np.concatenate([np.frombuffer(b, np.int64) for b in group.column("owners").to_pylist()])
        order = np.lexsort((owners, tokens))
        tokens, owners = tokens[order], owners[order]
        single = np.r_[True, (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])]
        tokens, owners = tokens[single], owners[single]
        same = tokens[1:] == tokens[:-1]
        shared = np.r_[False, same] | np.r_[same, False]
        found, times = np.unique(owners[shared], return_counts=True)
        return pa.table({"key": found, "shared": times.astype(np.int64)})

    dealt = sets.select("key", "shingles").mapInArrow(deal, "bucket int, tokens binary, owners binary")
    counted = dealt.groupBy("bucket").applyInArrow(count, "key long, shared long")
    return counted.groupBy("key").agg(F.sum("shared").alias("shared"))


def ordered_prefixes(sets: DataFrame, buckets: int, parts: int) -> DataFrame:
    """(key, shared, prefix) of every class that shares a shingle: how many it shares, and the first of them, rare ones first.

    ``sets`` has key and shingles. Frequencies are exact, up to COMMON. Of ``shared`` shingles a set that passes the test needs a fifth
    and one more at most; shingles that it shares with nobody would stand before them and meet nobody. Shingles travel as packed
    arrays, to buckets of the hash space and back to ``parts`` of the classes.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, keys, size = [], [], 0

        def send():
            tokens, owners = np.concatenate(values), np.concatenate(keys)
            part = (tokens.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
            return _packed(part, tokens, owners)

        for batch in batches:
            tokens, lengths = _flat(batch.column("shingles"))
            values.append(tokens)
            keys.append(np.repeat(batch.column("key").to_numpy(zero_copy_only=False), lengths))
            size += len(tokens)
            if size >= GATHERED:
                yield send()
                values, keys, size = [], [], 0
        if size:
            yield send()

    def count(group: pa.Table) -> pa.Table:
        tokens, owners = (np.concatenate([np.frombuffer(x, np.int64) for x in group.column(c).to_pylist()]) for c in ("first", "second"))
        order = np.lexsort((owners, tokens))
        tokens, owners = tokens[order], owners[order]
        single = np.r_[True, (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])]
        tokens, owners = tokens[single], owners[single]
        place = np.cumsum(np.r_[True, tokens[1:] != tokens[:-1]]) - 1
        times = np.bincount(place)[place]
        met = times > 1
        tokens, owners, times = tokens[met], owners[met], np.minimum(times[met], COMMON).astype(np.int32)
        return pa.Table.from_batches([_packed((owners.view(np.uint64) % np.uint64(parts)).astype(np.int32), tokens, owners, times)])

    def choose(group: pa.Table) -> pa.Table:
        tokens, owners = (np.concatenate([np.frombuffer(x, np.int64) for x in group.column(c).to_pylist()]) for c in ("first", "second"))
        times = np.concatenate([np.frombuffer(x, np.int32) for x in group.column("third").to_pylist()])
        order = np.lexsort((tokens, times, owners))
        tokens, owners = tokens[order], owners[order]
        starts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
        shared = np.diff(np.r_[starts, len(owners)])
        most = shared - (PERCENT * shared + 99) // 100 + 1
        first = np.arange(len(owners)) - np.repeat(starts, shared) < np.repeat(most, shared)
        prefix = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(most)], pa.int32()), pa.array(tokens[first]))
        return pa.table({"key": owners[starts], "shared": shared.astype(np.int64), "prefix": prefix})

    dealt = sets.select("key", "shingles").mapInArrow(deal, "part int, first binary, second binary")
    counted = dealt.groupBy("part").applyInArrow(count, "part int, first binary, second binary, third binary")
    return counted.groupBy("part").applyInArrow(choose, "key long, shared long, prefix array<long>")


def _packed(part: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """A row per part with the bytes of each column's values there."""
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [x[order] for x in columns]
    cuts = np.flatnonzero(np.diff(part)) + 1
    pieces = list(zip(np.r_[0, cuts], np.r_[cuts, len(part)], strict=True)) if len(part) else []
    values = [pa.array([int(part[a]) for a, _ in pieces], pa.int32()), *[pa.array([x[a:b].tobytes() for a, b in pieces], pa.binary()) for x in columns]]
    return pa.record_batch(values, ["part", "first", "second", "third"][: len(values)])


class _Trie:
    """Path-compressed trie of sets in one order; a node is an interval of the sorted sets."""

    def __init__(self, sets: list[tuple[int, ...]], sizes: list[int]):
        order = sorted(range(len(sets)), key=lambda i: sets[i])
        self.nodes: list[tuple] = []
        ordered = [sets[i] for i in order]
        shared = [0] + [_common_length(a, b) for a, b in zip(ordered, ordered[1:], strict=False)]
        # (members that end here, label, longest rest with label, smallest set size, children)
        stack = [(0, len(order), 0, -1)]
        while stack:
            low, high, depth, parent = stack.pop()
            end = min(shared[low + 1 : high], default=len(ordered[low]))
            inside = order[low:high]
            ending = [i for i in inside if len(sets[i]) == end] if high - low > 1 else list(inside)
            label = ordered[low][depth:end] if high - low > 1 else ordered[low][depth:]
            me = len(self.nodes)
            self.nodes.append((ending, frozenset(label), label[0] if label else None, max(len(sets[i]) for i in inside) - depth, min(sizes[i] for i in inside), []))
            if parent >= 0:
                self.nodes[parent][5].append(me)
            if high - low > 1:
                start = low + len(ending)
                for k in range(start + 1, high + 1):
                    if k == high or shared[k] == end:
                        stack.append((start, k, end, me))
                        start = k


def _common_length(a: tuple, b: tuple) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n - 1
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def joined_parts(labels: list, sizes: list[int], tokens: list[np.ndarray], asks: list[bool]) -> list[tuple]:
    """(label, root label) of every set, after joining by links between asking sets and all sets.

    Sets with one label are one component from the start.
    """
    roots: dict = {label: label for label in labels}

    def find(x):
        while roots[x] != x:
            roots[x] = roots[roots[x]]
            x = roots[x]
        return x

    values, inverse, counts = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    # common shingles first, so that sets share long paths; a shingle of one set only cannot be shared
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -counts))] = np.arange(len(values))
    shared = counts[inverse] > 1
    sequences, at = [], 0
    for one in tokens:
        own = rank[inverse[at : at + len(one)][shared[at : at + len(one)]]]
        sequences.append(tuple(np.sort(own).tolist()))
        at += len(one)
    able = [i for i in range(len(tokens)) if sizes[i] and len(sequences[i]) >= _needed(sizes[i])]
    parts = len({find(labels[i]) for i in able})
    if parts > 1:
        trie = _Trie([sequences[i] for i in able], [sizes[i] for i in able])
        for q in able:
            if not asks[q]:
                continue
            own, sequence, size = frozenset(sequences[q]), sequences[q], sizes[q]
            stack = [(0, 0)]
            while stack:
                n, overlap = stack.pop()
                ending, label, first, rest, least, children = trie.nodes[n]
                left = len(sequence) - bisect.bisect_left(sequence, first) if first is not None else rest
                if (100 + PERCENT) * (overlap + min(rest, left)) < PERCENT * (size + least):
                    continue
                if not children and all(find(labels[able[i]]) == find(labels[q]) for i in ending):
                    continue
                overlap += len(own & label)
                for i in ending:
                    other = able[i]
                    if (100 + PERCENT) * overlap >= PERCENT * (size + sizes[other]):
                        a, b = find(labels[q]), find(labels[other])
                        if a != b:
                            roots[max(a, b)] = min(a, b)
                            parts -= 1
                stack.extend((child, overlap) for child in children)
            if parts == 1:
                break
    return [(label, find(label)) for label in set(labels)]


def _join_tasks(rows: DataFrame) -> DataFrame:
    """(u, v): labels and their smallest linked label, task by task. ``rows`` has task, label, n, shingles and asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, ([], [], [], [])

        def finish():
            found = [(a, b) for a, b in joined_parts(*held) if a != b] if len(held[0]) > 1 else []
            return pa.record_batch([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], ["u", "v"])

        for batch in batches:
            tokens, lengths = _flat(batch.column("shingles"))
            ends = np.cumsum(lengths)
            columns = [batch.column(c).to_pylist() for c in ("task", "label", "n", "asks")]
            for i, (task, label, n, asks) in enumerate(zip(*columns, strict=True)):
                if task != current:
                    if current is not None:
                        yield finish()
                    current, held = task, ([], [], [], [])
                for where, value in zip(held, (label, n, tokens[ends[i] - lengths[i] : ends[i]].copy(), asks), strict=True):
                    where.append(value)
        if current is not None:
            yield finish()

    dealt = rows.repartition("task").sortWithinPartitions("task")
    return dealt.select("task", "label", "n", "shingles", "asks").mapInArrow(run, "u binary, v binary")


def _with_shingles(tasks: DataFrame, sets: DataFrame) -> DataFrame:
    return tasks.join(sets, F.col("member") == F.col("node")).select("task", "label", "n", "shingles", "asks")


def _task(*parts: Column) -> Column:
    return F.concat(F.col("cluster"), *[F.unhex(F.lpad(F.hex(p.cast("long")), 16, "0")) for p in parts])


def linked_classes(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes with a link. ``sets`` has node, n and shingles, a row per node; ``edges`` (node, shingle) of the prefixes."""
    centres = edges.groupBy("shingle").agg(F.min("node").alias("v"), F.max("node").alias("top")).where("v != top").select(F.col("shingle").alias("of"), "v")
    meetings = edges.join(centres, F.col("shingle") == F.col("of")).where("node != v").select(F.col("node").alias("u"), "v").distinct()
    meetings = staged(meetings, "join-meetings")
    clusters = components(meetings).select(F.col("node").alias("member"), F.col("root").alias("cluster"))

    sized = sets.select("node", "n").dropDuplicates(["node"]).join(clusters, F.col("node") == F.col("member")).select("member", "cluster", (F.col("n") + SET_COST).alias("cost"))
    totals = sized.groupBy("cluster").agg(F.sum("cost").alias("total")).withColumnRenamed("cluster", "c")
    sized = staged(sized.join(totals, F.col("cluster") == F.col("c")).drop("c"), "join-clusters")
    # a cluster above a block is chained together by shingles; all sets with one of them meet at its smallest set
    stars = meetings.unionByName(meetings.select(F.col("v").alias("u"), "v").distinct())
    chained = sized.where(F.col("total") > BLOCK).select("member", "cost").join(stars, F.col("u") == F.col("member")).select("member", F.col("v").alias("cluster"), "cost")
    units = staged(sized.where(F.col("total") <= BLOCK).select("member", "cluster", "cost").unionByName(chained), "join-units")
    blocks = units.groupBy("cluster").agg(F.ceil(F.sum("cost") / BLOCK).cast("int").alias("blocks")).withColumnRenamed("cluster", "c")
    placed = units.join(blocks, F.col("cluster") == F.col("c")).select("member", "cluster", "cost", "blocks", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int").alias("block"))
    placed = staged(placed, "join-placed")

    # tasks are made out of narrow rows; shingles join them once, at the end
    goals = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    inside = placed.select("member", "cluster", F.explode(goals).alias("goal"), F.col("member").alias("label"), F.lit(True).alias("asks"))
    first = components(_join_tasks(_with_shingles(inside.withColumn("task", _task(F.col("goal"))), sets)))

    large = placed.where("blocks > 1").join(first, F.col("member") == F.col("node"), "left").select("member", "cluster", "cost", "blocks", "block", F.coalesce("root", "member").alias("label"))
    large = staged(large, "join-large")
    sizes = large.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("members"))
    main = sizes.groupBy("cluster").agg(F.max(F.struct("members", "label")).alias("m")).select(F.col("cluster").alias("c"), F.col("m.label").alias("main"))
    outside = large.join(main, F.col("cluster") == F.col("c")).where("label != main").drop("c", "main")
    rounds = outside.groupBy("cluster").agg(F.ceil(F.sum("cost") / BLOCK).cast("long").alias("rounds")).withColumnRenamed("cluster", "rc")
    asking = outside.join(rounds, F.col("cluster") == F.col("rc")).withColumn("round", F.pmod(F.xxhash64(F.lit(2), "member"), F.col("rounds")))
    asking = asking.select("member", "cluster", "round", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "label", F.lit(True).alias("asks"))
    asked = large.join(rounds, F.col("cluster") == F.col("rc")).select("member", "cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rounds") - 1)).alias("round"), "block", "label", F.lit(False).alias("asks"))
    # few rows, or none; once written, Spark sees that and does not move all sets for them
    tasks = staged(asking.unionByName(asked).withColumn("task", _task(F.col("round"), F.col("block"))), "join-tasks")
    second = _join_tasks(_with_shingles(tasks, sets))
    return components(first.where("node != root").select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(second))


def _grouped(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, __k1, __k2, node, n) of every row, and (c, least, root) of every class of texts with words.

    ``least`` is the row of the class that comes first: no_id, doc_id, k1, k2, and copies, the rows equal to it by their digests.
    """
    spark = keyed.sparkSession
    limit = int(-(2**63) + 2**64 * SAMPLED)
    buckets = max(64, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    all_sets = shingle_sets(keyed).withColumn("shingles", F.filter("shingles", lambda x: x < limit))
    sampled, path = staged_at(all_sets, "join-sets")
    equal = sampled.where("n > 0").groupBy("node", "doc_id", "__k1", "__k2").agg(F.count(F.lit(1)).alias("copies"), F.first("key").alias("key"), F.first("n").alias("n"), F.first(F.size("shingles")).alias("a"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.col("copies").alias("copies"))
    classes = staged(equal.groupBy("node").agg(F.min(place).alias("least"), F.first("key").alias("key"), F.first("n").alias("n"), F.first("a").alias("a")), "join-classes")
    shared = shared_shingles(sampled, buckets).withColumnRenamed("key", "of")
    able = classes.join(shared, F.col("key") == F.col("of"), "left").where(F.coalesce("shared", F.lit(0)) >= F.col("a") - misses(F.col("n")))
    able = staged(able.select("least.k1", "least.k2", (F.col("least.copies") > 1).alias("single")), "join-able")
    narrow = staged(sampled.select("doc_id", "__k1", "__k2", "node", "n"), "join-nodes")
    removed(spark, path)
    # by the digests, so that a class is read once also where its id is null or repeats
    again = _chosen_rows(keyed.select("doc_id", "text", "__k1", "__k2"), able)
    full, path = staged_at(shingle_sets(again).select("node", "key", "n", "shingles"), "join-shingles")
    # the same test over all shingles: what most of a set shares with nobody left cannot be linked
    tokens = full.agg(F.sum("n")).first()[0] or 0
    prefixes = staged(ordered_prefixes(full, max(16, tokens >> 19), max(16, tokens >> 21)).withColumnRenamed("key", "of"), "join-prefixes")
    spare = F.col("shared") - F.col("n") + misses(F.col("n"))
    edges = full.where("n > 0").select("node", "key", "n").join(prefixes, F.col("key") == F.col("of")).where(spare >= 0)
    edges = edges.select("node", F.explode(F.slice("prefix", F.lit(1), (spare + 1).cast("int"))).alias("shingle"))
    roots = linked_classes(full, edges)
    removed(spark, path)
    named = classes.select(F.col("node").alias("c"), "least").join(roots, F.col("c") == F.col("node"), "left")
    return narrow, named.select("c", "least", F.coalesce("root", "c").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    component_id is the smallest doc_id that links reach, null ids last. Texts without words, and null texts, have no shingles
    and are linked with nothing, not even one another. Rows with equal sets are one class. Rows that share a doc_id are taken
    by their texts. An empty table gives no rows; other columns are ignored.
    """
    narrow, named = _grouped(_keyed(docs.select("doc_id", "text"), ["doc_id", "text"]))
    smallest = named.groupBy("root").agg(F.min("least.doc_id").alias("component_id")).withColumnRenamed("root", "r")
    names = named.join(smallest, F.col("root") == F.col("r")).select("c", "component_id")
    out = narrow.select("doc_id", "n", "node").join(names, F.col("node") == F.col("c"), "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, with its own columns: the one with the smallest doc_id (null last), then with the least digest.

    Of rows equal in every column one stays. Texts without words are linked with nothing, so all of them stay.
    """
    keyed = _keyed(docs, docs.columns)
    narrow, named = _grouped(keyed)
    first = named.groupBy("root").agg(F.min("least").alias("f")).select("f.k1", "f.k2", (F.col("f.copies") > 1).alias("single"))
    blank = narrow.where("n = 0").select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.lit(False).alias("single")).distinct()
    return _chosen_rows(keyed, staged(first.unionByName(blank), "join-kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
