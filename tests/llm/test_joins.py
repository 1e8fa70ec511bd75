"""Connected components, the prefix-tree join, packing."""

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import component_ids, shingles
from conftest import LINES, ODD, SCHEMA, document
from tidemark.llm import ngram_join, packing
from tidemark.llm.common import components, numbered

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    nodes = [f"{rng.random():.6f}" for _ in range(120)]
    edges = [tuple(rng.sample(nodes, 2)) for _ in range(70)] + [(a, b) for a, b in zip(nodes[:40], nodes[1:40], strict=False)] + [(nodes[50], nodes[50])]
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "u string, v string")).collect()
    assert sorted((r["node"], r["root"]) for r in got) == sorted((n, find(n)) for n in touched)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_numbers_have_no_gaps(spark):
    rows = spark.range(500).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.xxhash64("id").alias("h"))
    got = numbered(rows, ["g"], "h", [F.col("id")], "at", 4).collect()
    for g in (None, 1, 2):
        own = sorted((r["h"], r["at"]) for r in got if r["g"] == g)
        assert [at for _, at in own] == list(range(len(own)))


def _near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def _corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=40))
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 90))) for _ in range(40)]
    texts += [f"{t} {passage}" for t in texts[:25]]
    for _ in range(4):
        texts += _near_copies(rng, " ".join(rng.choices(vocabulary, k=rng.randint(8, 120))), 25, 3)
    chain = rng.choices(vocabulary, k=60)
    for k in range(12):
        texts.append(" ".join([f"c{k}{i}" for i in range(4)] + chain[k:] + [f"t{i}" for i in range(k)]))
    texts += [texts[3].upper(), "  " + texts[5].replace(" ", "\n\t"), None, "", " \n"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return [document(i, t) for i, t in zip(ids, texts, strict=True)]


@pytest.mark.parametrize(("seed", "block", "common"), [(1, 1 << 20, 1 << 16), (2, 4000, 1 << 16), (3, 1500, 10), (4, 1 << 20, 1)])
def test_join_equals_brute_force(spark, monkeypatch, seed, block, common):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "COMMON", common)
    rows = _corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()}
    expected = component_ids([(r[0], r[1]) for r in rows])
    assert got == {r[0]: (len(shingles(r[1])), c) for r, c in zip(rows, expected, strict=True)}
    assert len(set(expected)) < len(rows) - 30


@pytest.mark.parametrize("seed", range(20))
def test_trie_links(seed):
    rng = random.Random(seed)
    base = rng.sample(range(10**9), 60)
    sets = []
    for _ in range(40):
        own = set(rng.sample(base, rng.randint(30, 60)))
        sets.append(np.array(sorted(own | set(rng.sample(range(10**9), rng.randint(0, 6)))), np.int64))
    labels = [bytes([i]) for i in range(40)]
    parts = dict(ngram_join.joined_parts(labels, [len(s) for s in sets], sets, [True] * 40))
    root = {x: x for x in labels}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(40), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(labels[a]), find(labels[b])
            root[max(x, y)] = min(x, y)
    assert parts == {x: find(x) for x in labels}


def test_join_of_odd_rows(odd, none):
    got = sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(odd).collect())))
    expected = component_ids([(r[0], r[1]) for r in ODD])
    assert got == sorted(str((r[0], len(shingles(r[1])), c)) for r, c in zip(ODD, expected, strict=True))
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns
    assert ngram_join.near_duplicates(none).count() == 0 and ngram_join.one_of_each(none).count() == 0


def test_one_row_of_each_component_stays(spark):
    texts = ["\n".join(LINES[k : k + 5]) for k in (0, 6)]
    extra = [document(None, t) for t in (LINES[5], LINES[5], texts[1], texts[1] + " ", "", None)] + [document(30, texts[1]), document(31, LINES[0]), document(31, LINES[0].upper()), document(31, LINES[0])]
    # digests that left out nulls would take the first two for one row
    swapped = [document(40, LINES[3], "en", None), document(40, LINES[4], "en", None), document(40, LINES[4], None, "en")]
    rows = ODD + extra + swapped
    left = [tuple(r) for r in ngram_join.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()]
    groups = {}
    for name, row in zip(component_ids([(i, r[1]) for i, r in enumerate(rows)]), rows, strict=True):
        groups.setdefault(name, []).append(row)
    assert len(left) == len(groups)
    for members in groups.values():
        mine = [r for r in left if r in members]
        if shingles(members[0][1]):
            assert len(mine) == 1
        # the smallest doc_id stays, a null one only where there is no other
        assert {(r[0] is None, r[0] or 0) for r in mine} == {min((r[0] is None, r[0] or 0) for r in members)}


def test_a_class_is_read_once_under_null_and_repeated_ids(spark, monkeypatch):
    rng = random.Random(9)
    rows, plain = [], [" ".join(f"p{k}w{i}" for i in range(60)) for k in range(8)]
    for k, base in enumerate(plain):
        for text in _near_copies(rng, base, 5, 2):
            rows += [document(None, text)] * 2 if k % 2 else [document(7, text), document(7, text), document(None, text)]
    read, kept = {}, ngram_join.staged_at

    def counting(df, name):
        out = kept(df, name)
        read[name] = out[0].count()
        return out

    monkeypatch.setattr(ngram_join, "staged_at", counting)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect())))
    expected = component_ids([(r[0], r[1]) for r in rows])
    assert got == sorted(str((r[0], len(shingles(r[1])), c)) for r, c in zip(rows, expected, strict=True))
    assert 8 <= read["join-shingles"] <= len({frozenset(shingles(r[1])) for r in rows})


def _padding(histogram, ends):
    return sum(n * (min(e for e in ends if e >= length) - length) for length, n in histogram)


@pytest.mark.parametrize("seed", range(30))
def test_boundaries_need_the_least_padding(seed):
    rng = random.Random(seed)
    histogram = sorted((length, rng.randint(1, 50)) for length in rng.sample(range(200), rng.randint(1, 9)))
    for buckets in (1, 2, 3, 12):
        ends = packing.best_boundaries(histogram, buckets)
        lengths = [length for length, _ in histogram]
        best = min(_padding(histogram, [*inner, lengths[-1]]) for k in range(min(buckets, len(lengths))) for inner in itertools.combinations(lengths[:-1], k))
        assert len(ends) <= buckets and _padding(histogram, ends) == best
    assert packing.best_boundaries([], 4) == []


def test_grid_keeps_leading_bits(spark):
    values = [0, 1, 5, 4095, 4096, 4097, 8191, 8193, 123_457, 10**12 + 1]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v long").orderBy("i").select(packing.on_grid(F.col("v"))).collect()]
    assert got[:6] == [0, 1, 5, 4095, 4096, 4098] and all(v <= g <= v * (1 + 1 / 2047) for v, g in zip(values, got, strict=True))


def test_batches_hold_the_budget(odd, none, spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(300)) * F.pmod(F.col("id"), F.lit(7))).alias("n"))
    got = packing.packed(rows, "n", buckets=6, token_budget=5000).collect()
    assert len(got) == 4000 and len({r["bucket_len"] for r in got}) <= 6
    for bucket in {r["bucket_len"] for r in got}:
        own = [r for r in got if r["bucket_len"] == bucket]
        room = max(1, 5000 // max(bucket, 1))
        assert all(0 <= r["padding"] == bucket - r["n"] for r in own)
        assert sorted((r["batch"], r["slot"]) for r in own) == [(i // room, i % room) for i in range(len(own))]
    out = packing.packed_documents(odd)
    assert out.count() == len(ODD) and out.where("padding < 0 or bucket_len is null").count() == 0
    assert packing.packed_documents(none).count() == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")
def test_buckets_are_optimal_on_the_table(spark):
    docs = spark.read.parquet(SMALL + "/documents.parquet")
    got = packing.packed_documents(docs).collect()
    lengths = sorted(r["n_tokens"] for r in got)
    distinct = sorted(set(lengths))
    below = np.searchsorted(lengths, distinct, side="right")
    cost = np.array(distinct, float) * below
    for _ in range(15):
        cost = np.minimum(cost, np.array([min([cost[i] + distinct[j] * (below[j] - below[i]) for i in range(j)], default=cost[j]) for j in range(len(distinct))]))
    on_grid = max(distinct) < 4096
    assert not on_grid or sum(r["bucket_len"] for r in got) == cost[-1]


def test_boundaries_of_long_texts_are_real_lengths(spark):
    rng = random.Random(3)
    lengths = [5461] * 3 + [20_020] + [rng.choice((4097, 4099, 6001, 8193, 9999, 12_345)) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n long")
    histogram = sorted((x, lengths.count(x)) for x in set(lengths))
    for buckets in (3, 16):
        got = packing.packed(rows, "n", buckets).collect()
        distinct = [x for x, _ in histogram]
        best = min(_padding(histogram, [*inner, distinct[-1]]) for k in range(min(buckets, len(distinct))) for inner in itertools.combinations(distinct[:-1], k))
        assert sum(r["padding"] for r in got) == best and {r["bucket_len"] for r in got} <= set(lengths)
    # three rows of 5,461 words fit into 16,384 tokens
    assert {(r["batch"], r["slot"]) for r in got if r["n"] == 5461} == {(0, 0), (0, 1), (0, 2)}
