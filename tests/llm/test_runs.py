"""Periodic runs against the definition, word by word."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from conftest import ODD
from tidemark.llm import periodic_runs

TABLES = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(TABLES), reason="test tables not present")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs_by_definition(words, least):
    """For each period, smallest first, the longest stretches in which words that far apart are equal; a stretch met before has a smaller period."""
    known = {w: n for n, w in enumerate(dict.fromkeys(words))}
    numbers = np.array([known[w] for w in words], np.int64)
    found = {}
    for q in range(1, len(words) // 2 + 1):
        same = np.concatenate([[False], numbers[:-q] == numbers[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in edges.reshape(-1, 2).tolist():
            # a period of two lengths of it is the smallest one unless a divisor has the stretch
            if b - a + q >= max(least, 2 * q) and not any(s <= a and b + q <= s + n for (s, n), p in found.items() if q % p == 0):
                found[a, b - a + q] = q
    return sorted((a, n, q) for (a, n), q in found.items())


def contract(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_definition(words, 12)
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{a},{b},{c}\n" for a, b, c in runs), " ".join(w for i, w in enumerate(words) if i not in gone))]
    return (doc_id, len(runs), *four, *digest)


@pytest.mark.parametrize("least", [2, 5, 12])
def test_short_sequences(least):
    dice = random.Random(7)
    for _ in range(1500):
        size, letters = dice.randint(0, 60), dice.randint(1, 4)
        words = [dice.randint(1, letters) for _ in range(size)]
        if dice.random() < 0.5 and size:
            p = dice.randint(1, max(1, size // 3))
            words = [words[i % p] if dice.random() < 0.99 else words[i] for i in range(size)]
        got = [tuple(r) for r in periodic_runs.runs_of(words, least).tolist()]
        assert got == runs_by_definition(words, least), words


def test_repetitive_families():
    fibonacci, previous = "ab", "a"
    while len(fibonacci) < 400:
        fibonacci, previous = fibonacci + previous, fibonacci
    for words in (fibonacci, "a" * 300, ("abc" * 40 + "abd") * 3, "ab" * 100 + "a", "".join("ab"[bin(i).count("1") % 2] for i in range(256)), "x".join(["abcabcabc"] * 20)):
        for least in (2, 12):
            assert [tuple(r) for r in periodic_runs.runs_of(list(words), least).tolist()] == runs_by_definition(words, least)


def test_extensions_equal_the_definition():
    dice = random.Random(3)
    text = [dice.randint(1, 2) for _ in range(90)]
    extension = periodic_runs.Extension(*periodic_runs.Tree(text, 3).tour())
    a, b = zip(*[(i, j) for i in range(91) for j in range(91) if i != j], strict=True)

    def common(i, j):
        k = 0
        while max(i, j) + k < len(text) and text[i + k] == text[j + k]:
            k += 1
        return k

    assert extension(np.array(a), np.array(b)).tolist() == [common(i, j) for i, j in zip(a, b, strict=True)]
    order, _ = periodic_runs.Tree(text, 3).tour(down=True)
    assert order.tolist() == sorted(range(91), key=lambda i: [-x for x in text[i:]])


def test_a_long_text_of_one_period():
    words = [f"w{i % 9001}" for i in range(60_000)]
    assert periodic_runs.runs_of(words).tolist() == [[0, 60_000, 9001]]


def test_odd_rows(spark, odd, none):
    more = odd.selectExpr("*", "doc_id AS runs", "text AS collapsed", "doc_id AS length")
    got = sorted(map(tuple, periodic_runs.runs_of_documents(more).collect()), key=str)
    assert got == sorted((contract(r[0], r[1]) for r in ODD), key=str)
    assert periodic_runs.runs_of_documents(none).count() == 0
    looped = [(i, " ".join(f"w{k * i % 7}" for k in range(i % 90)) + " \n\x0b") for i in range(400)]
    docs = spark.createDataFrame(looped, "doc_id long, text string")
    assert sorted(map(tuple, periodic_runs.runs_of_documents(docs).collect()), key=str) == sorted((contract(*r) for r in looped), key=str)


def test_general_interface(spark):
    docs = spark.createDataFrame([(1, "go a b a b a b stop", "kept"), (2, None, "kept")], "doc_id long, text string, extra string")
    rows = periodic_runs.with_runs(docs, least=6).orderBy("doc_id").collect()
    assert [r.asDict(True) for r in rows] == [
        {"doc_id": 1, "text": "go a b a b a b stop", "extra": "kept", "runs": [{"start": 1, "length": 6, "period": 2}], "collapsed": "go a b stop"},
        {"doc_id": 2, "text": None, "extra": "kept", "runs": [], "collapsed": ""},
    ]


@needs_tables
def test_documents(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    got = sorted(map(tuple, periodic_runs.runs_of_documents(docs).collect()), key=str)
    assert got == sorted((contract(r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    assert sum(r[1] for r in got) > 10
