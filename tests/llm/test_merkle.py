"""Merkle manifest against a plain tree."""

import hashlib
import os
import zlib

import pytest

from conftest import SCHEMA
from tidemark.llm import merkle_manifest

TABLES = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(TABLES), reason="test tables not present")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(hashes):
    """The root, and per leaf the siblings (left, right) of each level."""
    paths, own = [[] for _ in hashes], [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        upper, owners = [], []
        for at in range(0, len(hashes), 3):
            run = hashes[at : at + 3]
            for k in range(len(run)):
                for i in own[at + k]:
                    paths[i].append((run[:k], run[k + 1 :]))
            upper.append(digest(*run))
            owners.append([i for some in own[at : at + 3] for i in some])
        hashes, own = upper, owners
    return hashes[0], paths


def manifest_of(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["source"], []).append(row)
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    inner = {}
    for k in keys:
        ordered = sorted(groups[k], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
        inner[k] = ordered, *tree([leaf_of(r, r["text"]) for r in ordered])
    root, above = tree([inner[k][1] for k in keys]) if keys else (None, [])
    out = []
    for k, more in zip(keys, above, strict=True):
        ordered, subroot, paths = inner[k]
        for row, path in zip(ordered, paths, strict=True):
            text = row["text"]
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            folded = leaf_of(row, text)
            for left, right in path + more:
                folded = digest(*left, folded, *right)
            proof = digest(*[h for left, right in path + more for h in left + right])
            out.append((row["doc_id"], leaf_of(row, row["text"]), subroot, root, proof, folded, folded == root))
    return sorted(out, key=str)


def _got(docs, digits):
    return sorted(map(tuple, merkle_manifest.proven_documents(docs, digits).collect()), key=str)


@pytest.mark.parametrize("digits", [2, 5])
def test_odd_rows(odd, digits):
    clashing = odd.selectExpr("*", "text AS hash", "doc_id AS rank", "source AS k", "lang AS path")
    assert _got(clashing, digits) == manifest_of(odd.collect())


def test_empty_table(none):
    out = merkle_manifest.proven_documents(none)
    assert out.count() == 0 and out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_lone_rows_and_groups(spark):
    one = [(5, "a\nb", "en", "s", 3)]
    assert _got(spark.createDataFrame(one, SCHEMA), 2) == manifest_of([r.asDict() for r in spark.createDataFrame(one, SCHEMA).collect()])
    # a null, an empty and a non-ASCII source, and more groups than a block has places
    many = [(i, f"t{i}\nx", "en", s, i) for i, s in enumerate([None, "", "ä", "z", "Z", *[f"s{i}" for i in range(30)]])]
    docs = spark.createDataFrame(many, SCHEMA)
    assert _got(docs, 2) == manifest_of(docs.collect())


@pytest.mark.parametrize("digits", [3])
def test_a_hot_group_of_many_blocks(spark, digits):
    docs = spark.range(1003).selectExpr("id - 500 AS doc_id", "concat('x', id, '\\n', id) AS text", "'en' AS lang", "if(id % 3 = 0, 'hot', concat('s', id % 40)) AS source", "id AS n_chars")
    assert _got(docs, digits) == manifest_of(docs.collect())


@needs_tables
def test_documents(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    got = _got(docs, merkle_manifest.DIGITS)
    assert got == manifest_of(docs.collect()) and {r[-1] for r in got} == {True, False}


def test_a_block_is_one_exchange(spark):
    leaves = spark.range(100).selectExpr("concat('k', id % 1) AS k", "id AS rank", "id * 0 + 100 AS n", "sha2(string(id), 256) AS hash", "id AS load")
    plan = merkle_manifest._nested(leaves, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert [r.count() for r in merkle_manifest.raised(leaves, 3)] == [4, 1]
