"""Capture index, quality classifier, SentencePiece, pipeline."""

import base64
import gzip
import hashlib
import os
import random
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brute import component_ids, without_repeated_lines
from conftest import ODD
from tidemark.llm import capture_index, quality_classifier, quality_rules, sentencepieces
from tidemark.llm.common import scratch

TABLES = "/root/testdata/sf0.01"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
needs_tables = pytest.mark.skipif(not os.path.isdir(TABLES), reason="test tables not present")
needs_pieces = pytest.mark.skipif(not os.path.exists(PIECES), reason="vocabulary not present")

PAGES = [(1, "https://Sub.Example.com:8080/a?x=1#top", "<p>a</p>"), (2, "http://example.com", "<p>b</p>"), (3, None, None), (4, "http://example.com/", ""), (5, "http://user@example.com/a", "<p>a</p>"),
         (6, "no scheme", "<p>\r\n\r\nWARC/1.1\r\n\r\n" * 9), (7, "http://b.example.com/\r\nX: y", "日本 😀"), (None, "http://example.com/n", "<p>b</p>"), (None, None, None), (8, "http://example.com", "x" * 200_000)]


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "page_id AS key", "url AS ident", "html AS file")


def _expected(rows):
    best = {}
    for page_id, _, html in rows:
        best[html or ""] = max((page_id if page_id is not None else -1), best.get(html or "", -1))
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        first = best[html or ""] == (page_id if page_id is not None else -1)
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else best[html or ""]))
    return Counter(out)


def test_pages_come_back(spark):
    got = Counter(map(tuple, capture_index.archived_pages(_pages(spark, PAGES)).collect()))
    assert got == _expected(PAGES)
    assert capture_index.archived_pages(_pages(spark, [])).count() == 0


def test_look_up_finds_all_captures_of_a_url(spark):
    rows = [(i, f"http://h{i % 7}.example.com/{i % 50}", f"page {i % 400}") for i in range(3000)]
    pages = _pages(spark, rows)
    folder, captures, index = capture_index.archive(pages)
    assert captures.count() == 3000 and index.agg(F.sum("lines")).first()[0] == 3000
    asked = spark.createDataFrame([("http://H3.example.com/10",), ("http://h1.example.com/8",), ("http://none.example.com/",)], "url string")
    got = {r["page_id"] for r in capture_index.look_up(asked, folder, index).collect()}
    assert got == {i for i, url, _ in rows if url in ("http://h3.example.com/10", "http://h1.example.com/8")} and got
    names = [f for f in os.listdir(folder.removeprefix("file:")) if f.endswith(".warc.gz")]
    records = b"".join(gzip.open(os.path.join(folder.removeprefix("file:"), f)).read() for f in names)
    assert records.count(b"WARC/1.1\r\nWARC-Type: ") == 3000


def test_reversed_host_keys(spark):
    urls = spark.createDataFrame([(p[1],) for p in PAGES[:5]], "url string").select(capture_index.reversed_host_key(F.col("url")))
    assert [r[0] for r in urls.collect()] == ["com,example,sub)/a?x=1", "com,example)/", ")/", "com,example)/", "com,example)/a"]


@needs_tables
def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_classifier.scored_documents(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    held = [r for r in out if r["held_out"]]
    assert np.mean([r["predicted"] for r in held if r["quality"] == 1]) > 0.95
    assert np.mean([r["predicted"] for r in held if r["quality"] == 0]) < 0.2
    # held-out labels do not matter
    turned = labels.withColumn("quality", F.when(quality_classifier.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality_classifier.scored_documents(docs, turned).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in out)


def test_classifier_without_two_labels(odd, none, spark):
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, 0), (9, None, 0), (None, 0, 0), (11, 0, 0), (11, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.scored(odd, labels)
    assert got.count() == len(ODD) and {c for c in got.columns} >= set(odd.columns)
    assert quality_classifier.scored_documents(odd, labels.limit(0)).select("score").distinct().collect() == [(0.5,)]
    assert quality_classifier.scored_documents(none, labels).count() == 0
    assert quality_classifier.kept_documents(odd, labels).columns == odd.columns


def test_classifier_sample_has_one_text_per_id(spark):
    docs = spark.createDataFrame([(i % 8, f"text {i} of many " * 3) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    got = quality_classifier.labelled_sample(docs, labels, 2500, 20)
    drawn = {i for i in range(8) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert sorted(r["doc_id"] for r in got) == sorted(drawn) and all(len(r["text"]) <= 20 for r in got)


def test_classifier_features_do_not_grow_with_length():
    good, bad = (quality_classifier._compressor(d * 40) for d in (b"some good words ", b"<b>buy now</b> "))
    text = (" ".join(f"word{i}" for i in range(2000)))[: 8 * quality_classifier.PIECE]
    assert len(text) == 8 * quality_classifier.PIECE
    assert np.allclose(quality_classifier.features(text, good, bad), quality_classifier.features(text * 10, good, bad))


def _texts():
    rng = random.Random(5)
    alphabet = "ab tion the  \n é😀日本,.3\tx" + sentencepieces.MARK
    texts = ["".join(rng.choices(alphabet, k=rng.randint(1, 500))) for _ in range(60)]
    texts += [" " * rng.randint(1, 60) + "x" + " " * rng.randint(0, 40) for _ in range(20)] + ["a" * 500, "=-" * 300, " " * 200]
    return texts + ["".join(rng.choices(string.printable, k=400)) for _ in range(10)]


@needs_pieces
@pytest.mark.parametrize("chunk", [3, 17, 64])
def test_chunks_give_the_same_ids(chunk):
    with open(PIECES, "rb") as f:
        pieces = sentencepieces.Pieces(f.read())
    for text in _texts():
        cut = sentencepieces.Cut(text, chunk, pieces.longest)
        parts = list(cut.pieces())
        matrices = [{a: set(b) for a, b in sentencepieces.transfer(pieces, t, s, s + w)} for t, s, w, _ in parts]
        # products may be taken in any order
        left = right = matrices[0]
        for matrix in matrices[1:]:
            left = sentencepieces.multiply(left, matrix)
        if len(matrices) > 2:
            right = matrices[-1]
            for matrix in reversed(matrices[:-1]):
                right = sentencepieces.multiply(matrix, right)
            assert left == right
        goal = next(s for s in left[0, ""] if s[0] == 0)
        path = [*sentencepieces.walk(matrices, {(0, "")}, goal), goal]
        ids = []
        for (t, s, w, runs), a, b in zip(parts, path, path[1:], strict=False):
            ids += pieces.numbers(sentencepieces.trace(pieces, t, s, s + w, a, b), cut.hollow, runs)
        assert ids == pieces.processor.encode(text)


@needs_pieces
def test_giants_are_encoded_like_others(odd, none, spark):
    docs = odd.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(_texts()[:25])], "doc_id long, text string"), allowMissingColumns=True)
    one = sentencepieces.encoded(docs, PIECES)
    many = sentencepieces.encoded(docs, PIECES, giant=300, chunk=400, block=3)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in one.collect()) == Counter((r["doc_id"], tuple(r["ids"])) for r in many.collect())
    assert many.agg(F.max("n_chunks")).first()[0] > 100 and set(odd.columns) <= set(many.columns)
    back = sentencepieces.decoded(many, PIECES).collect()
    assert all(r["decoded"] == (r["text"] or "").replace(sentencepieces.MARK, " ") for r in back)
    assert sentencepieces.encoded_documents(none, PIECES).count() == 0
    assert sentencepieces.encoded_documents(odd, PIECES).where("not round_trip").count() == 0


@needs_tables
def test_pipeline_stages(spark):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs, kept = spark.read.parquet(f"{TABLES}/documents.parquet"), []
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "line dedup", "n-gram Jaccard join", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, TABLES)
        path = scratch(spark, "stage")
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == columns
        rows = {r["doc_id"]: r["text"] for r in before.collect()}
        if name == "quality classifier":
            model = quality_classifier.train(before, spark.read.parquet(f"{TABLES}/labels.parquet"))
            good, bad = quality_classifier._compressor(model.good), quality_classifier._compressor(model.bad)
            x = np.array([quality_classifier.features(t or "", good, bad) for t in rows.values()])
            p = 1 / (1 + np.exp(-(model.weights[0] + (x - model.centre) / model.scale @ model.weights[1:])))
            assert {r["doc_id"] for r in docs.collect()} == {i for i, s in zip(rows, p, strict=True) if s >= 0.7}
        elif name == "quality rules":
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in quality_rules.judged(before).where("kept").collect()}
        elif name == "line dedup":
            expected = without_repeated_lines(list(rows.items()))
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == {i: expected[i, t] for i, t in rows.items()}
        elif name == "n-gram Jaccard join":
            groups = component_ids(list(rows.items()))
            assert {r["doc_id"] for r in docs.collect()} == set(groups)
        else:
            assert docs.count() == len(rows) and docs.where("padding < 0").count() == 0
            assert docs.groupBy("bucket_len", "batch").agg((F.count("*") * F.col("bucket_len")).alias("t")).where("t > 16384 and t > bucket_len").count() == 0
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[0] < 1000
    assert corpus_pipeline.run(spark, TABLES).count() == kept[-1]
