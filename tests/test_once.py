"""Work that a plan must do once: texts folded for several questions, signatures, and the support of claims."""

import random
import re

from pyspark.sql import functions as F

from tidemark.operators import rank as R
from tidemark.operators import text as T

ITEMS = "doc_id int, `group` string, pos int, text string, cited string"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_questions_share_one_scan(spark):
    rows = [(f"c{i}", "Section", f"margin {'growth ' * (i % 3)}open", "A", "en", 4, i > 5) for i in range(9)]
    chunks = spark.createDataFrame(rows, "chunk_id string, heading string, content string, ticker string, theme string, base int, meaningful boolean")
    asked = [{"text": w, "ticker": "A", "company": "open", "theme": "de", "layer": 2} for w in ("margin growth", "growth")]
    context = R.context_for_queries(chunks, asked, 4, [])
    assert len(re.findall("LogicalRDD|LocalRelation", _plan(context))) == 1 and "WindowGroupLimit" in context._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in context.collect():
        got.setdefault(r["query"], []).append((r["chunk_id"], r["score"], r["meaningful"], r["meaningful_count"], r["thin"]))
    for question in asked:
        one = R.top_chunks(R.score_chunks(chunks, question, []), 4).collect()
        n = sum(r["meaningful"] for r in one)
        assert sorted(got[question["text"]]) == sorted((r["chunk_id"], r["score"], r["meaningful"], n, n < 2) for r in one)
    assert {r["query"]: r["thin"] for r in R.thin_context(context.select("query", "chunk_id", "meaningful")).collect()} == {k: v[0][4] for k, v in got.items()}


def test_signature_is_the_first_words(spark):
    dice = random.Random(5)
    texts = ["".join(dice.choice("aB9%$ .\néİ -") for _ in range(dice.randint(0, 90))) for _ in range(400)] + ["", " ", ". . .", "w " * 40, "x" * 50_000, ("y" * 9 + "\n") * 9_000, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in df.select("text", F.lower("text").alias("low"), T.signature(F.col("text")).alias("s")).collect():
        assert r["s"] == (None if r["text"] is None else " ".join(re.findall("[a-z0-9%$]+", r["low"])[:14]))


def test_signatures_are_found_once(spark):
    items = spark.createDataFrame([(1, "g", 2, "One two", "x"), (1, "g", 1, "one, TWO!", "x"), (1, "g", 3, "...", "x")], ITEMS)
    kept = T.dedupe_items(items, "doc_id").select("doc_id", "pos")
    assert [tuple(r) for r in kept.collect()] == [(1, 1)]
    assert len(re.findall(r"regexp_replace\(", _plan(kept))) == 1


def test_support_is_found_once(spark):
    draft = spark.createDataFrame([(1, "a", 2, "revenue growth reached 512", "revenue growth reached 512"), (1, "b", 3, "revenue growth reached 512", "nothing"), (2, "a", 2, "margin", "margin"),
                                   (2, "a", 4, "margin", "margin")], ITEMS)
    fallback = spark.createDataFrame([(1, "a", 1, "f"), (1, "b", 1, "f"), (2, "b", 2, "f"), (None, "a", 1, "f"), (3, None, 1, "f")], "doc_id int, `group` string, pos int, text string")
    out = T.validated_groups(draft, fallback, "doc_id").select("doc_id", "group", "pos", "origin")
    assert len(re.findall("LogicalRDD|LocalRelation", _plan(out))) == 2
    assert {tuple(r) for r in out.collect()} == {(1, "a", 2, "DRAFT"), (2, "a", 2, "DRAFT"), (1, "b", 1, "FALLBACK"), (2, "b", 2, "FALLBACK"), (None, "a", 1, "FALLBACK"), (3, None, 1, "FALLBACK")}
