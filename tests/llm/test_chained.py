"""Sets that shared passages chain into one large cluster: the join stays in proportion to them."""

import random

from conftest import document
from brute import component_ids

from tidemark.llm import ngram_join


def test_chained_sets_are_not_joined_block_by_block(spark, monkeypatch):
    rng = random.Random(5)
    passages = [[f"p{k}w{i}" for i in range(40)] for k in range(46)]
    texts = []
    for k in range(45):
        # every shingle of a family is shared with a neighbour, so the order by frequency cannot keep them apart
        words = passages[k] + passages[k + 1]
        other = list(words)
        other[rng.randrange(5)] = f"x{k}"
        texts += [" ".join(words), " ".join(other)]
    rows = [document(i, t) for i, t in enumerate(texts)]
    moved, joined = [], ngram_join._join_tasks

    def counting(rows):
        moved.append(rows.count())
        return joined(rows)

    monkeypatch.setattr(ngram_join, "BLOCK", 6000)
    monkeypatch.setattr(ngram_join, "_join_tasks", counting)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs).collect()}
    expected = component_ids([(r[0], r[1]) for r in rows])
    assert got == dict(enumerate(expected)) and len(set(expected)) == 45
    assert sum(moved) <= 6 * len(rows)
