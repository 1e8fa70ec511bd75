"""Token counts against the library."""

import os
import random

import pytest
import tokenizers

from conftest import ODD
from tidemark.llm import token_counts

TABLES = "/root/testdata/sf0.01"
WORDS = "/opt/tokenizers/word_bpe_49k.json"
needs_tables = pytest.mark.skipif(not os.path.isdir(TABLES), reason="test tables not present")
pytestmark = pytest.mark.skipif(not os.path.exists(WORDS), reason="vocabulary not present")

PARTS = ["a", "b", "the", "ing", "'", "'s", "'re", "'ll", "r", "e", "l", "v", " ", "\n", "1", "42", "!", "...", "é", "ü", "İ", "日本", "😀", "ß", "Σ", "<|endoftext|>", "<|startoftext|>", "<", "|", ">",
         "ñ", "x", "aaaa", "zq", "\x1c", " ", "́", "K", "한", "ᅡ", "½", "ſ", "‘", "𝔘", "jeky", "ll", "<|ENDOFTEXT|>"]


@pytest.fixture(scope="module")
def machine():
    with open(WORDS, encoding="utf-8") as f:
        return token_counts.Machine(f.read())


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(WORDS)


def count(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def made_up(dice):
    if dice.random() < 0.3:
        return "".join(dice.choice("abcdefghijklmnopqrstuvwxyz'") for _ in range(dice.randint(1, 40)))
    return "".join(dice.choice(PARTS) for _ in range(dice.randint(0, 40)))


def test_maps_of_cut_texts_compose(machine, library):
    dice = random.Random(5)
    for _ in range(4000):
        text = made_up(dice)
        places = [i for i in range(1, len(text)) if text[i].isascii() and "<" not in text[max(0, i - token_counts.SPECIAL) : i]]
        cuts = sorted(dice.sample(places, min(len(places), dice.randint(0, 4))))
        maps = [machine.map_of(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        # from the left, and the last two first: composition is associative
        left = maps[0]
        for m in maps[1:]:
            left = machine.joined(left, m)
        right = maps[-1]
        for m in maps[-2::-1]:
            right = machine.joined(m, right)
        assert machine.counted(left) == machine.counted(right) == count(library, text), (text, cuts)


def test_pairs_of_tokens_are_told_by_undone_merges(machine):
    dice = random.Random(9)
    vocabulary = machine.vocabulary
    inner = [n for n, s in vocabulary.symbols.items() if s[-1] < 256]
    every = list(vocabulary.symbols)
    for _ in range(3000):
        a, b = dice.choice(inner), dice.choice(every)
        plain = vocabulary.merged([vocabulary.single[s] for t in (a, b) for s in vocabulary.symbols[t]])
        assert vocabulary.fit(a, b) == (plain == [a, b])


def test_states_compiled_anew(machine, library, monkeypatch):
    monkeypatch.setattr(token_counts, "STATES", 50)
    dice = random.Random(2)
    for _ in range(200):
        text = made_up(dice)
        assert machine.counted(machine.map_of(text)) == count(library, text)


@pytest.mark.parametrize(("chunk", "block"), [(1, 2), (5, 3), (1024, 256)])
def test_chunks_and_blocks(spark, library, chunk, block):
    dice = random.Random(chunk)
    rows = [(i, made_up(dice)) for i in range(60)] + [(60, "x" * 3000), (61, "ab cd'll " * 500), (62, "日本語" * 400), (63, None), (64, ""), (64, ""), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = token_counts.with_token_counts(docs, WORDS, chunk, block).collect()
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=str) == sorted(((i, count(library, t)) for i, t in rows), key=str)


def test_odd_rows(odd, none, library):
    more = odd.selectExpr("*", "doc_id AS n_tokens", "text AS head", "doc_id AS row", "doc_id AS n_bytes", "doc_id AS chunk")
    got = token_counts.counted_documents(more, WORDS).collect()
    expected = [(r[0], len((r[1] or "").encode()), count(library, r[1]), count(library, r[1]) > 2048) for r in ODD]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str) and any(r["over_limit"] for r in got)
    assert token_counts.with_token_counts(more, WORDS).columns == [c for c in more.columns if c not in ("text", "n_tokens")] + ["n_tokens"]
    assert token_counts.counted_documents(none, WORDS).count() == 0


@needs_tables
def test_documents(spark, library):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.counted_documents(docs, WORDS).collect()}
    assert got == {r["doc_id"]: count(library, r["text"]) for r in docs.collect()}
