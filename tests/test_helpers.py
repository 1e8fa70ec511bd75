import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from tidemark.operators import company_metric as CM
from tidemark.operators import text as T
from tidemark.operators.keyed import as_of, range_match, running_sum, top_n_per_key

DAY = date(2020, 1, 1)


def test_range_match_equals_brute_force(spark):
    rng = random.Random(1)
    left = [(i, rng.choice("ab"), DAY + timedelta(days=rng.randrange(80))) for i in range(120)]
    right = [(i, rng.choice("ab"), DAY + timedelta(days=rng.randrange(80))) for i in range(120)]
    a, b = spark.createDataFrame(left, "l int, k string, ld date"), spark.createDataFrame(right, "r int, k string, rd date")
    want = sorted((x[0], y[0]) for x in left for y in right if x[1] == y[1] and abs((x[2] - y[2]).days) <= 7)
    assert sorted((r.l, r.r) for r in range_match(a, b, ["k"], "ld", "rd", 7).collect()) == want
    lonely = sorted(x[0] for x in left if not any(x[0] == w[0] for w in want))
    assert sorted(r.l for r in range_match(a, b, ["k"], "ld", "rd", 7, "left_anti").collect()) == lonely


def test_as_of_equals_brute_force(spark):
    rng = random.Random(2)
    facts = {(rng.choice("ab"), DAY + timedelta(days=rng.randrange(60))): float(i) for i in range(40)}
    targets = [(i, rng.choice("abc"), DAY + timedelta(days=rng.randrange(-5, 65))) for i in range(100)]
    f = spark.createDataFrame([(k, d, v) for (k, d), v in facts.items()], "k string, day date, v double")
    t = spark.createDataFrame(targets, "i int, k string, target date")
    got = {r.i: r.v for r in as_of(t, f, "k", "target", "day", ["v"]).collect()}
    for i, k, d in targets:
        known = [(x, v) for (kk, x), v in facts.items() if kk == k and x <= d]
        assert got[i] == (max(known)[1] if known else None)


def test_running_sum_over_ranges(spark):
    rows = [(k, i, i % 3) for k in "ab" for i in range(50)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = {(r.k, r.i): r.s for r in running_sum(df, ["k"], "i", F.col("v"), "s", width=7).collect()}
    assert all(got[(k, i)] == sum(j % 3 for j in range(i + 1)) for k in "ab" for i in range(50))


def test_top_n_puts_a_limit_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = top_n_per_key(df, ["k"], [F.desc("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def pack(sentences, size):
    chunks = []
    for s in sentences:
        if chunks and len(chunks[-1]) + len(s) + 1 <= size:
            chunks[-1] += " " + s
        else:
            chunks.append(s)
    return chunks


def test_chunk_text_packs_greedily(spark):
    rng = random.Random(3)
    sentences = ["x" * rng.randrange(5, 60) + "." for _ in range(60)]
    df = spark.createDataFrame([(" ".join(sentences),)], "text string")
    assert df.select(T.chunk_text(F.col("text"), 100).alias("c")).first().c == pack(sentences, 100)


def test_definitions_compatible_in_every_pair(spark):
    rng = random.Random(4)
    base = [f"term {c * 3}" for c in "abcdefgh"]
    rows, groups = [], {}
    for g in range(60):
        groups[g] = []
        for i in range(rng.randrange(1, 5)):
            words = list(base)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(8)] = f"term {rng.choice('uv') * 4}"
            groups[g].append(sorted(set(words)))
            rows.append((g, "|".join(groups[g][-1]), groups[g][-1]))
    a, b, c = base, [*base[:7], "x one"], [*base[:6], "x one", "x two"]
    groups[99] = [a, b, c]
    rows += [(99, str(i), t) for i, t in enumerate(groups[99])]

    def fits(a, b):
        a, b = set(a), set(b)
        s = len(a & b)
        return a == b or len(a) >= 5 and len(b) >= 5 and s >= 2 and s / min(len(a), len(b)) >= 0.85 and s / max(len(a), len(b)) >= 0.75 and s / len(a | b) >= 0.75

    assert fits(a, b) and fits(b, c) and not fits(a, c)
    df = spark.createDataFrame(rows, "g int, fingerprint string, terms array<string>")
    got = {r.g: r.compatible for r in CM.definitions_compatible(df, ["g"]).collect()}
    assert got == {g: all(fits(x, y) for x in sets for y in sets) for g, sets in groups.items()}
    assert got[99] is False and True in got.values()


def test_exchanges_borrow_answers(spark):
    rows = [(1, 0, "Operator", "Operator", "We open the call for the first question"), (1, 1, "A", "Analyst, Firm", "What is the outlook for margins next year?"),
            (1, 2, "B", "Analyst, Firm", "Could you talk about demand trends please?"), (1, 3, "C", "CEO", "Demand is strong.")]
    df = spark.createDataFrame(rows, "call_id int, seq int, speaker string, role string, text string")
    got = sorted((r.sequence, r.part, r.seq) for r in T.qa_exchanges(df).collect())
    assert got == [(1, "answer", 3), (1, "question", 1), (2, "answer", 3), (2, "question", 2)]


def test_claim_support(spark):
    rows = [("Revenue grew 12.5% in automotive markets", "automotive markets lifted sales 12.5% this year"), ("Revenue grew 14.5% in automotive markets", "automotive markets lifted sales 12.5%"),
            ("EPS improved in automotive markets", "non-GAAP results in automotive markets improved")]
    df = spark.createDataFrame(rows, "text string, cited string")
    assert [r.supported for r in T.with_support(df).collect()] == [True, False, False]
