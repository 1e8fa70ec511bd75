"""Sharding, exact dedup, quality rules, license scan, line dedup."""

import hashlib
import math
import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import SPACE, WORD, determinant_distances, statistics, without_repeated_lines
from conftest import LINES, ODD, document
from tidemark.llm import exact_dedup, license_scan, line_dedup, quality_rules, sharding

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")


def test_hypergeometric_follows_its_law(spark):
    draws, population, marked, taken = 4000, 60, 25, 14
    at = spark.range(draws).select(((F.col("id") + 0.5) / draws).alias("u"), *[F.lit(x).cast("long").alias(n) for n, x in (("p", population), ("m", marked), ("t", taken))])
    found = Counter(r[0] for r in at.select(sharding.hypergeometric(F.col("p"), F.col("m"), F.col("t"), F.col("u"))).collect())
    for k in range(taken + 1):
        share = math.comb(marked, k) * math.comb(population - marked, taken - k) / math.comb(population, taken)
        assert abs(found[k] - draws * share) <= 1.01, k


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_shards_are_even_gapless_and_whole(spark, shards):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("v"))
    out = sharding.shuffle_into_shards(rows, shards, seed=4, fan=4, split_bits=3)
    got = out.collect()
    assert sorted(r["doc_id"] for r in got) == list(range(3000))
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(shards)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, size in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(size))
    again = sharding.shuffle_into_shards(rows.repartition(7), shards, seed=4, fan=4, split_bits=3).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    if shards == 24:
        assert abs(np.corrcoef([r["doc_id"] for r in got], [r["shard"] * 125 + r["slot"] for r in got])[0, 1]) < 0.08


def test_shards_of_odd_rows(odd, none, tmp_path):
    out = sharding.shuffle_into_shards(odd, 4)
    assert out.count() == len(ODD) and set(odd.columns) < set(out.columns)
    sharding.write_shards(out, str(tmp_path / "shards"))
    assert odd.sparkSession.read.parquet(str(tmp_path / "shards")).count() == len(ODD)
    assert sharding.placed_documents(odd).count() == len(ODD)
    assert sharding.placed_documents(none).count() == 0


def _expected_groups(rows):
    body = ["".join(c for c in text or "" if c not in SPACE) for _, text in rows]
    groups = defaultdict(list)
    for i, b in enumerate(body):
        groups[b].append(i)
    best = {b: max(found, key=lambda i: (len(rows[i][1] or ""), rows[i][0] is not None, -(rows[i][0] or 0))) for b, found in groups.items()}
    return Counter((rows[i][0], rows[best[b]][0], len(groups[b]), hashlib.sha256(b.encode()).hexdigest()) for i, b in enumerate(body)), len(groups)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(odd, tmp_path, weak):
    path = str(tmp_path / "docs")
    odd.repartition(3).write.parquet(path)
    digest = (lambda text: F.substring(F.sha2(text, 256), 1, 1)) if weak else exact_dedup.sha256
    got = exact_dedup.deduplicate(odd.sparkSession, path, digest, bytes_per_batch=20_000).collect()
    expected, groups = _expected_groups([(r[0], r[1]) for r in ODD])
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == Counter({k: v for key, n in expected.items() for k, v in [(key[:3], 0)]} | {}) + sum((Counter({key[:3]: n}) for key, n in expected.items()), Counter())
    assert sum(r["kept"] for r in got) == groups
    if not weak:
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["digest"]) for r in got) == expected


def test_exact_dedup_of_nothing(none, tmp_path):
    none.write.parquet(str(tmp_path / "docs"))
    assert exact_dedup.marked_documents(none.sparkSession, str(tmp_path / "docs")).count() == 0


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def test_statistics(odd):
    got = quality_rules.with_statistics(odd.select("doc_id", "text")).collect()
    assert sorted(map(str, [(r["doc_id"], *[r[n] for n in NAMES]) for r in got])) == sorted(map(str, [(r[0], *statistics(r[1])) for r in ODD]))
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])


@needs_tables
def test_verdicts_equal_numpy(spark):
    docs = spark.read.parquet(SMALL.replace("0.001", "0.01") + "/documents.parquet")
    rows = docs.select("doc_id", "lang", "source", "text").collect()
    stats = {r["doc_id"]: statistics(r["text"]) for r in rows}
    failed = {i: s[0] < 20 or 100 * s[4] > 30 * s[0] for i, s in stats.items()}

    def vector(s):
        n_words, chars, symbols, dup, repeat, lines = s
        shape = [math.log(max(chars / n_words if n_words else 0, 1)), math.log1p(100 * symbols / chars if chars else 0), dup / lines if lines else 0, repeat / n_words if n_words else 0]
        return [math.floor(x * quality_rules.UNIT + 0.5) for x in shape]

    good = Counter((r["lang"], r["source"]) for r in rows if not failed[r["doc_id"]])
    least = 20
    pooled = defaultdict(int)
    for (lang, source), n in good.items():
        pooled[lang, source if n >= least else "*"] += n
    names = {}
    for r in rows:
        source = r["source"] if good[r["lang"], r["source"]] >= least else "*"
        names[r["doc_id"]] = (r["lang"] if pooled[r["lang"], source] >= least else "*", source)
    expected = {}
    limit = quality_rules.chi_square_limit(1e-4)
    inside = quality_rules.chi_square_limit(0.25)
    consistency = 0.75 / (1 - quality_rules._chi_square_tail(inside, 6))
    for name in set(names.values()):
        ids = [i for i, n in names.items() if n == name]
        x = np.array([vector(stats[i]) for i in ids], float)
        base = np.array([failed[i] for i in ids])
        v = x[~base]
        d = determinant_distances(v, quality_rules.UNIT, quality_rules.LEAST_SPREAD, quality_rules.BINS, 0.75, 4) / consistency
        expected |= {i: bool(k <= limit) for i, k in zip(np.array(ids)[~base], d, strict=True)} | {i: False for i in np.array(ids)[base]}
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judged(docs, least_rows=least).collect()}
    assert got == expected
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(SMALL.replace("0.001", "0.01") + "/labels.parquet").collect()}
    clean = [i for i in labels if labels[i] == 1 and not failed[i]]
    assert np.mean([got[i] for i in clean]) > 0.99
    assert np.mean([got[i] for i in labels if labels[i] == 0]) < 0.1


def test_rules_on_odd_rows(odd, none):
    assert quality_rules.judged(odd).count() == len(ODD)
    kept = quality_rules.kept_documents(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} <= {r[0] for r in ODD if statistics(r[1])[0] >= 20}
    assert quality_rules.judged(none).count() == 0 and quality_rules.kept_documents(none).count() == 0


def test_line_dedup_equals_brute_force(odd, none):
    got = line_dedup.without_repeats(odd).collect()
    expected = without_repeated_lines([(r[0], r[1]) for r in ODD])
    assert sorted(str((r["doc_id"], r["text"])) for r in got) == sorted(str((r[0], expected[r[0], r[1]])) for r in ODD)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
    assert line_dedup.cleaned_documents(odd).columns == odd.columns
    assert line_dedup.without_repeats(none).count() == 0


def _licences(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", ".,;:!?()[]\"'")
    words = WORD.findall((text or "").translate(table))
    at = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    out = set()
    for name, template in license_scan.TEMPLATES.items():
        t = WORD.findall(template.translate(table))
        wanted = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
        s = license_scan.setting(len(wanted))
        for start in range(0, len(at), s.stride):
            if 100 * len(wanted & set(at[start : start + s.length])) >= 80 * len(wanted):
                out.add((name, start))
    return out


def test_license_scan_equals_brute_force(spark, odd, none):
    header = license_scan.TEMPLATES["MIT-grant"].split()
    changed = " ".join([*header[:20], "any", *header[21:]])
    texts = [f"{' '.join(LINES)} {t.upper()} {LINES[3]} {t}" for t in license_scan.TEMPLATES.values()] + [changed, "x " * 37 + changed, None, "", license_scan.TEMPLATES["GPL-3.0"].replace("version 3", "version 2")]
    docs = spark.createDataFrame([document(i, t) for i, t in enumerate(texts)], odd.schema.names[:2] + ["lang", "source", "n_chars"])
    got = {(r["doc_id"], r["license"], r["start"]) for r in license_scan.scanned(docs).collect()}
    assert got == {(i, name, start) for i, t in enumerate(texts) for name, start in _licences(t)}
    assert {i for i, _, _ in got} >= set(range(10))
    assert license_scan.scanned(odd).count() == 0 and license_scan.scanned(none).count() == 0
    assert license_scan.licensed_documents(none).count() == 0


def test_band_settings_bound_misses():
    for n in range(1, 200):
        s = license_scan.setting(n)
        assert s.length >= n + s.stride - 1
        least = license_scan.needed(n) / (s.length + n - license_scan.needed(n))
        assert (1 - least) ** s.bands <= 1e-6
