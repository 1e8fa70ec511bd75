"""Keyed stores: touched buckets, versions that stay, interrupted writes, clean-up; snapshots as VARIANT; audits after an interruption."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators.keyed import latest_wins
from tidemark.session import shared_folder
from tidemark.sources import keyed_store as K
from tidemark.sources import sinks, snapshots

WINS = lambda old, new: latest_wins(old, new, ["ticker"], "at")


def _quotes(spark, rows):
    return spark.createDataFrame(rows, "ticker string, price double, at int")


def _files(path):
    top = path.removeprefix("file:")
    return {os.path.relpath(os.path.join(d, f), top) for d, _, names in os.walk(top) for f in names if f.endswith(".parquet")}


def _rows(spark, path, version=None):
    return sorted(map(tuple, K.read(spark, path, version).collect()))


def test_an_upsert_writes_only_touched_buckets(spark):
    path = shared_folder(spark, "store-test")
    first = [(f"t{i}", float(i), 1) for i in range(200)]
    assert K.upsert(_quotes(spark, first), path, ["ticker"], WINS, buckets=16) == 1
    before = _files(f"{path}/data")
    reader = K.read(spark, path)
    assert K.upsert(_quotes(spark, [("t7", 99.0, 2), ("t8", -1.0, 0), ("new", 5.0, 2)]), path, ["ticker"], WINS) == 2
    added = {f.split("/")[1] for f in _files(f"{path}/data") - before}
    keys = K.bucketed(_quotes(spark, [("t7", 0.0, 0), ("t8", 0.0, 0), ("new", 0.0, 0)]), ["ticker"], 16)
    assert added == {f"bucket={r['bucket']}" for r in keys.collect()} and len(added) < 16
    second = sorted([r for r in first if r[0] != "t7"] + [("t7", 99.0, 2), ("new", 5.0, 2)])
    assert _rows(spark, path) == second
    # the earlier version and a reader that was there before see what they saw
    assert _rows(spark, path, 1) == sorted(first) == sorted(map(tuple, reader.collect()))
    # nothing new publishes nothing
    assert K.upsert(_quotes(spark, []), path, ["ticker"], WINS) == 2
    gone = K.cleaned(spark, path, keep=1)
    assert {g.split("/")[1] for g in gone} == added
    assert K.versions(spark, path) == [2] and _rows(spark, path) == second
    assert len(_files(f"{path}/data")) == 16


def test_an_interrupted_write_changes_nothing(spark, monkeypatch):
    path = shared_folder(spark, "store-test")
    K.upsert(_quotes(spark, [("a", 1.0, 1), ("b", 1.0, 1)]), path, ["ticker"], WINS)

    def fails(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patched:
        patched.setattr(K, "_publish", fails)
        with pytest.raises(KeyboardInterrupt):
            K.upsert(_quotes(spark, [("a", 2.0, 2)]), path, ["ticker"], WINS)
    assert _rows(spark, path) == [("a", 1.0, 1), ("b", 1.0, 1)]
    # a task that fails inside the merge
    broken = lambda old, new: WINS(old, new).withColumn("price", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        K.upsert(_quotes(spark, [("a", 2.0, 2)]), path, ["ticker"], broken)
    assert _rows(spark, path) == [("a", 1.0, 1), ("b", 1.0, 1)]
    # later writes work, and clean-up takes away what the broken ones left
    assert K.upsert(_quotes(spark, [("a", 3.0, 3)]), path, ["ticker"], WINS) == 2
    assert K.cleaned(spark, path, keep=1)
    assert _rows(spark, path) == [("a", 3.0, 3), ("b", 1.0, 1)] and not os.path.exists(f"{path.removeprefix('file:')}/incoming")


def test_of_two_writers_one_fails(spark):
    path = shared_folder(spark, "store-test")
    K.upsert(_quotes(spark, [("a", 1.0, 1)]), path, ["ticker"], WINS)

    def slow(old, new):
        K.upsert(_quotes(spark, [("a", 5.0, 5)]), path, ["ticker"], WINS)
        return WINS(old, new)

    with pytest.raises(K.VersionConflict):
        K.upsert(_quotes(spark, [("a", 4.0, 4)]), path, ["ticker"], slow)
    assert _rows(spark, path) == [("a", 5.0, 5)] and K.versions(spark, path) == [1, 2]


def test_a_merge_may_drop_the_rows_of_a_bucket(spark):
    path = shared_folder(spark, "store-test")
    K.upsert(_quotes(spark, [("a", 1.0, 1)]), path, ["ticker"], WINS)
    K.upsert(_quotes(spark, [("a", 1.0, 1)]), path, ["ticker"], lambda old, new: old.where("false"))
    assert _rows(spark, path) == [] and K.read(spark, path).columns == ["ticker", "price", "at"]


def test_audits_merge_and_survive_an_interruption(spark, monkeypatch):
    path = shared_folder(spark, "audit-test")
    rows = lambda *r: spark.createDataFrame(r, "ticker string, metric string, period string, value double, status string")
    sinks.write_audit(rows(("A", "revenue", "1999A", 1.0, "OLD"), ("B", "revenue", "1999A", 2.0, "OLD")), path)
    with monkeypatch.context() as patched:
        patched.setattr(K, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("ended")))
        with pytest.raises(RuntimeError):
            sinks.write_audit(rows(("A", "revenue", "1999A", 9.0, "LOST")), path)
    sinks.write_audit(rows(("A", "revenue", "1999A", 3.0, "NEW"), ("A", "ebit", "1999A", 4.0, "NEW")), path)
    got = sorted(map(tuple, sinks.read_audit(spark, path).collect()))
    assert got == [("A", "ebit", "1999A", 4.0, "NEW"), ("A", "revenue", "1999A", 3.0, "NEW"), ("B", "revenue", "1999A", 2.0, "OLD")]
    assert spark.read.option("header", True).csv(f"{path}/csv").count() == 2 == spark.read.json(f"{path}/json").count()
    assert [r["ticker"] for r in spark.read.json(f"{path}/manifest").collect()] == ["A"]


def test_snapshots_of_two_schemas(spark):
    path = shared_folder(spark, "snapshot-test")
    rows = spark.createDataFrame([
        (" aa ", "v1", [1999, 1998, 1999], '{"revenue": {"1999A": 5}, "price": 3}', "2001-05-01"), ("BB", "v2", [1998, 1999], '{"metrics": {"revenue": {"1999A": 7.5}}, "multiples": {}}', "2001-06-01"),
        ("CC", "v2", [1999], '{"metrics": {"revenue": {"1999A": "none"}}}', "2001-06-01"), ("DD", "v9", [1998, 1999], "[1]", "2001-06-01"), ("EE", "v2", [1998, 1999], None, None),
    ], "ticker string, engine_version string, actual_years array<int>, json string, at string")
    ready = rows.select("ticker", "engine_version", "actual_years", F.parse_json("json").alias("snapshot"), F.to_timestamp("at").alias("updated_at"))
    assert snapshots.save(ready, path) == 1
    stored = {r["ticker"]: r["p"] for r in K.read(spark, path).select("ticker", F.to_json("snapshot").alias("p")).collect()}
    assert stored["AA"] == '{"revenue":{"1999A":5}}' and stored["BB"] == '{"metrics":{"revenue":{"1999A":7.5}}}'
    wanted = spark.createDataFrame([("aa",), ("BB ",), ("CC",), ("DD",), ("EE",)], "ticker string")
    as_of = F.lit("2001-06-15").cast("timestamp")
    load = lambda: {r["ticker"]: tuple(r)[1:] for r in snapshots.load(spark, path, wanted, [1999, 1998], as_of).select(
        "ticker", "migrated", snapshots.metric("revenue", "1999A").alias("v"), "state", F.array_join("reasons", ",").alias("r")).collect()}
    first = load()
    assert first == {
        "AA": (True, 5.0, "STALE", ""), "BB": (False, 7.5, "READY", ""), "CC": (False, None, "INCOMPATIBLE", "ACTUAL_YEAR_SET_MISMATCH"),
        "DD": (False, None, "INCOMPATIBLE", "ENGINE_VERSION_MISMATCH,SNAPSHOT_SCHEMA_INVALID"), "EE": (False, None, "INCOMPATIBLE", "SNAPSHOT_SCHEMA_INVALID")}
    # what was migrated has been written back
    assert load() == first | {"AA": (False, 5.0, "STALE", "")} and len(K.versions(spark, path)) == 2
    # an older save does not replace a newer one
    snapshots.save(ready.where("ticker = 'BB'").withColumns({"updated_at": F.lit("2000-01-01").cast("timestamp"), "snapshot": F.parse_json(F.lit("{}"))}), path)
    assert load()["BB"] == (False, 7.5, "READY", "")
