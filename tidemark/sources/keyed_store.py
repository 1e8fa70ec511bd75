"""Keyed tables on a shared file system: versions, upserts of touched buckets, and readers that keep their version.

``data/<write>/bucket=NN`` holds the rows of one bucket of keys as one write left them; ``versions/<number>`` lists, per bucket, the
folder that is current. A version is published by renaming its finished list into place, so a write that ends early changes nothing,
and of two writers of one number the later one fails. Folders are never changed: a reader keeps what its list names until ``cleaned``
takes versions away. The list has a line per bucket, which is all that passes through the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
#: Written whole before its rename; other names are unfinished.
LIST = "list-{:09d}.json"


class VersionConflict(RuntimeError):
    """Another writer has published the version that this one was to become."""


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions, oldest first; empty without a store."""
    where, fs = _fs(spark, f"{path}/versions")
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n[5:-5]) for n in names if n.startswith("list-") and n.endswith(".json"))


def _listed(spark: SparkSession, path: str, version: int) -> dict:
    text = spark.read.text(f"{path}/versions/{LIST.format(version)}", wholetext=True).first()[0]
    return json.loads(text)


def _publish(spark: SparkSession, path: str, version: int, content: dict) -> None:
    folder, fs = _fs(spark, f"{path}/versions")
    fs.mkdirs(folder)
    draft = _path(spark, f"{path}/versions/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(json.dumps(content).encode())
    finally:
        out.close()
    final = _path(spark, f"{path}/versions/{LIST.format(version)}")
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise VersionConflict(f"version {version} of {path} is there already")


def bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def _rows(spark: SparkSession, path: str, content: dict, only: set[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(content["schema"])
    folders = [f"{path}/data/{write}/bucket={b}" for b, write in content["folders"].items() if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, by default of the newest; they stay the same whatever is written later."""
    number = versions(spark, path)[-1] if version is None else version
    return _rows(spark, path, _listed(spark, path, number))


def upsert(new: DataFrame, path: str, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> int:
    """Publishes the store with ``new`` merged into it and returns the version; only buckets that hold a key of ``new`` are written.

    ``merge`` gets the current rows of those buckets and ``new`` and must keep a row's keys. Rows go to a bucket by ``keys``, so it may
    compare rows of equal keys only. The first write gives the schema; ``new`` without rows publishes nothing new.
    """
    spark = new.sparkSession
    known = versions(spark, path)
    before = _listed(spark, path, known[-1]) if known else {"schema": json.loads(new.schema.json()), "buckets": buckets, "folders": {}}
    count = before["buckets"]
    write = uuid.uuid4().hex
    # written once: the merge reads it several times, and the touched buckets are taken from it
    incoming_path = f"{path}/incoming/{write}"
    bucketed(new, keys, count).write.partitionBy("bucket").parquet(incoming_path)
    where, fs = _fs(spark, incoming_path)
    touched = {int(s.getPath().getName()[7:]) for s in fs.listStatus(where) if s.getPath().getName().startswith("bucket=")}
    if not touched and known:
        fs.delete(where, True)
        return known[-1]
    incoming = spark.read.schema(new.schema).parquet(incoming_path).select(*new.columns) if touched else new.limit(0)
    merged = merge(_rows(spark, path, before, touched), incoming).select(*T.StructType.fromJson(before["schema"]).fieldNames())
    bucketed(merged, keys, count).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/data/{write}")
    where_data, _ = _fs(spark, f"{path}/data/{write}")
    filled = {int(s.getPath().getName()[7:]) for s in fs.listStatus(where_data) if s.getPath().getName().startswith("bucket=")}
    if not filled <= touched:
        raise ValueError("the merge moved rows to other keys")
    folders = {b: w for b, w in before["folders"].items() if int(b) not in touched} | {str(b): write for b in sorted(filled)}
    number = known[-1] + 1 if known else 1
    _publish(spark, path, number, {**before, "folders": folders})
    fs.delete(where, True)
    return number


def cleaned(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Takes away all but the newest ``keep`` versions, and the data folders that no version left names; returns those folders.

    Not to be run beside a writer: what an unfinished write has put down is taken away too.
    """
    known = versions(spark, path)
    kept = known[-keep:]
    used = {f"{write}/bucket={b}" for n in kept for b, write in _listed(spark, path, n)["folders"].items()}
    where, fs = _fs(spark, f"{path}/data")
    gone = []
    for write in fs.listStatus(where) if fs.exists(where) else []:
        folders = [s.getPath() for s in fs.listStatus(write.getPath()) if s.getPath().getName().startswith("bucket=")]
        free = [f for f in folders if f"{write.getPath().getName()}/{f.getName()}" not in used]
        gone += [f"{write.getPath().getName()}/{f.getName()}" for f in free]
        for f in [write.getPath()] if len(free) == len(folders) else free:
            fs.delete(f, True)
    for n in known[: len(known) - len(kept)]:
        fs.delete(_path(spark, f"{path}/versions/{LIST.format(n)}"), False)
    incoming, _ = _fs(spark, f"{path}/incoming")
    if fs.exists(incoming):
        fs.delete(incoming, True)
    return sorted(gone)
