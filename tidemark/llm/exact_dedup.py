"""Exact deduplication as a stateful stream.

The stream keeps one state row per digest in RocksDB, on disk and without expiry: how many rows had it, and of the best
row so far its length, stable identifier and content locator (file and row in it). Digests alone decide nothing: where a
digest was hit more than once, the full texts of its rows are compared, and a digest with different texts is split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import scratch, squeezed, staged, text_of

#: State on disk, with a bound on the memory that all stores of an executor share.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _with_digest(rows: DataFrame, digest) -> DataFrame:
    """Identifier, order, locator and digest of each row."""
    text = text_of("text")
    return rows.select(
        "doc_id", F.length(text).alias("points"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"),
        digest(squeezed(text)).alias("digest"), squeezed(text).alias("body"),
    )


def _folder(spark: SparkSession, path: str) -> str:
    """A stream reads folders; a table in one file is named by a pattern that only it matches."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where)
    return path if status.isDirectory() else f"{path[:-1]}[{path[-1]}]"


def _best() -> Column:
    """Most code points, then smallest identifier (a null one last), then the first place."""
    return F.max(F.struct(F.col("points"), (-F.col("doc_id")).alias("minus_id"), F.col("file"), (-F.col("at")).alias("minus_at")))


def _final_state(spark: SparkSession, path: str, schema, digest, bytes_per_batch: int) -> DataFrame:
    """Runs the stream over all files of ``path`` and reads the state it left: digest, best, n."""
    where = scratch(spark, "dedup-state")
    before = {k: spark.conf.get(k, None) for k in STATE}
    for key, value in STATE.items():
        spark.conf.set(key, value)
    try:
        stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(_folder(spark, path))
        state = _with_digest(stream, digest).groupBy("digest").agg(_best().alias("best"), F.count(F.lit(1)).alias("n"))
        query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", where).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    left = spark.read.format("statestore").load(where)
    best, n = (f.name for f in left.schema["value"].dataType.fields)
    return left.select("key.digest", F.col(f"value.{best}").alias("best"), F.col(f"value.{n}").alias("n"))


def deduplicate(spark: SparkSession, path: str, digest=sha256, bytes_per_batch: int = 64 << 30) -> DataFrame:
    """One row per row of the Parquet table ``path``: doc_id, keep_id, group_size, kept, digest, file and at.

    Texts are equal when they are identical without white space; null counts as empty. Of equal texts the row with most
    code points stays, then the smallest doc_id (null last), then, for repeated rows, the one that lies first, so that
    exactly one row of a group stays. An empty table gives no rows; other columns are ignored. ``bytes_per_batch``
    bounds a micro-batch, and a stream that was stopped goes on from its checkpoint.
    """
    schema = spark.read.parquet(path).schema
    rows = _with_digest(spark.read.schema(schema).parquet(path), digest)
    state = _final_state(spark, path, schema, digest, bytes_per_batch)

    hits = rows.groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high"), F.count(F.lit(1)).alias("seen"))
    # written, so that Spark knows how few they are (none, but for a weak digest) before it plans the joins with texts
    mixed = staged(hits.where((F.col("seen") > 1) & (F.col("low") != F.col("high"))).select(F.col("digest").alias("mixed_digest")), "dedup-mixed")
    settled = state.join(mixed, F.col("digest") == F.col("mixed_digest"), "left_anti")

    alike = rows.drop("body").join(settled.withColumnRenamed("digest", "of"), F.col("digest") == F.col("of"))
    exact = rows.join(mixed, F.col("digest") == F.col("mixed_digest"), "left_semi")
    split = exact.groupBy("digest", "body").agg(_best().alias("best"), F.count(F.lit(1)).alias("n"))
    unlike = exact.alias("r").join(split.alias("s"), (F.col("r.digest") == F.col("s.digest")) & (F.col("r.body") == F.col("s.body"))).select("r.*", "s.best", "s.n")

    columns = ["doc_id", "file", "at", "digest", "best", "n"]
    both = alike.select(*columns).unionByName(unlike.select(*columns))
    keep_id = -F.col("best.minus_id")
    first = (F.col("file") == F.col("best.file")) & (F.col("at") == -F.col("best.minus_at"))
    return both.select("doc_id", keep_id.alias("keep_id"), F.col("n").alias("group_size"), first.alias("kept"), "digest", "file", "at")


def marked_documents(spark: SparkSession, path: str) -> DataFrame:
    return deduplicate(spark, path).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))
