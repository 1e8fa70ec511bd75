"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: str = "8", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for cut lineage.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session that
    has no such setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return os.path.join(tempfile.gettempdir(), f"tidemark-checkpoints-{os.getpid()}")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of one run below the shared one."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors and is computed once for all branches."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, per_task: int = 20_000) -> DataFrame:
    """Rows of a small table that the next step makes large, dealt out evenly.

    A file of few bytes is one task, however many rows it has. The count is read from the footers of the files.
    """
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // per_task))
    return df.repartition(n)


def written(df: DataFrame, name: str) -> DataFrame:
    """A stage table as Parquet in the shared folder: computed once for all branches, a tenth of a checkpoint's bytes."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(df: DataFrame, per_task: int = 50_000) -> int:
    """Tasks for wide rows, in proportion to their count; on a stage table the count is read from the footers of its files."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // per_task))


@contextmanager
def joined_in_place(spark: SparkSession) -> Iterator[None]:
    """Plans made inside join tables that lie in buckets by one of the join's keys without moving them; the session's value comes back."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bucketed(parts: DataFrame | list[DataFrame], name: str, key: str, tasks: int) -> DataFrame:
    """``written`` in ``tasks`` buckets by a key, so that groups, windows and joins by this key and others move no rows again.

    Rows that lie in such buckets already are not moved to be written. Several parts with the columns of the first become one table; a
    union of them could lose the buckets. Every table of a plan has to use the same number of buckets.
    """
    parts = parts if isinstance(parts, list) else [parts]
    spark = parts[0].sparkSession
    table, path = f"{name}_{uuid.uuid4().hex}".replace("-", "_"), shared_folder(spark, name)
    with joined_in_place(spark):
        for part in parts:
            part.repartition(tasks, key).write.format("parquet").mode("append").bucketBy(tasks, key).option("path", path).saveAsTable(table)
    out = spark.read.table(table)
    # the plan knows the files and their buckets; the name is not needed again, and dropping it leaves the files
    spark.sql(f"DROP TABLE {table}")
    return out
