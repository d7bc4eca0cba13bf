"""Session helpers: local builder for tests/bench, shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for every plan in this package.  AQE re-plans joins
# (broadcast when a side turns out small, split skewed partitions) and
# coalesces small shuffle partitions at runtime.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # a join on (k1, k2, ...) may reuse an existing hash(k1) partitioning
    # instead of re-shuffling an already co-partitioned side
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8,
                  app: str = "ascribe", driver_memory: str = "16g",
                  extra: dict | None = None) -> SparkSession:
    """Session for tests and the local benchmark (one JVM, N task threads)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", driver_memory))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared filesystem (HDFS / object store)
    and is used as is.  Only when it is unset and the master is local (tests)
    do we create a private scratch folder; on a cluster each executor would
    write to its own disk, so there an unset folder is an error.
    """
    cur = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if cur:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(cur)
        return cur
    cur = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if cur:
        spark.conf.set("spark.checkpoint.dir", cur)
        return cur
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="ascribe-ckpt-")
    sc.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for one run."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root.rstrip("/"), f"{name}-{uuid.uuid4().hex[:12]}")


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 1 << 21          # bytes of rows that go to a Python worker at once


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session by bytes, unless it has a bound of
    its own.  By rows alone (10,000), a batch grows with the texts: it stands in
    the JVM's and the worker's memory at once, and buffers grow by doubling.
    Frames run after they are returned, so the setting stays."""
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str = "materialized") -> DataFrame:
    """Cut the lineage of an intermediate result by writing it as a parquet
    table under the shared checkpoint folder and reading it back (survives
    executor loss; never ``localCheckpoint``).  One computation, unlike
    ``checkpoint()``, which recomputes an unpersisted plan to save it; later
    checks and reuses then do not recompute the upstream joins.  The shuffle
    files behind the table are removed as soon as it is written."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(*tables: DataFrame) -> None:
    """Delete tables written by ``materialize`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
