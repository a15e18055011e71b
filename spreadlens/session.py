"""Session helpers: a tuned local session for tests/bench and the shared scratch folder.

On a cluster the session is created by the platform; the library only reads
``spark.checkpoint.dir`` from it. A folder of our own is set only when that
setting is missing (local tests and the bench).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "spreadlens") -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    log_dir = os.environ.get("SPREADLENS_EVENT_LOG_DIR")      # opt-in: stage/task times for profiling
    if log_dir:
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; set one only if unset (tests)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        master = sc.master or ""
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf_dir = tempfile.mkdtemp(prefix="spreadlens-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written intermediate tables."""
    root = checkpoint_root(spark)
    return os.path.join(root, "spreadlens", f"{name}-{uuid.uuid4().hex[:12]}")


def release(df: DataFrame) -> None:
    """Delete the files of a table in the scratch folder once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of a finished execution at once instead of at the driver's next garbage
    collection; what runs several jobs then needs the disk of its largest job only."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_batches(spark: SparkSession, mb: int = 8) -> None:
    """Arrow batches of some ``mb`` MB at most, as a task's numpy work takes a multiple of its batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def spread(df, key: str | None = None):
    """Spread the rows over the cluster's cores when a scan yields fewer partitions than cores (a small file with
    one row group is read by one task); a no-op for real inputs, which come in many splits. Used in front of
    CPU-heavy row-wise work (tokenising text) that would otherwise run in that single task. With ``key`` the rows
    are hash-partitioned on it, so later aggregates / windows keyed by it need no exchange of their own."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key) if key else df.repartition(cores)
