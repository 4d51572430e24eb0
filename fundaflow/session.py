"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every job relies on.  The co-partition setting lets joins on
# (security_id, ...) reuse data already hash-partitioned by security_id.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows grow many times over behind a shuffle, and a task sorts all that it reads: so a task reads little, and
    # there are enough partitions to begin with that more input means more tasks, not larger ones.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}

# Set when a session is created: call-site capture on every column expression dominates the
# time to build large plans.
START_SETTINGS = {
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", app: str = "fundaflow", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    n = str(cores)
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8" if n == "*" else n)
        .config("spark.driver.memory", "12g")
    )
    for key, value in {**RUNTIME_SETTINGS, **START_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it an action's shuffle files go when the action ends, not when the driver happens to collect garbage.

    For steps that keep what they read again as files: nothing asks for those shuffles a second time.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def balanced_scans(spark: SparkSession, tasks: int = 4) -> Iterator[None]:
    """Within it a scan has so many tasks a core where its files split: a few files of different sizes would leave cores idle."""
    wanted = {"spark.sql.files.minPartitionNum": str(tasks * spark.sparkContext.defaultParallelism), "spark.sql.files.openCostInBytes": "256k"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints.

    On a cluster the folder must be configured; only a local session may fall back to
    a folder of its own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(folder)
        return folder
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="fundaflow-")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
