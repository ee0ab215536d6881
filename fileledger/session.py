"""Session helpers: a local session for tests, and lineage cuts for iterative jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, name: str = "fileledger", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, use the cluster's own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Small test tables would otherwise collapse into one task after each exchange.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        # Checkpoints nobody refers to any more are deleted; set it on clusters too.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names, or a local one where none is set.

    Only a single-machine session may fall back to a temporary folder: on a
    cluster it would be lost with its machine, so that is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder all executors share.")
    folder = tempfile.mkdtemp(prefix="fileledger-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a result to the checkpoint folder and continue from there.

    Used where a plan would otherwise double with each step, and in loops. The
    copy is on shared storage, so a lost executor costs a re-read, not a restart.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
