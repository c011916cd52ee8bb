"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "regimen") -> SparkSession:
    """Return the active session, or build a local one for tests and benches.

    On a cluster the session already exists (spark-submit) and is returned
    untouched; the options below only apply when a new local session is built.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage.

    Reads ``spark.checkpoint.dir`` from the session (on a cluster it names a
    shared, fault-tolerant folder).  Only when it is unset -- local tests -- a
    private scratch folder is created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="regimen-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def materialize(df):
    """Write ``df`` once to the shared checkpoint folder and read it back.

    For a tagged split that feeds several aggregates: later passes read the
    written rows instead of recomputing the hashing and boundary joins, and
    the lineage is cut, so a lost executor costs a re-read, not a replay.
    (A reliable ``checkpoint``, never a machine-local one.)"""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def deal_up(df, rows: int = 1 << 18):
    """``df`` in at least as many partitions as the cluster has cores, and more if a task had over ``rows`` rows.

    Only for a table in fewer: one shuffle before a fit that passes over the rows many times.  A table in
    more partitions is left as it is, whatever its size."""
    have = df.rdd.getNumPartitions()
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if have >= wanted:
        return df
    return df.repartition(max(wanted, -(-df.count() // rows)))


def compact(df, rows: int = 1 << 16):
    """``df`` (a written table) in no more partitions than give a task ``rows`` rows.

    A boosted fit is hundreds of jobs; on a small table, tasks of a few rows each only add to their latency."""
    parts = max(1, -(-df.count() // rows))
    return df.coalesce(parts) if parts < df.rdd.getNumPartitions() else df
