"""Session helpers: tuned defaults for tests/bench and checkpoint-dir lookup."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "statgate") -> SparkSession:
    """Session with AQE on and the UI off (used by tests and bench only).

    On a cluster the caller brings its own session; nothing here is required.
    """
    pkg_parent = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # Python workers (pandas state functions) import this package; locally they
    # get it through PYTHONPATH, on a cluster ship it with --py-files.
    os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (pkg_parent, os.environ.get("PYTHONPATH", "")) if p)
    spark = (
        SparkSession.builder.master(master)
        .config("spark.executorEnv.PYTHONPATH", os.environ["PYTHONPATH"])
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("statgate.scanPartitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("STATGATE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    A local session without one gets a temporary folder; on a cluster a
    missing setting is an error, for executors don't share their disks.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="statgate-ckpt-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, for small tables that several plans read."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
