"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import sys
import tempfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
}


def travels(module: str) -> None:
    """What tasks use of a module is sent with them, so workers need not be able to import it."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def build_session(app: str = "tidemark", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators were tuned for; cluster sizing stays with spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster, cleared when the driver ends; a scratch folder only on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-ckpt-"))
        folder = sc._jvm.org.apache.hadoop.fs.Path(sc.getCheckpointDir())
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder, for written intermediate tables and stream state."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{os.urandom(6).hex()}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows as a table below the shared checkpoint folder and go on from there.

    The table outlives its executors, is read column by column, and its size is known to the planner.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
