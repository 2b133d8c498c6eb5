"""Session settings for people who do not bring their own session."""

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app="lendgrain", cores=None):
    b = SparkSession.builder.appName(app)
    if cores:
        b = (b.master(f"local[{cores}]")
             .config("spark.sql.shuffle.partitions", str(cores))
             .config("spark.driver.memory", os.environ.get("LENDGRAIN_DRIVER_MEMORY", "12g"))
             .config("spark.ui.enabled", "false"))
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # a feature frame has more columns than the default limit of 100 for generated code
        .config("spark.sql.codegen.maxFields", "400")
        # call-site capture costs milliseconds per Column, and feature frames build thousands
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is set (local tests)."""
    current = spark.sparkContext.getCheckpointDir()
    if current is not None:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="lendgrain-ckpt-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame, eager=True) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
