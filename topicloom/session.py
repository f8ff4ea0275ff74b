"""Session helpers: local sessions for tests, and lineage cuts that survive lost executors."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: str = "8", app: str = "topicloom", memory: str = "16g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster passes its own session instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; every executor must reach it.

    Only a session in one process (``local[n]``) that names none gets a temporary folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_CONF, None) or context.getConf().get(CHECKPOINT_CONF) or context.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="topicloom-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from the table.

    Later steps restart from files when an executor is lost, and plans of iterative jobs stay
    small: a written table carries its true size to the optimiser and no constraints of the
    rounds before it. ``schema`` reads stored values as types of their own, such as vectors.
    """
    path = f"{shared_folder(df.sparkSession)}/topicloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, on whatever file system it lies."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that nothing refers to any more.

    It does so when the driver's memory is collected, by itself only when that fills up or every half hour; a loop of many shuffles asks for it.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
