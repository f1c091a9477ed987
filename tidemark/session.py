"""Session defaults and cluster settings read from the session."""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.tidemark.spread", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Without one only a local master (one machine, one disk) may go on, in a scratch folder; on a cluster every executor would
    write to its own disk and reading back would miss rows, so that is an error.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    target = spark.conf.get("spark.checkpoint.dir", None) or scratch_dir(spark.sparkContext.master)
    spark.sparkContext.setCheckpointDir(target)
    return spark.sparkContext.getCheckpointDir() or target


def scratch_dir(master: str) -> str:
    if re.fullmatch(r"local(\[.*\])?", master):
        return tempfile.mkdtemp(prefix="tidemark-ckpt-")
    raise RuntimeError(f"spark.checkpoint.dir names no shared folder, and {master} is not one machine")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder and read it back.

    Survives the loss of executors like a reliable checkpoint; being a table, it also has a known
    size, so the optimizer broadcasts it only when it is small.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/cut_{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete the table behind a frame of ``cut_lineage`` once nothing reads it any more; other frames are left alone."""
    path = getattr(df, "_table_path", None)
    if path:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def with_code(fn: Callable) -> Callable:
    """A query whose Python workers find this package in the folder it was imported from.

    On a cluster the package comes with ``--py-files`` or the image; the extra folder does no harm where it does not exist.
    """

    @functools.wraps(fn)
    def run(spark: SparkSession, *args, **kwargs):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        known = spark.sparkContext.environment.get("PYTHONPATH", "")
        if root not in known.split(os.pathsep):
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))
        return fn(spark, *args, **kwargs)

    return run
