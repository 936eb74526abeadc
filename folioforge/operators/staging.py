"""Intermediate tables in shared storage."""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; where it is unset, in local mode, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="folioforge-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def stage(table: DataFrame, name: str) -> DataFrame:
    """Write the table once (runs a job) and return a reader of it.

    Cuts the lineage in a way that survives the loss of executors, and later branches scan only the columns
    they need instead of repeating the parsing of the raw input.
    """
    folder = new_folder(table.sparkSession, name)
    table.write.parquet(folder)
    reader = table.sparkSession.read.schema(table.schema).parquet(folder)
    # Where it lies, for ``release``.
    reader.staged_in = folder
    return reader


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder that ``new_folder`` named."""
    if not folder.startswith(f"{shared_folder(spark)}/"):
        raise ValueError(f"not a staged table: {folder}")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(*staged: DataFrame) -> None:
    """Remove the folders of tables returned by ``stage`` that nothing reads any more."""
    for table in staged:
        remove_folder(table.sparkSession, table.staged_in)
