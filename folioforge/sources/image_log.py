"""Readers for what the image fetcher landed: the attempt log, and the bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.images import mime_type
from folioforge.schemas import IMAGE_ATTEMPT


def read_image_responses(log: DataFrame) -> DataFrame:
    """The attempt log in its canonical schema, with ``mime`` added.

    Columns the log lacks become null; body columns are never selected, so the scan prunes them.
    """
    columns = [
        (F.col(field.name) if field.name in log.columns else F.lit(None)).cast(field.dataType).alias(field.name)
        for field in IMAGE_ATTEMPT.fields
    ]
    return log.select(*columns).withColumn("mime", mime_type(F.col("content_type")))


def read_image_bodies(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Landed image files as (path, size_bytes, content); ``content`` is read only when it is selected. Spark
    lists no empty files, so an image without a byte has no body."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return files.load(folder).select("path", F.col("length").alias("size_bytes"), "content")
