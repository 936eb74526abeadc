"""Documents in buckets by slug: what is looked up or replaced by slug meets them where they lie.

Files of a batch are cut by the hash of the slug, one file for a bucket. Spark keeps the number of buckets in its catalog
only, so tables are entered there for as long as it takes to write them or to plan a scan, and the number is kept with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@contextmanager
def _catalog_name(spark: SparkSession) -> Iterator[str]:
    """A name that is free again afterwards. Its table has a folder of its own, which stays."""
    name = f"folioforge_{uuid4().hex}"
    try:
        yield name
    finally:
        spark.sql(f"drop table if exists {name}")


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_bucketed(rows: DataFrame, folder: str, buckets: int) -> None:
    """Replace what is in ``folder`` by the rows, in ``buckets`` files by slug, sorted by it. One exchange, of these rows."""
    with _catalog_name(rows.sparkSession) as name:
        dealt = rows.repartition(buckets, "slug").write.mode("overwrite").bucketBy(buckets, "slug").sortBy("slug")
        dealt.option("path", folder).saveAsTable(name)


def read_bucketed(spark: SparkSession, folder: str, schema: str, buckets: int, partition: str | None = None) -> DataFrame:
    """Rows written by ``write_bucketed`` to ``folder``, or to its folders ``<partition>=...``, as a table in buckets."""
    parted = f"partitioned by ({partition})" if partition else ""
    # Folders are listed, as those of a plain path are, and not entered in the catalog one by one.
    with _catalog_name(spark) as name, _setting(spark, "spark.sql.hive.manageFilesourcePartitions", "false"):
        place = folder.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"create table {name} ({schema}) using parquet {parted} clustered by (slug) sorted by (slug) into {buckets} buckets location '{place}'")
        return spark.table(name)


def of_places(documents: DataFrame, places: DataFrame, buckets: int | None) -> DataFrame:
    """The documents at the places (slug, batch_id). Places are dealt out as the documents lie, which are not moved.

    The batch is compared by a range: as a second key of the join it would ask for another partitioning of both sides.
    """
    own = places.select(F.col("slug").alias("_slug"), F.col("batch_id").alias("_batch"))
    own = own.repartition(buckets, "_slug") if buckets else own
    same = (F.col("slug") == F.col("_slug")) & (F.col("batch_id") >= F.col("_batch")) & (F.col("batch_id") <= F.col("_batch"))
    return documents.join(own, same, "left_semi")


def of_slugs(documents: DataFrame, slugs: DataFrame, buckets: int | None) -> DataFrame:
    """The documents under the slugs, in the same way. Slugs that are null or under which there is none give nothing."""
    own = slugs.select("slug")
    return documents.join(own.repartition(buckets, "slug") if buckets else own, "slug", "left_semi")
