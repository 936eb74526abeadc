"""Image bodies by content: each distinct body is stored once, whatever urls, articles and batches it came from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BODY = "digest string, size_bytes bigint, content binary"


def body_digests(bodies: DataFrame) -> DataFrame:
    """Landed bodies (path, content) as (path, digest, size_bytes, content), the digest SHA-256 in hex. Row-local; a
    body that is null is left out."""
    return bodies.where(F.col("content").isNotNull()).select(
        "path", F.sha2("content", 256).alias("digest"), F.octet_length("content").cast("long").alias("size_bytes"), "content"
    )


def read_bodies(spark: SparkSession, root: str) -> DataFrame:
    """The stored bodies (digest, size_bytes, content); none before the first batch."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    exists = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(BODY).parquet(root) if exists else spark.createDataFrame([], BODY)


def store_bodies(bodies: DataFrame, root: str) -> None:
    """Add the landed bodies (path, content) that ``root`` does not hold yet.

    Digests of the stored bodies alone are read. Equal bodies are reduced by an aggregate before the one shuffle of their
    content, so a body that a third of all urls share is sent once by a task. A batch stored twice adds nothing; one that
    failed midway left no file that is read, as the write is committed as a whole.
    """
    known = read_bodies(bodies.sparkSession, root).select("digest")
    new = body_digests(bodies).select("digest", "size_bytes", "content").join(known, "digest", "left_anti")
    new.groupBy("digest").agg(F.any_value("size_bytes").alias("size_bytes"), F.any_value("content").alias("content")).write.mode("append").parquet(root)


def address_images(manifest: DataFrame, landed: DataFrame, digests: DataFrame) -> DataFrame:
    """The image manifest (article_id, seq, url, filename, ...) with ``digest`` and ``body_bytes`` of its body.

    ``landed``: (article_id, url, path), where the fetcher put the body of an article's image, the greatest path if it
    did so several times; ``digests``: (path, digest, size_bytes). Both are null where no body has come. Content takes no part.
    """
    last = landed.groupBy("article_id", "url").agg(F.max("path").alias("path"))
    found = last.join(digests.select("path", "digest", F.col("size_bytes").alias("body_bytes")), "path")
    return manifest.join(found.select("article_id", "url", "digest", "body_bytes"), ["article_id", "url"], "left")


def body_savings(addressed: DataFrame) -> DataFrame:
    """One row: stored images, distinct bodies, bytes if each image had its own, bytes as stored."""
    each = addressed.where("digest is not null").groupBy("digest").agg(F.count("*").alias("images"), F.max("body_bytes").alias("bytes"))
    return each.agg(
        F.coalesce(F.sum("images"), F.lit(0)).alias("images"),
        F.count("*").alias("bodies"),
        F.coalesce(F.sum(F.col("images") * F.col("bytes")), F.lit(0)).alias("image_bytes"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("stored_bytes"),
    )
