"""Which images of an article are stored, under which name, and where the text is pointed at them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import images as img
from folioforge.functions import urls
from folioforge.operators.attempts import resolve_attempts
from folioforge.settings import Settings


def accept_image_responses(responses: DataFrame) -> DataFrame:
    """Add ``rejection``: why a successful response is not stored (header check), null when it is."""
    return responses.withColumn("rejection", img.rejection(F.col("content_type"), F.col("url")))


def content_type_lookup(responses: DataFrame) -> DataFrame:
    """Add ``type_ext``, the extension that belongs to the content type."""
    return responses.withColumn("type_ext", img.extension_of_type(img.mime_type(F.col("content_type"))))


def judge_images(images: DataFrame, attempts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every distinct image (article_id, seq, url) with ``failure``, null when it is stored.

    Adds attempts, content_type and size_bytes of its settled response. Private hosts are refused whatever
    the log says. Both sides are narrow and meet on (article_id, url), unique on either side.
    """
    settled = resolve_attempts(attempts, settings)
    kind = urls.host_kind(F.col("url"))
    refused = F.when(kind == "malformed", "malformed_host").when(
        kind.isin("localhost", "loopback", "private"), "private_host"
    )
    return (
        images.withColumn("_refused", refused)
        .join(settled, ["article_id", "url"], "left")
        .withColumn(
            "failure",
            F.coalesce(
                "_refused",
                F.when(F.col("stored_ok").isNull(), "no_response"),
                "failure",
                img.rejection(F.col("content_type"), F.col("url")),
            ),
        )
        .select("article_id", "seq", "url", "attempts", "content_type", "size_bytes", "failure")
    )


def failed_images(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("failure").isNotNull()).select("article_id", "seq", "url", "attempts", "failure")


def image_local_filename(judged: DataFrame, *, with_type: bool = False) -> DataFrame:
    """The image manifest: article_id, seq, url, filename, size_bytes of the stored images, and content_type on request.

    Names can only collide with names that begin alike (up to the first hyphen) and share the extension, as
    the suffixes start with a hyphen. So names are settled per (article, beginning, extension); the table is
    partitioned by article alone, which serves this grouping and a later one by article with one shuffle. A
    group is at most the images of one document, that is, bounded by one text cell.
    """
    named = (
        judged.filter(F.col("failure").isNull())
        .withColumn("_name", img.name_parts(F.col("url")))
        .select(
            "article_id",
            "seq",
            "url",
            "size_bytes",
            F.col("_name.base").alias("base"),
            img.extension(F.col("content_type"), F.col("_name.ext")).alias("ext"),
            "content_type",
        )
    )
    groups = (
        named.repartition("article_id")
        .groupBy("article_id", F.substring_index("base", "-", 1).alias("_beginning"), "ext")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "url", "base", "ext", "size_bytes", *(["content_type"] if with_type else [])))).alias("_images"))
        .withColumn("_names", img.local_names(F.col("_images")))
    )
    return groups.select("article_id", F.inline(F.arrays_zip("_images", "_names"))).select(
        "article_id", "_images.seq", "_images.url", F.col("_names").alias("filename"), "_images.size_bytes", *(["_images.content_type"] if with_type else [])
    )


def resolve_image_refs(refs: DataFrame, manifest: DataFrame) -> DataFrame:
    """References with ``filename`` of their stored image, null when it failed."""
    names = manifest.select("article_id", "url", "filename")
    return refs.join(names, ["article_id", "url"], "left")


def files_per_article(manifest: DataFrame) -> DataFrame:
    """article_id, files (url -> file name), image_bytes; at most one entry per image of the document."""
    return manifest.groupBy("article_id").agg(
        F.map_from_entries(F.collect_list(F.struct("url", "filename"))).alias("files"),
        F.sum("size_bytes").alias("image_bytes"),
    )


def rewrite_image_refs(prepared: DataFrame, manifest: DataFrame) -> DataFrame:
    """Replace ``markdown`` by the text that points at local files. The text is shuffled once."""
    joined = prepared.join(files_per_article(manifest), "article_id", "left")
    return joined.withColumn(
        "markdown",
        F.when(F.col("files").isNull(), F.col("markdown")).otherwise(
            img.rewrite(F.col("markdown"), F.col("refs"), F.col("files"))
        ),
    )
