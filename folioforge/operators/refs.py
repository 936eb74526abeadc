"""Image references as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.images import image_refs, unique_images


def extract_image_refs(articles: DataFrame) -> DataFrame:
    """Add ``refs``, the array of http(s) references of the article's own text."""
    return articles.withColumn("refs", image_refs(F.col("markdown")))


def explode_image_refs(articles: DataFrame) -> DataFrame:
    """One row per reference: article_id, pos (from 0), alt, url, original_match."""
    return articles.select("article_id", F.inline(image_refs(F.col("markdown"))))


def explode_images(prepared: DataFrame) -> DataFrame:
    """One row per distinct image of an article: article_id, seq (from 1), url. Needs column ``images``."""
    return prepared.select("article_id", F.inline("images"))


def dedup_image_urls(refs: DataFrame) -> DataFrame:
    """First occurrence of each url in its article: article_id, url, pos, mentions.

    An aggregate rather than a window, so a url mentioned very often is reduced before the shuffle.
    """
    return refs.groupBy("article_id", "url").agg(
        F.min("pos").alias("pos"), F.count(F.lit(1)).cast("int").alias("mentions")
    )


def image_sequence(refs: DataFrame) -> DataFrame:
    """Number the distinct urls of each article from 1 in order of first sight: article_id, url, pos, seq."""
    # Partitioned by article once, for the aggregate and the window alike; an article's references fit one text.
    firsts = dedup_image_urls(refs.select("article_id", "url", "pos").repartition("article_id"))
    order = Window.partitionBy("article_id").orderBy("pos")
    return firsts.select("article_id", "url", "pos", F.row_number().over(order).alias("seq"))


def count_unique_images(articles: DataFrame) -> DataFrame:
    """article_id, images_found; counted inside the row."""
    return articles.select("article_id", F.size(unique_images(image_refs(F.col("markdown")))).alias("images_found"))
