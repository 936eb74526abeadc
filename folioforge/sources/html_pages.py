"""Provider over raw HTML pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import html, metadata
from folioforge.functions.text import has_text
from folioforge.sources.layout import evaluate_once


def read_html_pages(pages: DataFrame) -> DataFrame:
    """Landed pages (page_id, url, html) as articles, with ``fetch_class``.

    Row-local, so it works on a batch or a stream and never shuffles the page text.
    """
    seen = pages.select("page_id", "url", "html").withColumn("_page", html.visible(F.col("html")))
    parts = seen.withColumn("_part", html.main_part(F.col("_page")))
    parts = parts.withColumn("_head", html.head(F.col("_page")))
    read = evaluate_once(html.with_markdown(parts, "_part", "url", "markdown"), "markdown", "_head")
    read = read.withColumn("_meta", html.meta_tags(F.col("_head")))
    return read.select(
        F.col("page_id").alias("article_id"),
        F.col("url").alias("source_url"),
        html.page_title(F.col("_head")).alias("title"),
        html.meta_text(F.col("_meta"), metadata.AUTHOR_KEYS).alias("author"),
        html.meta_text(F.col("_meta"), metadata.DATE_KEYS).alias("date"),
        html.meta_text(F.col("_meta"), metadata.DESCRIPTION_KEYS).alias("description"),
        "markdown",
        F.when(has_text(F.col("markdown")), "ok").otherwise("empty_content").alias("fetch_class"),
    )
