"""Classification of source urls and of fetch outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import urls
from folioforge.functions.text import has_text


def validate_urls(table: DataFrame, column: str = "url") -> DataFrame:
    """Add ``url_error``: why the url is refused, null when it is acceptable."""
    return table.withColumn("url_error", urls.url_problem(F.col(column)))


def mark_private_hosts(table: DataFrame, column: str = "url") -> DataFrame:
    """Add ``is_private_host``, the guard for image urls and redirect targets."""
    return table.withColumn("is_private_host", urls.is_private_host(F.col(column)))


def fetch_class(error_kind: Column, http_status: Column, decoded: Column, content: Column) -> Column:
    """Outcome of a fetch; the order of the checks is part of the meaning."""
    return (
        F.when(error_kind.isNotNull() | http_status.isNull(), "unreachable")
        .when(http_status == 429, "rate_limit")
        .when(http_status >= 400, "http_error")
        .when(~decoded, "decode_error")
        .when(~has_text(content), "empty_content")
        .otherwise("ok")
    )


def filter_usable_articles(articles: DataFrame) -> DataFrame:
    return articles.filter(F.col("fetch_class") == "ok").drop("fetch_class")


def latest_articles(articles: DataFrame, arrival: str | None = None) -> DataFrame:
    """One row for each article_id: the one with the greatest ``arrival``; of equal ones, or without it, the one
    whose url, and then whose text, is greatest. Rows that are repeated altogether count once.

    An aggregate: rows of one article are reduced before the shuffle, however often it was fetched.
    """
    order = F.struct(*([arrival] if arrival else []), "source_url", F.xxhash64("markdown"), "markdown")
    return articles.groupBy("article_id").agg(F.max_by(F.struct(*articles.columns), order).alias("_row")).select("_row.*")
