"""Provider over landed responses of a reader service."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import metadata
from folioforge.functions.text import none_if_empty
from folioforge.operators.fetch import fetch_class
from folioforge.schemas import READER_BODY
from folioforge.sources.layout import evaluate_once


def parse_body(responses: DataFrame) -> DataFrame:
    """Add ``_data`` (the struct under ``data``, null when absent) and ``_decoded``."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed"}
    parsed = responses.withColumn("_body", F.from_json("body", READER_BODY, options))
    return evaluate_once(parsed, "_body").withColumn(
        "_decoded", F.col("body").isNotNull() & F.col("_body").isNotNull() & F.col("_body.malformed").isNull()
    ).withColumn("_data", F.col("_body.data"))


def extract_metadata(parsed: DataFrame) -> DataFrame:
    """Add title, author, date and description to rows of :func:`parse_body`."""
    tags = F.col("_data.metadata")
    return parsed.withColumns(
        {
            "title": none_if_empty(F.col("_data.title")),
            "author": metadata.lookup_text(tags, metadata.AUTHOR_KEYS),
            "date": F.coalesce(
                none_if_empty(F.col("_data.publishedTime")), metadata.lookup_text(tags, metadata.DATE_KEYS)
            ),
            "description": none_if_empty(F.col("_data.description")),
        }
    )


def read_reader_responses(responses: DataFrame) -> DataFrame:
    """Landed responses (``schemas.FETCH_RESPONSE``) as articles, with ``fetch_class``.

    Failed fetches stay in the table, with a class other than ``ok``; see ``filter_usable_articles``.
    """
    parsed = extract_metadata(parse_body(responses))
    return parsed.select(
        "article_id",
        F.col("url").alias("source_url"),
        "title",
        "author",
        "date",
        "description",
        F.col("_data.content").alias("markdown"),
        fetch_class(
            F.col("error_kind"), F.col("http_status"), F.col("_decoded"), F.col("_data.content")
        ).alias("fetch_class"),
    )
