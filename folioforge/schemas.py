"""Schemas of the tables that operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

LONG, INT, STR = T.LongType(), T.IntegerType(), T.StringType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# A page as landed by a crawler.
HTML_PAGE = _table(page_id=LONG, url=STR, html=STR)

# One response of a reader service per requested article.
FETCH_RESPONSE = _table(article_id=LONG, url=STR, http_status=INT, error_kind=STR, body=STR)

# What every provider returns.
ARTICLE = _table(
    article_id=LONG,
    source_url=STR,
    title=STR,
    author=STR,
    date=STR,
    description=STR,
    markdown=STR,
)

# One row per try to get an image. ``error_kind`` outranks ``http_status``.
IMAGE_ATTEMPT = _table(
    article_id=LONG,
    url=STR,
    attempt=INT,
    http_status=INT,
    error_kind=STR,
    content_type=STR,
    size_bytes=LONG,
)

# What ``prepare_articles`` makes of an article, as DDL.
PREPARED = (
    "article_id: bigint, source_url: string, slug: string, title: string, front_matter: string, markdown: string, "
    "refs: array<struct<pos: int, alt: string, url: string, original_match: string>>, images: array<struct<seq: int, url: string>>"
)

REDIRECT = _table(src=STR, location=STR)

IMAGE_MANIFEST = _table(article_id=LONG, seq=INT, url=STR, filename=STR, size_bytes=LONG)

# The part of a reader response that is used. ``malformed`` receives the text when it is not JSON.
READER_BODY = T.StructType(
    [
        T.StructField(
            "data",
            T.StructType(
                [
                    T.StructField("title", STR),
                    T.StructField("description", STR),
                    T.StructField("content", STR),
                    T.StructField("publishedTime", STR),
                    T.StructField("metadata", T.MapType(STR, T.VariantType())),
                ]
            ),
        ),
        T.StructField("malformed", STR),
    ]
)
