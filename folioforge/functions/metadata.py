"""Metadata choice from an open key/value map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.text import has_text, strip

# Metadata keys in order of preference.
AUTHOR_KEYS = ("author", "article:author", "og:author", "citation_author")
DATE_KEYS = ("article:published_time", "date", "DC.date")
DESCRIPTION_KEYS = ("description", "og:description")


def first_text(candidates: list[Column]) -> Column:
    """The first candidate with visible text, stripped."""
    return F.coalesce(*[F.when(has_text(value), strip(value)) for value in candidates])


def variant_text(value: Column) -> Column:
    """The string inside a variant; null for lists, numbers and every other type."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def lookup_text(metadata: Column, keys: tuple[str, ...]) -> Column:
    return first_text([variant_text(F.try_element_at(metadata, F.lit(key))) for key in keys])
