"""Per-article and per-batch reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import urls
from folioforge.functions.images import image_matches, split_match
from folioforge.functions.text import has_text
from folioforge.settings import Settings


def outcome_of(failed: Column) -> Column:
    # Outcome labels.
    return F.when(failed > 0, "Partial success").otherwise("Success")


def run_results(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """article_id, outcome, images_found, images_downloaded, images_failed.

    ``found`` is (article_id, images_found), one row per article; an article without images is a success.
    """
    stored = manifest.groupBy("article_id").agg(F.count(F.lit(1)).cast("int").alias("images_downloaded"))
    counted = found.join(stored, "article_id", "left").withColumn(
        "images_downloaded", F.coalesce("images_downloaded", F.lit(0))
    )
    failed = F.col("images_found") - F.col("images_downloaded")
    return counted.select(
        "article_id", outcome_of(failed).alias("outcome"), "images_found", "images_downloaded", failed.alias("images_failed")
    )


def run_status(requests: DataFrame) -> DataFrame:
    """Add ``status``: 1 refused url, 2 failed fetch, 3 slug conflict, 0 published (wholly or in part).

    ``requests`` has url_error, fetch_class and slug_status; a later stage is null when it was not reached.
    """
    return requests.withColumn(
        "status",
        F.when(F.col("url_error").isNotNull(), 1)
        .when(F.col("fetch_class") != "ok", 2)
        .when(F.col("slug_status") == "conflict", 3)
        .otherwise(0),
    )


def corpus_report(results: DataFrame) -> DataFrame:
    """Images and outcomes summed by host of ``source_url``, and over all hosts (host null).

    The sums are combined before the shuffle, so neither a hot host nor the total is a bottleneck.
    """
    return (
        results.withColumn("host", urls.host(F.col("source_url")))
        .rollup("host")
        .agg(
            F.count(F.lit(1)).alias("articles"),
            F.count_if(F.col("outcome") == "Success").alias("succeeded"),
            F.count_if(F.col("outcome") == "Partial success").alias("partly_succeeded"),
            F.sum("images_found").alias("images_found"),
            F.sum("images_downloaded").alias("images_downloaded"),
            F.sum("images_failed").alias("images_failed"),
        )
    )


def running_image_bytes(manifest: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Add ``total_bytes`` in download order and ``crosses_limit``, true on the row that passes the limit.

    A window over the article: its images are those of one text, and a manifest is partitioned by article already.
    """
    order = Window.partitionBy("article_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    totals = manifest.withColumn("total_bytes", F.sum("size_bytes").over(order))
    limit = F.lit(settings.article_size_warning)
    crosses = (F.col("total_bytes") > limit) & (F.col("total_bytes") - F.col("size_bytes") <= limit)
    return totals.withColumn("crosses_limit", crosses)


def resource_warnings(found: DataFrame, manifest: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per warning: article_id, warning, subject, amount. ``found`` as in :func:`run_results`."""
    many = found.filter(F.col("images_found") > settings.image_count_warning).select(
        "article_id",
        F.lit("image_count").alias("warning"),
        F.lit(None).cast("string").alias("subject"),
        F.col("images_found").cast("bigint").alias("amount"),
    )
    large = manifest.filter(F.col("size_bytes") > settings.image_size_warning).select(
        "article_id",
        F.lit("image_size").alias("warning"),
        F.col("filename").alias("subject"),
        F.col("size_bytes").alias("amount"),
    )
    total = running_image_bytes(manifest, settings).filter("crosses_limit").select(
        "article_id",
        F.lit("article_size").alias("warning"),
        F.col("filename").alias("subject"),
        F.col("total_bytes").alias("amount"),
    )
    return many.unionByName(large).unionByName(total)


PROFILE_COLUMNS = (
    "images", "data_uris", "multiline_alts", "query_urls", "fragment_urls", "paren_urls", "empty_alts",
    "html_images", "reference_style", "in_code_fences", "image_links", "title_attributes",
)


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


# What counts as an image of each form. An opening sign is not passed over on the way to its closing one, so a
# row of unclosed ones is read once; a match that begins with several of them is counted from the last.
REFERENCE_STYLE = r"!\[[^\]!]*+(?:!(?!\[)[^\]!]*+)*+\]\[[^\]]+\]"
IMAGE_LINK = r"\[!\[[^\]\[]*+(?:\[(?!!\[)[^\]\[]*+)*+\]\([^)\[]*+(?:\[(?!!\[)[^)\[]*+)*+(?<!\()\)\]\([^)]+\)"
IMAGE_TAG = r"(?i)<img\s[^>]*+>"
IMAGE_SOURCE = r"""(?i)src=["'][^"']+["']"""


def _count_tags(text: Column) -> Column:
    """Image elements with a source. The text is cut after its last closing bracket, so that each tag has one."""
    closed = F.substring(text, F.lit(1), F.length(text) - F.length(F.substring_index(text, ">", -1)))
    return F.size(F.filter(F.regexp_extract_all(closed, F.lit(IMAGE_TAG), F.lit(0)), lambda tag: tag.rlike(IMAGE_SOURCE)))


def image_syntax_profile(documents: DataFrame, text: str = "markdown") -> DataFrame:
    """Per document, how often each form of image syntax occurs. Row-local; replaces the text by counts."""
    source = F.col(text)

    def parts(match: Column) -> Column:
        alt, url = split_match(match)
        return F.struct(alt.alias("alt"), url.alias("url"))

    def matching(condition) -> Column:
        return F.size(F.filter("_images", condition))

    def counted(mark: str, count: Column) -> Column:
        # The literal that every match contains is looked for first: most texts have no images at all.
        return F.when(F.instr(source, mark) > 0, count).otherwise(0)

    fences = F.regexp_extract_all(source, F.lit(r"(?s)```.*?```"), F.lit(0))
    fenced = F.aggregate(fences, F.lit(0), lambda total, block: total + F.size(image_matches(block)))
    return (
        documents.withColumn("_images", F.transform(image_matches(source), parts))
        .withColumns(
            {
                "images": F.size("_images"),
                "data_uris": matching(lambda image: image["url"].startswith("data:")),
                "multiline_alts": matching(lambda image: image["alt"].contains("\n")),
                "query_urls": matching(lambda image: image["url"].contains("?")),
                "fragment_urls": matching(lambda image: image["url"].contains("#")),
                "paren_urls": matching(lambda image: image["url"].contains("(")),
                "empty_alts": matching(lambda image: ~has_text(image["alt"])),
                "html_images": counted("<", _count_tags(source)),
                "reference_style": counted("![", _count(source, REFERENCE_STYLE)),
                "in_code_fences": counted("```", fenced),
                "image_links": counted("[![", _count(source, IMAGE_LINK)),
                "title_attributes": matching(lambda image: image["url"].rlike(r"""\s["'][^"']*["']\s*\z""")),
            }
        )
        .drop("_images", text)
    )


def profile_totals(profile: DataFrame) -> DataFrame:
    """One row: documents, documents with images, and the sum of every count."""
    return profile.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("images") > 0).alias("with_images"),
        *[F.sum(name).alias(name) for name in PROFILE_COLUMNS],
    )
