"""From fetched articles to finished documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import images as img
from folioforge.operators import manifest as mf
from folioforge.operators.attempts import apply_redirects
from folioforge.operators.documents import assemble, prepare_articles
from folioforge.operators.fetch import filter_usable_articles, latest_articles, validate_urls
from folioforge.operators.refs import explode_images
from folioforge.operators.reports import outcome_of
from folioforge.operators.slugs import slug_conflict_policy
from folioforge.settings import Settings


def acceptable_articles(articles: DataFrame, settings: Settings = Settings(), arrival: str | None = None) -> DataFrame:
    """Provider output (with ``fetch_class``) prepared for building: fetched, with an acceptable url, once each."""
    asked = validate_urls(filter_usable_articles(articles), "source_url").filter("url_error is null").drop("url_error")
    return prepare_articles(latest_articles(asked, arrival), settings)


def decide_slugs(
    prepared: DataFrame,
    settings: Settings = Settings(),
    *,
    policy: str = "fail",
    published: DataFrame | None = None,
    batch_id: str | None = None,
) -> DataFrame:
    """Under which slug each prepared article is published: (article_id, slug, final_slug, slug_status)."""
    return slug_conflict_policy(prepared.select("article_id", "slug"), policy, published, settings, batch_id=batch_id)


def image_manifest(
    prepared: DataFrame,
    attempts: DataFrame,
    settings: Settings = Settings(),
    redirects: DataFrame | None = None,
    decisions: DataFrame | None = None,
    with_type: bool = False,
) -> DataFrame:
    """Stored images of the prepared articles, with their local names; with ``decisions``, of accepted articles only."""
    if decisions is not None:
        accepted = decisions.filter(F.col("final_slug").isNotNull()).select("article_id")
        prepared = prepared.select("article_id", "images").join(accepted, "article_id", "left_semi")
    if redirects is not None:
        attempts = apply_redirects(attempts, redirects, settings)
    return mf.image_local_filename(mf.judge_images(explode_images(prepared), attempts, settings), with_type=with_type)


def build_corpus(
    prepared: DataFrame,
    attempts: DataFrame,
    settings: Settings = Settings(),
    *,
    policy: str = "fail",
    published: DataFrame | None = None,
    redirects: DataFrame | None = None,
    manifest: DataFrame | None = None,
    decisions: DataFrame | None = None,
    batch_id: str | None = None,
    keep_source: bool = False,
) -> DataFrame:
    """Finish prepared articles (``operators.documents.prepare_articles``).

    Columns: article_id, source_url, slug (null when refused), slug_status, outcome, images_found,
    images_downloaded, images_failed, image_bytes, content (null when refused).

    ``prepared`` has one row per article_id (``acceptable_articles``). Slugs are decided first, unless ``decisions``
    are given, and articles that are refused take no part in the image work: their images all count as failed.

    Only ids, slugs and urls take part in the conflict and image branches. The text is partitioned by
    article_id once, and both branches arrive partitioned the same way. Pass a staged ``prepared`` at scale,
    so that the branches do not parse the raw pages again.

    ``keep_source`` adds ``source``, the prepared article, to documents some of whose images failed: enough to build them
    again when those arrive.
    """
    own = F.struct(*[F.col(name).alias(name) for name in prepared.columns])
    if keep_source:
        prepared = prepared.withColumn("_source", F.when(F.size("images") > 0, own))
    if decisions is None:
        decisions = decide_slugs(prepared, settings, policy=policy, published=published, batch_id=batch_id)
    if manifest is None:
        manifest = image_manifest(prepared, attempts, settings, redirects, decisions)
    joined = (
        prepared.drop("slug", "title")
        .join(decisions.drop("slug"), "article_id")
        .join(mf.files_per_article(manifest), "article_id", "left")
    )
    text = F.when(F.col("files").isNull(), F.col("markdown")).otherwise(
        img.rewrite(F.col("markdown"), F.col("refs"), F.col("files"))
    )
    stored = F.when(F.col("files").isNull(), 0).otherwise(F.size("files"))
    counted = joined.withColumn("images_found", F.size("images")).withColumn("images_downloaded", stored)
    failed = F.col("images_found") - F.col("images_downloaded")
    return counted.select(
        "article_id",
        "source_url",
        F.col("final_slug").alias("slug"),
        "slug_status",
        F.when(F.col("final_slug").isNotNull(), outcome_of(failed)).otherwise("Failure").alias("outcome"),
        "images_found",
        "images_downloaded",
        failed.alias("images_failed"),
        F.coalesce("image_bytes", F.lit(0).cast("bigint")).alias("image_bytes"),
        F.when(F.col("final_slug").isNotNull(), assemble(F.col("front_matter"), text)).alias("content"),
        *([F.when(failed > 0, F.col("_source")).alias("source")] if keep_source else []),
    )


def documents(corpus: DataFrame) -> DataFrame:
    """The publishable part: slug, path, article_id, content."""
    return corpus.filter(F.col("slug").isNotNull()).select(
        "slug", F.concat("slug", F.lit("/article.md")).alias("path"), "article_id", "content"
    )
