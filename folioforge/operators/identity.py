"""Articles across batches: what changed, which slug an article keeps, and what is still open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.operators.slugs import slug_conflict_policy
from folioforge.settings import Settings

OPEN_IMAGES = "article_id bigint, slug string, doc_batch_id string, source_hash binary, stored int, since bigint"


def source_hash() -> Column:
    """16 bytes that stand for what a document is made of, but for the time of the run. For prepared articles."""
    front = F.regexp_replace("front_matter", r'\ndownloaded: "[^"]*"', "")
    parts = [F.coalesce(part, F.lit("")) for part in (F.col("source_url"), F.col("slug"), front, F.col("markdown"))]
    # Lengths keep text from moving between parts unnoticed.
    return F.unhex(F.md5(F.concat_ws(" ", *[F.char_length(part).cast("string") for part in parts], *parts).cast("binary")))


def compare_with_current(articles: DataFrame, current: DataFrame) -> DataFrame:
    """``articles`` (article_id, slug, source_hash, ...) with ``change``: ``new``, ``changed`` or ``unchanged``, and the current
    document's ``current_slug``, ``current_wanted`` and ``current_batch_id``. ``current`` is ``publish.read_current``."""
    known = current.select(
        "article_id",
        F.col("slug").alias("current_slug"),
        F.col("wanted").alias("current_wanted"),
        F.col("source_hash").alias("_hash"),
        F.col("batch_id").alias("current_batch_id"),
    )
    same = F.col("_hash") == F.col("source_hash")
    change = F.when(F.col("current_slug").isNull(), "new").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("changed")
    return articles.join(known, "article_id", "left").withColumn("change", change).drop("_hash")


def upsert_slugs(
    compared: DataFrame, policy: str, current: DataFrame, settings: Settings = Settings(), batch_id: str | None = None
) -> DataFrame:
    """Slugs of new and changed articles (of ``compare_with_current``): article_id, slug, final_slug, slug_status.

    A changed article that asks for the slug it asked for before keeps the one it got (``updated``). Any other is decided
    by ``policy`` like a new one; where it is refused, its current document stays. What another article of the
    batch keeps is never taken: under ``overwrite`` the one that asks for it is ``superseded``. A slug that is given up
    is free from the next batch on.
    """
    keeps = F.coalesce(F.col("slug") == F.col("current_wanted"), F.lit(False)) & (F.col("change") == "changed")
    asked = compared.filter(F.col("change") != "unchanged").withColumn("_keeps", keeps)
    kept = asked.filter("_keeps").select("article_id", "slug", F.col("current_slug").alias("final_slug"), F.lit("updated").alias("slug_status"))
    decided = slug_conflict_policy(asked.filter("not _keeps").select("article_id", "slug"), policy, current, settings, batch_id=batch_id)
    if policy == "overwrite":
        # One article replaces each slug, so this join has no frequent key.
        held = kept.select("final_slug", F.lit(True).alias("_held"))
        met = F.col("_held").isNotNull()
        decided = decided.join(held, "final_slug", "left").select(
            "article_id", "slug", F.when(~met, F.col("final_slug")).alias("final_slug"), F.when(met, "superseded").otherwise(F.col("slug_status")).alias("slug_status")
        )
    return kept.unionByName(decided)


def still_open(decisions: DataFrame, found: DataFrame, manifest: DataFrame, batch_id: str) -> DataFrame:
    """Of the accepted articles (``decisions`` with source_hash and since) those with images that are not stored yet, as
    OPEN_IMAGES. ``found`` is (article_id, images_found)."""
    stored = manifest.groupBy("article_id").agg(F.count(F.lit(1)).cast("int").alias("stored"))
    counted = decisions.filter("final_slug is not null").join(found, "article_id").join(stored, "article_id", "left")
    counted = counted.withColumn("stored", F.coalesce("stored", F.lit(0)))
    return counted.filter("images_found > stored").select(
        "article_id", F.col("final_slug").alias("slug"), F.lit(batch_id).alias("doc_batch_id"), "source_hash", "stored", "since"
    )
