"""Build and publish whatever landed since the last run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioforge.operators import publish
from folioforge.operators.identity import OPEN_IMAGES, compare_with_current, source_hash, still_open, upsert_slugs
from folioforge.operators.staging import release, stage
from folioforge.plans.corpus import acceptable_articles, build_corpus, image_manifest
from folioforge.schemas import IMAGE_ATTEMPT
from folioforge.settings import Settings

# Batches after which an image, or an attempt at one of an article that never came, is given up.
OPEN_BATCHES = 30
# How often a batch is decided again because another writer published one of its slugs or articles first.
TRIES = 5
OPEN_ATTEMPTS = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in IMAGE_ATTEMPT.fields) + ", since bigint"


def publish_batch(
    root: str,
    batch_id: str,
    articles: DataFrame,
    attempts: DataFrame,
    settings: Settings = Settings(),
    *,
    policy: str = "fail",
    redirects: DataFrame | None = None,
    open_batches: int = OPEN_BATCHES,
) -> bool:
    """Prepare, build and publish one batch of provider output (with ``fetch_class``). Runs jobs.

    Articles with a refused url take no part, and of an article that landed several times the latest is taken (a column
    ``arrival`` decides, where there is one). An article is known by its id in all batches: one that is as it was
    published is skipped, one that changed takes the place of its own document (``operators.identity``).

    ``attempts`` are the image attempts logged since the last batch; the whole log does as well. Attempts whose article has not
    been published, and documents whose images have not all been stored, stay open for ``open_batches`` batches: an
    image that arrives by then reaches its document, which is built again once for all that came in a batch. Images that a
    changed article had before count as arrived. A batch reads what came, what is open, and the list of current documents.

    Slugs are decided before the image work. The raw input is parsed once, into a staged table; what is staged is removed
    once the batch is published. Where another writer publishes one of the slugs or articles first, all is decided again.
    """
    arrival = "arrival" if "arrival" in articles.columns else None
    prepared = stage(acceptable_articles(articles, settings, arrival).withColumn("source_hash", source_hash()), "prepared")
    try:
        for left in reversed(range(TRIES)):
            try:
                return _publish(root, batch_id, prepared, attempts, settings, policy, redirects, open_batches)
            except publish.ConcurrentBatch:
                if not left:
                    raise
    finally:
        release(prepared)


def _publish(root, batch_id, prepared, attempts, settings, policy, redirects, open_batches) -> bool:
    spark = prepared.sparkSession
    batch_id = publish.checked(batch_id)
    if publish.is_logged(spark, root, batch_id):
        return False
    version, before = publish.latest_batch(spark, root)
    version += 1
    current = publish.read_current(spark, root)
    names = [field.name for field in IMAGE_ATTEMPT.fields]
    given = attempts.select(*names).withColumn("since", F.lit(version).cast("bigint"))
    waiting = publish.read_of_batch(spark, root, "open_attempts", before, OPEN_ATTEMPTS)
    arrived = stage(given.unionByName(waiting).groupBy(*names).agg(F.min("since").alias("since")), "arrived")

    # Ids, slugs and hashes only, from here to the manifest.
    compared = stage(compare_with_current(prepared.select("article_id", "slug", "source_hash"), current), "compared")
    fresh = upsert_slugs(compared, policy, current, settings, batch_id).join(compared.select("article_id", "source_hash"), "article_id")
    fresh = stage(fresh.withColumn("since", F.lit(version).cast("bigint")), "fresh")
    documents = current.select("article_id", "slug", "wanted", F.col("batch_id").alias("doc_batch_id"))
    open_before = publish.read_of_batch(spark, root, "open_images", before, OPEN_IMAGES).join(documents, ["article_id", "slug", "doc_batch_id"])
    open_before = open_before.join(fresh.filter("final_slug is not null"), "article_id", "left_anti")
    open_before = open_before if before is None else stage(open_before, "open-images")
    anything_open = before is not None and not open_before.isEmpty()
    plain = prepared.drop("source_hash")
    woken, decisions, ready = open_before.limit(0), fresh, plain
    if anything_open:
        # A changed article that was refused keeps its document as it is, and open.
        woken = open_before.join(arrived.filter(F.col("since") == version).select("article_id").distinct(), "article_id", "left_semi")
        woken = woken.join(fresh, "article_id", "left_anti")
        again = woken.select("article_id", F.col("wanted").alias("slug"), F.col("slug").alias("final_slug"), F.lit("updated").alias("slug_status"), "source_hash", "since")
        decisions = stage(fresh.unionByName(again), "decisions")
        # The sources of documents that are looked at again lie beside them.
        sources = publish.read_sources(spark, root, woken.select("slug", F.col("doc_batch_id").alias("batch_id")))
        ready = plain.unionByName(sources.join(compared.select("article_id"), "article_id", "left_anti"))

    # What a changed article had stored needs no new attempt.
    changed = compared.filter("change = 'changed'").select("article_id", F.col("current_slug").alias("slug"), F.col("current_batch_id").alias("batch_id"))
    had = publish.read_table(spark, root, "images", publish.IMAGE).join(changed, ["article_id", "slug", "batch_id"], "left_semi")
    had = had.select("article_id", "url", F.lit(1).alias("attempt"), F.lit(200).alias("http_status"), F.lit(None).cast("string").alias("error_kind"), "content_type", "size_bytes")
    manifest = stage(image_manifest(ready, arrived.select(*names).unionByName(had), settings, redirects, decisions, with_type=True), "manifest")

    decided = decisions
    if anything_open:
        # Documents for which nothing new could be stored stay as they are.
        gained = manifest.groupBy("article_id").agg(F.count(F.lit(1)).alias("now")).join(woken.select("article_id", "stored"), "article_id").filter("now > stored")
        idle = woken.join(gained, "article_id", "left_anti").select("article_id")
        decided = stage(decisions.join(idle, "article_id", "left_anti"), "decided")
    touched = decided.filter("final_slug is not null").select("article_id")
    opened = still_open(decided, ready.select("article_id", F.size("images").alias("images_found")), manifest, batch_id)
    untouched = open_before.drop("wanted").join(touched, "article_id", "left_anti")
    recent = F.col("since") > version - open_batches
    opened.unionByName(untouched).filter(recent).write.mode("overwrite").parquet(f"{root}/open_images/batch_id={batch_id}")
    open_now = publish.read_of_batch(spark, root, "open_images", batch_id, OPEN_IMAGES).select("article_id")
    unknown = arrived.join(current.select("article_id").union(touched), "article_id", "left_anti").filter(recent)
    unknown.unionByName(arrived.join(open_now, "article_id", "left_semi")).write.mode("overwrite").parquet(f"{root}/open_attempts/batch_id={batch_id}")

    corpus = build_corpus(ready, attempts, settings, manifest=manifest, decisions=decided.drop("source_hash", "since"), keep_source=True)
    wanted = decided.select("article_id", F.col("slug").alias("wanted"), "source_hash")
    done = publish.publish_corpus(root, batch_id, corpus, manifest, sources=wanted, against=version - 1)
    release(*{id(table): table for table in (arrived, compared, fresh, open_before, decisions, manifest, decided) if hasattr(table, "staged_in")}.values())
    return done


def build_corpus_incremental(
    landed: DataFrame,
    provider: Callable[[DataFrame], DataFrame],
    read_attempts: Callable[[], DataFrame] | None,
    root: str,
    checkpoint: str,
    settings: Settings = Settings(),
    *,
    policy: str = "fail",
    read_redirects: Callable[[], DataFrame] | None = None,
    image_log: DataFrame | None = None,
) -> StreamingQuery:
    """Run ``publish_batch`` on every micro-batch of the stream ``landed`` until it is drained.

    Image attempts come as a second stream, ``image_log``, of which a batch gets what was logged since the last one; or,
    without it, ``read_attempts`` gives the whole log each time. The batch id comes from the micro-batch, and a
    logged batch is skipped, so a micro-batch that is repeated after a failure is published exactly once.
    """
    articles = provider(landed)
    names = [field.name for field in IMAGE_ATTEMPT.fields]
    kinds = {"article": articles.schema, "attempt": IMAGE_ATTEMPT}

    def side(rows: DataFrame, name: str) -> DataFrame:
        own = {name: F.struct(*rows.columns)}
        return rows.select(*[own.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in kinds.items()])

    def publish_both(batch: DataFrame, epoch: int) -> None:
        redirects = read_redirects() if read_redirects else None
        came = batch.filter("article is not null").select("article.*")
        attempts = read_attempts() if image_log is None else batch.filter("attempt is not null").select("attempt.*")
        publish_batch(root, f"stream-{epoch:010d}", came, attempts, settings, policy=policy, redirects=redirects)

    both = side(articles, "article")
    if image_log is not None:
        both = both.unionByName(side(image_log.select(*names), "attempt"))
    return both.writeStream.foreachBatch(publish_both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
