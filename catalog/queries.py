"""Every operator as a query over the given tables (whole tables, whole texts)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import views
from folioforge import Settings
from folioforge.functions import images as img
from folioforge.functions import text, urls
from folioforge.functions.dates import normalize_date
from folioforge.operators import attempts as at
from folioforge.operators import documents as docs
from folioforge.operators import fetch, manifest, publish, refs, reports, slugs
from folioforge.operators.staging import new_folder, stage
from folioforge.plans import corpus
from folioforge.session import configure
from folioforge.sources import read_html_pages, read_image_responses, read_reader_responses
from folioforge.sources.layout import evaluate_once
from folioforge.streaming.incremental import build_corpus_incremental, publish_batch

SETTINGS = Settings()
# Low enough for the derived tables, which hold 42 MB and 7 images per article, to be warned about.
WARNING_SETTINGS = Settings(article_size_warning=40 * 1024 * 1024, image_count_warning=6)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    """Register the function under its name, less a trailing underscore where the name is taken by an import."""

    def configured(spark: SparkSession, folder: str) -> DataFrame:
        return run(configure(spark), folder)

    QUERIES[run.__name__.rstrip("_")] = configured
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    for base in ("pages", "documents"):
        table(spark, folder, base).createOrReplaceTempView(base)
    return spark.sql(views.VIEWS[name](views.SPARK))


def articles(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "articles")


def prepared(spark: SparkSession, folder: str) -> DataFrame:
    return stage(docs.prepare_articles(articles(spark, folder), SETTINGS), "prepared")


def referenced(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Image references and distinct images per article; the text only where a query asks for it."""
    found = evaluate_once(refs.extract_image_refs(articles(spark, folder)), "refs")
    images = img.unique_images(F.col("refs")).alias("images")
    return stage(found.select("article_id", "refs", images, *columns), "referenced")


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "attempts")


# --- sources and sinks


@query
def read_reader_responses_(spark, folder):
    return read_reader_responses(view(spark, folder, "fetches"))


@query
def read_html_pages_(spark, folder):
    return read_html_pages(table(spark, folder, "pages"))


@query
def read_image_responses_(spark, folder):
    return read_image_responses(attempts(spark, folder))


@query
def write_articles(spark, folder):
    target = new_folder(spark, "articles")
    ready = docs.assemble_documents(docs.add_front_matter(docs.resolve_title_slug(articles(spark, folder))))
    publish.write_articles(ready.select("article_id", "slug", "content"), target)
    return spark.read.parquet(target)


@query
def write_image_manifest(spark, folder):
    target = new_folder(spark, "images")
    stored = corpus.image_manifest(referenced(spark, folder), attempts(spark, folder), SETTINGS)
    publish.write_image_manifest(stored, target)
    return spark.read.parquet(target)


@query
def publish_corpus(spark, folder):
    """Publish the corpus, then a later run over it that replaces what is there."""
    root = new_folder(spark, "corpus")
    ready = prepared(spark, folder)
    stored = stage(corpus.image_manifest(ready, attempts(spark, folder), SETTINGS), "manifest")
    for batch_id, policy in (("first", "fail"), ("second", "overwrite")):
        known = publish.read_current_slugs(spark, root).select("slug")
        built = corpus.build_corpus(
            ready, attempts(spark, folder), SETTINGS, policy=policy, published=known, manifest=stored
        )
        publish.publish_corpus(root, batch_id, built, stored)
    images = publish.read_published_images(spark, root).groupBy("slug").agg(F.count(F.lit(1)).alias("images"))
    current = publish.read_published(spark, root).join(images, "slug", "left")
    return current.select("slug", "path", "article_id", "content", "batch_id", F.coalesce("images", F.lit(0)).alias("images"))


def landed(spark, folder):
    return articles(spark, folder).withColumn("fetch_class", F.lit("ok"))


@query
def publish_relanded(spark, folder):
    """All articles, and then all once more, those with an even id with more text: one document each, unchanged ones
    skipped. No image is logged again."""
    root = new_folder(spark, "corpus")
    first, log = landed(spark, folder), attempts(spark, folder)
    longer = F.when(F.col("article_id") % 2 == 0, F.concat("markdown", F.lit("\nmore"))).otherwise(F.col("markdown"))
    publish_batch(root, "first", first, log, SETTINGS)
    publish_batch(root, "second", first.withColumn("markdown", longer), log.limit(0), SETTINGS)
    images = publish.read_published_images(spark, root).groupBy("slug").agg(F.count(F.lit(1)).alias("images"))
    current = publish.read_published(spark, root).join(images, "slug", "left")
    return current.select("slug", "path", "article_id", "content", "batch_id", F.coalesce("images", F.lit(0)).alias("images"))


@query
def publish_late_images(spark, folder):
    """All articles, the attempts at one image of every other article being logged only after their batch: they reach its
    document."""
    root = new_folder(spark, "corpus")
    log = attempts(spark, folder)
    late = F.col("url").contains("/hero.png") & (F.col("article_id") % 2 == 0)
    publish_batch(root, "first", landed(spark, folder), log.filter(~late), SETTINGS)
    publish_batch(root, "second", landed(spark, folder).limit(0), log.filter(late), SETTINGS)
    images = publish.read_published_images(spark, root).groupBy("slug").agg(F.count(F.lit(1)).alias("images"))
    current = publish.read_published(spark, root).join(images, "slug", "left")
    return current.select("slug", "path", "article_id", "content", "batch_id", F.coalesce("images", F.lit(0)).alias("images"))


# --- filters and classification


@query
def validate_urls(spark, folder):
    return fetch.validate_urls(view(spark, folder, "urls"))


@query
def is_private_host(spark, folder):
    return fetch.mark_private_hosts(view(spark, folder, "urls"))


@query
def classify_fetch(spark, folder):
    return read_reader_responses(view(spark, folder, "fetches")).select("article_id", "source_url", "fetch_class")


@query
def filter_usable_articles(spark, folder):
    usable = fetch.filter_usable_articles(read_reader_responses(view(spark, folder, "fetches")))
    return usable.select("article_id", "source_url", "markdown")


@query
def accept_image_response(spark, folder):
    judged = manifest.accept_image_responses(attempts(spark, folder))
    return judged.select("article_id", "url", "attempt", "content_type", "rejection")


@query
def http_scheme_filter(spark, folder):
    text_of = F.col("markdown")
    return articles(spark, folder).select(
        "article_id",
        F.size(img.image_matches(text_of)).alias("matches"),
        F.size(img.image_refs(text_of)).alias("web_refs"),
    )


# --- metadata and document scalars


@query
def extract_metadata(spark, folder):
    read = fetch.filter_usable_articles(read_reader_responses(view(spark, folder, "fetches")))
    return read.select("article_id", "title", "author", "date", "description")


@query
def normalize_date_(spark, folder):
    dates = read_reader_responses(view(spark, folder, "fetches")).select("article_id", "date")
    dates = dates.unionByName(articles(spark, folder).select("article_id", "date"))
    return dates.withColumn("normalized", normalize_date(F.col("date")))


@query
def transliterate(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text").select(
        "doc_id", text.transliterate(F.col("text")).alias("ascii_text")
    )


@query
def slugify(spark, folder):
    titled = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), titled.alias("text"))
    texts = table(spark, folder, "documents").select("doc_id", "text").unionByName(pages)
    return texts.select("doc_id", text.slugify(F.col("text")).alias("slug"))


@query
def extract_h1(spark, folder):
    return articles(spark, folder).select("article_id", text.first_heading(F.col("markdown")).alias("heading"))


@query
def url_path_slug(spark, folder):
    path = F.btrim(urls.path(F.col("url")), F.lit("/"))
    parts = table(spark, folder, "pages").select(F.col("page_id").alias("article_id"), "url").withColumn("path", path)
    return parts.select(
        "article_id",
        text.none_if_empty(text.slugify(F.col("path"))).alias("slug"),
        F.concat(urls.authority(F.col("url")), F.lit("/"), "path").alias("title"),
    )


@query
def resolve_title_slug(spark, folder):
    return docs.resolve_title_slug(articles(spark, folder), SETTINGS).select("article_id", "slug", "title")


@query
def front_matter(spark, folder):
    titled = docs.resolve_title_slug(articles(spark, folder), SETTINGS)
    return docs.add_front_matter(titled, SETTINGS).select("article_id", "front_matter")


@query
def assemble_documents(spark, folder):
    titled = docs.resolve_title_slug(articles(spark, folder), SETTINGS)
    return docs.assemble_documents(docs.add_front_matter(titled, SETTINGS)).select("article_id", "slug", "content")


@query
def redact_secrets(spark, folder):
    return view(spark, folder, "secrets").select("doc_id", text.redact_secrets(F.col("text")).alias("text"))


# --- image references


@query
def extract_image_refs(spark, folder):
    found = refs.extract_image_refs(articles(spark, folder))
    return found.select(
        "article_id",
        F.size("refs").alias("refs"),
        F.array_join(F.transform("refs", lambda ref: ref["url"]), " ").alias("urls"),
        F.array_join(F.transform("refs", lambda ref: ref["alt"]), "|").alias("alts"),
    )


@query
def explode_image_refs(spark, folder):
    return refs.explode_image_refs(articles(spark, folder))


@query
def image_sequence(spark, folder):
    return refs.image_sequence(refs.explode_image_refs(articles(spark, folder)))


@query
def dedup_image_urls(spark, folder):
    return refs.dedup_image_urls(refs.explode_image_refs(articles(spark, folder)))


@query
def image_filename_parts(spark, folder):
    named = refs.explode_image_refs(articles(spark, folder)).withColumn("name", img.name_parts(F.col("url")))
    return named.select("article_id", "pos", "url", "name.base", "name.ext")


@query
def image_extension(spark, folder):
    named = attempts(spark, folder).withColumn("name", img.name_parts(F.col("url")))
    ext = img.extension(F.col("content_type"), F.col("name.ext"))
    return named.select("article_id", "url", "attempt", ext.alias("extension"))


@query
def image_local_filename(spark, folder):
    return corpus.image_manifest(referenced(spark, folder), attempts(spark, folder), SETTINGS)


@query
def rewrite_image_refs(spark, folder):
    ready = referenced(spark, folder, "markdown")
    stored = corpus.image_manifest(ready, attempts(spark, folder), SETTINGS)
    return manifest.rewrite_image_refs(ready, stored).select("article_id", "markdown")


@query
def image_syntax_profile(spark, folder):
    return reports.image_syntax_profile(articles(spark, folder).select("article_id", "markdown"))


@query
def image_syntax_totals(spark, folder):
    """The corpus sums, over the derived articles and the given documents."""
    texts = articles(spark, folder).select("markdown")
    given = table(spark, folder, "documents").select("doc_id", "text")
    texts = texts.unionByName(given.select(F.col("text").alias("markdown")))
    return reports.profile_totals(reports.image_syntax_profile(texts))


# --- joins


@query
def resolve_image_refs(spark, folder):
    ready = referenced(spark, folder)
    stored = corpus.image_manifest(ready, attempts(spark, folder), SETTINGS)
    exploded = ready.select("article_id", F.inline("refs"))
    return manifest.resolve_image_refs(exploded, stored).select("article_id", "pos", "alt", "url", "filename")


@query
def failed_images(spark, folder):
    judged = manifest.judge_images(refs.explode_images(referenced(spark, folder)), attempts(spark, folder), SETTINGS)
    return manifest.failed_images(judged)


@query
def content_type_lookup(spark, folder):
    found = manifest.content_type_lookup(attempts(spark, folder))
    return found.select("article_id", "url", "attempt", "content_type", "type_ext")


@query
def resolve_redirects(spark, folder):
    return at.resolve_redirects(view(spark, folder, "requested"), view(spark, folder, "redirects"), SETTINGS)


@query
def publish_conflicts(spark, folder):
    titled = docs.resolve_title_slug(articles(spark, folder), SETTINGS).select("article_id", "slug")
    return slugs.publish_conflicts(stage(titled, "slugs"), view(spark, folder, "published"))


# --- aggregations


@query
def count_unique_images(spark, folder):
    return refs.count_unique_images(articles(spark, folder))


@query
def resolve_attempts(spark, folder):
    return at.resolve_attempts(attempts(spark, folder), SETTINGS)


def _found_and_stored(spark, folder):
    ready = referenced(spark, folder, "source_url")
    found = ready.select("article_id", F.size("images").alias("images_found"))
    return found, corpus.image_manifest(ready, attempts(spark, folder), SETTINGS), ready


@query
def run_results(spark, folder):
    found, stored, _ = _found_and_stored(spark, folder)
    return reports.run_results(found, stored)


@query
def run_status(spark, folder):
    asked = fetch.validate_urls(view(spark, folder, "urls")).select("article_id", "url_error")
    read = read_reader_responses(view(spark, folder, "fetches"))
    titled = docs.resolve_title_slug(fetch.filter_usable_articles(read), SETTINGS).select("article_id", "slug")
    # A refused url is never fetched, so its article takes part in no contest for a slug.
    titled = titled.join(asked.filter("url_error is null"), "article_id", "left_semi")
    decided = slugs.slug_conflict_policy(stage(titled, "slugs"), "fail", settings=SETTINGS).select("article_id", "slug_status")
    requests = asked.join(read.select("article_id", "fetch_class"), "article_id").join(decided, "article_id", "left")
    return reports.run_status(requests)


@query
def corpus_report(spark, folder):
    found, stored, ready = _found_and_stored(spark, folder)
    results = reports.run_results(found, stored).join(ready.select("article_id", "source_url"), "article_id")
    return reports.corpus_report(results)


# --- windows


@query
def running_image_bytes(spark, folder):
    _, stored, _ = _found_and_stored(spark, folder)
    return reports.running_image_bytes(stage(stored, "manifest"), WARNING_SETTINGS)


@query
def resource_warnings(spark, folder):
    found, stored, _ = _found_and_stored(spark, folder)
    return reports.resource_warnings(found, stage(stored, "manifest"), WARNING_SETTINGS)


def _policy(spark, folder, policy):
    titled = docs.resolve_title_slug(articles(spark, folder), SETTINGS).select("article_id", "slug")
    return slugs.slug_conflict_policy(stage(titled, "slugs"), policy, view(spark, folder, "published"), SETTINGS)


@query
def slug_conflict_policy_fail(spark, folder):
    return _policy(spark, folder, "fail")


@query
def slug_conflict_policy_overwrite(spark, folder):
    return _policy(spark, folder, "overwrite")


@query
def slug_conflict_policy_suffix(spark, folder):
    return _policy(spark, folder, "suffix")


# --- end to end


@query
def build_corpus(spark, folder):
    return corpus.build_corpus(prepared(spark, folder), attempts(spark, folder), SETTINGS, policy="suffix")


@query
def build_corpus_redirects(spark, folder):
    """The same with redirects of images, which may lead to a private host or too far."""
    edges = view(spark, folder, "image_redirects")
    return corpus.build_corpus(prepared(spark, folder), attempts(spark, folder), SETTINGS, policy="suffix", redirects=edges)


@query
def build_corpus_incremental_(spark, folder):
    """The landed pages as a stream, drained into a published corpus."""
    schema = table(spark, folder, "pages").schema
    landed = spark.readStream.schema(schema).option("pathGlobFilter", "pages*.parquet").parquet(folder)
    root, state = new_folder(spark, "corpus"), new_folder(spark, "stream-state")
    running = build_corpus_incremental(
        landed, read_html_pages, lambda: attempts(spark, folder), root, state, SETTINGS, policy="fail"
    )
    running.awaitTermination()
    return publish.read_published(spark, root).select("slug", "path", "article_id", "content")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """One finished document per usable page."""
    pages = read_html_pages(table(configure(spark), folder, "pages"))
    ready = stage(corpus.acceptable_articles(pages, SETTINGS), "prepared")
    return corpus.build_corpus(ready, attempts(spark, folder), SETTINGS, policy="suffix")
