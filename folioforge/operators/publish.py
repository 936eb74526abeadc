"""Writing and reading a published corpus on plain files.

Layout below a root folder: ``articles`` and ``images`` (one partition per batch), ``replaced`` (documents a batch took
the place of, and from which batch), ``open_images`` and ``open_attempts`` (what the next batch has to look at again), and
``batches``, the log. A batch exists once its entry is in the log, which is made last; what a failed job leaves behind is
never read and is overwritten by the next try.

``articles`` lie in buckets by slug, as many in all batches (``layout.json``): current documents, those under given slugs and those
that are built again are found without moving published text. A corpus begun without buckets goes on without.

Log entries are numbered files, each made by a rename that fails if the file exists, so of two writers that are ready
at once one gets the number. The other looks at what was logged meanwhile: if that shares no slug and no article with
its own batch it takes the next number, else it is told to start again.

Which documents are current is written down every ``COMPACT_EVERY`` batches (``current`` and ``covered``, logged in
``snapshots``), so that a new batch reads one such list and the few batches after it, not the whole history.
"""

from __future__ import annotations

import json
import re
import time
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from folioforge.operators.buckets import of_places, of_slugs, read_bucketed, write_bucketed
from folioforge.schemas import PREPARED

DOCUMENT = (
    "slug string, path string, article_id bigint, content string, slug_status string, wanted string, source_hash binary, "
    f"source struct<{PREPARED}>, batch_id string"
)
IMAGE = "article_id bigint, slug string, seq int, url string, filename string, path string, size_bytes bigint, content_type string, batch_id string"
REPLACED = "slug string, old_batch_id string, refused boolean, batch_id string"
BATCH = "version bigint, batch_id string, articles bigint, images bigint"
CURRENT = "slug string, article_id bigint, wanted string, source_hash binary, batch_id string"
COVERED = "batch_id string"
COMPACT_EVERY = 50


class ConcurrentBatch(Exception):
    """Another batch with a slug or an article of this one was published meanwhile: decide again."""


def write_articles(documents: DataFrame, folder: str, buckets: int | None = None) -> None:
    """One row per document, in buckets by slug: the text is exchanged here once, so that reading by slug need not."""
    write_bucketed(documents, folder, buckets or default_buckets(documents.sparkSession))


def write_image_manifest(manifest: DataFrame, folder: str) -> None:
    """One row per stored image; articles without one leave no trace."""
    manifest.write.mode("overwrite").parquet(folder)


def read_table(spark: SparkSession, root: str, table: str, schema: str, form: str = "parquet") -> DataFrame:
    kind = T.StructType.fromDDL(schema)
    try:
        return spark.read.schema(kind).format(form).load(f"{root}/{table}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        # Known to be empty when a plan is made, so that joins with it go.
        return spark.range(1).select(*[F.lit(None).cast(field.dataType).alias(field.name) for field in kind.fields]).limit(0)


def default_buckets(spark: SparkSession) -> int:
    """As many as a shuffle has partitions: ``configure`` fits those to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_layout(spark: SparkSession, root: str) -> int | None:
    """In how many buckets documents lie; None if in none, or nothing is published."""
    path, files = _file_system(spark, f"{root}/layout.json")
    return json.loads(_content(files, path))["buckets"] if files.exists(path) else None


def make_layout(spark: SparkSession, root: str, buckets: int | None = None) -> int | None:
    """Fix the number of buckets of a corpus that has none yet. The first writer decides; returns what holds."""
    path, files = _file_system(spark, f"{root}/articles")
    if read_layout(spark, root) is None and not files.exists(path):
        _create_once(spark, root, f"{root}/layout.json", {"buckets": buckets or default_buckets(spark)})
    return read_layout(spark, root)


def read_articles(spark: SparkSession, root: str) -> DataFrame:
    """The documents of all batches, logged or not, in their buckets."""
    buckets = read_layout(spark, root)
    path, files = _file_system(spark, f"{root}/articles")
    if buckets is None or not files.exists(path):
        return read_table(spark, root, "articles", DOCUMENT)
    return read_bucketed(spark, f"{root}/articles", DOCUMENT, buckets, "batch_id")


def read_batches(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "batches", BATCH, "json")


def _names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of the log, hidden ones left out; none if there is no such folder."""
    path, files = _file_system(spark, folder)
    if not files.exists(path):
        return []
    return sorted(name for name in (status.getPath().getName() for status in files.listStatus(path)) if name[0] not in "._")


def latest_batch(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """Number and id of the last entry of the log; 0 and None if there is none."""
    names = _names(spark, f"{root}/batches")
    if not names:
        return 0, None
    path, files = _file_system(spark, f"{root}/batches/{names[-1]}")
    entry = json.loads(_content(files, path))
    return entry["version"], entry["batch_id"]


def _logged(spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
    batches = read_batches(spark, root).select("batch_id")
    return read_table(spark, root, table, schema).join(batches, "batch_id", "left_semi")


def is_logged(spark: SparkSession, root: str, batch_id: str) -> bool:
    return not read_batches(spark, root).filter(F.col("batch_id") == batch_id).isEmpty()


def read_of_batch(spark: SparkSession, root: str, table: str, batch_id: str | None, schema: str) -> DataFrame:
    """The part of a table that one batch wrote; empty for None."""
    return read_table(spark, root, f"{table}/batch_id={batch_id}" if batch_id else "none", schema)


def _snapshot(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The latest list of current documents, and the batches that it covers."""
    # One file for each COMPACT_EVERY batches, of which the last is taken.
    name = f"snapshot={(_names(spark, f'{root}/snapshots') or ['none'])[-1]}"
    return read_table(spark, root, f"current/{name}", CURRENT), read_table(spark, root, f"covered/{name}", COVERED)


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """(slug, article_id, wanted, source_hash, batch_id) of the current documents: the latest list, and what the
    batches after it changed."""
    known, covered = _snapshot(spark, root)
    newer = read_batches(spark, root).select("batch_id").join(covered, "batch_id", "left_anti")
    columns = known.columns
    added = read_table(spark, root, "articles", DOCUMENT).select(*columns).join(newer, "batch_id", "left_semi")
    replaced = read_table(spark, root, "replaced", REPLACED).join(newer, "batch_id", "left_semi")
    gone = replaced.select("slug", F.col("old_batch_id").alias("batch_id"))
    return known.unionByName(added.select(*columns)).join(gone, ["slug", "batch_id"], "left_anti").select(*columns)


def read_current_slugs(spark: SparkSession, root: str) -> DataFrame:
    return read_current(spark, root).select("slug", "batch_id")


def compact(spark: SparkSession, root: str, every: int = 1) -> bool:
    """Write down which documents are current, if at least ``every`` batches came since the last time."""
    # Entries are never removed, and the last one's number is how many there are; a list is named by how many it covers.
    total, listed = latest_batch(spark, root)[0], _names(spark, f"{root}/snapshots")[-1:]
    if total - (int(listed[0].split("-")[0]) if listed else 0) < every:
        return False
    batches = read_batches(spark, root).select("batch_id")
    # The list covers the batches that were logged when it was begun, so they are written down first.
    name = f"{total:012d}-{uuid4().hex}"
    batches.write.parquet(f"{root}/covered/snapshot={name}")
    covered = read_table(spark, root, f"covered/snapshot={name}", COVERED)
    known, before = _snapshot(spark, root)
    newer = covered.join(before, "batch_id", "left_anti")
    added = read_table(spark, root, "articles", DOCUMENT).select(*known.columns).join(newer, "batch_id", "left_semi")
    gone = read_table(spark, root, "replaced", REPLACED).join(newer, "batch_id", "left_semi").select("slug", F.col("old_batch_id").alias("batch_id"))
    current = known.unionByName(added.select(*known.columns)).join(gone, ["slug", "batch_id"], "left_anti")
    current.select(*known.columns).write.parquet(f"{root}/current/snapshot={name}")
    done, files = _file_system(spark, f"{root}/snapshots/{name}")
    files.create(done, False).close()
    return True


def read_published(spark: SparkSession, root: str) -> DataFrame:
    """Current documents: those of logged batches that no later batch replaced. No document is moved for it, and a filter
    on one slug reads one bucket."""
    documents = read_articles(spark, root).select("slug", "path", "article_id", "content", "batch_id")
    return of_places(documents, read_current_slugs(spark, root), read_layout(spark, root))


def read_published_slugs(spark: SparkSession, root: str, slugs: DataFrame) -> DataFrame:
    """Current documents under the slugs of a table with a column ``slug``, each once. No document is moved for it."""
    return of_slugs(read_published(spark, root), slugs, read_layout(spark, root))


def read_sources(spark: SparkSession, root: str, places: DataFrame) -> DataFrame:
    """What the documents at the places (slug, batch_id) were built from, where it was kept. No source is moved for it."""
    kept = read_articles(spark, root).filter("source is not null").select("slug", "batch_id", "source")
    return of_places(kept, places, read_layout(spark, root)).select("source.*")


def read_published_images(spark: SparkSession, root: str) -> DataFrame:
    """Current images: those of the current documents."""
    return _logged(spark, root, "images", IMAGE).join(read_current_slugs(spark, root), ["slug", "batch_id"], "left_semi")


def checked(batch_id: str) -> str:
    """Batch ids are parts of paths: letters, digits, ``.``, ``_`` and ``-``, the first a letter or digit."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch_id):
        raise ValueError(f"not a batch id: {batch_id!r}")
    return batch_id


def _file_system(spark: SparkSession, path: str):
    """A path of Hadoop's, and the file system that it is on."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def _content(files, path) -> bytes:
    stream = files.open(path)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def _create_once(spark: SparkSession, root: str, name: str, content: dict) -> bool:
    """Make a file of that name and content, unless there is one."""
    target, files = _file_system(spark, name)
    ready, _ = _file_system(spark, f"{root}/commits/{uuid4().hex}.json")
    files.mkdirs(target.getParent())
    stream = files.create(ready, False)
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(files.makeQualified(ready), files.makeQualified(target), options)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
            raise
        files.delete(ready, False)
        return False
    return True


def _commit(spark: SparkSession, root: str, version: int, batch_id: str, articles: int, images: int) -> bool:
    """Make the log entry of that number, unless there is one."""
    entry = {"version": version, "batch_id": batch_id, "articles": articles, "images": images}
    return _create_once(spark, root, f"{root}/batches/{version:012d}.json", entry)


def publish_corpus(
    root: str,
    batch_id: str,
    corpus: DataFrame,
    manifest: DataFrame,
    *,
    overwrite: bool = False,
    sources: DataFrame | None = None,
    against: int | None = None,
    buckets: int | None = None,
) -> bool:
    """Publish the documents and images of a batch, all or nothing. False if the batch is logged already.

    ``corpus`` is the result of ``plans.corpus.build_corpus`` against ``read_published(root)``. The document
    text is computed once, while it is written; image and replacement tables are derived from what was
    written. Several writers may publish at once, each under a batch id of its own: one whose batch shares a slug or an
    article with a batch that was logged since it began raises ``ConcurrentBatch``.

    An article and a slug have at most one current document each, whatever the corpus was built against: which documents
    are replaced is decided by what is current when the batch is written. A document takes the place of its
    article's current one, under whatever slug that is. It takes that of another article under its slug if its status is ``replaces``,
    or any does with ``overwrite``; else the batch is refused, as is one that holds a slug or an article twice.

    ``sources`` (article_id, wanted, source_hash) says which slug an article asked for and what its text was made from,
    for later batches to compare; ``operators.identity`` does. ``against`` is the number of the last log entry when the
    slugs were decided: a batch logged since then counts as published meanwhile. ``buckets``: in how many buckets by slug the
    documents lie, of use for the first batch; those after it follow.
    """
    spark = corpus.sparkSession
    batch_id = checked(batch_id)
    if is_logged(spark, root, batch_id):
        return False
    base = latest_batch(spark, root)[0] if against is None else against
    articles, images, replaced = (f"{root}/{table}/batch_id={batch_id}" for table in ("articles", "images", "replaced"))
    if sources is not None:
        corpus = corpus.join(sources.select("article_id", "wanted", "source_hash"), "article_id", "left")
    given = {name: F.col(name) if name in corpus.columns else F.lit(None) for name in ("wanted", "source_hash", "source")}
    kinds = {field.name: field.dataType for field in T.StructType.fromDDL(DOCUMENT)}
    ready = corpus.filter(F.col("slug").isNotNull()).select(
        "slug",
        F.concat("slug", F.lit("/article.md")).alias("path"),
        "article_id",
        "content",
        "slug_status",
        F.coalesce(given["wanted"], F.col("slug")).alias("wanted"),
        *[given[name].cast(kinds[name]).alias(name) for name in ("source_hash", "source")],
    )
    layout = make_layout(spark, root, buckets)
    if layout:
        write_articles(ready, articles, layout)
    else:
        ready.write.mode("overwrite").parquet(articles)
    written = spark.read.schema(ready.schema).parquet(articles).select("article_id", "slug", "slug_status")
    documents, slugs, ids = written.agg(F.count(F.lit(1)), F.count_distinct("slug"), F.count_distinct("article_id")).first()
    if slugs < documents:
        raise ValueError(f"batch {batch_id} holds a slug twice")
    if ids < documents:
        raise ValueError(f"batch {batch_id} holds an article twice")

    earlier = read_current(spark, root).select("slug", "article_id", F.col("batch_id").alias("old_batch_id"))
    others = written.select("slug", F.col("article_id").alias("by"), "slug_status")
    refused = (F.col("article_id") != F.col("by")) & (F.col("slug_status") != "replaces")
    met = earlier.join(others, "slug").select("slug", "old_batch_id", refused.alias("refused"))
    own = earlier.join(written.select("article_id"), "article_id").select("slug", "old_batch_id", F.lit(False).alias("refused"))
    # Written also without rows: a file that an earlier try of this batch left would count.
    met.union(own).groupBy("slug", "old_batch_id").agg(F.max("refused").alias("refused")).write.mode("overwrite").parquet(replaced)
    if not overwrite and not read_of_batch(spark, root, "replaced", batch_id, REPLACED).filter("refused").isEmpty():
        if latest_batch(spark, root)[0] > base and against is not None:
            raise ConcurrentBatch(batch_id)
        raise ValueError(f"batch {batch_id} meets published slugs that it does not replace")

    kind = F.col("content_type") if "content_type" in manifest.columns else F.lit(None).cast("string")
    placed = manifest.join(written.drop("slug_status"), "article_id").select(
        "article_id",
        "slug",
        "seq",
        "url",
        "filename",
        F.concat("slug", F.lit("/images/"), "filename").alias("path"),
        "size_bytes",
        kind.alias("content_type"),
    )
    write_image_manifest(placed, images)
    stored = spark.read.schema(placed.schema).parquet(images).count()
    while not _commit(spark, root, base + 1, batch_id, documents, stored):
        newer = read_batches(spark, root).filter(F.col("version") > base).select("batch_id")
        theirs = read_table(spark, root, "articles", DOCUMENT).select("slug", "article_id", "batch_id").join(newer, "batch_id", "left_semi")
        if not newer.filter(F.col("batch_id") == batch_id).isEmpty():
            return False
        if not all(theirs.join(written, key, "left_semi").isEmpty() for key in ("slug", "article_id")):
            raise ConcurrentBatch(batch_id)
        base, _ = latest_batch(spark, root)
    compact(spark, root, COMPACT_EVERY)
    return True


def vacuum(spark: SparkSession, root: str, retention_seconds: int = 7 * 24 * 3600) -> list[str]:
    """Remove what no reader can reach any more and was last written that long ago; returns the removed paths.

    Reachable are the documents and images of batches that hold a current document, the latest list of current documents, the
    open work of the latest batch, and everything of batches that were logged since that list. What goes: batches of which
    every document was replaced, what failed tries left, and older lists. A reader that started before must be done within the
    retention. Reads the log and lists folders, one for each batch; a batch that holds one current document stays whole.
    """
    compact(spark, root)
    logged = {r.batch_id for r in read_batches(spark, root).select("batch_id").collect()}
    covered = {r.batch_id for r in _snapshot(spark, root)[1].collect()}
    live = {r.batch_id for r in read_current(spark, root).select("batch_id").distinct().collect()}
    newer = logged - covered
    latest = latest_batch(spark, root)[1]
    snapshot = set(_names(spark, f"{root}/snapshots")[-1:])
    reachable = {
        "articles": live | newer, "images": live | newer, "replaced": newer,
        "open_images": {latest}, "open_attempts": {latest}, "current": snapshot, "covered": snapshot, "commits": set(),
    }
    oldest = (time.time() - retention_seconds) * 1000
    removed = []
    for table, kept in reachable.items():
        folder, files = _file_system(spark, f"{root}/{table}")
        if not files.exists(folder):
            continue
        for status in files.listStatus(folder):
            path = status.getPath()
            if path.getName().split("=", 1)[-1] in kept:
                continue
            inside = files.listStatus(path) if status.isDirectory() else []
            if max([status.getModificationTime(), *(own.getModificationTime() for own in inside)]) <= oldest:
                files.delete(path, True)
                removed.append(f"{table}/{path.getName()}")
    return sorted(removed)
