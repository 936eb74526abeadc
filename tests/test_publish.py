import pytest
from pyspark.sql import functions as F

from folioforge import Settings
from folioforge.operators import publish, slugs
from folioforge.operators.documents import prepare_articles
from folioforge.plans.corpus import build_corpus, documents, image_manifest
from folioforge.schemas import ARTICLE, HTML_PAGE, IMAGE_ATTEMPT
from folioforge.sources import read_html_pages
from folioforge.streaming.incremental import build_corpus_incremental, publish_batch

SETTINGS = Settings(downloaded_at="2026-03-15T10:00:00Z")


def decide(spark, policy, published=(), **kw):
    rows = [(3, "home"), (1, "home"), (2, "about"), (4, "home"), (5, "taken"), (6, "taken")]
    table = spark.createDataFrame(rows, "article_id bigint, slug string")
    known = spark.createDataFrame([(s,) for s in published], "slug string")
    found = slugs.slug_conflict_policy(table, policy, known, SETTINGS, **kw).collect()
    return {r.article_id: (r.final_slug, r.slug_status) for r in found}


def test_conflict_policies(spark):
    conflict, superseded = (None, "conflict"), (None, "superseded")
    assert decide(spark, "fail", ["taken"]) == {
        1: ("home", "new"), 2: ("about", "new"), 3: conflict, 4: conflict, 5: conflict, 6: conflict,
    }
    assert decide(spark, "overwrite", ["taken"]) == {
        1: superseded, 2: ("about", "new"), 3: superseded, 4: ("home", "new"), 5: superseded, 6: ("taken", "replaces"),
    }
    assert decide(spark, "suffix", ["taken"]) == {
        1: ("home", "new"), 2: ("about", "new"), 3: ("home-20260315-100000--3", "renamed"),
        4: ("home-20260315-100000--4", "renamed"), 5: ("taken-20260315-100000--5", "renamed"),
        6: ("taken-20260315-100000--6", "renamed"),
    }
    with pytest.raises(ValueError):
        decide(spark, "other")


def test_arrival_order_decides_first_and_last(spark):
    table = spark.createDataFrame([(1, "s", 9), (2, "s", 5), (3, "s", 9)], "article_id bigint, slug string, at int")
    first = slugs.slug_conflict_policy(table, "fail", settings=SETTINGS, arrival="at").filter("final_slug is not null")
    last = slugs.slug_conflict_policy(table, "overwrite", settings=SETTINGS, arrival="at").filter("final_slug is not null")
    assert (first.first().article_id, last.first().article_id) == (2, 3)


def test_publish_conflicts(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "article_id bigint, slug string")
    known = spark.createDataFrame([("a",), ("z",)], "slug string")
    assert sorted(r.article_id for r in slugs.publish_conflicts(table, known).collect()) == [1, 3]
    assert slugs.publish_conflicts(table, known, force=True).count() == 0


def prepared(spark, *rows):
    """rows: (id, title, markdown)"""
    data = [(i, f"https://example.com/{i}", title, None, None, None, md) for i, title, md in rows]
    return prepare_articles(spark.createDataFrame(data, ARTICLE), SETTINGS)


def attempts(spark, *rows):
    data = [(i, url, 1, 200, None, "image/png", size) for i, url, size in rows]
    return spark.createDataFrame(data, IMAGE_ATTEMPT)


def run(spark, root, batch_id, rows, log=(), policy="fail"):
    ready, tries = prepared(spark, *rows), attempts(spark, *log)
    manifest = image_manifest(ready, tries, SETTINGS)
    known = publish.read_published(spark, root).select("slug")
    built = build_corpus(ready, tries, SETTINGS, policy=policy, published=known, manifest=manifest)
    return publish.publish_corpus(root, batch_id, built, manifest)


def read_pages(spark, *rows):
    """rows: (id, url, title, text)"""
    data = [(i, u, f"<title>{t}</title><article><p>{x}</p><img src='/p.png'></article>") for i, u, t, x in rows]
    return read_html_pages(spark.createDataFrame(data, HTML_PAGE))


def current(spark, root):
    rows = [(r.slug, (r.article_id, r.batch_id)) for r in publish.read_published(spark, root).collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def images(spark, root):
    return {r.path: r.batch_id for r in publish.read_published_images(spark, root).collect()}


def test_publish_conflict_replace_and_repeat(spark, tmp_path):
    root = str(tmp_path / "corpus")
    md = "![p](https://x/p.png)"
    assert current(spark, root) == {}
    assert run(spark, root, "one", [(1, "Home", md), (2, "About", md), (3, "Home", "")], [(1, "https://x/p.png", 4)])
    assert current(spark, root) == {"home": (1, "one"), "about": (2, "one")}
    assert images(spark, root) == {"home/images/001-p.png": "one"}
    # Without force the published document stays, and the new ones are added.
    assert run(spark, root, "two", [(4, "Home", "new"), (5, "News", "")])
    assert current(spark, root) == {"home": (1, "one"), "about": (2, "one"), "news": (5, "two")}
    # With it, the whole of the old document goes, its images too.
    assert run(spark, root, "three", [(6, "Home", "no image")], policy="overwrite")
    assert current(spark, root) == {"home": (6, "three"), "about": (2, "one"), "news": (5, "two")}
    assert images(spark, root) == {}
    # A logged batch is not published again.
    assert not run(spark, root, "three", [(7, "Other", "x")])
    assert "other" not in current(spark, root)
    log = {r.batch_id: (r.articles, r.images) for r in publish.read_batches(spark, root).collect()}
    assert log == {"one": (2, 1), "two": (1, 0), "three": (1, 0)}


def test_a_failed_run_leaves_the_published_corpus_alone(spark, tmp_path):
    root = str(tmp_path / "corpus")
    run(spark, root, "one", [(1, "Home", "precious")])
    ready = prepared(spark, (2, "Home", "new"), (3, "More", "new"))
    manifest = image_manifest(ready, attempts(spark), SETTINGS)
    built = build_corpus(ready, attempts(spark), SETTINGS, policy="overwrite", manifest=manifest)
    broken = manifest.withColumn("filename", F.raise_error(F.lit("lost")).cast("string")).unionByName(
        spark.createDataFrame([(3, 1, "u", "f", 1)], manifest.schema).withColumn("filename", F.expr("cast(raise_error('lost') as string)"))
    )
    with pytest.raises(Exception, match="lost"):
        publish.publish_corpus(root, "two", built, broken, overwrite=True)
    assert current(spark, root) == {"home": (1, "one")}
    # The next try with the same id takes the place of what the failed one left.
    with pytest.raises(ValueError, match="does not replace"):
        publish.publish_corpus(root, "two", built, manifest)
    assert publish.publish_corpus(root, "two", built, manifest, overwrite=True)
    assert current(spark, root) == {"home": (2, "two"), "more": (3, "two")}


def test_end_to_end(spark):
    url = "https://x/{}".format
    md = f"# T\n\n![Test image]({url('image1.png')})\n![Another]({url('image2.jpg')})\n![gone]({url('gone.png')})\n"
    ready = prepared(spark, (1, "Test Article Title", md), (2, "Plain", "# P\n\nText"), (3, "Plain", "again"))
    log = attempts(spark, (1, url("image1.png"), 10), (1, url("image2.jpg"), 20))
    rows = {r.article_id: r for r in build_corpus(ready, log, SETTINGS).collect()}
    first = rows[1]
    assert (first.slug, first.outcome, first.images_found, first.images_downloaded, first.images_failed, first.image_bytes) == (
        "test-article-title", "Partial success", 3, 2, 1, 30,
    )
    assert first.content == (
        '---\ntitle: "Test Article Title"\nsource_url: "https://example.com/1"\ndownloaded: "2026-03-15T10:00:00Z"\n'
        'tool: "folioforge v0.1.0"\n---\n\n# T\n\n![Test image](./images/001-image1.png)\n'
        f"![Another](./images/002-image2.png)\n![gone]({url('gone.png')})\n"
    )
    assert (rows[2].outcome, rows[2].images_found, rows[2].slug_status) == ("Success", 0, "new")
    assert (rows[3].slug, rows[3].content, rows[3].outcome, rows[3].slug_status) == (None, None, "Failure", "conflict")
    published = documents(build_corpus(ready, log, SETTINGS)).collect()
    assert sorted(r.path for r in published) == ["plain/article.md", "test-article-title/article.md"]


def test_redirects_take_part_in_the_build(spark):
    ready = prepared(spark, (1, "T", "![p](https://x/p.png) ![q](https://x/q.png)"))
    log = attempts(spark, (1, "https://x/p.png", 1), (1, "https://x/q.png", 1))
    edges = spark.createDataFrame([("https://x/p.png", "http://192.168.0.1/p.png")], "src string, location string")
    row = build_corpus(ready, log, SETTINGS, redirects=edges).first()
    assert (row.images_found, row.images_downloaded) == (2, 1)


def test_incremental_runs(spark, tmp_path):
    landing, root, state = (str(tmp_path / name) for name in ("landing", "corpus", "state"))

    def land(*rows):
        data = [(i, f"https://example.com/{i}", f"<title>{t}</title><article><p>{t}</p><img src='/p.png'></article>") for i, t in rows]
        spark.createDataFrame(data, HTML_PAGE).coalesce(1).write.mode("append").parquet(landing)

    def drain():
        stream = spark.readStream.schema(HTML_PAGE).parquet(landing)
        log = attempts(spark, (1, "https://example.com/p.png", 5))
        build_corpus_incremental(stream, read_html_pages, lambda: log, root, state, SETTINGS).awaitTermination()
        return current(spark, root)

    land((1, "One"), (2, "Two"))
    assert drain() == {"one": (1, "stream-0000000000"), "two": (2, "stream-0000000000")}
    land((3, "Two"), (4, "Four"))
    assert drain() == {
        "one": (1, "stream-0000000000"), "two": (2, "stream-0000000000"), "four": (4, "stream-0000000001"),
    }
    assert drain() == current(spark, root)
    assert images(spark, root) == {"one/images/001-p.png": "stream-0000000000"}


def test_a_batch_is_published_once(spark, tmp_path):
    root = str(tmp_path / "corpus")
    pages = read_html_pages(spark.createDataFrame([(1, "https://example.com/1", "<title>One</title><p>x</p>")], HTML_PAGE))
    assert publish_batch(root, "b", pages, attempts(spark), SETTINGS)
    assert not publish_batch(root, "b", pages, attempts(spark), SETTINGS)
    assert current(spark, root) == {"one": (1, "b")}


@pytest.mark.parametrize("batch_id", ["2026/03", "a%2Fb", "", "..", "_x", "a b"])
def test_batch_ids_that_cannot_be_folders_are_refused(spark, tmp_path, batch_id):
    with pytest.raises(ValueError, match="batch id"):
        run(spark, str(tmp_path / "corpus"), batch_id, [(1, "Home", "x")])


def test_a_slug_and_an_article_have_one_document_after_any_order_of_runs(spark, tmp_path):
    root = str(tmp_path / "corpus")
    log = attempts(spark)
    for number, policy in enumerate(["suffix", "suffix", "fail", "overwrite", "suffix"]):
        pages = read_pages(spark, (1, "https://example.com/1", "Home", f"run {number}"), (2, "https://example.com/2", "Home", "x"))
        assert publish_batch(root, f"b{number}", pages, log, SETTINGS, policy=policy)
        # The first changes and keeps its slug, the second stays as it was published.
        assert current(spark, root) == {"home": (1, f"b{number}"), "home-20260315-100000--2-in-b0": (2, "b0")}


def test_what_a_failed_try_replaced_does_not_count(spark, tmp_path):
    root = str(tmp_path / "corpus")
    run(spark, root, "one", [(1, "Home", "kept")])
    broken = image_manifest(prepared(spark, (2, "Home", "x")), attempts(spark), SETTINGS)
    lost = spark.createDataFrame([(2, 1, "u", "f", 1)], broken.schema).withColumn("filename", F.expr("cast(raise_error('lost') as string)"))
    built = build_corpus(prepared(spark, (2, "Home", "x")), attempts(spark), SETTINGS, policy="overwrite", published=publish.read_published(spark, root).select("slug"), manifest=broken)
    with pytest.raises(Exception, match="lost"):
        publish.publish_corpus(root, "two", built, lost)
    run(spark, root, "two", [(3, "Other", "y")])
    assert current(spark, root) == {"home": (1, "one"), "other": (3, "two")}


def test_an_article_that_landed_twice_is_one_document(spark, tmp_path):
    root = str(tmp_path / "corpus")
    url = "https://example.com/1"
    pages = read_pages(spark, (1, url, "Home", "old"), (1, url, "Home", "old"), (1, url, "Home", "other"), (2, url, "Two", "x"))
    assert publish_batch(root, "b", pages.withColumn("arrival", F.when(F.col("markdown").contains("other"), 2).otherwise(1)), attempts(spark, (1, "https://example.com/p.png", 5)), SETTINGS)
    rows = {r.article_id: r.content for r in publish.read_published(spark, root).collect()}
    assert set(rows) == {1, 2} and "other" in rows[1] and "images/001-p.png" in rows[1]


def test_refused_urls_are_not_published(spark, tmp_path):
    root = str(tmp_path / "corpus")
    pages = read_pages(spark, (1, "http://127.0.0.1/a", "Home", "x"), (2, "ftp://e.com/b", "Home", "x"), (3, "https://e.com/c", "Home", "x"), (4, None, "Null", "x"))
    assert publish_batch(root, "b", pages, attempts(spark), SETTINGS)
    assert current(spark, root) == {"home": (3, "b")}


def test_refused_articles_take_no_part_in_the_image_work(spark):
    ready = prepared(spark, (1, "Home", "![p](https://x/p.png)"), (2, "Home", "![p](https://x/p.png)"))
    log = attempts(spark, (1, "https://x/p.png", 4), (2, "https://x/p.png", 4))
    rows = {r.article_id: (r.images_found, r.images_downloaded, r.outcome) for r in build_corpus(ready, log, SETTINGS).collect()}
    assert rows == {1: (1, 1, "Success"), 2: (1, 0, "Failure")}


def test_staged_folders_of_a_batch_are_removed(spark, tmp_path):
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    assert publish_batch(str(tmp_path / "corpus"), "b", read_pages(spark, (1, "https://example.com/1", "T", "x")), attempts(spark), SETTINGS)
    assert set(shared.iterdir()) == before


def test_lists_of_current_slugs_change_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(publish, "COMPACT_EVERY", 2)
    root = str(tmp_path / "corpus")
    expected = {}
    for number, (title, policy) in enumerate([("Home", "fail"), ("About", "fail"), ("Home", "overwrite"), ("News", "fail"), ("About", "overwrite")]):
        assert run(spark, root, f"b{number}", [(number, title, "x")], policy=policy)
        expected[title.lower()] = (number, f"b{number}")
        assert current(spark, root) == expected
        assert {(r.slug, r.batch_id) for r in publish.read_current_slugs(spark, root).collect()} == {(s, b) for s, (_, b) in expected.items()}
    assert len(publish._names(spark, f"{root}/snapshots")) == 2
    assert publish.compact(spark, root) and not publish.compact(spark, root)
    assert current(spark, root) == expected
