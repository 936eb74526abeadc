"""Articles across batches: re-landed pages, images that arrive late, writers that meet, and clean-up."""

import pytest
from pyspark.sql import functions as F

from folioforge.operators import identity, publish
from folioforge.schemas import ARTICLE, HTML_PAGE, IMAGE_ATTEMPT
from folioforge.sources import read_html_pages
from folioforge.streaming.incremental import build_corpus_incremental, publish_batch
from tests.test_publish import SETTINGS, attempts, current, images, run



def url(i):
    return f"https://example.com/{i}"


def pages(spark, *rows):
    """rows: (id, title, text)"""
    data = [(i, url(i), title, None, None, None, f"{text}\n\n![p](https://example.com/p.png)", "ok") for i, title, text in rows]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ARTICLE.fields)
    return spark.createDataFrame(data, f"{kinds}, fetch_class string")


def image(spark, *ids, size=5):
    return attempts(spark, *[(i, "https://example.com/p.png", size) for i in ids])


def test_source_hash_ignores_the_time_of_the_run_only(spark):
    rows = [("a", "b", "x\ndownloaded: \"1\"\ny", "c"), ("a", "b", "x\ndownloaded: \"2\"\ny", "c"), ("a", "b", "x\ny", "d"), ("ab", "", "x\ny", "c"), (None, "b", "x\ny", None)]
    table = spark.createDataFrame(rows, "source_url string, slug string, front_matter string, markdown string")
    hashes = [bytes(r.h) for r in table.select(identity.source_hash().alias("h")).collect()]
    assert hashes[0] == hashes[1] and len(set(hashes)) == 4 and all(len(h) == 16 for h in hashes)


def test_slugs_of_articles_that_land_again(spark):
    known = spark.createDataFrame(
        [("home", 1, "home", b"1", "b"), ("home-x--2", 2, "home", b"2", "b"), ("news", 3, "news", b"3", "b")], publish.CURRENT
    )
    landed = spark.createDataFrame(
        [(1, "home", b"1"), (2, "home", b"changed"), (3, "home", b"changed"), (4, "news", b"4"), (5, "new", b"5"), (6, "home", b"6")],
        "article_id long, slug string, source_hash binary",
    )
    compared = identity.compare_with_current(landed, known)
    assert {r.article_id: r.change for r in compared.collect()} == {1: "unchanged", 2: "changed", 3: "changed", 4: "new", 5: "new", 6: "new"}

    def decided(policy):
        return {r.article_id: (r.final_slug, r.slug_status) for r in identity.upsert_slugs(compared, policy, known, SETTINGS, "c").collect()}

    kept, refused = ("home-x--2", "updated"), (None, "conflict")
    assert decided("fail") == {2: kept, 3: refused, 4: refused, 5: ("new", "new"), 6: refused}
    assert decided("overwrite") == {2: kept, 3: (None, "superseded"), 4: ("news", "replaces"), 5: ("new", "new"), 6: ("home", "replaces")}
    assert decided("suffix")[3] == ("home-20260315-100000--3-in-c", "renamed")


def test_what_an_article_of_the_batch_keeps_is_not_taken(spark):
    known = spark.createDataFrame([("home", 1, "home", b"1", "b")], publish.CURRENT)
    landed = spark.createDataFrame([(1, "home", b"changed"), (9, "home", b"9")], "article_id long, slug string, source_hash binary")
    found = identity.upsert_slugs(identity.compare_with_current(landed, known), "overwrite", known, SETTINGS).collect()
    assert {r.article_id: (r.final_slug, r.slug_status) for r in found} == {1: ("home", "updated"), 9: (None, "superseded")}


@pytest.mark.parametrize("policy", ["fail", "suffix"])
def test_an_article_has_one_document_whatever_lands_again(spark, tmp_path, policy):
    root = str(tmp_path / "corpus")
    none = attempts(spark)

    def land(number, *rows):
        assert publish_batch(root, f"b{number}", pages(spark, *rows), none, SETTINGS, policy=policy)
        found = publish.read_published(spark, root).collect()
        assert len({r.article_id for r in found}) == len({r.slug for r in found}) == len(found)
        return {r.article_id: (r.slug, r.batch_id, r.content.rsplit("\n\n", 1)[0].split("---\n\n")[-1]) for r in found}

    assert land(0, (7, "Same title", "old"), (8, "Other", "x"))[7] == ("same-title", "b0", "old")
    # Changed text, an unchanged neighbour; then a changed title; then both back as they were.
    found = land(1, (7, "Same title", "new"), (8, "Other", "x"))
    assert (found[7], found[8][1]) == (("same-title", "b1", "new"), "b0")
    assert land(2, (7, "Changed title", "new"))[7][:2] == ("changed-title", "b2")
    found = land(3, (7, "Same title", "old"), (8, "Other", "x"))
    assert (found[7][:2], found[8][1], len(found)) == (("same-title", "b3"), "b0", 2)


def test_images_that_arrive_late_reach_their_document_once(spark, tmp_path):
    root = str(tmp_path / "corpus")
    nothing = pages(spark).limit(0)
    assert publish_batch(root, "b1", pages(spark, (1, "One", "x"), (2, "Two", "x"), (3, "Three", "x")), image(spark, 1), SETTINGS)
    assert images(spark, root) == {"one/images/001-p.png": "b1"}
    # Of the log only what is open is kept, and it is empty: the image of the second and third never came.
    assert {r.article_id for r in publish.read_of_batch(spark, root, "open_images", "b1", identity.OPEN_IMAGES).collect()} == {2, 3}
    # An attempt that fails changes nothing; one for an article that has not come yet waits for it.
    failed = image(spark, 2).withColumn("http_status", F.lit(503)).unionByName(image(spark, 4))
    assert publish_batch(root, "b2", nothing, failed, SETTINGS)
    assert current(spark, root) == {"one": (1, "b1"), "two": (2, "b1"), "three": (3, "b1")}
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in IMAGE_ATTEMPT.fields) + ", since bigint"
    assert {(r.article_id, r.since) for r in publish.read_of_batch(spark, root, "open_attempts", "b2", kinds).collect()} == {(2, 2), (4, 2)}
    # The retry succeeds, the early attempt meets its article, and the other documents stay where they are.
    retried = image(spark, 2).withColumn("attempt", F.lit(2))
    assert publish_batch(root, "b3", pages(spark, (4, "Four", "x")), retried, SETTINGS)
    assert current(spark, root) == {"one": (1, "b1"), "two": (2, "b3"), "three": (3, "b1"), "four": (4, "b3")}
    assert images(spark, root) == {"one/images/001-p.png": "b1", "two/images/001-p.png": "b3", "four/images/001-p.png": "b3"}
    content = {r.article_id: r.content for r in publish.read_published(spark, root).collect()}
    assert "](./images/001-p.png)" in content[2] and "](https://example.com/p.png)" in content[3]
    # Logged once more, it is not built again. A changed article keeps the image that it had.
    assert publish_batch(root, "b4", pages(spark, (1, "One", "changed")), retried, SETTINGS)
    assert current(spark, root)["two"] == (2, "b3") and current(spark, root)["one"] == (1, "b4")
    assert images(spark, root)["one/images/001-p.png"] == "b4"
    # Beyond the batches that an image may stay open it is given up.
    assert publish_batch(root, "b5", nothing, image(spark, 3), SETTINGS, open_batches=2)
    assert publish.read_of_batch(spark, root, "open_images", "b5", identity.OPEN_IMAGES).count() == 0


def test_a_stream_of_pages_and_a_stream_of_attempts(spark, tmp_path):
    landing, log, root, state = (str(tmp_path / name) for name in ("landing", "log", "corpus", "state"))

    def land(*rows):
        data = [(i, url(i), f"<title>{t}</title><article><p>{t}</p><img src='/p.png'></article>") for i, t in rows]
        spark.createDataFrame(data, HTML_PAGE).coalesce(1).write.mode("append").parquet(landing)

    def drain():
        stream = spark.readStream.schema(HTML_PAGE).parquet(landing)
        tries = spark.readStream.schema(IMAGE_ATTEMPT).parquet(log)
        build_corpus_incremental(stream, read_html_pages, None, root, state, SETTINGS, image_log=tries).awaitTermination()
        return current(spark, root)

    land((1, "One"), (2, "Two"))
    image(spark, 1).coalesce(1).write.mode("append").parquet(log)
    assert drain() == {"one": (1, "stream-0000000000"), "two": (2, "stream-0000000000")}
    # Only an attempt lands: its document is built again from what was kept of it.
    image(spark, 2).coalesce(1).write.mode("append").parquet(log)
    assert drain() == {"one": (1, "stream-0000000000"), "two": (2, "stream-0000000001")}
    assert images(spark, root) == {"one/images/001-p.png": "stream-0000000000", "two/images/001-p.png": "stream-0000000001"}
    assert drain() == current(spark, root)


def interleaved(spark, root, monkeypatch, other):
    """Publish a batch of "Home" and "Mine"; before it is logged, another writer runs ``other``."""
    real, done = publish._commit, []

    def commit(*args):
        if not done:
            done.append(True)
            assert other()
        return real(*args)

    monkeypatch.setattr(publish, "_commit", commit)
    return lambda: publish_batch(root, "mine", pages(spark, (1, "Home", "x"), (2, "Mine", "x")), attempts(spark), SETTINGS)


def test_of_two_writers_with_one_slug_one_wins(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "corpus")
    mine = interleaved(spark, root, monkeypatch, lambda: run(spark, root, "other", [(5, "Home", "theirs")]))
    # The batch is decided again: the slug is taken by then, its other document is published.
    assert mine()
    assert current(spark, root) == {"home": (5, "other"), "mine": (2, "mine")}
    assert {r.version: r.batch_id for r in publish.read_batches(spark, root).collect()} == {1: "other", 2: "mine"}


def test_writers_that_share_nothing_are_both_logged(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "corpus")
    mine = interleaved(spark, root, monkeypatch, lambda: run(spark, root, "other", [(5, "Theirs", "x")]))
    assert mine()
    assert current(spark, root) == {"home": (1, "mine"), "mine": (2, "mine"), "theirs": (5, "other")}


def test_a_number_of_the_log_is_given_once(spark, tmp_path):
    root = str(tmp_path / "corpus")
    assert publish._commit(spark, root, 1, "a", 1, 0)
    assert not publish._commit(spark, root, 1, "b", 1, 0)
    assert [r.batch_id for r in publish.read_batches(spark, root).collect()] == ["a"]
    assert publish.latest_batch(spark, root) == (1, "a")


def test_clean_up_removes_what_nothing_reaches(spark, tmp_path):
    root = str(tmp_path / "corpus")
    md = "![p](https://x/p.png)"
    for number, (rows, policy) in enumerate([([(1, "Home", md), (2, "About", "x")], "fail"), ([(3, "News", "x")], "fail"), ([(4, "News", "y")], "overwrite"), ([(5, "Home", "z")], "overwrite")]):
        assert run(spark, root, f"b{number}", rows, [(1, "https://x/p.png", 4)], policy=policy)
    failed = spark.createDataFrame([(9, "half")], "article_id long, slug string")
    failed.write.parquet(f"{root}/articles/batch_id=failed")
    before, pictures = current(spark, root), images(spark, root)
    assert publish.vacuum(spark, root) == [], "all of it is younger than the retention"
    removed = publish.vacuum(spark, root, retention_seconds=0)
    # "About" of b0 is current, all of b1 was replaced by b2.
    assert {"articles/batch_id=b1", "images/batch_id=b1", "articles/batch_id=failed"} <= set(removed)
    assert not [r for r in removed if r.startswith("articles") and r.split("=")[1] not in ("b1", "failed")]
    assert current(spark, root) == before and images(spark, root) == pictures
    assert publish.vacuum(spark, root, retention_seconds=0) == []
    assert run(spark, root, "b4", [(6, "Home", "again")], policy="overwrite")
    assert current(spark, root)["home"] == (6, "b4")
