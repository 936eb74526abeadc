"""Image bodies by content, from landed files to the manifest."""

import hashlib

from folioforge.operators import bodies
from folioforge.sources import read_image_bodies

MANIFEST = "article_id bigint, seq int, url string, filename string, size_bytes bigint"


def land(folder, files):
    folder.mkdir()
    for name, content in files.items():
        (folder / name).write_bytes(content)
    return str(folder)


def test_each_body_is_stored_once(spark, tmp_path):
    root = str(tmp_path / "store")
    first = read_image_bodies(spark, land(tmp_path / "one", {"a.png": b"A", "b.png": b"B", "c.png": b"A", "empty.png": b""}))
    second = read_image_bodies(spark, land(tmp_path / "two", {"a.png": b"C", "d.png": b"B"}))
    for batch in (first, second, second):
        bodies.store_bodies(batch, root)
    stored = {row.digest: bytes(row.content) for row in bodies.read_bodies(spark, root).collect()}
    assert bodies.read_bodies(spark, root).count() == len(stored) == 3
    assert stored == {hashlib.sha256(content).hexdigest(): content for content in (b"A", b"B", b"C")}


def test_manifest_points_at_bodies(spark, tmp_path):
    landed_files = spark.createDataFrame([("p1", b"same"), ("p2", b"same"), ("p3", b"other"), ("p4", None)], "path string, content binary")
    landed = spark.createDataFrame([(1, "u", "p1"), (2, "v", "p2"), (2, "w", "p1"), (2, "w", "p3"), (3, "x", "p4")], "article_id bigint, url string, path string")
    manifest = spark.createDataFrame([(1, 1, "u", "a.png", 4), (2, 1, "v", "b.png", 4), (2, 2, "w", "c.png", 5), (3, 1, "x", "d.png", 1), (4, 1, "u", "e.png", 1)], MANIFEST)
    addressed = bodies.address_images(manifest, landed, bodies.body_digests(landed_files))
    found = {(row.article_id, row.seq): (row.digest, row.body_bytes) for row in addressed.collect()}
    same, other = (hashlib.sha256(content).hexdigest() for content in (b"same", b"other"))
    assert found == {(1, 1): (same, 4), (2, 1): (same, 4), (2, 2): (other, 5), (3, 1): (None, None), (4, 1): (None, None)}
    assert tuple(bodies.body_savings(addressed).first()) == (3, 2, 13, 9)
    assert tuple(bodies.body_savings(addressed.limit(0)).first()) == (0, 0, 0, 0)


def test_content_stays_out_of_the_manifest(spark, tmp_path):
    """Files are hashed where they are read; only the digests meet the manifest."""
    files = read_image_bodies(spark, land(tmp_path / "one", {"a.png": b"A"}))
    landed = spark.createDataFrame([(1, "u", "p")], "article_id bigint, url string, path string")
    manifest = spark.createDataFrame([(1, 1, "u", "a.png", 1)], MANIFEST)
    plan = bodies.address_images(manifest, landed, bodies.body_digests(files))._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanged and not any("content" in line for line in exchanged)
