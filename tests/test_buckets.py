"""Documents in buckets by slug: written, looked up and replaced without moving published text."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioforge.operators import buckets, publish
from tests.test_publish import run

NAMES = [f"page {i}" for i in range(12)]


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """Two batches, the second replacing four documents of the first, with joins that are not broadcast."""
    root = str(tmp_path_factory.mktemp("root") / "corp'us")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    run(spark, root, "b1", [(i, name, f"old {i}") for i, name in enumerate(NAMES)])
    run(spark, root, "b2", [(i, NAMES[i], f"new {i}") for i in range(4)], policy="overwrite")
    yield root
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_published_side_is_not_exchanged(spark, root):
    assert publish.read_layout(spark, root) == 4
    wanted = spark.createDataFrame([("page-1",), ("page-7",), ("page-7",), ("none",), (None,)], "slug string")
    for frame, rows in ((publish.read_published(spark, root), 12), (publish.read_published_slugs(spark, root, wanted), 2)):
        plan = plan_of(frame)
        assert "Bucketed: true" in plan and "SortMergeJoin" in plan
        # The scan of the documents comes first in the plan: nothing above it exchanges them.
        above = plan[: next(i for i in range(len(plan)) if plan.startswith("FileScan", i))]
        assert "Exchange" not in above
        assert frame.count() == rows
    found = {r.slug: r.content.split()[-2:] for r in publish.read_published_slugs(spark, root, wanted).collect()}
    assert found == {"page-1": ["new", "1"], "page-7": ["old", "7"]}


def test_one_slug_reads_one_bucket(spark, root):
    one = publish.read_published(spark, root).filter(F.col("slug") == "page-2")
    assert "SelectedBucketsCount: 1 out of 4" in plan_of(one)
    assert [r.batch_id for r in one.collect()] == ["b2"]


def test_each_bucket_is_one_file(spark, root):
    files = [f.name for f in (Path(root) / "articles" / "batch_id=b1").glob("*.parquet")]
    assert len(files) == len({f.split("_")[-1] for f in files}) <= 4


def test_catalog_and_settings_are_left_as_they_were(spark, root):
    key = "spark.sql.hive.manageFilesourcePartitions"
    before = spark.conf.get(key)
    publish.read_published(spark, root).collect()
    assert spark.conf.get(key) == before
    rows = spark.createDataFrame([("a", 1)], "slug string, x int").withColumn("x", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        buckets.write_bucketed(rows, f"{root}/broken", 4)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("folioforge_")]


def test_first_writer_fixes_the_buckets(spark, tmp_path):
    root = str(tmp_path / "corpus")
    assert publish.read_layout(spark, root) is None
    assert publish.make_layout(spark, root, 3) == 3
    assert publish.make_layout(spark, root, 5) == 3
    run(spark, root, "b1", [(1, "One", "x")])
    run(spark, root, "b2", [])
    assert [r.slug for r in publish.read_published(spark, root).collect()] == ["one"]
    assert all(int(f.name.split("_")[-1].split(".")[0]) < 3 for f in Path(root).glob("articles/*/*.parquet"))


def test_a_corpus_without_buckets_goes_on(spark, tmp_path):
    """As published before there were buckets."""
    root = str(tmp_path / "corpus")
    spark.createDataFrame([], publish.DOCUMENT).drop("batch_id").write.parquet(f"{root}/articles/batch_id=b0")
    run(spark, root, "b1", [(1, "One", "x"), (2, "Two", "y")])
    assert publish.read_layout(spark, root) is None
    assert {r.slug for r in publish.read_published(spark, root).collect()} == {"one", "two"}
    assert publish.read_published_slugs(spark, root, spark.createDataFrame([("two",)], "slug string")).count() == 1
