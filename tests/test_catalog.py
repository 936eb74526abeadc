"""The registered queries against their SQL. ``check.py`` compares all of them; here a selection."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
import check
from catalog.oracles import ORACLES
from catalog.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SELECTION = ["read_html_pages", "read_reader_responses", "resolve_title_slug", "resolve_redirects", "run_status", "build_corpus", "build_corpus_redirects"]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")


def test_every_query_has_its_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SELECTION)
def test_results_agree(spark, name):
    assert check.differences(spark, check.connect(FOLDER), FOLDER, name) == []


def test_flagship_gives_one_document_per_page(spark):
    built = entry.entry(spark)
    rows = built.select("article_id", "slug").collect()
    assert len(rows) == len({r.article_id for r in rows}) == len({r.slug for r in rows}) == 50


def test_images_and_slugs_are_joined_without_the_text(spark, tmp_path):
    """The text takes part in one exchange, and the branches of decisions and images read no text column."""
    from catalog.queries import attempts, prepared
    from folioforge.plans import corpus

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        built = corpus.build_corpus(prepared(spark, FOLDER), attempts(spark, FOLDER), policy="suffix")
        plan = built._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scans = [line for line in plan.splitlines() if "FileScan" in line and "markdown#" in line]
    assert len(scans) == 1
    assert plan.count("Exchange hashpartitioning(article_id") == 9
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "ArrowEvalPython" not in plan


def test_shuffle_partitions_grow_with_the_input(spark):
    from folioforge.session import configure

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        configure(spark, input_bytes=10 * 1024**4)
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(10 * 1024**4 // (512 * 1024**2))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
