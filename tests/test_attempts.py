import pytest
from pyspark.sql import functions as F

from folioforge import Settings
from folioforge.operators import attempts as at
from folioforge.operators import lookup
from folioforge.schemas import IMAGE_ATTEMPT, REDIRECT


def settle(spark, *tries):
    """tries of one image: (attempt, status, error kind)"""
    rows = [(1, "u", n, status, error, "image/png" if status == 200 else None, 9) for n, status, error in tries]
    row = at.resolve_attempts(spark.createDataFrame(rows, IMAGE_ATTEMPT)).first()
    return row and (row.stored_ok, row.attempts, row.failure)


def test_retries(spark):
    limit = "too_many_redirects"
    assert settle(spark, (1, 200, None)) == (True, 1, None)
    assert settle(spark, (3, 200, None), (2, 500, None), (1, None, "timeout")) == (True, 3, None)
    assert settle(spark, *[(n, 404, None) for n in (1, 2, 3, 4)]) == (False, 4, "attempts_failed")
    # A success after the last allowed try does not count.
    assert settle(spark, *[(n, 404, None) for n in (1, 2, 3, 4)], (5, 200, None)) == (False, 4, "attempts_failed")
    # A redirect-limit error ends the tries, a redirect to a private host does not.
    assert settle(spark, (1, None, limit), (2, 200, None)) == (False, 1, limit)
    assert settle(spark, (1, None, "private_target"), (2, 200, None)) == (True, 2, None)
    # An error outranks the status.
    assert settle(spark, (1, 200, "timeout")) == (False, 1, "attempts_failed")


def follow(spark, edges, *starts, settings=Settings()):
    requested = spark.createDataFrame([(s,) for s in starts], "url string")
    rows = at.resolve_redirects(requested, spark.createDataFrame(edges, REDIRECT), settings).collect()
    return {r.url: (r.final_url, r.hops, r.redirect_status) for r in rows}


def chain(name, length):
    return [(f"https://x/{name}{i}", f"https://x/{name}{i + 1}") for i in range(length)]


def test_redirects(spark):
    edges = [
        *chain("five", 5), *chain("six", 6), *chain("nine", 9), ("https://x/loop", "https://x/loop"),
        ("https://x/p", "http://10.0.0.1/"), *chain("late", 5), ("https://x/late5", "http://127.0.0.1/"),
        *chain("later", 6), ("https://x/later6", "http://127.0.0.1/"),
        ("https://x/dir/rel", "../up?q"), ("https://x/empty", ""), ("https://x/none", None),
        ("https://x/to-empty", "https://x/empty"),
    ]
    many = "too_many_redirects"
    assert follow(
        spark, edges, "https://x/five0", "https://x/six0", "https://x/six1", "https://x/nine0", "https://x/loop", "https://x/p",
        "https://x/late0", "https://x/later0", "https://x/dir/rel", "https://x/empty", "https://x/none", "https://x/to-empty",
        "https://x/direct", "https://x/direct",
    ) == {
        "https://x/five0": ("https://x/five5", 5, "ok"),
        "https://x/six0": (None, 6, many),
        "https://x/six1": ("https://x/six6", 5, "ok"),
        "https://x/nine0": (None, 6, many),
        "https://x/loop": (None, 6, many),
        "https://x/p": (None, 1, "private_target"),
        "https://x/late0": (None, 6, "private_target"),
        "https://x/later0": (None, 6, many),
        "https://x/dir/rel": ("https://x/up?q", 1, "ok"),
        "https://x/empty": (None, 1, many),
        "https://x/none": ("https://x/none", 0, "direct"),
        "https://x/to-empty": (None, 2, many),
        "https://x/direct": ("https://x/direct", 0, "direct"),
    }


def test_redirects_into_one_heavy_target(spark, monkeypatch):
    monkeypatch.setattr(at, "heavy_keys", lambda table, key: lookup.heavy_keys(table, key, limit=2, at_least=10))
    edges = [(f"https://x/{i}", "https://x/login") for i in range(50)] + [("https://x/login", "https://x/home")]
    found = follow(spark, edges, *[f"https://x/{i}" for i in range(50)])
    assert set(found.values()) == {("https://x/home", 2, "ok")} and len(found) == 50


def test_failed_redirects_mark_attempts(spark):
    edges = spark.createDataFrame([("https://x/p", "http://10.0.0.1/"), ("https://x/ok", "https://x/y")], REDIRECT)
    tries = [(1, u, 1, 200, None, "image/png", 1) for u in ("https://x/p", "https://x/ok", "https://x/plain")]
    tries.append((2, "https://x/p", 1, None, "timeout", None, None))
    marked = at.apply_redirects(spark.createDataFrame(tries, IMAGE_ATTEMPT), edges).collect()
    assert {(r.article_id, r.url): r.error_kind for r in marked} == {
        (1, "https://x/p"): "private_target", (1, "https://x/ok"): None, (1, "https://x/plain"): None, (2, "https://x/p"): "timeout",
    }
    assert set(marked[0].asDict()) == set(IMAGE_ATTEMPT.names)


@pytest.mark.parametrize("heavy", [[], ["hot"], ["hot", "absent"]])
def test_lookup_gives_the_same_result_whichever_keys_are_heavy(spark, heavy):
    keys = ["hot"] * 300 + ["cold", "other", None, "absent"]
    left = spark.createDataFrame(list(enumerate(keys)), "id int, k string")
    right = spark.createDataFrame([("hot", 1), ("cold", 2), ("unused", 3)], "k string, v int")
    rows = lookup.lookup(left, right, key="k", row_id="id", name="v", heavy=heavy).orderBy("id").collect()
    assert [(r.id, r.k, r.v) for r in rows] == [(i, k, {"hot": 1, "cold": 2}.get(k)) for i, k in enumerate(keys)]


def test_a_heavy_key_is_spread_over_partitions(spark):
    left = spark.range(20_000).select(F.col("id"), F.lit("hot").alias("k"))
    right = spark.createDataFrame([("hot", 1)], "k string, v int")
    assert lookup.heavy_keys(left, "k", at_least=1000) == ["hot"]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lookup.lookup(left, right, key="k", row_id="id", name="v", heavy=["hot"])
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 20_000 and len(sizes) == 4 and max(sizes) < 10_000


def test_several_locations_of_one_url(spark):
    rows = [("https://x/a", "https://x/old", 1), ("https://x/a", "https://x/new", 2), ("https://x/b", "https://x/p", 3), ("https://x/b", "https://x/q", 3), ("https://x/b", "https://x/p", 3), ("https://x/c", "https://x/d", None)]
    edges = spark.createDataFrame(rows, "src string, location string, seen_at int")
    requested = spark.createDataFrame([(f"https://x/{n}",) for n in "abc"], "url string")
    found = {r.url: (r.final_url, r.redirect_status) for r in at.resolve_redirects(requested, edges).collect()}
    assert found == {"https://x/a": ("https://x/new", "ok"), "https://x/b": (None, "ambiguous_redirect"), "https://x/c": ("https://x/d", "ok")}
    found = {r.url: r.redirect_status for r in at.resolve_redirects(requested, edges.drop("seen_at")).collect()}
    assert found == {"https://x/a": "ambiguous_redirect", "https://x/b": "ambiguous_redirect", "https://x/c": "ok"}
