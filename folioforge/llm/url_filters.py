"""URL filters: a sort-merge range join of urls against prefix rules.

The key of a host is its labels in reverse order, each followed by a character that sorts before all others of a host.
So the hosts that a rule fits (its own and all subdomains) are one interval of keys, and the intervals of all rules are
nested or disjoint. Hosts and rules are sorted into ranges; a sweep over each range keeps the stack of rules that are
open, one level for each number of labels, and hands the stack at a range's end to the next range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.operators.staging import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR, AFTER_SEPARATOR = "\x01", "\x02"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path: from there up to ``? #`` or
    the end. Both are empty for null and for a url without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    labels = F.reverse(F.split(host, "\\.", -1))
    return F.when(host == "", "").otherwise(F.concat(F.array_join(labels, SEPARATOR), F.lit(SEPARATOR)))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (action, host, path) as a table."""
    return spark.createDataFrame(rules, "action string, host string, path string")


def open_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """For each host the rules whose interval holds its key: (host, open).

    ``hosts``: distinct hosts, so no key is frequent. The rules of one host travel as one array: a rule list is a
    configuration, not data that grows with the urls.
    """
    fixed = rules.select(
        "action",
        F.translate("host", UPPER, LOWER).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
    ).where("action is not null and host is not null and host != ''")
    starts = (
        fixed.groupBy("host")
        .agg(F.collect_set(F.struct("action", "host", "path")).alias("rules"))
        .select(
            host_key(F.col("host")).alias("key"),
            F.size(F.split("host", "\\.", -1)).alias("level"),
            "rules",
            F.lit(None).cast("string").alias("host"),
        )
    )
    levels = sorted(row.level for row in starts.select("level").distinct().collect())
    if not levels:
        return hosts.select("host", F.array().cast(starts.schema["rules"].dataType).alias("open"))
    asked = hosts.select(
        host_key(F.col("host")).alias("key"),
        F.lit(0).alias("level"),
        F.lit(None).cast(starts.schema["rules"].dataType).alias("rules"),
        "host",
    )
    # Written once: a range keeps its number however often the sweep is run again.
    events = stage(
        starts.unionByName(asked).repartitionByRange("key").withColumn("range", F.spark_partition_id()),
        "url-filter-events",
    )

    def opened(level: int) -> Column:
        return F.when(F.col("level") == level, F.struct("key", "rules"))

    # What is open at the end of a range: one row for each range.
    ends = events.where("level > 0").groupBy("range").agg(*[F.max_by(opened(n), F.when(F.col("level") == n, F.col("key"))).alias(f"end{n}") for n in levels])
    ranges = events.select("range").distinct().join(ends, "range", "left")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select("range", *[F.last(f"end{n}", True).over(before).alias(f"end{n}") for n in levels])
    sweep = Window.partitionBy("range").orderBy("key", F.col("level") == 0).rowsBetween(Window.unboundedPreceding, 0)
    swept = events.select("*", *[F.last(opened(n), True).over(sweep).alias(f"open{n}") for n in levels]).where("level = 0")
    stack = F.array(*[F.coalesce(f"open{n}", f"end{n}") for n in levels])
    # An interval ends where its last separator would be followed by something greater: there the level is closed.
    still = F.filter(stack, lambda x: F.col("key") < F.concat(F.substring(x["key"], F.lit(1), F.char_length(x["key"]) - 1), F.lit(AFTER_SEPARATOR)))
    return swept.join(carried, "range", "left").select("host", F.flatten(F.transform(still, lambda x: x["rules"])).alias("open"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_column: str = "page_id") -> DataFrame:
    """Judge each url: (id, host, path, rule, verdict).

    The longest of the rules that fit wins; of equally long ones that with the longer host, then ``block``. A url that
    no rule fits gets ``default``. Null, empty and malformed urls have an empty host and path, which no rule fits.
    Every row of ``pages`` gives one row, repeated ones too; a null id stays null. Rules without action or host fit
    nothing; a rule without path fits every path.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    urls = pages.select(F.col(id_column), host.alias("host"), path.alias("path"))
    # A host may hold a third of all urls: the sweep sees it once, and the join back has one row for each host, so
    # that adaptive execution can split the side of the urls.
    found = open_rules(urls.select("host").where("host != ''").distinct(), rules)
    judged = urls.join(found, "host", "left")
    fits = F.filter(
        "open",
        lambda r: F.col("path").startswith(r["path"]) & ((F.col("host") == r["host"]) | F.col("host").endswith(F.concat(F.lit("."), r["host"]))),
    )
    ranked = F.transform(fits, lambda r: F.struct(F.char_length(F.concat(r["host"], r["path"])).alias("size"), F.char_length(r["host"]).alias("host_size"), r["action"].alias("action"), F.concat(r["host"], r["path"]).alias("rule")))
    best = F.array_max(ranked)
    return judged.select(id_column, "host", "path", best.alias("best")).select(
        id_column, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")
    )
