"""Slug conflicts inside a batch and with what is already published."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators.lookup import heavy_keys, lookup
from folioforge.settings import Settings

POLICIES = ("fail", "overwrite", "suffix")


def publish_conflicts(articles: DataFrame, published: DataFrame, force: bool = False) -> DataFrame:
    """Articles (article_id, slug, ...) whose slug is published already; none when ``force`` is set.

    Very frequent slugs (say, of untitled pages) do not pile up in one task, see ``lookup``; finding them
    reads the slugs once, so pass a staged table.
    """
    if force:
        return articles.limit(0)
    taken = published.select("slug").distinct().withColumn("_taken", F.lit(True))
    heavy = heavy_keys(articles, "slug")
    found = lookup(articles, taken, key="slug", row_id="article_id", name="_taken", heavy=heavy)
    return found.filter("_taken").drop("_taken")


def slug_conflict_policy(
    articles: DataFrame,
    policy: str = "fail",
    published: DataFrame | None = None,
    settings: Settings = Settings(),
    arrival: str | None = None,
    batch_id: str | None = None,
) -> DataFrame:
    """Decide for each article (article_id, slug) under which slug it is published.

    ``fail``: the first article of a slug wins; the others, and all whose slug is published, are refused.
    ``overwrite``: the last article wins and replaces what is published.
    ``suffix``: the first keeps a free slug; the others get ``slug-<run stamp>--<article id>``, and with a
    ``batch_id``, which no other batch has, ``-in-<batch id>`` after it. A slug never holds two hyphens in a row,
    so such a name meets no slug of this batch; an article whose name is published already is refused.

    Columns: article_id, slug, final_slug (null when refused), slug_status (``new``, ``replaces``,
    ``renamed``, ``superseded``, ``conflict``). First and last are by (``arrival``, article_id). The winner of
    a slug is an aggregate that comes back on article_id, so a slug shared by many articles never gathers in
    one task.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}, not {policy!r}")
    choose = F.max if policy == "overwrite" else F.min
    order = F.struct(arrival, "article_id") if arrival else F.col("article_id")
    winners = articles.groupBy("slug").agg(choose(order).alias("_winner"))
    winners = winners.withColumn("article_id", F.col("_winner.article_id") if arrival else F.col("_winner"))
    if published is None:
        winners = winners.withColumn("_published", F.lit(False))
    else:
        taken = published.select("slug").distinct().withColumn("_known", F.lit(True))
        winners = winners.join(taken, "slug", "left").withColumn("_published", F.col("_known").isNotNull())
    decided = articles.join(winners.select("article_id", "_published"), "article_id", "left")

    wins = F.col("_published").isNotNull()
    free = wins & ~F.col("_published")
    ending = F.lit(f"-in-{batch_id}" if batch_id else "")
    renamed = F.concat(F.col("slug"), F.lit(f"-{settings.run_stamp}--"), F.col("article_id").cast("string"), ending)
    if policy == "fail":
        final = F.when(free, F.col("slug"))
        status = F.when(free, "new").otherwise("conflict")
    elif policy == "overwrite":
        final = F.when(wins, F.col("slug"))
        status = F.when(free, "new").when(wins, "replaces").otherwise("superseded")
    else:
        final = F.when(free, F.col("slug")).otherwise(renamed)
        status = F.when(free, "new").otherwise("renamed")
        if published is not None:
            # Names are unique, so this join has no frequent key.
            known = published.select(F.col("slug").alias("_name")).distinct().withColumn("_met", F.lit(True))
            decided = decided.withColumn("_name", F.when(~free | free.isNull(), renamed)).join(known, "_name", "left")
            met = F.col("_met").isNotNull()
            final, status = F.when(~met, final), F.when(met, "conflict").otherwise(status)
    return decided.select("article_id", "slug", final.alias("final_slug"), status.alias("slug_status"))
