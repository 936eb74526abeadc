"""Outcome of image retries, and redirect chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import urls
from folioforge.operators.lookup import heavy_keys, lookup
from folioforge.operators.staging import stage
from folioforge.settings import Settings

REDIRECT_LIMIT = "too_many_redirects"
PRIVATE_TARGET = "private_target"
AMBIGUOUS = "ambiguous_redirect"


def resolve_attempts(attempts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per image of an article: the first attempt that settles it, among those allowed.

    A success settles it, and so does a redirect-limit error; everything else is tried again.
    Columns: article_id, url, stored_ok, attempts, failure, content_type, size_bytes.
    """
    succeeded = F.col("error_kind").isNull() & (F.col("http_status") < 400)
    settled = F.coalesce(succeeded | (F.col("error_kind") == REDIRECT_LIMIT), F.lit(False))
    outcome = F.when(
        settled,
        F.struct("attempt", F.col("error_kind").alias("failure"), "content_type", "size_bytes"),
    )
    return (
        attempts.filter(F.col("attempt").between(1, settings.max_attempts))
        .groupBy("article_id", "url")
        .agg(F.min(outcome).alias("first"), F.max("attempt").alias("last_attempt"))
        .select(
            "article_id",
            "url",
            (F.col("first").isNotNull() & F.col("first.failure").isNull()).alias("stored_ok"),
            F.coalesce("first.attempt", "last_attempt").alias("attempts"),
            F.when(F.col("first").isNull(), "attempts_failed").otherwise(F.col("first.failure")).alias("failure"),
            "first.content_type",
            "first.size_bytes",
        )
    )


def _steps(redirects: DataFrame) -> DataFrame:
    """(node, hops, end, state): one redirect per redirecting url, its target made absolute and judged.

    A url seen with several Locations goes to the one seen last, if there is a column ``seen_at``; without it, or
    where several were seen last, it is ambiguous.
    """
    location = F.col("location")
    target = urls.resolve(F.col("src"), location)
    known = redirects.filter(location.isNotNull())
    if "seen_at" in redirects.columns:
        # A row for each Location, so that a url that is often redirected is reduced before the shuffle.
        seen = known.groupBy("src", "location").agg(F.max("seen_at").alias("seen_at"))
        last = seen.groupBy("src").agg(F.max("seen_at").alias("seen_at"))
        known = seen.join(last, "src").filter(seen["seen_at"].eqNullSafe(last["seen_at"]))
    return (
        known.groupBy("src")
        .agg(F.min("location").alias("location"), F.max("location").alias("other"))
        .select(F.col("src").alias("node"), "location", "other", target.alias("end"))
        .select(
            "node",
            F.lit(1).alias("hops"),
            "end",
            F.when(location != F.col("other"), AMBIGUOUS)
            .when(location == "", REDIRECT_LIMIT)
            .when(urls.is_private_host(F.col("end")), PRIVATE_TARGET)
            .otherwise("open")
            .alias("state"),
        )
    )


def _followed(chains: DataFrame, onward: DataFrame) -> DataFrame:
    """Open chains prolonged by the chains that start at their ends; one that ends where none starts is ``ok``.

    Only open chains are joined. One url (a log-in page, say) may be the end of a large share of them, hence
    ``lookup``.
    """
    is_open = F.col("state") == "open"
    ended = chains.filter(~is_open)
    targets = chains.filter(is_open).withColumn("_target", F.col("end"))
    starts = onward.select(F.col("node").alias("_target"), F.struct("hops", "end", "state").alias("_onward"))
    found = lookup(targets, starts, key="_target", row_id="node", name="_onward", heavy=heavy_keys(targets, "_target"))
    goes_on = F.col("_onward").isNotNull()
    followed = found.select(
        "node",
        F.when(goes_on, F.col("hops") + F.col("_onward.hops")).otherwise(F.col("hops")).alias("hops"),
        F.when(goes_on, F.col("_onward.end")).otherwise(F.col("end")).alias("end"),
        F.when(goes_on, F.col("_onward.state")).otherwise("ok").alias("state"),
    )
    return ended.unionByName(followed)


def _chains(redirects: DataFrame, limit: int) -> DataFrame:
    """(node, hops, end, state): what following up to ``limit`` redirects from each redirecting url leads to.

    ``state`` is ``open`` (limit used up), ``ok`` (``end`` redirects no further) or a failure. Chains double in
    length with each join, so a limit of six takes three.
    """
    power = stage(_steps(redirects), "redirect-steps")
    chains, rest = None, limit
    while rest:
        if rest % 2:
            chains = power if chains is None else _followed(chains, power)
        rest //= 2
        if rest:
            power = stage(_followed(power, power), "redirect-chains")
    return chains


def resolve_redirects(requested: DataFrame, redirects: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Follow the redirects of each distinct url.

    ``requested`` has a column url, ``redirects`` is (src, location). One redirect more than the limit, a
    redirect to a private host, or an empty Location fails. Stages the table of redirects.

    Columns: url, final_url (null on failure), hops, redirect_status (``direct``, ``ok``, ``private_target``,
    ``too_many_redirects``, ``ambiguous_redirect``).
    """
    chains = _chains(redirects, settings.max_redirects + 1)
    state = F.when(F.col("state") == "open", REDIRECT_LIMIT).otherwise(F.col("state"))
    status = F.coalesce(state, F.lit("direct"))
    return (
        requested.select("url")
        .distinct()
        .join(chains.withColumnRenamed("node", "url"), "url", "left")
        .select(
            "url",
            F.when(status == "direct", F.col("url")).when(status == "ok", F.col("end")).alias("final_url"),
            F.coalesce("hops", F.lit(0)).alias("hops"),
            status.alias("redirect_status"),
        )
    )


def apply_redirects(attempts: DataFrame, redirects: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Mark attempts whose url leads nowhere allowed: ``error_kind`` is set where it was null."""
    chains = resolve_redirects(attempts, redirects, settings)
    failed = chains.filter(F.col("final_url").isNull()).select("url", F.col("redirect_status").alias("_failure"))
    heavy = heavy_keys(attempts, "url")
    marked = lookup(attempts, failed, key="url", row_id="article_id", name="_failure", heavy=heavy)
    return marked.withColumn("error_kind", F.coalesce("error_kind", "_failure")).drop("_failure")
