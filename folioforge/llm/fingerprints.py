"""Document fingerprints from closed syncmers.

The letters are the words of a text. A run of K words is chosen when the smallest of its inner runs (single words, by
hash) is its first or its last. The choice depends on the K words alone, so a passage is anchored alike in whatever
document it stands, and anchors that two texts share can be matched by position. The fingerprint is the set of the
SIZE smallest anchor hashes, a sample whose overlap estimates the likeness of the whole sets of anchors.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import identified
from folioforge.llm.licenses import let

K = 3
SIZE = 64
SPACE = r"[\x20\x09-\x0D]+"


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text; none for null."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def anchors(text: Column) -> Column:
    """Closed syncmers of a text: (position, hash), positions in words. A text of fewer than K words, but at least one,
    has one anchor, its whole sequence; of equally small inner runs any may decide."""

    def chosen(h: Column) -> Column:
        first, middle, last = (lambda i: F.get(h, i)), (lambda i: F.get(h, i + 1)), (lambda i: F.get(h, i + 2))
        starts = F.filter(F.sequence(F.lit(0), F.size(h) - K), lambda i: F.least(first(i), last(i)) <= middle(i))
        return F.transform(starts, lambda i: F.struct(i.alias("position"), F.xxhash64(first(i), middle(i), last(i)).alias("hash")))

    def all_of(h: Column) -> Column:
        whole = F.array(F.struct(F.lit(0).alias("position"), F.xxhash64(F.lit("short"), h).alias("hash")))
        return F.when(F.size(h) >= K, chosen(h)).when(F.size(h) > 0, whole).otherwise(F.array().cast("array<struct<position:int,hash:bigint>>"))

    return let(word_hashes(text), all_of)


def sketch(found: Column) -> Column:
    """The SIZE smallest of 32-bit forms of the anchor hashes, in order."""
    return F.slice(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["hash"].bitwiseAND(0xFFFFFFFF)))), 1, SIZE)


def fingerprint_text(sketched: Column) -> Column:
    return F.array_join(F.transform(sketched, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(left: Column, right: Column) -> Column:
    """Estimated share of anchors in common: of the SIZE smallest of both together, those that both have. 1 where
    neither text has an anchor."""

    def shared(pair: Column) -> Column:
        union = F.slice(F.array_sort(F.array_union(pair["a"], pair["b"])), 1, SIZE)
        return let(union, lambda u: F.size(F.array_intersect(u, F.array_intersect(pair["a"], pair["b"]))) / F.size(u))

    return F.when((F.size(left) == 0) & (F.size(right) == 0), 1.0).otherwise(let(F.struct(left.alias("a"), right.alias("b")), shared))


def matched_anchors(left: Column, right: Column) -> Column:
    """Anchors that two texts share, with their positions in either, for aligning them."""
    return F.flatten(
        F.transform(left, lambda a: F.transform(F.filter(right, lambda b: b["hash"] == a["hash"]), lambda b: F.struct(a["position"].alias("left"), b["position"].alias("right"))))
    )


def fingerprint(docs: DataFrame) -> DataFrame:
    """Anchors and fingerprint of each text: (doc_id, anchors, fingerprint). One row for each row; null and empty texts
    have neither anchors nor digits; equal texts have equal fingerprints."""
    found = identified(docs).select("doc_id", anchors(F.col("text")).alias("anchors"))
    return found.select("doc_id", "anchors", fingerprint_text(sketch(F.col("anchors"))).alias("fingerprint"))


def below(bounds: list[int], value: Column) -> Column:
    """How many of the sorted bounds are at most ``value``: a search in two steps of about the root of their number."""
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]

    def count(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b <= value))

    def literal(values: list[int]) -> Column:
        return F.array(*[F.lit(v).cast("long") for v in values])

    group = count(literal([g[0] for g in groups]))
    rest = F.get(F.array(*[literal(g) for g in groups]), group - 1)
    return F.when(group == 0, 0).otherwise((group - 1) * step + count(rest))


def with_next(texts: DataFrame, carried: list[str]) -> DataFrame:
    """Each row with ``carried`` of the next one by descending doc_id (the last: of the first), as ``next_<name>``.

    Ids are cut into ranges at quantiles; each range is sorted on its own and gets, as its last row, a copy of the row
    that the next range begins with. Rows of equal doc_id are ordered by text; a null doc_id comes last.
    """
    parts = 4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = texts.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or []
    bounds = sorted(set(cuts))
    ranged = texts.withColumn("part", F.when(F.col("doc_id").isNull(), -1).otherwise(below(bounds, F.col("doc_id")) if bounds else F.lit(0)).cast("int"))
    ranged = ranged.withColumn("borrowed", F.lit(False))
    # At most one row for each range; ids alone.
    tops = sorted(ranged.groupBy("part").agg(F.max("doc_id").alias("top")).collect(), key=lambda r: -r.part)
    if not tops:
        return ranged.select(*texts.columns, *[F.col(c).alias(f"next_{c}") for c in carried])
    pairs = [(after.top, before.part) for before, after in pairwise([*tops, tops[0]])]
    wanted = texts.sparkSession.createDataFrame(pairs, "top bigint, to_part int")
    # One pair of numbers for each range: broadcast, so the texts are not dealt out to find these few rows.
    heads = texts.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("top")))
    first = Window.partitionBy("to_part").orderBy("text")
    heads = heads.withColumn("rank", F.row_number().over(first)).where("rank = 1")
    heads = heads.select(*texts.columns, F.col("to_part").alias("part"), F.lit(True).alias("borrowed"))
    order = Window.partitionBy("part").orderBy("borrowed", F.col("doc_id").desc_nulls_last(), "text")
    led = ranged.unionByName(heads).select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried])
    return led.where("not borrowed").drop("part", "borrowed")


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint each text and its edited form, in which the last third is replaced by as many code points from the
    start of the next text (or all it has), and estimate the likeness of text and edit and of text and next text.

    One row for each row of ``docs``; null texts count as empty, whose likeness to an empty text is 1.
    """
    texts = identified(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sketched = texts.select("doc_id", "text", sketch(anchors(F.col("text"))).alias("sketch"))
    pairs = with_next(sketched, ["text", "sketch"])
    n = F.char_length("text")
    taken = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - taken), F.substring("next_text", F.lit(1), taken))
    pairs = pairs.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    both = pairs.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "sketch", "next_sketch", sketch(anchors(F.col("edited"))).alias("edited_sketch"))
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint_text(F.col("sketch")).alias("fingerprint"),
        fingerprint_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
