"""Look up a value by key when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# At most this many keys count as heavy; any other key holds less than 1/HEAVY_KEYS of the rows.
HEAVY_KEYS = 1000
# A key with fewer rows than this is never heavy.
HEAVY_KEY_ROWS = 100_000
# A heavy key is spread over this many shuffle keys, so the copies on the other side are bounded too.
SALTS = 256


def heavy_keys(
    table: DataFrame, key: str, *, limit: int = HEAVY_KEYS, at_least: int = HEAVY_KEY_ROWS
) -> list[str]:
    """The keys with the most rows. Runs a job that reads the key column; the list has a fixed upper bound."""
    counts = table.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    heaviest = counts.filter(F.col("rows") >= at_least).orderBy(F.desc("rows"), key).limit(limit)
    return [row[key] for row in heaviest.collect()]


def lookup(
    left: DataFrame,
    right: DataFrame,
    *,
    key: str,
    row_id: str | Column,
    name: str,
    heavy: Sequence[str],
) -> DataFrame:
    """Left join that adds ``name``, the value ``right`` holds for ``left[key]``, or null.

    ``right`` has the columns (key, name), one row per key. The rows of a heavy key are spread by a hash of
    ``row_id`` over ``SALTS`` shuffle keys, each of which gets a copy of the key's row of ``right``. Rows with
    a null key, which match nothing, are spread the same way. All other keys are joined as they are.
    """
    zero = F.lit(0).cast("bigint")
    hot = F.col(key).isin(list(heavy)) if heavy else F.lit(False)
    salt = F.pmod(F.xxhash64(row_id), F.lit(SALTS))
    salted = left.withColumn("_salt", F.when(hot | F.col(key).isNull(), salt).otherwise(zero))
    last_copy = F.when(hot, F.lit(SALTS - 1).cast("bigint")).otherwise(zero)
    copies = right.withColumn("_salt", F.explode(F.sequence(zero, last_copy)) if heavy else zero)
    return salted.join(copies, [key, "_salt"], "left").drop("_salt")
