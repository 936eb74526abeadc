"""Session settings that suit these jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Shuffle partitions aimed at when the size of the input is given. Text rows are large, and the number of shuffle
# blocks grows with the product of map and reduce tasks: at 20 TB, 80,000 scan tasks and 40,000 partitions.
SHUFFLE_PARTITION_BYTES = 512 * 1024 * 1024

# Runtime settings that do not depend on the input.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Where AQE sees that each partition of the small side is below this, it hashes that side instead of
    # sorting both: the side with the document text is then not sorted.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # Groups here are the images of one article: small, and many more than the 128 after which Spark would
    # go over to sorting them.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "10000",
    # Rows are parsed one at a time, so a split costs no memory of its size.
    "spark.sql.files.maxPartitionBytes": "256MB",
}


def configure(spark: SparkSession, input_bytes: int | None = None) -> SparkSession:
    """Apply the settings. With ``input_bytes``, the uncompressed size of the text that a run shuffles, the
    number of shuffle partitions is raised to fit it; adaptive execution merges those that stay small."""
    for name, value in RECOMMENDED.items():
        spark.conf.set(name, value)
    if input_bytes is not None:
        wanted = -(-input_bytes // SHUFFLE_PARTITION_BYTES)
        current = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set("spark.sql.shuffle.partitions", str(max(current, wanted)))
    return spark
