import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from folioforge.session import configure

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)


@pytest.fixture(scope="session")
def apply(spark):
    """Evaluate a one-argument column function on a list of strings."""
    from pyspark.sql import functions as F

    def run(function, values, kind="string"):
        table = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        return [row.r for row in table.select("i", function(F.col("v")).alias("r")).orderBy("i").collect()]

    return run
