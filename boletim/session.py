"""Session settings the reports are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution does three jobs here: it turns a shuffled join into a
# broadcast join only after it has measured the finished side, it splits skewed
# join partitions, and it merges small shuffle partitions. No report carries a
# broadcast hint, so every broadcast is behind one of these size checks.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot student's partition even where the next step then needs a shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
    # Joins whose shuffled partitions all turn out to be this small skip the sort.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.autoBroadcastJoinThreshold": "32m",
    # A selective filter on a dimension of up to this size also thins the fact
    # scans before their first shuffle.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "64m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings that steer adaptive execution to a running session.

    The session's own broadcast threshold, time zone and shuffle partitions stay.
    """
    for key, value in SETTINGS.items():
        if key.startswith(("spark.sql.adaptive.", "spark.sql.optimizer.")):
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("boletim")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        # Room for the compiled code of all reports, which otherwise evict each other.
        .config("spark.sql.codegen.cache.maxEntries", "2000")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
