"""Session settings this library is tuned for; none is required for right results."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split a hot join key even if the split costs one more exchange behind the join.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "true",
}


def local_session(
    app: str = "cellarline", cores: int | str | None = None, memory: str = "12g", settings: dict[str, str] | None = None
) -> SparkSession:
    """A session for one machine (tests, bench), with further ``settings``. A cluster brings its own session."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in (SQL_SETTINGS | (settings or {})).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Input file bytes per shuffle partition.
BYTES_PER_PARTITION = 256 << 20
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
# Upper limit on what ``size_shuffles`` asks for; unset means none.
MOST_PARTITIONS = "cellarline.mostShufflePartitions"

# The value this library has set itself, by application: anything else in the setting is the user's.
_own: dict[str, str] = {}


def size_shuffles(spark: SparkSession, input_bytes: int) -> None:
    """Start shuffles of large input with enough partitions to fit in memory.

    AQE joins partitions that turn out small but never splits a plain aggregation's, so the first number
    must suit the largest shuffle. It is only raised, by a later larger input too, and not touched where
    the user has set it.
    """
    app, now = spark.sparkContext.applicationId, spark.conf.get(INITIAL_PARTITIONS, None)
    if now is not None and now != _own.get(app):
        return
    wanted, most = input_bytes // BYTES_PER_PARTITION, spark.conf.get(MOST_PARTITIONS, None)
    if most is not None:
        wanted = min(wanted, int(most))
    if wanted > int(now or spark.conf.get("spark.sql.shuffle.partitions")):
        _own[app] = str(wanted)
        spark.conf.set(INITIAL_PARTITIONS, str(wanted))


ADVISED_SIZE = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
MOST_SHUFFLED = 16 << 20


def bound_tasks(spark: SparkSession) -> None:
    """Let AQE join partitions up to 16 MB of shuffled rows instead of 64 MB, unless the session has its own size.

    Packed rows of the star grow about thirtyfold when a task sorts them for a join and again for a write by year.
    """
    if spark.conf.get(ADVISED_SIZE, None) is None:
        spark.conf.set(ADVISED_SIZE, str(MOST_SHUFFLED))
