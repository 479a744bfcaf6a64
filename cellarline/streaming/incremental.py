"""Incremental append: only rows the sink has not seen are written.

The batch form compares row numbers with the sink's row count. The stream form reads file drops with a
checkpoint, which also makes the append exactly-once. Neither rewrites rows that were edited at the source.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cellarline.sources.sheets import normalize_cells
from cellarline.sources.storage import path_exists


def new_rows(source: DataFrame, loaded: int, row_no: str = "row_no") -> DataFrame:
    """The rows behind the first ``loaded`` ones; row numbers start at 1."""
    return source.filter(F.col(row_no) > loaded)


def append_new(source: DataFrame, sink: str, row_no: str = "row_no") -> int:
    """Append to the table at ``sink`` what it lacks, and return the number of rows it had before.

    The count comes from the Parquet footers. A source with no more rows than the sink appends nothing.
    """
    spark = source.sparkSession
    loaded = spark.read.parquet(sink).count() if path_exists(spark, sink) else 0
    fresh = new_rows(source, loaded, row_no)
    if loaded == 0 or not fresh.isEmpty():
        fresh.write.mode("append").parquet(sink)
    return loaded


def append_stream(
    spark: SparkSession,
    source: str,
    schema: StructType,
    sink: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] = normalize_cells,
    file_format: str = "parquet",
    interval: str | None = None,
    files_per_batch: int | None = None,
):
    """Append the files that arrived in ``source`` since the last run to the Parquet table ``sink``.

    Without ``interval`` the query takes what is there and ends (run it again for later drops); with it
    (for example "3 seconds") the running query is returned.
    """
    reader = spark.readStream.schema(schema).format(file_format)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    writer = (
        transform(reader.load(source))
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", sink)
    )
    if interval is not None:
        return writer.trigger(processingTime=interval).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def sync_sources(jobs: Mapping[str, Callable[[], object]]) -> dict[str, str]:
    """Run one append per source; a source that fails is reported and the others still run."""
    states = {}
    for name, job in jobs.items():
        try:
            job()
            states[name] = "ok"
        except Exception as error:
            states[name] = f"error: {type(error).__name__}"
    return states
