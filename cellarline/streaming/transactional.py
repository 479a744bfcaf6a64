"""Transactional append: each batch of a source lands exactly once, wherever a run breaks off.

A sink is a folder of finished batches and a ledger that names them. A batch is written to a folder of its own first;
then the ledger gets a new version with one more entry (batches, folder, first row number, rows). Readers follow the
ledger, so

* a run that dies before the ledger has it leaves a folder that nobody reads, and the batch is written again;
* a run that dies behind the ledger but before the stream's checkpoint gets the batch a second time, finds its number in
  the ledger and does nothing.

Row numbers follow from the entries: a batch's rows are numbered behind those before it. Small batches are compacted:
a run of neighbouring ones becomes one folder of larger files under one entry; the rows and the numbers of the batches
stay. ``clean_up`` removes folders that no kept version of the ledger names.
"""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cellarline.sources.storage import _hadoop_path, path_exists, read_table, versions, write_truncate

log = logging.getLogger(__name__)

LEDGER_SCHEMA = "first_batch bigint, last_batch bigint, rows string, first_row bigint, n bigint, bytes bigint"
#: Files are aimed at this size; folders with less on average are small.
FILE_BYTES = 128 << 20


@dataclass(frozen=True)
class Entry:
    """Batches ``first_batch`` to ``last_batch``: ``n`` rows in the folder ``rows``, the first one numbered ``first_row``."""

    first_batch: int
    last_batch: int
    rows: str
    first_row: int
    n: int
    bytes: int


def ledger(spark: SparkSession, sink: str) -> list[Entry]:
    """The entries of the sink's present ledger, in the order of batches: one per folder, so few after a compaction."""
    if not versions(spark, f"{sink}/ledger"):
        return []
    rows = read_table(spark, f"{sink}/ledger").orderBy("first_batch").collect()
    return [Entry(**row.asDict()) for row in rows]


def _write_ledger(spark: SparkSession, sink: str, entries: list[Entry]) -> None:
    rows = [tuple(vars(entry).values()) for entry in entries]
    write_truncate(spark.createDataFrame(rows, LEDGER_SCHEMA).coalesce(1), f"{sink}/ledger")


def _folder_bytes(spark: SparkSession, path: str) -> int:
    system, target = _hadoop_path(spark, path)
    return system.getContentSummary(target).getLength()


def commit_batch(df: DataFrame, batch: int, sink: str) -> bool:
    """Append ``df`` as batch number ``batch``; False if the ledger has that batch already. One writer per sink."""
    spark = df.sparkSession
    entries = ledger(spark, sink)
    if entries and batch <= entries[-1].last_batch:
        return False
    folder = f"{sink}/rows/batch-{batch}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    count = spark.read.schema(df.schema).parquet(folder).count()
    first = entries[-1].first_row + entries[-1].n if entries else 1
    _write_ledger(spark, sink, [*entries, Entry(batch, batch, folder, first, count, _folder_bytes(spark, folder))])
    return True


def read_committed(spark: SparkSession, sink: str, schema: StructType) -> DataFrame:
    """The rows of all batches in the ledger."""
    folders = [entry.rows for entry in ledger(spark, sink) if entry.n]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def compact(spark: SparkSession, sink: str, schema: StructType, file_bytes: int = FILE_BYTES, least: int = 8) -> int:
    """Join runs of at least ``least`` neighbouring small entries; returns how many entries the ledger has lost.

    Rows are read and written once; until the ledger names the new folder, readers see the old ones.
    """
    entries, out, run = ledger(spark, sink), [], []

    def close() -> None:
        if len(run) < least:
            out.extend(run)
        else:
            folder = f"{sink}/rows/batch-{run[0].first_batch}-{run[-1].last_batch}-{uuid.uuid4().hex}"
            size, full = sum(e.bytes for e in run), [e.rows for e in run if e.n]
            rows = spark.read.schema(schema).parquet(*full) if full else spark.createDataFrame([], schema)
            rows.coalesce(max(1, -(-size // file_bytes))).write.parquet(folder)
            n = sum(e.n for e in run)
            out.append(Entry(run[0].first_batch, run[-1].last_batch, folder, run[0].first_row, n, _folder_bytes(spark, folder)))
        run.clear()

    held = 0
    for entry in entries:
        # A run is closed before it passes the size of one file, so that a compaction is one small write.
        if entry.bytes >= file_bytes or held + entry.bytes > file_bytes:
            close()
            held = 0
        if entry.bytes >= file_bytes:
            out.append(entry)
        else:
            run.append(entry)
            held += entry.bytes
    close()
    if len(out) < len(entries):
        _write_ledger(spark, sink, out)
    return len(entries) - len(out)


def clean_up(spark: SparkSession, sink: str, keep: int = 3, older_than: float = 3600.0) -> list[str]:
    """Remove batch folders that none of the last ``keep`` ledgers names and that are ``older_than`` seconds old."""
    kept = versions(spark, f"{sink}/ledger")[-keep:]
    named = {row["rows"].rpartition("/")[2] for _, rows in kept for row in spark.read.parquet(rows).select("rows").collect()}
    system, target = _hadoop_path(spark, f"{sink}/rows")
    limit, removed = (time.time() - older_than) * 1000, []
    for entry in system.listStatus(target) if system.exists(target) else []:
        name = entry.getPath().getName()
        if name not in named and entry.getModificationTime() <= limit:
            system.delete(entry.getPath(), True)
            removed.append(f"{sink}/rows/{name}")
    return sorted(removed)


def append_source(
    spark: SparkSession,
    source: str,
    schema: StructType,
    sink: str,
    transform: Callable[[DataFrame], DataFrame] = lambda df: df,
    file_format: str = "parquet",
    files_per_batch: int | None = None,
    compact_after: int = 32,
) -> int:
    """Append the files that arrived in ``source`` since the last run to the ``sink``; returns the rows it has then.

    The stream's checkpoint (which files are in which batch) lies beside the ledger. A sink with ``compact_after``
    small batches is compacted at the end.
    """
    reader = spark.readStream.schema(schema).format(file_format)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = transform(reader.load(source))
    stream = rows.writeStream.foreachBatch(lambda df, batch: commit_batch(df, batch, sink) and None)
    query = stream.option("checkpointLocation", f"{sink}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    entries = ledger(spark, sink)
    if len(entries) >= compact_after:
        compact(spark, sink, rows.schema)
        entries = ledger(spark, sink)
    return sum(entry.n for entry in entries)


def sync_report(spark: SparkSession, jobs: Mapping[str, Callable[[], int]]) -> DataFrame:
    """Run one append per source and report ``fuente``, ``estado``, ``filas``, ``mensaje``; one that fails stops no other."""
    report = []
    for name, job in jobs.items():
        try:
            report.append((name, "ok", job(), None))
        except Exception as error:
            log.warning("%s was not appended: %s", name, error)
            report.append((name, "error", None, f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"))
    return spark.createDataFrame(report, "fuente string, estado string, filas bigint, mensaje string")
