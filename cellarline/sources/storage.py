"""Shared folder, written tables and CSV output."""

from __future__ import annotations

import hashlib
import os
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


# The shared folder by application. ``getCheckpointDir`` names a folder of the session's own below it.
_shared: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str | None:
    """The folder all executors see, from ``spark.checkpoint.dir``; the same at every call of a session.

    Only a one-machine session without the setting gets a folder of its own; on a cluster None is returned.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or _shared.get(context.applicationId) or context.getCheckpointDir()
    if not folder and _is_local(spark):
        folder = tempfile.mkdtemp(prefix="cellarline-")
    if not folder:
        return None
    _shared[context.applicationId] = folder
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/cellarline"


def require_shared_dir(spark: SparkSession) -> str:
    folder = shared_dir(spark)
    if folder is None:
        raise RuntimeError("this operator writes an intermediate table: set spark.checkpoint.dir to a shared folder")
    return folder


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a folder of its own below the shared one, and read again."""
    path = f"{require_shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame) -> DataFrameWriter:
    """A writer of closer packed files, for tables that take more room than the time to write them."""
    return df.write.option("compression", "zstd")


def write_truncate(df: DataFrame, path: str, *, partition_by: tuple[str, ...] = ()) -> None:
    """Replace the table at ``path`` with ``df``; readers of the old rows keep them until the new ones are there.

    The rows go to a folder of their own below ``path``; ``path/current`` then names it. A write that fails
    leaves the pointer, and so the old rows, as they are. Read it with ``read_table``; ``clean_up`` removes old rows.
    """
    spark, rows = df.sparkSession, f"{path}/rows-{uuid.uuid4().hex}"
    packed(df).partitionBy(*partition_by).parquet(rows)
    point_to(spark, path, rows)


def point_to(spark: SparkSession, path: str, rows: str) -> int:
    """Let ``path`` mean the finished table at ``rows``; returns the pointer's number. The last one counts.

    Pointers are small files, numbered and created without overwriting: of writers that start together each gets a
    number of its own, and all finish. The text ends with a line feed, so one that was not finished is told apart.
    """
    begun = _pointers(spark, path)
    number = _number(begun[-1]) + 1 if begun else 1
    while not _created(spark, f"{path}/{_POINTER}{number:09d}", f"{rows}\n"):
        number += 1
    return number


_POINTER = "current-"


def _number(pointer: str) -> int:
    return int(pointer.rpartition("-")[2])


def _created(spark: SparkSession, path: str, text: str) -> bool:
    """Write a new file; False if there is one of that name already."""
    system, target = _hadoop_path(spark, path)
    if system.getUri().getScheme() == "file":
        # Hadoop's local file system looks first and creates then; the operating system does both at once.
        name = target.toUri().getPath()
        os.makedirs(os.path.dirname(name), exist_ok=True)
        try:
            with open(name, "x", encoding="utf-8") as file:
                file.write(text)
        except FileExistsError:
            return False
        return True
    try:
        stream = system.create(target, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName() or system.exists(target):
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def _text_of(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None if it is gone."""
    system, target = _hadoop_path(spark, path)
    try:
        stream = system.open(target)
    except Py4JJavaError as error:
        if "FileNotFound" in error.java_exception.getClass().getName():
            return None
        raise
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _pointers(spark: SparkSession, path: str) -> list[str]:
    """Pointers below ``path``, oldest first, finished or not."""
    system, target = _hadoop_path(spark, path)
    if not system.exists(target):
        return []
    names = [entry.getPath().getName() for entry in system.listStatus(target)]
    return [f"{path}/{name}" for name in sorted(names) if name.startswith(_POINTER)]


def versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, rows) of the finished pointers of the table at ``path``, oldest first."""
    texts = [(_number(pointer), _text_of(spark, pointer)) for pointer in _pointers(spark, path)]
    return [(number, text[:-1]) for number, text in texts if text and text.endswith("\n")]


def current_rows(spark: SparkSession, path: str) -> str | None:
    """The folder with the present rows of the table at ``path``, or None if no write of it was finished."""
    for pointer in reversed(_pointers(spark, path)):
        text = _text_of(spark, pointer)
        if text and text.endswith("\n"):
            return text[:-1]
    return None


def clean_up(spark: SparkSession, path: str, keep: int = 3, older_than: float = 3600.0) -> list[str]:
    """Remove what the last ``keep`` versions of the table at ``path`` do not need, and return the folders removed.

    Pointers go first and rows behind them, so a reader finds no pointer without its rows; one that has begun on a
    kept version keeps it. Rows without a pointer may belong to a write under way: only those go that have not changed
    for ``older_than`` seconds. Rows outside ``path`` (see ``point_to``) are never touched.
    """
    if keep < 1:
        raise ValueError("the present version is always kept")
    system, target = _hadoop_path(spark, path)
    if not system.exists(target):
        return []
    finished = versions(spark, path)
    kept = finished[-keep:]
    for number, _ in finished[:-keep]:
        system.delete(_hadoop_path(spark, f"{path}/{_POINTER}{number:09d}")[1], False)
    wanted = {rows.rstrip("/").rpartition("/")[2] for _, rows in kept}
    limit, removed = time.time() * 1000 - older_than * 1000, []
    for entry in system.listStatus(target):
        name = entry.getPath().getName()
        if name.startswith("rows-") and name not in wanted and entry.getModificationTime() <= limit:
            system.delete(entry.getPath(), True)
            removed.append(f"{path}/{name}")
    return sorted(removed)


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The table at ``path``: what its pointer names, or plain Parquet files."""
    path = current_rows(spark, path) or path
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def _hadoop_path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    system, target = _hadoop_path(spark, path)
    return system.exists(target)


def table_exists(spark: SparkSession, name: str) -> bool:
    """Is there a table or view of this name in the catalog?"""
    return spark.catalog.tableExists(name)


def table_schema(tables: dict[str, DataFrame]) -> DataFrame:
    """Column name and type per table; reads metadata only."""
    rows = [
        (table, position, field.name, field.dataType.simpleString())
        for table, df in sorted(tables.items())
        for position, field in enumerate(df.schema, start=1)
    ]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "tabla string, posicion bigint, columna string, tipo string")


def export_csv(df: DataFrame, path: str) -> None:
    """Write ``df`` as CSV with a header; the parts stay distributed."""
    df.write.mode("overwrite").option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def files_state(spark: SparkSession, paths: list[str]) -> tuple[str, int]:
    """A name for the present content of ``paths``, and its bytes.

    The name comes from the path, length and change time of every file, in folders below too; change times of
    folders, which some stores make up, play no part. A path that is a file costs one call; the files of all
    folders are listed by Spark, and the driver gets three numbers.
    """
    marks, size, folders = [], 0, []
    for path in sorted(paths):
        system, target = _hadoop_path(spark, path)
        status = system.getFileStatus(target)
        if status.isDirectory():
            folders.append(path)
            continue
        size += status.getLen()
        marks.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    if folders:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders)
        mark = F.xxhash64("path", "length", F.col("modificationTime").cast("double")).cast("decimal(38,0)")
        row = files.agg(F.count("*").alias("n"), F.sum("length").alias("size"), F.sum(mark).alias("marks")).first()
        size += row["size"] or 0
        marks.append((folders, row["n"], row["size"], str(row["marks"])))
    return hashlib.sha256(repr(marks).encode()).hexdigest()[:24], size
