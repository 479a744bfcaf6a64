"""Tables derived from the star, written once per state of its files and shared by all queries."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from cellarline.session import bound_tasks, size_shuffles
from cellarline.sources.fact import SALES_SCHEMA, STAR_TABLES, ledger, read_star, sales_fact
from cellarline.sources.storage import current_rows, files_state, path_exists, read_table, shared_dir, write_truncate

# Raise it with every change of what a derived table holds, so that older copies are not taken.
VERSION = 3

# The star's files hold packed keys and numbers; their joined lines take many times the bytes, so their shuffles are sized
# for as many times the input.
WIDENING = 32


# Finished copies by their home folder; a home names one state of the input, so an entry never grows old.
_copies: dict[str, str] = {}


def star_state(spark: SparkSession, folder: str) -> tuple[str, int]:
    """The state of the star's files in ``folder`` and their bytes."""
    return files_state(spark, [f"{folder}/{table}.parquet" for table in STAR_TABLES])


def size_star(spark: SparkSession, folder: str) -> None:
    """Size shuffles for the star in ``folder``."""
    _size_for(spark, star_state(spark, folder)[1])


def _size_for(spark: SparkSession, star_bytes: int) -> None:
    size_shuffles(spark, star_bytes * WIDENING)
    bound_tasks(spark)


def derived_path(
    spark: SparkSession,
    folder: str,
    name: str,
    build: Callable[[], DataFrame],
    partition_by: tuple[str, ...] = (),
    parameters: object = None,
) -> str | None:
    """The path of ``build()`` as a written table under the folder that ``spark.checkpoint.dir`` names.

    The copy is named after the state of the star's files and the ``parameters`` of ``build``, so changed input
    or another parameter gets a new one. A pointer is written only behind a
    finished copy: a half-written one is never read, and of two sessions that build at once either copy may be
    used. On a cluster without the setting there is none.
    """
    root = shared_dir(spark)
    if root is None:
        return None
    state, size = star_state(spark, folder)
    _size_for(spark, size)
    chosen = hashlib.sha256(repr(parameters).encode()).hexdigest()[:12]
    home = f"{root}/{name}/v{VERSION}-{state}-{chosen}"
    path = _copies.get(home)
    if path is None or not path_exists(spark, path):
        path = current_rows(spark, home)
    if path is None or not path_exists(spark, path):
        write_truncate(build(), home, partition_by=partition_by)
        path = current_rows(spark, home)
    _copies[home] = path
    return path


def derived_table(
    spark: SparkSession, folder: str, name: str, schema: StructType, build: Callable[[], DataFrame], parameters: object = None
) -> DataFrame:
    """``build()`` read from its written copy, or as it is where nothing can be written."""
    path = derived_path(spark, folder, name, build, parameters=parameters)
    return build() if path is None else read_table(spark, path, schema)


def sales_path(spark: SparkSession, folder: str) -> str | None:
    return derived_path(spark, folder, "sales", lambda: sales_fact(read_star(spark, folder)), partition_by=("anno",))


def sales_table(spark: SparkSession, folder: str) -> DataFrame:
    """The fact over the star in ``folder``, joined once and then read by every query.

    The joins are the most expensive part of any report, and every report needs them. Partitioned by year,
    the written rows give readers column pruning, row-group skipping and year pruning, and an executor that
    is lost later costs no join.
    """
    path = sales_path(spark, folder)
    return sales_fact(read_star(spark, folder)) if path is None else read_table(spark, path, SALES_SCHEMA)


def ledger_table(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger of the written fact. Its entries are four to seven times the lines, with three texts of their own each, so
    they are made from the years and columns that a statement reads and not written."""
    return ledger(sales_table(spark, folder))
