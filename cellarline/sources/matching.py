"""Rows of two tables matched by the n-th occurrence of a repeated key.

Sales lines and stock movements carry the same text key, and a key repeats. Joining on the key alone multiplies rows;
here the first occurrence on one side meets the first on the other, the second the second, and so on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarline.sources.storage import require_shared_dir

MATCHED, NO_RIGHT, NO_LEFT = "emparejado", "sin movimiento", "sin venta"


def number_occurrences(df: DataFrame, key: str, order: Sequence[str], name: str = "n") -> DataFrame:
    """Number the rows of each ``key`` 1, 2, ... in ``order``; rows that are equal in it are numbered in any order.

    A window over the key would bring all rows of a hot key to one task. The rows are range-sorted by key and order
    instead, which cuts a hot key over as many tasks as it fills; a row's number is its place in the key's run inside
    its task and the rows that the key has in the tasks before. What is summed up is one row for each key and task.
    """
    require_shared_dir(df.sparkSession)
    ident, part, first, before = (f"_{x}_of_{name}" for x in ("id", "part", "first", "before"))
    placed = df.orderBy(key, *order).withColumn(ident, F.monotonically_increasing_id()).checkpoint()
    # monotonically_increasing_id is (partition << 33) + position in the partition.
    placed = placed.withColumn(part, F.shiftright(F.col(ident), 33))
    runs = placed.groupBy(F.col(key).alias("_key"), F.col(part).alias("_part")).agg(F.min(ident).alias(first), F.count("*").alias("_rows"))
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn(before, F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    joined = placed.join(runs, (F.col(key) == F.col("_key")) & (F.col(part) == F.col("_part")))
    number = (F.col(ident) - F.col(first) + F.col(before) + 1).cast("bigint")
    return joined.withColumn(name, number).drop(ident, part, first, before, "_key", "_part")


def _keyed(column: str) -> Column:
    return F.col(column).isNotNull() & (F.col(column) != "")


def match_occurrences(
    sales: DataFrame,
    movements: DataFrame,
    key: str,
    sales_order: Sequence[str],
    movements_order: Sequence[str],
    sales_columns: Sequence[str],
    movements_columns: Sequence[str],
) -> DataFrame:
    """``key``, ``n``, the chosen columns of both sides and ``estado``: every row of either side exactly once.

    The join is on (key, n), which is unique on both sides, so no row is multiplied and a hot key spreads over its
    numbers. Rows without a partner are reported with nulls on the other side; blank keys have no number and no partner.
    """
    left = number_occurrences(sales.where(_keyed(key)), key, sales_order).select(key, "n", *sales_columns)
    right = number_occurrences(movements.where(_keyed(key)), key, movements_order).select(key, "n", *movements_columns)
    left, right = left.withColumn("_left", F.lit(True)), right.withColumn("_right", F.lit(True))
    state = F.when(F.col("_right").isNull(), NO_RIGHT).when(F.col("_left").isNull(), NO_LEFT).otherwise(MATCHED)
    columns = [key, "n", *sales_columns, *movements_columns]
    both = left.join(right, [key, "n"], "full").select(*columns, state.alias("estado"))
    nothing = F.lit(None)
    for df, own, text in ((sales, sales_columns, NO_RIGHT), (movements, movements_columns, NO_LEFT)):
        blank = df.where(~F.coalesce(_keyed(key), F.lit(False)))
        kinds = {f.name: f.dataType for f in both.schema}
        filled = [F.col(c) if c == key or c in own else nothing.cast(kinds[c]).alias(c) for c in columns]
        both = both.unionByName(blank.select(*filled, F.lit(text).alias("estado")))
    return both
