"""DataFrame helpers: totals without a second scan, distributed ranking, paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarline.sources.storage import require_shared_dir


def totals(df: DataFrame, **aggregates: Column) -> Column:
    """One row of totals over ``df`` as a struct-valued scalar subquery; read with ``[name]``.

    A global window would move every row to one task, and a plain total would scan the input again with
    fewer columns. The hash over all columns keeps the subquery's aggregate equal to the caller's, so
    Spark reuses the caller's shuffle (``ReusedExchange``) and the total costs one more pass over the
    already aggregated rows.
    """
    fields = [expr.alias(name) for name, expr in aggregates.items()]
    keep_columns = F.max(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])).alias("_columns")
    return df.agg(F.struct(*fields, keep_columns).alias("_totals")).scalar()


def first_rows(df: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows of a sorted frame; None (and 0) means all of them."""
    return df.limit(limit) if limit else df


def rank_rows(df: DataFrame, order: Sequence[Column], name: str = "ranking", limit: int | None = None) -> DataFrame:
    """Number the rows of ``df`` 1..n in ``order`` (which must end in a unique key), sorted.

    With ``limit`` only the top rows are wanted: a top-k, then a window over at most ``limit`` rows.
    Without it the numbering is distributed: range sort, position inside each sorted partition, and the
    partition's offset. Range bounds are sampled, so the sorted rows are checkpointed before they are
    counted; the offsets are one row per sort partition, whatever the data size.
    """
    if limit is not None:
        top = df.orderBy(*order).limit(limit)
        return top.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))

    require_shared_dir(df.sparkSession)
    ident = "_row_id"
    placed = df.orderBy(*order).withColumn(ident, F.monotonically_increasing_id()).checkpoint()
    # monotonically_increasing_id is (partition << 33) + position in the partition.
    part = F.shiftright(F.col(ident), 33)
    position = F.col(ident).bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumn("_part", part).withColumn("_position", position)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    # At most one offset row per sort partition (spark.sql.shuffle.partitions), so the broadcast is bounded.
    numbered = placed.join(F.broadcast(offsets), "_part")
    rank = (F.col("_offset") + F.col("_position") + 1).cast("bigint")
    return numbered.withColumn(name, rank).drop("_part", "_position", "_offset", ident)


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 50) -> DataFrame:
    """Page ``number`` (from 1) of ``df`` in ``order``; Spark plans it as a top-k with an offset."""
    if number < 1 or size < 1:
        raise ValueError("page number and size start at 1")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
