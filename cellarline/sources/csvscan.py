"""Records of CSV files, cut right and numbered without gaps while the files are read in many splits.

A record may hold line breaks inside quotes, and a split may begin inside a record. Whether it does depends on all the
quotes before it, so the scan runs in two steps, as a parallel prefix sum does:

1. Each task goes over its lines once, in order, and writes them with what it can know alone: the line's place in its
   split, whether the quotes before it in the split are balanced, and how many records begin up to it under either
   state of the split's beginning.
2. From one row per split (quotes odd or even, records under either state) the state at each split's beginning and the
   number of records before it follow. Joined to the lines, they give every line the number of its record.

Lines that are a record by themselves are done; only records of several lines are dealt by their number and put together.
A quote inside a quoted cell is doubled, which leaves the balance as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellarline.sources.storage import scratch_table

_LINES = "file string, split bigint, place bigint, value string, quotes bigint, open boolean, begun_closed bigint, begun_open bigint"


def _own_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with what their split tells; a task's lines come in order, split after split."""
    now, place, odd, closed, opened = None, 0, 0, 0, 0
    for batch in batches:
        files, splits = batch.column("file").to_pylist(), batch.column("split").to_numpy()
        names = np.array([now[0] if now else None, *files], object)
        starts = np.array([now[1] if now else -1, *splits])
        cuts = np.flatnonzero((names[1:] != names[:-1]) | (starts[1:] != starts[:-1])).tolist()
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if a == b:
                continue
            if now != (files[a], splits[a]):
                now, place, odd, closed, opened = (files[a], splits[a]), 0, 0, 0, 0
            lines = batch.slice(a, b - a)
            quotes = pc.count_substring(lines.column("value"), '"').to_numpy().astype(np.int64)
            balance = odd + np.cumsum(quotes)
            inside = (balance - quotes) % 2 == 1
            begun_closed, begun_open = closed + np.cumsum(~inside), opened + np.cumsum(inside)
            columns = [
                lines.column("file"),
                lines.column("split"),
                pa.array(place + np.arange(b - a)),
                lines.column("value"),
                pa.array(quotes),
                pa.array(inside),
                pa.array(begun_closed),
                pa.array(begun_open),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["file", "split", "place", "value", "quotes", "open", "begun_closed", "begun_open"])
            place, odd = place + b - a, int(balance[-1]) % 2
            closed, opened = int(begun_closed[-1]), int(begun_open[-1])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``row_no`` (1..n without gaps) and ``record`` of all records in the files at ``path``, in the order of file names.

    Empty lines are records too. Lines end at a line feed; a carriage return before it is not part of the record, one
    inside quotes is. The lines are written once to the shared folder, so that both steps see the same splits. The
    table of splits has one row for each (a million for 128 TB at 128 MB), which one task puts in order. Quotes that a
    file does not close are an error, as all records behind them would be one.
    """
    text = spark.read.text(path, lineSep="\n")
    named = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    lines = scratch_table(named.mapInArrow(_own_lines, _LINES), "csv-lines")

    last = F.max_by(F.struct("begun_closed", "begun_open"), "place")
    splits = lines.groupBy("file", "split").agg(F.sum("quotes").alias("quotes"), last.alias("begun"))
    in_file = Window.partitionBy("file").orderBy("split")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    odd = (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside")
    splits = splits.select("file", "split", "quotes", "begun", odd)
    unclosed = splits.groupBy("file").agg(F.sum("quotes").alias("quotes")).where("quotes % 2 = 1").first()
    if unclosed:
        raise ValueError(f"{unclosed['file']} ends inside quotes")
    begun = F.when(F.col("inside"), F.col("begun.begun_open")).otherwise(F.col("begun.begun_closed"))
    whole = Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(begun).over(whole), F.lit(0)).alias("offset")
    splits = scratch_table(splits.select(F.col("file").alias("of_file"), F.col("split").alias("of_split"), "inside", offset), "csv-splits")

    both = lines.join(splits, (F.col("file") == F.col("of_file")) & (F.col("split") == F.col("of_split")))
    begins = F.col("open") == F.col("inside")
    number = F.col("offset") + F.when(F.col("inside"), F.col("begun_open")).otherwise(F.col("begun_closed"))
    numbered = both.select(number.alias("row_no"), begins.alias("begins"), (F.col("quotes") % 2 == 1).alias("odd"), "split", "place", "value")
    alone = F.col("begins") & ~F.col("odd")
    single = numbered.where(alone).select("row_no", F.col("value").alias("record"))
    parts = F.sort_array(F.collect_list(F.struct("split", "place", "value")))
    several = numbered.where(~alone).groupBy("row_no").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("record"))
    return single.unionByName(several).select("row_no", F.regexp_replace("record", "\r$", "").alias("record"))


def read_cells(spark: SparkSession, path: str, width: int, separator: str = ",") -> DataFrame:
    """A sheet saved as CSV: ``row_no`` (1..n) and text columns c1..c<width>; missing and empty cells are null."""
    cells = ", ".join(f"c{n} string" for n in range(1, width + 1))
    options = {"sep": separator, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}
    cut = F.from_csv("record", cells, options).alias("cut")
    return read_records(spark, path).select("row_no", cut).select("row_no", "cut.*")
