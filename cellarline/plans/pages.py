"""Lists that are read page by page or searched by part of a name, without going through all rows each time.

An order index is a list written in its order, in blocks of equally many rows with their numbers. A page is one or two
blocks, the first page like the last. A substring index holds, for each piece of three characters, the rows whose texts
have it; a search intersects the pieces of the needle and looks at the texts of what is left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarline.functions.frames import rank_rows
from cellarline.sources.storage import current_rows, path_exists, read_table, write_truncate

#: Rows of a block, and folders over which the pieces of a substring index are spread.
BLOCK_ROWS = 10_000
GRAM_FOLDERS = 64
GRAM = 3


class OrderIndex:
    """The rows of a list in a fixed order below ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def write(self, df: DataFrame, order: Sequence[Column], block_rows: int = BLOCK_ROWS) -> None:
        """Write ``df`` in ``order`` (which must end in a unique key). Readers keep the old index until the new one is there.

        Ranks are distributed; each block becomes one file, so a task writes blocks and never the whole list.
        """
        block = F.floor((F.col("puesto") - 1) / block_rows).cast("bigint")
        ranked = rank_rows(df, order, name="puesto")
        # The columns of a list that may have no row.
        write_truncate(ranked.limit(0).coalesce(1), f"{self.path}/columns")
        ranked = ranked.withColumn("bloque", block).withColumn("filas_bloque", F.lit(block_rows))
        write_truncate(ranked.repartition("bloque").sortWithinPartitions("bloque", "puesto"), self.path, partition_by=("filas_bloque", "bloque"))

    def rows(self, first: int, last: int) -> DataFrame:
        """The rows numbered ``first`` to ``last``; only the files of their blocks are listed and read."""
        home = current_rows(self.spark, self.path)
        if home is None:
            raise ValueError(f"there is no index at {self.path}")
        folder, nothing = self._folder(home), read_table(self.spark, f"{self.path}/columns")
        size = int(folder.rpartition("=")[2]) if folder else 1
        blocks = range((first - 1) // size, (last - 1) // size + 1) if folder else []
        there = [f"{folder}/bloque={b}" for b in blocks if path_exists(self.spark, f"{folder}/bloque={b}")]
        if not there:
            return nothing
        found = self.spark.read.schema(nothing.schema).parquet(*there)
        return found.where(F.col("puesto").between(first, last)).orderBy("puesto")

    def _folder(self, home: str) -> str | None:
        system = self.spark._jvm.org.apache.hadoop.fs.Path(home).getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [e.getPath().getName() for e in system.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(home))]
        found = [name for name in names if name.startswith("filas_bloque=")]
        return f"{home}/{found[0]}" if found else None

    def page(self, number: int = 1, size: int = 50) -> DataFrame:
        """Page ``number`` (from 1) with ``puesto``, the row's number in the list."""
        if number < 1 or size < 1:
            raise ValueError("page number and size start at 1")
        return self.rows((number - 1) * size + 1, number * size)

    def after(self, puesto: int, size: int = 50) -> DataFrame:
        """The ``size`` rows behind the one numbered ``puesto`` (0: the first ones)."""
        return self.rows(puesto + 1, puesto + size)


def grams(text: Column) -> Column:
    """The different pieces of GRAM characters of a text, in lower case; none of a shorter text."""
    low = F.lower(text)
    places = F.sequence(F.lit(1), F.length(low) - (GRAM - 1))
    return F.when(F.length(low) >= GRAM, F.array_distinct(F.transform(places, lambda i: F.substring(low, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def _folder_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_FOLDERS)).cast("int")


class SubstringIndex:
    """Rows below ``path`` that can be searched by any part of their ``columns``, in any case."""

    def __init__(self, spark: SparkSession, path: str, columns: Sequence[str]) -> None:
        self.spark, self.path, self.columns = spark, path, list(columns)

    def write(self, df: DataFrame) -> None:
        """Write the rows with a number each, and their pieces by folder. Pieces of all columns are kept apart."""
        write_truncate(df.withColumn("fila", F.monotonically_increasing_id()), f"{self.path}/rows")
        rows = read_table(self.spark, f"{self.path}/rows")
        postings = None
        for number, column in enumerate(self.columns):
            own = rows.select(F.lit(number).alias("columna"), F.explode(grams(F.col(column))).alias("pieza"), "fila")
            postings = own if postings is None else postings.unionByName(own)
        # A folder has few pieces, a common piece many rows: the rows of a piece are spread over several files.
        spread = F.pmod(F.xxhash64("fila"), F.lit(8))
        postings = postings.withColumn("carpeta", _folder_of(F.col("pieza"))).repartition("carpeta", spread).sortWithinPartitions("carpeta", "pieza")
        write_truncate(postings, f"{self.path}/pieces", partition_by=("carpeta",))

    def search(self, text: str) -> DataFrame:
        """The rows that contain ``text`` in one of the columns, as a scan would find them.

        A needle shorter than a piece is in no posting: its rows are scanned.
        """
        rows = read_table(self.spark, f"{self.path}/rows")
        needle = text.lower()
        wanted = F.lit(needle)
        contains = F.lit(False)
        for column in self.columns:
            contains = contains | F.coalesce(F.contains(F.lower(column), wanted), F.lit(False))
        pieces = sorted({needle[i : i + GRAM] for i in range(len(needle) - GRAM + 1)})
        if not pieces:
            return rows.where(contains).drop("fila")
        return rows.join(self._candidates(pieces), "fila", "left_semi").where(contains).drop("fila")

    def _candidates(self, pieces: list[str]) -> DataFrame:
        """Numbers of the rows that have all ``pieces`` in one column; reads only the folders of these pieces."""
        home = current_rows(self.spark, f"{self.path}/pieces")
        numbers = self.spark.range(1).select(F.array(*[_folder_of(F.lit(p)) for p in pieces]).alias("f")).first()["f"]
        folders = [f"{home}/carpeta={number}" for number in sorted(set(numbers))]
        schema = "columna int, pieza string, fila bigint"
        if not all(path_exists(self.spark, folder) for folder in folders):
            return self.spark.createDataFrame([], "fila bigint")
        postings = self.spark.read.schema(schema).parquet(*folders)
        found = postings.where(F.col("pieza").isin(*pieces)).groupBy("fila", "columna").agg(F.count("*").alias("n"))
        return found.where(F.col("n") == len(pieces)).select("fila").distinct()
