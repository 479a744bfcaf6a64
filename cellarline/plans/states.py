"""Views that are refreshed by changed year, and key figures from stored sets.

The written fact has a folder for each year. A year's signature comes from its files; a refresh looks at the signatures,
reads the files of the years whose signature has changed, and replaces the states of these years only. Views are then
computed from the states of all years, without the fact.

Two kinds of state merge exactly:

* **Grouped facts.** A state is the fact summed over all columns that a view does not look at; it has the fact's columns
  and types, so the view's own operator runs on it. Sums of sums, the largest of the largest and distinct keys among
  kept keys are the same as over the lines. Where the keys to count leave hardly fewer rows than there are lines, the
  sums come once for each group and the keys in rows of their own without amounts: both kinds together give the same.
* **Sets as bitmaps.** Orders and customers get dense numbers from a dictionary that only grows. Per day, a bitmap of
  32,768 numbers in each bucket says which occur; the union of days is ``bitmap_or_agg``, the distinct count the sum of
  ``bitmap_count``. Orders are numbered as they come in, so a day touches few buckets.

The lines are summed to orders first; days, sets and dictionaries are made from these rows, which are fewer.

A manifest names the folders of all states. It is written behind them and switched at once, so readers see a whole
refresh or none. One refresh runs at a time.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarline.config import DEFAULTS, Settings
from cellarline.functions.exprs import as_python_date, exact_sum, percent, round_ratio, safe_div
from cellarline.functions.frames import rank_rows
from cellarline.operators import customers, kpi, products, timeops
from cellarline.plans.materialize import BASE
from cellarline.sources.fact import SALES_SCHEMA
from cellarline.sources.storage import current_rows, packed, path_exists, read_table, write_truncate

# Raise it with every change of what a state holds, so that older states are not taken.
VERSION = 2

#: The columns each grouped fact keeps; the amounts are summed.
GRAINS = {
    "countries": ("anno", "pais_origen_producto"),
    "sellers": ("anno", "vendedor"),
    "products": ("anno", "producto", "nombre_tipo_bebida", "marca_producto"),
}
#: The keys that are counted in each group, of the states that have rows for them.
COUNTED = {"countries": ("cliente", "cod_venta"), "sellers": ("cod_venta",)}
AMOUNTS = ("venta_neta_mn", "costo_mn_total", "margen_mn")
#: Dictionaries and the column of the fact they number.
KEYS = {"order_keys": "cod_venta", "customer_keys": "cliente"}
_MANIFEST = "estado string, anno string, firma string, ruta string"


def year_signatures(spark: SparkSession, base: str) -> dict[str, str]:
    """A name for the content of each year's folder (``anno=...``) of the fact at ``base``, from all of its files.

    Spark lists the files; the driver gets one row per year.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(base)
    mark = F.xxhash64("path", "length", F.col("modificationTime").cast("double")).cast("decimal(38,0)")
    folder = F.regexp_extract("path", "/(anno=[^/]*)/", 1).alias("folder")
    rows = files.groupBy(folder).agg(F.count("*").alias("n"), F.sum("length").alias("size"), F.sum(mark).alias("marks")).collect()
    return {row["folder"]: f"{row['n']}-{row['size']}-{row['marks']}" for row in rows}


def grouped(sales: DataFrame, grain: tuple[str, ...]) -> DataFrame:
    """The fact summed to ``grain``, with its own columns and types; amounts below 10^14 for each row.

    Ten-thousandths of such sums fit one long, where ``exact_sum`` would shuffle two.
    """

    def total(amount: str) -> Column:
        units = F.sum((F.col(amount).cast("decimal(18,4)") * F.lit(10_000).cast("decimal(5,0)")).cast("bigint"))
        return (units.cast("decimal(19,0)") * F.lit("0.0001").cast("decimal(4,4)")).cast("decimal(18,4)")

    sums = [total(c).alias(c) for c in AMOUNTS]
    return sales.groupBy(*grain).agg(F.sum("cantidad").alias("cantidad"), *sums)


def grouped_beside_keys(sales: DataFrame, grain: tuple[str, ...], counted: tuple[str, ...]) -> DataFrame:
    """``grouped`` to ``grain``, and a row without amounts for each combination of ``grain`` and the keys ``counted``.

    An order has few lines of one country or seller: sums for each of them would be shuffled and written for nearly
    every line.
    """
    keys = sales.select(*grain, *counted).distinct()
    return grouped(sales, grain).unionByName(keys, allowMissingColumns=True)


def _marked(sales: DataFrame) -> DataFrame:
    """Lines, or sums of them, that say if they have an origin."""
    if "con_origen" in sales.columns:
        return sales
    country = F.col("pais_origen_producto")
    return sales.withColumn("con_origen", country.isNotNull() & (country != ""))


def placed_orders(sales: DataFrame) -> DataFrame:
    """The fact summed to orders, apart for lines with and without an origin."""
    return grouped(_marked(sales), ("anno", "mes", "fecha", "con_origen", "cliente", "cod_venta"))


def days(sales: DataFrame) -> DataFrame:
    """Exact sums per day, apart for lines with and without an origin."""
    sums = [exact_sum(c).alias(c) for c in ("venta_neta_mn", "margen_mn")]
    return _marked(sales).groupBy("anno", "fecha", "con_origen").agg(F.sum("cantidad").alias("cantidad"), *sums)


def day_sets(sales: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Bitmaps of the numbers of ``column`` per day and bucket; null keys are in no set, as in a distinct count.

    A key is taken once a day before it meets the dictionary, so a hot key is as rare as others there. The numbers are
    shuffled and bitmaps made behind that: a bitmap takes 4 KB however few numbers it holds, and each task of the join
    would send one of its own for nearly every day and bucket. A bitmap is made of at most 32,768 rows.
    """
    once = _marked(sales).where(F.col(column).isNotNull()).select("anno", "fecha", "con_origen", F.col(column).alias("of")).distinct()
    numbered = once.join(keys, F.col("of") == F.col("clave")).withColumn("cubo", F.bitmap_bucket_number("id"))
    of_a_bitmap = ("anno", "fecha", "con_origen", "cubo")
    placed = numbered.select(*of_a_bitmap, F.bitmap_bit_position("id").alias("_bit")).repartition(*of_a_bitmap)
    return placed.groupBy(*of_a_bitmap).agg(F.bitmap_construct_agg("_bit").alias("bits"))


def bands(sales: DataFrame, cfg: Settings) -> DataFrame:
    """Sums per year and band of unit cost, as a grouped fact."""
    return grouped(products.cost_banded(sales, cfg), ("anno", "segmento"))


class States:
    """The states below ``root`` of the fact at ``base``."""

    def __init__(self, spark: SparkSession, base: str, root: str, cfg: Settings = DEFAULTS) -> None:
        self.spark, self.base, self.root, self.cfg = spark, base, f"{root}/v{VERSION}", cfg

    def manifest(self) -> list[tuple[str, str, str, str]]:
        """(state, year's folder, signature, rows): a row for each state and year, one without a state for each year's
        signature, and a few for the dictionaries."""
        if current_rows(self.spark, f"{self.root}/manifest") is None:
            return []
        return [tuple(row) for row in read_table(self.spark, f"{self.root}/manifest").select("estado", "anno", "firma", "ruta").collect()]

    def read(self, state: str) -> DataFrame:
        """All years of one state."""
        manifest = self.manifest()
        if not manifest:
            raise ValueError("there are no states: refresh first")
        paths = [path for name, _, _, path in manifest if name == state]
        if paths:
            return self.spark.read.parquet(*paths)
        nothing = self.spark.createDataFrame([], SALES_SCHEMA)
        keys = {name: nothing.select(F.col(column).alias("clave"), F.lit(0).cast("bigint").alias("id")) for name, column in KEYS.items()}
        orders = placed_orders(nothing)
        return (keys | {"orders": orders} | self._build(nothing, orders, keys))[state]

    def _write(self, df: DataFrame, state: str, by_year: bool) -> str:
        path = f"{self.root}/{state}/rows-{uuid.uuid4().hex}"
        if by_year:
            # The year stays a column of the rows, so that each folder can be read by itself.
            packed(df.withColumn("_anno", F.col("anno"))).partitionBy("_anno").parquet(path)
        else:
            packed(df).parquet(path)
        return path

    def years(self, folders: list[str]) -> DataFrame:
        """The fact's rows of some years; only the files in their folders are listed and read."""
        paths = [f"{self.base}/{folder}" for folder in folders]
        return self.spark.read.schema(SALES_SCHEMA).option("basePath", self.base).parquet(*paths).select(*SALES_SCHEMA.names)

    def _grown(self, state: str, column: str, sales: DataFrame, parts: list[tuple]) -> list[tuple]:
        """The dictionary's rows of the manifest, with one more if ``sales`` has keys that are not in it."""
        fresh = sales.where(F.col(column).isNotNull()).select(F.col(column).alias("clave")).distinct()
        known = 0
        if parts:
            old = self.spark.read.parquet(*[row[3] for row in parts])
            known = old.agg(F.max("id").alias("n")).first()["n"] or 0
            fresh = fresh.join(old.select(F.col("clave").alias("alt")), F.col("clave") == F.col("alt"), "left_anti")
        numbered = rank_rows(fresh, [F.asc("clave")], name="puesto")
        path = self._write(numbered.select("clave", (F.col("puesto") + known).alias("id")), state, by_year=False)
        if parts and self.spark.read.parquet(path).isEmpty():
            return parts
        return [*parts, (state, f"{len(parts):05d}", "", path)]

    def _build(self, sales: DataFrame, orders: DataFrame, keys: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """The states of the lines in ``sales`` but for their ``orders``."""
        found = {
            state: grouped_beside_keys(sales, grain, COUNTED[state]) if state in COUNTED else grouped(sales, grain)
            for state, grain in GRAINS.items()
        }
        found |= {"bands": bands(sales, self.cfg), "days": days(orders)}
        return found | {state.replace("_keys", "_sets"): day_sets(orders, keys[state], column) for state, column in KEYS.items()}

    def refresh(self) -> list[str]:
        """Bring the states up to the fact; returns the folders of the years that were read anew or dropped.

        One job for each state writes all changed years.
        """
        now, old = year_signatures(self.spark, self.base), self.manifest()
        before = {folder: mark for state, folder, mark, _ in old if not state}
        changed = sorted(folder for folder, mark in now.items() if before.get(folder) != mark)
        gone = sorted(folder for folder in before if folder not in now)
        if not changed and not gone:
            return []
        rows = [row for row in old if row[0] not in KEYS and row[1] not in changed and row[1] not in gone]
        dictionaries = {state: [row for row in old if row[0] == state] for state in KEYS}
        if changed:
            sales = self.years(changed)
            orders = placed_orders(sales)
            written = {"orders": self._write(orders, "orders", by_year=True)}
            orders = self.spark.read.schema(orders.schema).parquet(written["orders"]).select(*orders.columns)
            dictionaries = {state: self._grown(state, KEYS[state], orders, parts) for state, parts in dictionaries.items()}
            keys = {state: self.spark.read.parquet(*[row[3] for row in parts]) for state, parts in dictionaries.items()}
            rows += [("", folder, now[folder], "") for folder in changed]
            written |= {state: self._write(df, state, by_year=True) for state, df in self._build(sales, orders, keys).items()}
            for state, path in written.items():
                # A year can have no row in a state, and then has no folder.
                rows += [(state, folder, "", f"{path}/_{folder}") for folder in changed if path_exists(self.spark, f"{path}/_{folder}")]
        every = rows + [row for parts in dictionaries.values() for row in parts]
        write_truncate(self.spark.createDataFrame(every, _MANIFEST).coalesce(1), f"{self.root}/manifest")
        return changed + gone

    def views(self, as_of: dt.date | str | None = None) -> dict[str, Callable[[], DataFrame]]:
        """The materialized views by name, from the states; ``BASE`` is the fact's revenue per month."""
        cfg, read = self.cfg, self.read
        return {
            BASE: lambda: timeops.monthly_revenue(read("orders")),
            "kpi_global": lambda: kpi.kpi_global(read("orders")),
            "serie_mensual": lambda: timeops.serie_mensual(read("orders")),
            "dimension_pais": lambda: products.dim_pais(read("countries")),
            "dimension_tipo": lambda: products.dim_tipo(read("products")),
            "dimension_marca": lambda: products.dim_marca(read("products"), limit=cfg.brand_limit),
            "top_clientes": lambda: customers.top_clientes(read("orders"), as_of, cfg=cfg),
            "top_productos": lambda: products.top_productos(read("products")),
            "vendedores": lambda: products.vendedores(read("sellers")),
            "segmento_precio": lambda: products.band_shares(read("bands")),
            "margen_marca": lambda: products.margen_marca(read("products"), limit=cfg.brand_limit, cfg=cfg),
            "rfm": lambda: customers.rfm_basic(read("orders"), as_of, cfg=cfg),
            "estacionalidad": lambda: timeops.estacionalidad(read("orders"), cfg),
            "kpi_ytd": lambda: kpi.kpi_ytd(read("orders"), as_of),
            "top_clientes_anno": lambda: customers.top_clientes_anno_mat(read("orders"), as_of),
        }

    def _figures(self, wanted: Callable[[DataFrame], DataFrame], guard: bool) -> DataFrame:
        """The key figures by year over the days that ``wanted`` keeps, from day sums and day sets."""

        def of(state: str) -> DataFrame:
            found = wanted(self.read(state))
            return found.where("con_origen") if guard else found

        def distinct(state: str, name: str) -> DataFrame:
            union = of(state).groupBy(F.col("anno").alias(f"{name}_anno"), "cubo").agg(F.bitmap_or_agg("bits").alias("bits"))
            return union.groupBy(f"{name}_anno").agg(F.sum(F.bitmap_count("bits")).alias(name))

        sums = of("days").groupBy("anno").agg(
            F.sum("venta_neta_mn").alias("venta"), F.sum("margen_mn").alias("margen_"), F.sum("cantidad").alias("unidades")
        )
        both = sums.join(distinct("customer_sets", "clientes"), F.col("anno").eqNullSafe(F.col("clientes_anno")), "left")
        both = both.join(distinct("order_sets", "pedidos"), F.col("anno").eqNullSafe(F.col("pedidos_anno")), "left")
        both = both.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("clientes", "pedidos")})
        return both.select(
            "anno",
            F.round("venta", 0).cast("double").alias("venta_neta"),
            F.round("margen_", 0).cast("double").alias("margen"),
            percent(F.col("margen_"), F.col("venta")).alias("pct_margen"),
            "unidades",
            "clientes",
            "pedidos",
            round_ratio(safe_div(F.col("venta"), F.col("pedidos")), 0).alias("pedido_promedio"),
        )

    def kpi_year(self, anno: int, as_of: dt.date | str | None = None, guard: bool = True) -> DataFrame:
        """``kpi.kpi_year`` of one year, without the fact."""
        day = as_python_date(as_of)
        return kpi.year_rows(kpi.paired(self._figures(lambda df: kpi.of_two_years(df, anno, kpi.cut_of(anno, day)), guard), anno), anno)

    def kpi_ytd(self, as_of: dt.date | str | None = None, guard: bool = False) -> DataFrame:
        """``kpi.kpi_ytd``, without the fact."""
        day = as_python_date(as_of)
        figures = self._figures(lambda df: kpi.of_two_years(df, day.year, day.strftime("%m-%d")), guard)
        return kpi.ytd_row(kpi.paired(figures, day.year), day)

