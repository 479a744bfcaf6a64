"""Every operator as a named query over the star tables in a folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellarline.functions.exprs import round_ratio
from cellarline.operators import customers, finance, forecast, kpi, products, timeops
from cellarline.plans import materialize
from cellarline.plans.dashboard import dashboard_bundle, long_rows
from cellarline.plans.pages import OrderIndex, SubstringIndex
from cellarline.plans.sample import ACCOUNT, AS_OF, CFG, PERIOD, YEAR, YEARS
from cellarline.plans.states import States
from cellarline.plans.warehouse import derived_table, ledger_table, sales_path, sales_table, size_star
from cellarline.sources import fact, sheets, storage
from cellarline.sources.csvscan import read_cells
from cellarline.sources.matching import match_occurrences
from cellarline.streaming.incremental import append_new, append_stream
from cellarline.streaming.transactional import append_source, compact, read_committed, sync_report

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        _QUERIES[name] = run
        return run

    return add


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def on_fact(name: str, operator: Callable[..., DataFrame], guard: bool, *args, **kwargs) -> None:
    """Register an operator that takes the fact (or the guarded fact) and fixed parameters."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        sales = sales_table(spark, folder)
        return operator(fact.guarded(sales) if guard else sales, *args, **kwargs)

    _QUERIES[name] = run


def on_ledger(name: str, operator: Callable[..., DataFrame], *args) -> None:
    _QUERIES[name] = lambda spark, folder: operator(ledger_table(spark, folder), *args)


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for readers without exact types."""
    return df.select(
        *[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else f.name for f in df.schema]
    )


def scratch(spark: SparkSession, name: str) -> str:
    return f"{storage.require_shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Sources


@query("sales_fact")
def _sales_fact(spark, folder):
    size_star(spark, folder)
    return plain(fact.sales_fact(fact.read_star(spark, folder)))


@query("guarded_sales")
def _guarded_sales(spark, folder):
    return plain(fact.guarded(sales_table(spark, folder)))


@query("lower_columns")
def _lower_columns(spark, folder):
    table = spark.read.parquet(f"{folder}/customer.parquet")
    return fact.lower_columns(table.toDF(*[c.upper() for c in table.columns]))


@query("year_window")
def _year_window(spark, folder):
    return plain(timeops.year_window(sales_table(spark, folder), AS_OF))


@query("rfm_header_join")
def _rfm_header_join(spark, folder):
    header = fact.order_header(fact.read_star(spark, folder))
    return plain(fact.with_exchange_rate(fact.guarded(sales_table(spark, folder)), header))


# Key figures and time

on_fact("kpi_global", kpi.kpi_global, False)
on_fact("kpi_year", kpi.kpi_year, True, YEAR, AS_OF)
on_fact("kpi_year_running", kpi.kpi_year, True, AS_OF.year, AS_OF)
on_fact("kpi_year_all", kpi.kpi_year, True, None, AS_OF)
on_fact("kpi_ytd", kpi.kpi_ytd, False, AS_OF)
on_fact("kpi_ytd_live", kpi.kpi_ytd, True, AS_OF)
on_fact("kpi_yoy_delta", kpi.kpi_yoy_delta, True, YEAR, AS_OF)
on_fact("serie_mensual", timeops.serie_mensual, False)
on_fact("serie_mensual_year", timeops.serie_mensual, False, YEAR)
on_fact("estacionalidad", timeops.estacionalidad, False, CFG)
on_fact("estacionalidad_matrix", timeops.estacionalidad_matrix, False, CFG)
on_fact("yoy_mensual", timeops.yoy_mensual, False, YEAR)
on_fact("margen_marca_anno", timeops.margen_marca_anno, False, YEARS)
on_fact("margen_marca_anno_all", timeops.margen_marca_anno, False)

# Products

on_fact("dim_pais", products.dim_pais, False)
on_fact("dim_tipo", products.dim_tipo, False)
on_fact("dim_marca", products.dim_marca, False, limit=CFG.brand_limit)
on_fact("dim_marca_all", products.dim_marca, False)
on_fact("margen_marca", products.margen_marca, False, limit=CFG.brand_limit, cfg=CFG)
on_fact("margen_marca_all", products.margen_marca, False, cfg=CFG)
on_fact("segmento_precio_costo", products.segmento_precio_costo, False, CFG)
on_fact("segmento_precio_venta", products.segmento_precio_venta, True, YEAR, CFG)
on_fact("rentabilidad_origen", products.rentabilidad_origen, True, YEAR)
on_fact("market_share_tipo", products.market_share_tipo, True, YEAR)
on_fact("dependencia_marca", products.dependencia_marca, True, YEAR)
on_fact("brand_type_fit", products.brand_type_fit, True, YEAR, CFG)
on_fact("productos_mix_pais", products.productos_mix_pais, True, YEAR, CFG)
on_fact("top_productos", products.top_productos, False)
on_fact("top_productos_year", products.top_productos_year, True, YEAR)
on_fact("top_productos_year_first", products.top_productos_year, True, YEAR, 500)
on_fact("productos_all", products.productos_all, True, YEAR)
on_fact("marcas_all", products.marcas_all, True, YEAR)
on_fact("productos_detalle", products.productos_detalle, False)
on_fact("vendedores", products.vendedores, False)
on_fact(
    "filter_products",
    lambda sales: products.filter_products(
        products.productos_detalle(sales), name="RED", tipo="PROMO", margin=(60.0, 90.0), number=2, size=20
    ),
    False,
)
on_fact(
    "search_products", lambda sales: products.search_products(products.productos_detalle(sales), "BRAND#1"), False
)

# Customers

on_fact("top_clientes", customers.top_clientes, False, AS_OF, cfg=CFG)
on_fact("top_clientes_first", customers.top_clientes, False, AS_OF, 20, CFG)
on_fact("top_clientes_year", customers.top_clientes_year, True, YEAR, None, AS_OF)
on_fact("top_clientes_year_first", customers.top_clientes_year, True, YEAR, 500, AS_OF)
on_fact("top_clientes_anno_mat", customers.top_clientes_anno_mat, False, AS_OF)
on_fact("rfm_basic", customers.rfm_basic, False, AS_OF, cfg=CFG)
on_fact("rfm_details", customers.rfm_details, True, None, AS_OF, CFG)
on_fact("rfm_stats", customers.rfm_stats, True, None, AS_OF, CFG)
on_fact("rfm_cross_sell", customers.rfm_cross_sell, True, YEAR, CFG)
on_fact("rfm_mix_details", customers.rfm_mix_details, True, YEAR, AS_OF, CFG)
on_fact("retencion", customers.retencion, True, None, AS_OF, CFG)
on_fact("retencion_listado_nuevos", customers.retencion_listado, True, YEAR - 1, YEAR, "nuevos")
on_fact("retencion_listado_retenidos", customers.retencion_listado, True, YEAR - 1, YEAR, "retenidos")
on_fact("retencion_listado_perdidos", customers.retencion_listado, True, YEAR - 1, YEAR, "perdidos")
on_fact("frecuencia_compra", customers.frecuencia_compra, True, YEAR, CFG)
on_fact("analisis_experto", customers.analisis_experto, True, AS_OF, CFG)
on_fact("analisis_clientes_wide", customers.analisis_clientes_wide, False, AS_OF, CFG)
on_fact("clientes_detalle", customers.clientes_detalle, False)
on_fact("cross_sell_opportunity", customers.cross_sell_opportunity, True, YEAR, CFG)
on_fact(
    "filter_customers",
    lambda sales: customers.filter_customers(
        customers.rfm_details(sales, None, AS_OF, CFG), name="CUSTOMER#", days=(0, 180), segment="Leales", number=2, size=25
    ),
    True,
)
on_fact(
    "search_customers",
    lambda sales: customers.search_customers(customers.clientes_detalle(sales).withColumnRenamed("valor_monetario", "venta_neta"), "1"),
    False,
)

# Lists with a year chosen

on_fact("dim_pais_year", products.dim_pais, False, YEAR)
on_fact("dim_tipo_year", products.dim_tipo, False, YEAR)
on_fact("dim_marca_year", products.dim_marca, False, YEAR)
on_fact("margen_marca_year", products.margen_marca, False, cfg=CFG, anno=YEAR)
on_fact("productos_detalle_year", products.productos_detalle, False, YEAR)
on_fact("clientes_detalle_year", customers.clientes_detalle, False, YEAR)

# Finance

on_ledger("fin_balance", finance.fin_balance, YEAR)
on_ledger("fin_resultados", finance.fin_resultados, YEAR)
on_ledger("fin_flujo", finance.fin_flujo, YEAR)
on_ledger("fin_detalle", finance.fin_detalle, YEAR, ACCOUNT, PERIOD)
on_ledger("ledger_profile_years", finance.ledger_profile_years)
on_ledger("ledger_profile_accounts", finance.ledger_profile_accounts)

# Forecast


def _vintage_sales(spark: SparkSession, folder: str) -> DataFrame:
    return fact.with_vintage_names(sales_table(spark, folder))


def _calendar(sales: DataFrame) -> DataFrame:
    # First and last day come from the files' statistics; only these two are cut to their month.
    ends = sales.agg(F.min("fecha").alias("first"), F.max("fecha").alias("last"))
    return ends.select(F.explode(F.array("first", "last")).alias("d")).select(F.trunc("d", "month").alias("periodo"))


def _product_forecast(spark: SparkSession, folder: str, anchor: str = "product") -> DataFrame:
    sales = _vintage_sales(spark, folder)
    return forecast.forecast_productos(forecast.fc_serie_productos(sales, CFG), _calendar(sales), anchor=anchor, cfg=CFG)


def _total_forecast(spark: SparkSession, folder: str) -> DataFrame:
    return forecast.forecast_total(forecast.fc_serie_total(sales_table(spark, folder)), cfg=CFG)


on_fact("fc_serie_total", forecast.fc_serie_total, False)


@query("strip_vintage")
def _strip_vintage(spark, folder):
    names = _vintage_sales(spark, folder).groupBy("producto").agg(F.count("*").alias("filas"))
    return names.select("producto", forecast.strip_vintage(F.col("producto")).alias("producto_base"), "filas")


@query("dominant_brand")
def _dominant_brand(spark, folder):
    return forecast.dominant_brand(_vintage_sales(spark, folder))


@query("fc_serie_productos")
def _fc_serie_productos(spark, folder):
    return forecast.fc_serie_productos(_vintage_sales(spark, folder), CFG)


@query("zero_fill_grid")
def _zero_fill_grid(spark, folder):
    sales = _vintage_sales(spark, folder)
    return forecast.zero_fill_grid(forecast.fc_serie_productos(sales, CFG), _calendar(sales))


@query("forecast_quantiles")
def _forecast_quantiles(spark, folder):
    grid = _zero_fill_grid(spark, folder)
    steps = forecast.forecast_quantiles(grid, ["producto", "marca"], "unidades", cfg=CFG)
    return steps.withColumns({c: round_ratio(F.col(c), 4) for c in ("forecast", "fc_lo", "fc_hi")})


@query("forecast_quantiles_short")
def _forecast_quantiles_short(spark, folder):
    """The same from the last nine months of each product only, which is less than a season."""
    grid = _zero_fill_grid(spark, folder)
    recent = F.row_number().over(Window.partitionBy("producto").orderBy(F.desc("periodo")))
    short = grid.withColumn("n", recent).where("n <= 9").drop("n")
    steps = forecast.forecast_quantiles(short, ["producto", "marca"], "unidades", cfg=CFG)
    return steps.withColumns({c: round_ratio(F.col(c), 4) for c in ("forecast", "fc_lo", "fc_hi")})


_QUERIES["forecast_total"] = _total_forecast
_QUERIES["forecast_productos"] = _product_forecast
_QUERIES["forecast_productos_global"] = lambda spark, folder: _product_forecast(spark, folder, "global")


def stored_product_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """The product table as the forecast batch leaves it; its readers do not forecast again."""
    schema = forecast.FORECAST_PRODUCTS_SCHEMA
    return derived_table(spark, folder, "forecast_productos", schema, lambda: _product_forecast(spark, folder), CFG)


@query("read_forecast_total")
def _read_forecast_total(spark, folder):
    schema = forecast.FORECAST_TOTAL_SCHEMA
    table = derived_table(spark, folder, "forecast_total", schema, lambda: _total_forecast(spark, folder), CFG)
    return forecast.read_forecast_total(table)


@query("read_forecast_productos")
def _read_forecast_productos(spark, folder):
    return forecast.read_forecast_productos(stored_product_forecast(spark, folder), "red widget")


@query("forecast_catalogo")
def _forecast_catalogo(spark, folder):
    return forecast.forecast_catalogo(stored_product_forecast(spark, folder))


@query("forecast_rollup_3m")
def _forecast_rollup(spark, folder):
    return forecast.forecast_rollup_3m(stored_product_forecast(spark, folder))


@query("write_truncate")
def _write_truncate(spark, folder):
    path = scratch(spark, "forecast_total")
    storage.write_truncate(_total_forecast(spark, folder), path)
    return storage.read_table(spark, path, forecast.FORECAST_TOTAL_SCHEMA)


@query("export_csv")
def _export_csv(spark, folder):
    path = scratch(spark, "forecast_productos_csv")
    table = stored_product_forecast(spark, folder)
    storage.export_csv(table.filter(F.col("tipo") == forecast.TAG_FORECAST), path)
    return spark.read.schema(forecast.FORECAST_PRODUCTS_SCHEMA).option("header", True).csv(path)


# Materialized views and the first page


@query("materialize_views")
def _materialize_views(spark, folder):
    """Refresh all views on the written fact and read what each table holds; the base as revenue per month."""
    sales, root = sales_table(spark, folder), scratch(spark, "views")
    materialize.materialize_views(sales, root, AS_OF, CFG, base_path=sales_path(spark, folder))
    twins = {view: materialize.written_twin(spark, root, view) for view in materialize.view_definitions(sales, AS_OF, CFG)}
    base = timeops.monthly_revenue(twins.pop(materialize.BASE))
    return long_rows(twins | {materialize.BASE: base})


def _states(spark: SparkSession, folder: str) -> States:
    """States of the written fact, kept up to date beside it."""
    base = sales_path(spark, folder)
    states = States(spark, base, f"{storage.require_shared_dir(spark)}/states/{base.rstrip('/').rpartition('/')[2]}", CFG)
    states.refresh()
    return states


@query("refresh_years")
def _refresh_years(spark, folder):
    """States of a fact that lacks half of one year; the rest comes, and one year is refreshed. All views from the states."""
    sales, root = sales_table(spark, folder), scratch(spark, "states")
    late = (F.col("anno") == YEAR) & (F.col("cod_venta") % 2 == 0)
    states = States(spark, f"{root}/fact", f"{root}/states", CFG)
    for part in (sales.where(~late), sales.where(late)):
        storage.packed(part).mode("append").partitionBy("anno").parquet(f"{root}/fact")
        states.refresh()
    return long_rows({name: build() for name, build in states.views(AS_OF).items()})


@query("kpi_year_states")
def _kpi_year_states(spark, folder):
    return _states(spark, folder).kpi_year(YEAR, AS_OF)


@query("kpi_ytd_states")
def _kpi_ytd_states(spark, folder):
    return _states(spark, folder).kpi_ytd(AS_OF)


@query("resolve_materialized")
def _resolve_materialized(spark, folder):
    sales, root = sales_table(spark, folder), scratch(spark, "views")
    materialize.materialize_views(sales, root, AS_OF, CFG, only=("dimension_pais",))
    written = materialize.resolve_materialized("dimension_pais", sales, root, AS_OF, CFG)
    computed = materialize.resolve_materialized("dimension_tipo", sales, root, AS_OF, CFG)
    columns = [F.col("venta_neta"), F.col("unidades")]
    return written.select(F.col("pais_origen_producto").alias("nombre"), *columns).unionByName(
        computed.select(F.col("nombre_tipo_bebida").alias("nombre"), *columns)
    )


@query("dashboard_bundle")
def _dashboard_bundle(spark, folder):
    """The content of the twelve sections as long rows."""
    return long_rows(dashboard_bundle(sales_table(spark, folder), YEAR, AS_OF, CFG))


# Sheets


def _raw_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The orders as a raw sheet: text cells, filler rows 1 to 5, header on row 6, data below.

    Rows of orders in state P are blank, half with nulls and half with empty texts.
    """
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    key = F.col("o_orderkey")
    pending = F.col("o_orderstatus") == "P"
    empty = F.when(key % 2 == 0, F.lit("")).otherwise(F.lit(None))

    def cell(value) -> F.Column:
        return F.when(pending, empty).otherwise(value.cast("string"))

    data = orders.select(
        (key + F.lit(sheets.SALES_HEADER_ROW + 1)).cast("bigint").alias("row_no"),
        cell(key).alias("c1"),
        cell(F.substring("o_orderpriority", 1, 1)).alias("c2"),
        cell(key + 1000).alias("c3"),
        cell(F.col("o_custkey")).alias("c4"),
    )
    texts = (" Codigo Venta ", "Serie", " Numero", "Cliente")
    top = spark.range(1, sheets.SALES_HEADER_ROW + 1).select(
        F.col("id").alias("row_no"),
        *[
            F.when(F.col("id") == sheets.SALES_HEADER_ROW, F.lit(text)).otherwise(F.lit("informe")).alias(f"c{n}")
            for n, text in enumerate(texts, start=1)
        ],
    )
    return top.unionByName(data)


@query("promote_header")
def _promote_header(spark, folder):
    sheet = sheets.promote_header(_raw_orders(spark, folder), sheets.SALES_HEADER_ROW)
    return sheet.toDF(*[name.strip().lower().replace(" ", "_") for name in sheet.columns])


@query("select_trimmed")
def _select_trimmed(spark, folder):
    sheet = sheets.promote_header(_raw_orders(spark, folder), sheets.SALES_HEADER_ROW)
    return sheets.select_trimmed(sheet, ("Numero", "Anulado", "Codigo Venta"), keep=("row_no",)).withColumnsRenamed(
        {"Codigo Venta": "codigo_venta", "Numero": "numero"}
    )


def _clean_orders(spark: SparkSession, folder: str) -> DataFrame:
    sheet = sheets.promote_header(_raw_orders(spark, folder), sheets.SALES_HEADER_ROW)
    filled = sheets.drop_blank_rows(sheet)
    return sheets.select_trimmed(filled, sheets.SALES_COLUMNS, keep=("row_no",))


@query("drop_blank_rows")
def _drop_blank_rows(spark, folder):
    return _clean_orders(spark, folder).withColumnsRenamed(
        {"Codigo Venta": "codigo_venta", "Serie": "serie", "Numero": "numero", "Cliente": "cliente"}
    )


@query("invoice_key")
def _invoice_key(spark, folder):
    keyed = sheets.invoice_key(_clean_orders(spark, folder), first="Codigo Venta")
    return keyed.select("row_no", F.col("Codigo Venta").alias("codigo_venta"), F.col("Factura").alias("factura"))


def _detail(spark: SparkSession, folder: str) -> DataFrame:
    """The lines as detail rows; returned ones have lost their order code, quantities come in halves."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    code = F.when(F.col("l_returnflag") == "R", F.lit("")).otherwise(F.col("l_orderkey").cast("string"))
    return lines.select(
        code.alias("Codigo Venta"), F.col("l_partkey").cast("string").alias("Codigo"), (F.col("l_quantity") / 2).alias("Cant")
    )


def _looked_up(spark: SparkSession, folder: str) -> DataFrame:
    size_star(spark, folder)
    header = sheets.invoice_key(_clean_orders(spark, folder), first="Codigo Venta")
    # A later row repeats every order under another invoice; the first one must win.
    again = header.withColumn("row_no", F.col("row_no") + 1_000_000_000_000).withColumn("Factura", F.lit("repetida"))
    return sheets.lookup_first(_detail(spark, folder), header.unionByName(again), "Codigo Venta", "Factura")


@query("lookup_first")
def _lookup_first(spark, folder):
    return _looked_up(spark, folder).select(
        F.col("Codigo Venta").alias("codigo_venta"), F.col("Codigo").alias("codigo"), F.col("Factura").alias("factura")
    )


@query("inventory_key_sales")
def _inventory_key_sales(spark, folder):
    keyed = sheets.inventory_key_sales(_looked_up(spark, folder), first="Codigo Venta")
    return keyed.select(
        F.col("Codigo Venta").alias("codigo_venta"), F.col("Cant").alias("cant"), F.col("Clave_Inventario").alias("clave_inventario")
    )


@query("inventory_key_movement")
def _inventory_key_movement(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        F.col("l_suppkey").alias("almacen"),
        F.col("l_returnflag").alias("Serie"),
        F.col("l_orderkey").alias("NroDoc"),
        F.col("l_partkey").alias("Código"),
        (F.col("l_quantity") / 2).alias("Cantidad"),
    )
    keyed = sheets.inventory_key_movement(lines, first="almacen")
    return keyed.select("almacen", F.col("Clave_Inventario").alias("clave_inventario"))


@query("normalize_cells")
def _normalize_cells(spark, folder):
    return sheets.normalize_cells(spark.read.parquet(f"{folder}/events.parquet"))


@query("incremental_append")
def _incremental_append(spark, folder):
    """Two drops of events stream into a table; a third run finds nothing new. The table is read."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    root = scratch(spark, "append")
    for drop in (F.col("event_id") % 3 == 0, F.coalesce(F.col("event_id") % 3 != 0, F.lit(True)), None):
        if drop is not None:
            events.where(drop).write.mode("append").parquet(f"{root}/drops")
        append_stream(spark, f"{root}/drops", events.schema, f"{root}/sink", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/sink")


@query("append_rows")
def _append_rows(spark, folder):
    """The batch form: the sink holds the first rows, the rest is appended, a further call appends nothing."""
    events = spark.read.parquet(f"{folder}/events.parquet").withColumn("row_no", F.col("event_id") + 1)
    sink = f"{scratch(spark, 'append')}/sink"
    events.where("row_no <= 1000").write.parquet(sink)
    for _ in range(2):
        append_new(events, sink)
    return sheets.normalize_cells(spark.read.parquet(sink).drop("row_no"))


@query("csv_rows")
def _csv_rows(spark, folder):
    """Events as CSV files with quotes and line breaks in a cell, numbered on reading; the numbers feed the append."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    note = F.concat(F.lit('"'), "event_type", F.lit('", '), "props", F.lit("\nfin"))
    root = scratch(spark, "csv")
    rows = events.select(F.col("event_id").cast("string"), note.alias("nota"), F.col("user_id").cast("string"))
    options = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    rows.orderBy(events["event_id"]).write.options(**options).csv(f"{root}/sheet")
    sheet = read_cells(spark, f"{root}/sheet", 3)
    for part in (sheet.where("row_no <= 1000"), sheet, sheet):
        append_new(part, f"{root}/sink")
    names = {"c1": "event_id", "c2": "nota", "c3": "user_id"}
    return spark.read.parquet(f"{root}/sink").withColumnsRenamed(names)


@query("transactional_append")
def _transactional_append(spark, folder):
    """Two drops of two tables; the second drop of the orders fails. The rows each ledger names, with the last report."""
    root, drops = scratch(spark, "append"), {}
    for name, key in (("events", "event_id"), ("orders", "o_orderkey")):
        table = spark.read.parquet(f"{folder}/{name}.parquet").select(F.col(key).cast("bigint").alias("clave"))
        drops[name] = [table.where(F.coalesce(first, F.lit(False))) for first in (F.col("clave") % 3 == 0, F.col("clave") % 3 != 0)]
    schema = drops["events"][0].schema
    odd = F.when(F.col("clave") % 3 == 0, F.col("clave")).otherwise(F.raise_error(F.lit("fila no valida")).cast("bigint"))
    changes = {"events": lambda df: df, "orders": lambda df: df.select(odd.alias("clave"))}
    for number in (0, 1, None):
        for name, parts in drops.items():
            if number is not None:
                parts[number].write.parquet(f"{root}/{name}/drops/{number}")
        jobs = {
            name: lambda name=name: append_source(spark, f"{root}/{name}/drops/*", schema, f"{root}/{name}/sink", changes[name])
            for name in drops
        }
        report = sync_report(spark, jobs)
    for name in drops:
        compact(spark, f"{root}/{name}/sink", schema, least=2)
    states = report.select(F.col("fuente").alias("de"), "estado")
    rows = [read_committed(spark, f"{root}/{name}/sink", schema).select(F.lit(name).alias("fuente"), "clave") for name in drops]
    both = rows[0].unionByName(rows[1])
    return both.join(states, F.col("fuente") == F.col("de")).select("fuente", "clave", "estado")


@query("cost_by_occurrence")
def _cost_by_occurrence(spark, folder):
    """Sales lines with the cost of the movement that is the same occurrence of their key; some sides lack a partner."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    place = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    code, quantity = (F.col("l_partkey") % 50).cast("string"), F.col("l_quantity") / 2
    sold = lines.where("l_orderkey % 4 <> 0").select(
        place.alias("venta"), F.concat_ws("-", "l_returnflag", "l_linenumber").alias("Factura"), code.alias("Codigo"), quantity.alias("Cant")
    )
    moved = lines.where("l_orderkey % 3 <> 0").select(
        place.alias("movimiento"),
        F.col("l_returnflag").alias("Serie"),
        F.col("l_linenumber").alias("NroDoc"),
        code.alias("Código"),
        quantity.alias("Cantidad"),
        F.col("l_extendedprice").alias("costo"),
    )
    left = sheets.inventory_key_sales(sold, first="venta").withColumnRenamed("Clave_Inventario", "clave")
    right = sheets.inventory_key_movement(moved, first="movimiento").withColumnRenamed("Clave_Inventario", "clave")
    found = match_occurrences(left, right, "clave", ["venta"], ["movimiento", "costo"], ["venta"], ["movimiento", "costo"])
    return found.withColumns({c: F.col(c).cast("string") for c in ("venta", "movimiento")})


@query("page_from_index")
def _page_from_index(spark, folder):
    """The third page of the product list from its order index."""
    index = OrderIndex(spark, scratch(spark, "product-pages"))
    order = [F.desc("venta_neta"), F.asc("producto"), F.asc("marca_producto"), F.asc("nombre_tipo_bebida")]
    index.write(products.productos_detalle(sales_table(spark, folder)), order, block_rows=128)
    return index.page(3, 100)


@query("search_from_index")
def _search_from_index(spark, folder):
    """Products with a text in their name or brand, from the substring index."""
    index = SubstringIndex(spark, scratch(spark, "product-search"), ["producto", "marca_producto"])
    index.write(products.productos_detalle(sales_table(spark, folder)))
    return index.search("BRAND#1").unionByName(index.search("Widget")).distinct()
