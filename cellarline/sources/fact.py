"""The sales fact (one row per sold line) and the frames derived from it.

The raw model is a star: lines, orders, customers, parts, suppliers, nations. ``sales_fact`` joins it on
plain equality and leaves each join's strategy to Spark: a side is broadcast only below
``spark.sql.autoBroadcastJoinThreshold``, larger ones are sort-merge joined with skew splitting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellarline.config import DEFAULT_EXCHANGE_RATE

STAR_TABLES = ("lineitem", "orders", "customer", "part", "supplier", "nation")

SALES_SCHEMA = T.StructType(
    [
        T.StructField("cod_venta", T.LongType()),
        T.StructField("cliente", T.StringType()),
        T.StructField("fecha", T.DateType()),
        T.StructField("mes", T.LongType()),
        T.StructField("producto", T.StringType()),
        T.StructField("marca_producto", T.StringType()),
        T.StructField("nombre_tipo_bebida", T.StringType()),
        T.StructField("pais_origen_producto", T.StringType()),
        T.StructField("vendedor", T.StringType()),
        T.StructField("cantidad", T.LongType()),
        T.StructField("venta_neta_mn", T.DecimalType(18, 4)),
        T.StructField("costo_mn_total", T.DecimalType(18, 4)),
        T.StructField("margen_mn", T.DecimalType(18, 4)),
        T.StructField("estado_pedido", T.StringType()),
        T.StructField("anno", T.LongType()),
    ]
)

LEDGER_COLUMNS = (
    "nro_cta", "nombre_cuenta", "ejercicio", "periodo", "mto_debe", "mto_haber", "fec_mov", "reg_ctb",
    "glosa", "tip_doc", "nro_doc", "cliente", "proveedor", "mda_origen",
)


def read_star(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in STAR_TABLES}


def sales_fact(tables: dict[str, DataFrame], cost_rate: str = "0.6") -> DataFrame:
    """Join the star to one row per sold line with the columns of ``SALES_SCHEMA``.

    Money is exact: the inputs are cast to decimal before they are multiplied, and the results fit
    decimal(18,4), which Spark keeps as a long. Unit cost is ``cost_rate`` of the list price.
    """
    lines = tables["lineitem"].select(
        "l_orderkey", "l_partkey", "l_suppkey",
        F.col("l_quantity").cast("bigint").alias("cantidad"),
        (F.col("l_extendedprice").cast("decimal(12,2)") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)")))
        .cast("decimal(18,4)").alias("venta_neta_mn"),
    )
    orders = tables["orders"].select(
        F.col("o_orderkey").alias("cod_venta"),
        "o_custkey",
        F.col("o_orderdate").cast("date").alias("fecha"),
        F.col("o_orderstatus").alias("estado_pedido"),
    )
    customers = tables["customer"].select("c_custkey", F.col("c_name").alias("cliente"))
    parts = tables["part"].select(
        "p_partkey",
        F.col("p_name").alias("producto"),
        F.col("p_brand").alias("marca_producto"),
        F.col("p_type").alias("nombre_tipo_bebida"),
        (F.lit(cost_rate).cast("decimal(2,1)") * F.col("p_retailprice").cast("decimal(12,2)")).alias("_unit_cost"),
    )
    sellers = tables["supplier"].select("s_suppkey", "s_nationkey", F.col("s_name").alias("vendedor"))
    nations = tables["nation"].select("n_nationkey", F.col("n_name").alias("pais_origen_producto"))
    # Orders meet their customer first, which shuffles the narrow orders by customer and not the lines. The lines meet
    # the smallest dimension first and their orders last: so the lines of an order are written together, and whoever
    # groups them by order later combines them before the shuffle.
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    joined = (
        lines.join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(placed, F.col("l_orderkey") == F.col("cod_venta"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    )
    cost = (F.col("_unit_cost") * F.col("cantidad").cast("decimal(6,0)")).cast("decimal(18,4)")
    priced = joined.withColumn("costo_mn_total", cost)
    shaped = (
        priced.withColumn("margen_mn", (F.col("venta_neta_mn") - F.col("costo_mn_total")).cast("decimal(18,4)"))
        .withColumn("anno", F.year("fecha").cast("bigint"))
        .withColumn("mes", F.month("fecha").cast("bigint"))
    )
    return shaped.select(*SALES_SCHEMA.names)


def guarded(sales: DataFrame) -> DataFrame:
    """Only lines with an origin country."""
    country = F.col("pais_origen_producto")
    return sales.filter(country.isNotNull() & (country != ""))


def in_year(sales: DataFrame, anno: int | None) -> DataFrame:
    """Lines of one year; None or 0 keeps all. On a fact partitioned by year this prunes folders."""
    return sales.filter(F.col("anno") == anno) if anno else sales


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.lower() for name in df.columns])


def with_exchange_rate(sales: DataFrame, header: DataFrame, default: float = DEFAULT_EXCHANGE_RATE) -> DataFrame:
    """Left join the order header on the order id and bring its exchange rate.

    A missing or unreadable rate becomes ``default``. A header that repeats an order repeats its lines, as
    a left join does; the segment operators therefore do not use this.
    """
    rates = header.select(
        F.col("cod_venta"), F.col("tipo_cambio_venta").cast("string").try_cast("double").alias("_rate")
    )
    joined = sales.join(rates, "cod_venta", "left")
    return joined.withColumn("tc", F.coalesce("_rate", F.lit(default))).drop("_rate")


def with_vintage_names(sales: DataFrame) -> DataFrame:
    """Append the sale year to the product name, as catalogs that list each vintage on its own do."""
    return sales.withColumn("producto", F.concat_ws(" ", "producto", F.col("anno").cast("string")))


def order_header(tables: dict[str, DataFrame]) -> DataFrame:
    """Order header with a textual exchange rate; some rates are unreadable text."""
    key = F.col("o_orderkey")
    rate = (F.lit(350) + F.pmod(key, F.lit(50))).cast("decimal(7,2)") / F.lit(100).cast("decimal(3,0)")
    text = F.when(F.pmod(key, F.lit(10)) == 0, F.lit("n/d")).otherwise(rate.cast("decimal(5,2)").cast("string"))
    return tables["orders"].select(key.alias("cod_venta"), text.alias("tipo_cambio_venta"))


#: Account, name, and the amounts of its debit and credit. Of every line, of a line of a finished order, and opening rows
#: of January lines.
_OF_LINE = (
    ("1212", "Facturas por cobrar", "venta", None),
    ("7011", "Ventas de mercaderías", None, "venta"),
    ("6911", "Costo de ventas", "costo", None),
    ("2011", "Mercaderías", None, "costo"),
)
_OF_FINISHED = (("10", "Efectivo", "venta", None),)
_OF_JANUARY = (("1212", "Facturas por cobrar", "venta", None), ("6911", "Costo de ventas", "costo", None))


def ledger(sales: DataFrame) -> DataFrame:
    """Journal entries of the sold lines, built without a shuffle.

    A line debits receivables and credits revenue with the sale, debits cost of sales and credits stock
    with the cost; a finished order also debits cash. January lines leave period-0 (opening) rows.

    The lines are read once, and each meets one of four constant lists of entries. A filter on the year prunes the fact's
    folders, one on the account comes before amounts and texts are made, and only the columns asked for are read.
    """
    sale, cost, month = F.col("venta_neta_mn"), F.col("costo_mn_total"), F.col("mes")
    finished, january = F.col("estado_pedido") == "F", month == 1

    def entries(plain: tuple, opening: tuple = ()) -> Column:
        fields = ("nro_cta", "nombre_cuenta", "_debe", "_haber")
        return F.array(
            *[
                F.struct(*[F.lit(v).cast("string").alias(f) for f, v in zip(fields, entry, strict=True)], F.lit(opens).alias("_apertura"))
                for kinds, opens in ((plain, False), (opening, True))
                for entry in kinds
            ]
        )

    of_line = (
        F.when(finished & january, entries(_OF_LINE + _OF_FINISHED, _OF_JANUARY))
        .when(finished, entries(_OF_LINE + _OF_FINISHED))
        .when(january, entries(_OF_LINE, _OF_JANUARY))
        .otherwise(entries(_OF_LINE))
    )
    needed = ("cod_venta", "cliente", "fecha", "mes", "vendedor", "venta_neta_mn", "costo_mn_total", "anno")
    book = sales.select(*needed, F.inline(of_line))

    def amount(kind: str) -> Column:
        nothing = F.lit(0).cast("decimal(18,4)")
        return F.when(F.col(kind) == "venta", sale).when(F.col(kind) == "costo", cost).otherwise(nothing)

    order = F.col("cod_venta").cast("string")
    columns = {
        "nro_cta": F.col("nro_cta"),
        "nombre_cuenta": F.col("nombre_cuenta"),
        "ejercicio": F.col("anno"),
        "periodo": F.when(F.col("_apertura"), F.lit(0)).otherwise(month).cast("bigint"),
        "mto_debe": amount("_debe"),
        "mto_haber": amount("_haber"),
        "fec_mov": F.col("fecha"),
        "reg_ctb": F.concat(F.lit("R-"), order),
        "glosa": F.concat(F.lit("Venta "), order),
        "tip_doc": F.lit("01"),
        "nro_doc": order,
        "cliente": F.when(F.col("nro_cta") != "2011", F.col("cliente")),
        "proveedor": F.col("vendedor"),
        "mda_origen": F.lit("PEN"),
    }
    return book.select(*[value.alias(name) for name, value in columns.items()])
