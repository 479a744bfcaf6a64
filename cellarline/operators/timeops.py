"""Monthly series, seasonality, month-over-year comparison and the year window."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellarline.config import DEFAULTS, Settings
from cellarline.functions.exprs import (
    as_python_date,
    exact_sum,
    first_match,
    money_sum,
    month_start,
    percent,
    round_ratio,
    safe_div,
)
from cellarline.sources.fact import in_year


def serie_mensual(sales: DataFrame, anno: int | None = None) -> DataFrame:
    """One row per month: revenue, margin, units, orders and average order value."""
    monthly = in_year(sales, anno).groupBy("anno", "mes").agg(
        money_sum("venta_neta_mn", 2).alias("venta_neta"),
        money_sum("margen_mn", 2).alias("margen_neto"),
        F.sum("cantidad").alias("unidades"),
        F.count_distinct("cod_venta").alias("pedidos"),
        exact_sum("venta_neta_mn").alias("_exact"),
    )
    period = month_start()
    return monthly.select(
        period.alias("periodo"),
        "anno",
        "mes",
        F.date_format(period, "MMM yyyy").alias("periodo_label"),
        "venta_neta",
        "margen_neto",
        "unidades",
        "pedidos",
        round_ratio(safe_div(F.col("_exact"), F.col("pedidos")), 2).alias("aov"),
    ).orderBy("periodo")


def monthly_revenue(sales: DataFrame) -> DataFrame:
    """Revenue per month with cents."""
    monthly = sales.groupBy("anno", "mes").agg(exact_sum("venta_neta_mn").alias("_exact"))
    return monthly.select("anno", "mes", F.round("_exact", 2).cast("double").alias("venta"))


def _seasonal(sales: DataFrame, cfg: Settings) -> DataFrame:
    # The window sees the twelve months of a year, after aggregation.
    monthly = sales.groupBy("anno", "mes").agg(money_sum("venta_neta_mn").alias("venta_mes"))
    mean = F.avg("venta_mes").over(Window.partitionBy("anno"))
    ratio = F.col("_ratio")
    return monthly.withColumn("_ratio", safe_div(F.col("venta_mes"), mean)).select(
        "anno",
        "mes",
        F.date_format(month_start(), "MMM").alias("mes_label"),
        "venta_mes",
        round_ratio(ratio * 100.0, 0).alias("indice_estacional"),
        first_match([(ratio > limit, text) for limit, text in cfg.season_levels], cfg.season_rest).alias("nivel"),
    )


def estacionalidad(sales: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Month revenue against the mean month of its year, as index and level."""
    return _seasonal(sales, cfg).orderBy("anno", "mes")


def estacionalidad_matrix(sales: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Seasonal index with one row per year, latest first, and columns m01..m12; 0 for a missing month."""
    index = _seasonal(sales, cfg)
    matrix = index.groupBy("anno").pivot("mes", list(range(1, 13))).agg(F.first("indice_estacional"))
    months = [F.coalesce(F.col(f"`{m}`"), F.lit(0.0)).alias(f"m{m:02d}") for m in range(1, 13)]
    return matrix.select("anno", *months).orderBy(F.desc("anno"))


def yoy_mensual(sales: DataFrame, anno: int) -> DataFrame:
    """Revenue of each month of ``anno`` beside the same month of the year before."""
    pair = sales.filter(F.col("anno").isin(anno - 1, anno))
    monthly = pair.groupBy("mes").agg(
        money_sum(F.when(F.col("anno") == anno, F.col("venta_neta_mn")), 2).alias("venta_actual"),
        money_sum(F.when(F.col("anno") == anno - 1, F.col("venta_neta_mn")), 2).alias("venta_anterior"),
    )
    change = F.col("venta_actual") - F.col("venta_anterior")
    return monthly.select(
        "mes",
        F.date_format(F.make_date(F.lit(anno), F.col("mes").cast("int"), F.lit(1)), "MMM").alias("mes_label"),
        "venta_actual",
        "venta_anterior",
        percent(change, F.col("venta_anterior")).alias("delta_pct"),
    ).orderBy("mes")


def margen_marca_anno(sales: DataFrame, annos: Sequence[int] | None = None) -> DataFrame:
    """Margin % per brand with one column ``margen_<year>`` for each of ``annos``, or for every year there is.

    Years that are given save the small job that finds them.
    """
    if annos is None:
        annos = [row["anno"] for row in sales.select("anno").where("anno IS NOT NULL").distinct().orderBy("anno").collect()]
    yearly = sales.filter(F.col("anno").isin(*annos)).groupBy("marca_producto", "anno").agg(
        percent(exact_sum("margen_mn"), exact_sum("venta_neta_mn")).alias("pct")
    )
    matrix = yearly.groupBy("marca_producto").pivot("anno", list(annos)).agg(F.first("pct"))
    columns = [F.col(f"`{year}`").alias(f"margen_{year}") for year in annos]
    return matrix.select("marca_producto", *columns).orderBy("marca_producto")


def year_window(sales: DataFrame, as_of: dt.date | str | None = None) -> DataFrame:
    """Lines of the running year and the year before, labelled ``Current`` and ``Previous``."""
    year = as_python_date(as_of).year
    label = first_match([(F.col("anno") == year, "Current"), (F.col("anno") == year - 1, "Previous")], "Older")
    return sales.filter(F.col("anno") >= year - 1).withColumn("temporalidad", label)
