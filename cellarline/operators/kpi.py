"""Key figures: whole history, by year, year to date, and change against the year before."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellarline.functions.exprs import as_python_date, exact_sum, money_sum, percent, round_ratio, safe_div

METRICS = ("venta_neta", "margen", "pct_margen", "unidades", "clientes", "pedidos", "pedido_promedio")
_COUNTS = ("clientes", "pedidos")


def _figures(names: dict[str, str] | None = None) -> list[Column]:
    """The seven aggregates, evaluated together in one pass."""
    names = names or {}
    orders = F.count_distinct("cod_venta")
    columns = {
        "venta_neta": money_sum("venta_neta_mn"),
        "margen": money_sum("margen_mn"),
        "pct_margen": percent(exact_sum("margen_mn"), exact_sum("venta_neta_mn")),
        "unidades": F.sum("cantidad"),
        "clientes": F.count_distinct("cliente"),
        "pedidos": orders,
        "pedido_promedio": round_ratio(safe_div(exact_sum("venta_neta_mn"), orders), 0),
    }
    return [expr.alias(names.get(name, name)) for name, expr in columns.items()]


def kpi_global(sales: DataFrame) -> DataFrame:
    """One row of key figures over the whole fact."""
    view_names = {
        "venta_neta": "venta_neta_total",
        "margen": "margen_neto_total",
        "pct_margen": "pct_margen_bruto",
        "unidades": "unidades_total",
        "clientes": "clientes_activos",
        "pedidos": "num_pedidos",
        "pedido_promedio": "aov",
    }
    return sales.agg(*_figures(view_names))


def of_two_years(rows: DataFrame, anno: int, cut: str | None) -> DataFrame:
    """The ``rows`` (with ``anno`` and ``fecha``) of ``anno`` and of the year before, each up to the month and day ``cut``."""
    wanted = rows.filter(F.col("anno").isin(anno - 1, anno))
    if cut is not None:
        # The date range beside the month-day test lets the scan skip row groups.
        first, last = f"{anno - 1}-01-01", f"{anno}-{cut}"
        wanted = wanted.filter(F.col("fecha").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
        wanted = wanted.filter(F.date_format("fecha", "MM-dd") <= cut)
    return wanted


def paired(by_year: DataFrame, anno: int) -> DataFrame:
    """One row: the figures of ``anno`` and of the year before as two structs."""
    packed = F.struct(*METRICS)
    return by_year.agg(
        F.max(F.when(F.col("anno") == anno, packed)).alias("current"),
        F.max(F.when(F.col("anno") == anno - 1, packed)).alias("previous"),
    )


def _two_years(sales: DataFrame, anno: int, cut: str | None) -> DataFrame:
    """``paired`` over the fact.

    Grouping by year needs one expansion per distinct count, where conditional distinct counts would need
    one per year and count. The second aggregate sees at most two rows.
    """
    return paired(of_two_years(sales, anno, cut).groupBy("anno").agg(*_figures()), anno)


def _metric(side: str, name: str) -> Column:
    """A year without rows has zero counts and null sums, as an aggregate over nothing."""
    value = F.col(f"{side}.{name}")
    return F.coalesce(value, F.lit(0).cast("bigint")) if name in _COUNTS else value


def cut_of(anno: int, as_of: dt.date) -> str | None:
    return as_of.strftime("%m-%d") if anno == as_of.year else None


def kpi_year(sales: DataFrame, anno: int | None, as_of: dt.date | str | None = None) -> DataFrame:
    """Two rows, ``anno`` and the year before; the running year is compared up to the same day.

    Without a year (None or 0) there is one row over all years, under year 0.
    """
    if not anno:
        whole = [F.lit("current").alias("periodo"), F.lit(0).cast("bigint").alias("anno")]
        return sales.agg(*_figures()).select(*whole, *METRICS)
    return year_rows(_two_years(sales, anno, cut_of(anno, as_python_date(as_of))), anno)


def year_rows(both: DataFrame, anno: int) -> DataFrame:
    """Two rows from a ``paired`` one."""
    sides = [
        F.struct(
            F.lit(side).alias("periodo"),
            F.lit(year).cast("bigint").alias("anno"),
            *[_metric(side, name).alias(name) for name in METRICS],
        )
        for side, year in (("current", anno), ("previous", anno - 1))
    ]
    return both.select(F.inline(F.array(*sides)))


def kpi_ytd(sales: DataFrame, as_of: dt.date | str | None = None) -> DataFrame:
    """One row with the year-to-date figures and, suffixed ``_prev``, those of the year before."""
    day = as_python_date(as_of)
    return ytd_row(_two_years(sales, day.year, day.strftime("%m-%d")), day)


def ytd_row(both: DataFrame, day: dt.date) -> DataFrame:
    """The year-to-date row from a ``paired`` one."""
    return both.select(
        F.lit(day.year).cast("bigint").alias("anno"),
        F.lit(day.isoformat()).alias("fecha_corte"),
        *[_metric("current", name).alias(name) for name in METRICS],
        *[_metric("previous", name).alias(f"{name}_prev") for name in METRICS],
    )


def kpi_yoy_delta(sales: DataFrame, anno: int, as_of: dt.date | str | None = None) -> DataFrame:
    """Per metric the change against the year before, absolute and in %, and its direction.

    Without a previous value, or with zero, there is no change in % and the direction is ``neutral``.
    """
    both = _two_years(sales, anno, cut_of(anno, as_python_date(as_of)))
    rows = [
        F.struct(
            F.lit(name).alias("metrica"),
            _metric("current", name).cast("double").alias("actual"),
            _metric("previous", name).cast("double").alias("anterior"),
        )
        for name in METRICS
    ]
    long = both.select(F.inline(F.array(*rows)))
    now, before = F.coalesce("actual", F.lit(0.0)), F.col("anterior")
    missing = before.isNull() | (before == 0)
    return long.select(
        "metrica",
        "actual",
        "anterior",
        (F.col("actual") - before).alias("delta"),
        F.when(~missing, percent(now - before, before)).alias("delta_pct"),
        F.when(missing, "neutral").when(now >= before, "up").otherwise("down").alias("direccion"),
    )
