"""Materialized views: a full refresh with each view on its own, and reads that prefer the written twin."""

from __future__ import annotations

import datetime as dt
import logging
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from cellarline.config import DEFAULTS, Settings
from cellarline.operators import customers, kpi, products, timeops
from cellarline.sources.storage import current_rows, point_to, read_table, write_truncate

BASE = "ventas_dashboard"
log = logging.getLogger(__name__)


def view_definitions(
    sales: DataFrame, as_of: dt.date | str | None = None, cfg: Settings = DEFAULTS
) -> dict[str, Callable[[], DataFrame]]:
    """The views by name, base first; each is built only when asked for."""
    return {
        BASE: lambda: sales,
        "kpi_global": lambda: kpi.kpi_global(sales),
        "serie_mensual": lambda: timeops.serie_mensual(sales),
        "dimension_pais": lambda: products.dim_pais(sales),
        "dimension_tipo": lambda: products.dim_tipo(sales),
        "dimension_marca": lambda: products.dim_marca(sales, limit=cfg.brand_limit),
        "top_clientes": lambda: customers.top_clientes(sales, as_of, cfg=cfg),
        "top_productos": lambda: products.top_productos(sales),
        "vendedores": lambda: products.vendedores(sales),
        "segmento_precio": lambda: products.segmento_precio_costo(sales, cfg),
        "margen_marca": lambda: products.margen_marca(sales, limit=cfg.brand_limit, cfg=cfg),
        "rfm": lambda: customers.rfm_basic(sales, as_of, cfg=cfg),
        "estacionalidad": lambda: timeops.estacionalidad(sales, cfg),
        "kpi_ytd": lambda: kpi.kpi_ytd(sales, as_of),
        "top_clientes_anno": lambda: customers.top_clientes_anno_mat(sales, as_of),
    }


def twin_path(root: str, view: str) -> str:
    return f"{root}/tb_cache_{view}"


def materialize_views(
    sales: DataFrame,
    root: str,
    as_of: dt.date | str | None = None,
    cfg: Settings = DEFAULTS,
    only: tuple[str, ...] | None = None,
    base_path: str | None = None,
    at_once: int = 4,
) -> list[tuple[str, str, str, float]]:
    """Write the views under ``root`` and return (view, path, "ok" or the error, seconds) per view.

    The base is written first and the others read the written copy; ``base_path`` names a copy of ``sales``
    that is already there and is then not written again. The other views do not depend on each other:
    ``at_once`` of them are handed to Spark together, so that small ones do not leave the executors idle.
    A view that fails leaves the others alone, and its readers on its last finished rows; the message is logged.
    """
    spark = sales.sparkSession

    def refresh(view: str, build: Callable[[], DataFrame]) -> tuple[str, str, str, float]:
        path, start = twin_path(root, view), time.perf_counter()
        try:
            write_truncate(build(), path, partition_by=("anno",) if view == BASE else ())
            state = "ok"
        except Exception as error:
            state = f"error: {type(error).__name__}"
            log.warning("%s was not refreshed: %s", view, error)
        return view, path, state, time.perf_counter() - start

    report = []
    if only is None or BASE in only:
        if base_path is None:
            report.append(refresh(BASE, lambda: sales))
        else:
            # The twin points to the copy that is there.
            point_to(spark, twin_path(root, BASE), base_path)
            report.append((BASE, twin_path(root, BASE), "ok", 0.0))
        if report[0][2] == "ok":
            sales = read_table(spark, report[0][1], sales.schema)
    views = {
        view: build
        for view, build in view_definitions(sales, as_of, cfg).items()
        if view != BASE and (only is None or view in only)
    }
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        report += pool.map(refresh, views, views.values())
    return report


def resolve_materialized(
    view: str, sales: DataFrame, root: str, as_of: dt.date | str | None = None, cfg: Settings = DEFAULTS
) -> DataFrame:
    """The written twin of ``view`` if there is one, else the view computed."""
    written = written_twin(sales.sparkSession, root, view)
    return view_definitions(sales, as_of, cfg)[view]() if written is None else written


def written_twin(spark: SparkSession, root: str, view: str) -> DataFrame | None:
    """The rows of the last finished refresh of ``view``; a refresh under way or broken off is not seen."""
    rows = current_rows(spark, twin_path(root, view))
    return None if rows is None else spark.read.parquet(rows)
