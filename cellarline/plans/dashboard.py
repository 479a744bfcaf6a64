"""The frames of the first page."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarline.config import DEFAULTS, Settings
from cellarline.operators import customers, kpi, products, timeops
from cellarline.sources.fact import guarded


def dashboard_bundle(
    sales: DataFrame, anno: int, as_of: dt.date | str | None = None, cfg: Settings = DEFAULTS
) -> dict[str, DataFrame]:
    """The twelve frames by section name; none is computed before it is read.

    The key figures use the guarded fact, the others the whole one. The limits are fixed values.
    """
    return {
        "kpis": kpi.kpi_year(guarded(sales), anno, as_of),
        "serie": timeops.serie_mensual(sales, anno),
        "pais": products.dim_pais(sales, limit=10),
        "tipo": products.dim_tipo(sales),
        "marca": products.dim_marca(sales, limit=cfg.brand_limit),
        "top_cli": customers.top_clientes(sales, as_of, limit=500, cfg=cfg),
        "top_prd": products.top_productos(sales, limit=6),
        "vendedores": products.vendedores(sales),
        "segmentos": products.segmento_precio_costo(sales, cfg),
        "margenes": products.margen_marca(sales, limit=cfg.brand_limit, cfg=cfg),
        "rfm": customers.rfm_basic(sales, as_of, limit=8, cfg=cfg),
        "heat": timeops.estacionalidad(sales, cfg),
    }


def long_rows(frames: dict[str, DataFrame]) -> DataFrame:
    """All frames as rows (section, key, measure, value): texts, dates and year and month are the key."""
    parts = []
    for name, df in frames.items():
        keys = [c for c, kind in df.dtypes if kind in ("string", "date") or c in ("anno", "mes")]
        pairs = [
            F.struct(F.lit(c).alias("medida"), F.col(c).cast("double").alias("valor")) for c in df.columns if c not in keys
        ]
        clave = F.concat_ws("|", *[F.col(c).cast("string") for c in keys]).alias("clave")
        parts.append(df.select(F.lit(name).alias("seccion"), clave, F.inline(F.array(*pairs))))
    return reduce(DataFrame.unionByName, parts)
