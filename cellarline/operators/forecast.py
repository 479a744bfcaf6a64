"""Forecast preparation, quantile forecasts per series, and reads of the forecast tables.

The built-in model is seasonal-naive where a series is longer than a season: the value one season earlier, with
P10/P50/P90 of the season-over-season changes around it. A shorter one gets exponential smoothing with a damped trend,
fitted over a small grid, and the quantiles of paths simulated from its own residuals. Both are Spark aggregates. Below
3 months there is nothing to fit: mean, 0 and mean x 1.5 + 1. A model of one's own runs through ``applyInPandas``, one
series per group; a series has one row per month, so a group is never larger than the calendar.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellarline.config import (
    DEFAULTS,
    MONTHS_ES,
    NO_BRAND,
    TAG_FORECAST,
    TAG_FORECAST_PLAIN,
    TAG_HISTORY,
    VINTAGE_PATTERN,
    Settings,
)
from cellarline.functions.exprs import money_sum, month_start, or_text, round_ratio
from cellarline.functions.frames import first_rows

# (values oldest first, horizon) -> three sequences of length horizon: P50, P10, P90.
Model = Callable[[Sequence[float], int], tuple[Sequence[float], Sequence[float], Sequence[float]]]

QUANTILES = (0.1, 0.5, 0.9)

FORECAST_TOTAL_SCHEMA = T.StructType(
    [
        T.StructField("periodo", T.DateType()),
        T.StructField("anno", T.LongType()),
        T.StructField("mes", T.LongType()),
        T.StructField("venta_real", T.DoubleType()),
        T.StructField("forecast", T.DoubleType()),
        T.StructField("fc_lo", T.DoubleType()),
        T.StructField("fc_hi", T.DoubleType()),
        T.StructField("tipo", T.StringType()),
    ]
)

FORECAST_PRODUCTS_SCHEMA = T.StructType(
    [
        T.StructField("producto", T.StringType()),
        T.StructField("marca", T.StringType()),
        T.StructField("periodo", T.DateType()),
        T.StructField("anno", T.LongType()),
        T.StructField("mes", T.LongType()),
        T.StructField("uds_real", T.DoubleType()),
        T.StructField("fc_uds", T.DoubleType()),
        T.StructField("fc_lo", T.DoubleType()),
        T.StructField("fc_hi", T.DoubleType()),
        T.StructField("mes_label", T.StringType()),
        T.StructField("tipo", T.StringType()),
    ]
)


def fc_serie_total(sales: DataFrame) -> DataFrame:
    """Monthly totals of the whole fact, one row per month in no order."""
    return sales.groupBy(month_start().alias("periodo"), "anno", "mes").agg(
        money_sum("venta_neta_mn", 2).alias("venta_neta"),
        money_sum("margen_mn", 2).alias("margen_neto"),
        F.sum("cantidad").alias("unidades"),
        F.count_distinct("cod_venta").alias("pedidos"),
    )


def strip_vintage(name: Column) -> Column:
    """Product name without its vintage: drop 1900 to 2049 at a word end, collapse spaces, trim.

    There is no boundary before the year, so it is also cut off the end of a longer number. A missing
    name becomes the text ``None``.
    """
    text = F.coalesce(name, F.lit("None"))
    without = F.regexp_replace(text, "(?U)" + VINTAGE_PATTERN, "")
    single = F.regexp_replace(without, r"(?U)\s{2,}", " ")
    return F.regexp_replace(single, r"(?U)^\s+|\s+$", "")


def _units_by_month(sales: DataFrame) -> DataFrame:
    """Units per (base product, brand, month) of the lines with units."""
    return sales.filter(F.col("cantidad") > 0).groupBy(
        strip_vintage(F.col("producto")).alias("producto"),
        or_text("marca_producto", NO_BRAND).alias("marca"),
        month_start().alias("periodo"),
        "anno",
        "mes",
    ).agg(F.sum("cantidad").alias("unidades"))


def _dominant(units: DataFrame) -> DataFrame:
    by_brand = units.groupBy("producto", "marca").agg(F.sum("unidades").alias("u"))
    least = F.min(F.struct((-F.col("u")).alias("minus"), F.col("marca")))
    top = by_brand.groupBy("producto").agg(least.alias("top"))
    return top.select("producto", F.col("top.marca").alias("marca"), (-F.col("top.minus")).alias("unidades_marca"))


def dominant_brand(sales: DataFrame) -> DataFrame:
    """Per base product the brand with most units; equal units go to the first brand by name."""
    return _dominant(_units_by_month(sales))


def fc_serie_productos(sales: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Monthly units per base product under its dominant brand, for products with enough months.

    The brand is found and the series summed from one (product, brand, month) aggregate, so the fact is
    read and shuffled once. The window counts the months of one product. The rows come in no order, as the
    forecast operators need none.
    """
    units = _units_by_month(sales)
    brands = _dominant(units).select("producto", "marca")
    series = units.groupBy("producto", "periodo", "anno", "mes").agg(F.sum("unidades").alias("unidades"))
    months = F.count("*").over(Window.partitionBy("producto"))
    long_enough = series.withColumn("_months", months).filter(F.col("_months") >= cfg.min_series_months)
    return long_enough.join(brands, "producto").select("producto", "marca", "periodo", "anno", "mes", "unidades")


def zero_fill_grid(series: DataFrame, calendar: DataFrame | None = None, last: str | None = None) -> DataFrame:
    """Every product's series over the whole month range, 0 for a missing month.

    The range is that of ``calendar`` (a frame with ``periodo``; by default the series itself). Each
    product's months go into one map, at most one entry per calendar month, and the range is laid over it;
    no product x month table has to be joined.
    """
    source = series if calendar is None else calendar
    span = source.agg(F.struct(F.min("periodo").alias("first"), F.max("periodo").alias("last"))).scalar()
    packed = series.groupBy("producto", "marca").agg(
        F.map_from_entries(F.collect_list(F.struct("periodo", F.col("unidades").cast("bigint")))).alias("_by_month"),
        F.max("periodo").alias("_last"),
    )
    months = F.sequence(span["first"], span["last"], F.expr("interval 1 month"))
    laid = packed.withColumn("periodo", F.explode(months))
    units = F.coalesce(F.try_element_at("_by_month", F.col("periodo")), F.lit(0).cast("bigint"))
    own = [] if last is None else [F.col("_last").alias(last)]
    return laid.select("producto", "marca", *own, "periodo", units.alias("unidades"))


# (level, trend, damping): the parameters that are tried; with equal errors the first one counts.
SMOOTHING = tuple((a, b, p) for a in (0.2, 0.5, 0.8) for b in (0.05, 0.2) for p in (0.8, 0.95))
LEAST_POINTS = 3


def _smoothed(y: Column, level: Column, trend: Column, damping: Column) -> Column:
    """Level, trend, squared error and residuals after a pass over the array ``y``; the first two points start it."""

    def step(state: Column, value: Column) -> Column:
        ahead = state["l"] + damping * state["b"]
        error = value - ahead
        return F.struct(
            (ahead + level * error).alias("l"),
            (damping * state["b"] + trend * error).alias("b"),
            (state["sse"] + error * error).alias("sse"),
            F.concat(state["e"], F.array(error)).alias("e"),
        )

    none = F.array().cast("array<double>")
    first = F.struct(F.element_at(y, 1).alias("l"), (F.element_at(y, 2) - F.element_at(y, 1)).alias("b"), F.lit(0.0).alias("sse"), none.alias("e"))
    return F.aggregate(F.slice(y, 2, F.size(y) - 1), first, step)


def _fitted(y: Column) -> Column:
    """The smoothing with the least squared error, with its parameters."""
    grid = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(v).alias(n) for n, v in zip("abp", row, strict=True)]) for i, row in enumerate(SMOOTHING)])

    def tried(g: Column) -> Column:
        return F.transform(
            F.array(_smoothed(y, g["a"], g["b"], g["p"])),
            lambda s: F.struct(s["sse"].alias("sse"), g["i"].alias("i"), s["l"].alias("l"), s["b"].alias("b"), s["e"].alias("e"), g.alias("g")),
        )

    return F.array_min(F.flatten(F.transform(grid, tried)))


def _simulated(fit: Column, horizon: int) -> Column:
    """For steps 1..horizon the sorted values of all paths; path k adds the residuals in turn, from the k-th on."""
    m = F.size(fit["e"])

    def path(k: Column) -> Column:
        def step(state: Column, h: Column) -> Column:
            ahead = state["l"] + fit["g"]["p"] * state["b"]
            error = F.get(fit["e"], F.pmod(k + h, m))
            return F.struct(
                (ahead + fit["g"]["a"] * error).alias("l"),
                (fit["g"]["p"] * state["b"] + fit["g"]["b"] * error).alias("b"),
                F.concat(state["y"], F.array(ahead + error)).alias("y"),
            )

        start = F.struct(fit["l"].alias("l"), fit["b"].alias("b"), F.array().cast("array<double>").alias("y"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(horizon - 1)), start, step)["y"]

    paths = F.transform(F.sequence(F.lit(0), m - 1), path)
    return F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda h: F.sort_array(F.transform(paths, lambda y: F.get(y, h))))


def _quantile_of(values: Column, q: float) -> Column:
    """Linear interpolation in a sorted array, as ``percentile`` does."""
    place = F.lit(q) * (F.size(values) - 1)
    low = F.floor(place).cast("int")
    below, above = F.get(values, low), F.get(values, F.least(low + 1, F.size(values) - 1))
    return below + (place - low) * (above - below)


def _native_quantiles(series: DataFrame, keys: list[str], value: str, horizon: int, season: int) -> DataFrame:
    own = Window.partitionBy(*keys).orderBy("periodo")
    y = F.col(value).cast("double")
    changes = series.select(*keys, "periodo", y.alias("y")).withColumn("_change", F.col("y") - F.lag("y", season).over(own))
    # One row per series; the collected list has one entry per month.
    fitted = changes.groupBy(*keys).agg(
        F.max("periodo").alias("ultimo"),
        F.count("*").alias("_n"),
        (F.sum("y") / F.count("*")).alias("_mean"),
        F.percentile("_change", F.array(*[F.lit(q) for q in QUANTILES])).alias("_q"),
        F.sort_array(F.collect_list(F.struct("periodo", "y"))).alias("_points"),
    )
    enough = F.col("_n") > season
    short = ~enough & (F.col("_n") >= LEAST_POINTS)
    values = F.transform("_points", lambda p: p["y"])
    fitted = fitted.withColumn("_fit", F.when(short, _fitted(values)))
    fitted = fitted.withColumn("_paths", F.when(short, _simulated(F.col("_fit"), horizon)))
    steps = fitted.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    at = (F.col("_n") - season + F.pmod(F.col("h") - 1, F.lit(season)) + 1).cast("int")
    base = F.when(enough, F.try_element_at("_points", at)["y"])
    reached = F.get("_paths", F.col("h") - 1)

    def quantile(position: int, few: Column) -> Column:
        level = F.when(enough, base + F.element_at("_q", position + 1)).when(short, _quantile_of(reached, QUANTILES[position])).otherwise(few)
        return F.greatest(F.lit(0.0), level)

    # Too few points to fit anything: mean, 0, mean * 1.5 + 1.
    mean = F.col("_mean")
    return steps.select(
        *keys,
        "ultimo",
        F.col("h").cast("bigint").alias("h"),
        quantile(1, mean).alias("forecast"),
        quantile(0, F.lit(0.0)).alias("fc_lo"),
        quantile(2, mean * 1.5 + 1.0).alias("fc_hi"),
    )


def _model_quantiles(series: DataFrame, keys: list[str], value: str, horizon: int, model: Model) -> DataFrame:
    types = {field.name: field.dataType.simpleString() for field in series.schema}
    schema = ", ".join(f"`{key}` {types[key]}" for key in keys)
    schema += ", ultimo date, h bigint, forecast double, fc_lo double, fc_hi double"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("periodo")
        values = group["_y"].tolist()
        if len(values) < LEAST_POINTS:
            mean = sum(values) / len(values)
            mid, low, high = [mean] * horizon, [0.0] * horizon, [mean * 1.5 + 1] * horizon
        else:
            mid, low, high = model(values, horizon)
        out = pd.DataFrame({"h": range(1, horizon + 1), "forecast": mid, "fc_lo": low, "fc_hi": high})
        for name in ("forecast", "fc_lo", "fc_hi"):
            out[name] = out[name].astype(float).clip(lower=0.0)
        for key in keys:
            out[key] = group[key].iloc[0]
        out["ultimo"] = group["periodo"].iloc[-1]
        return out[[*keys, "ultimo", "h", "forecast", "fc_lo", "fc_hi"]]

    narrow = series.select(*keys, "periodo", F.col(value).cast("double").alias("_y"))
    return narrow.groupBy(*keys).applyInPandas(run, schema)


def forecast_quantiles(
    series: DataFrame,
    keys: Sequence[str],
    value: str,
    horizon: int | None = None,
    model: Model | None = None,
    cfg: Settings = DEFAULTS,
) -> DataFrame:
    """P50, P10 and P90 of each series in ``series`` for steps 1..horizon, all at least 0.

    Rows are in month order by ``periodo``; ``ultimo`` is the series' last month.
    """
    horizon = horizon or cfg.horizon
    if model is not None:
        return _model_quantiles(series, list(keys), value, horizon, model)
    return _native_quantiles(series, list(keys), value, horizon, cfg.season_length)


def _missing() -> Column:
    return F.lit(None).cast("double")


def forecast_total(
    series: DataFrame, horizon: int | None = None, model: Model | None = None, cfg: Settings = DEFAULTS
) -> DataFrame:
    """The monthly totals followed by the forecast months, with the columns of the total table."""
    past = series.select(
        "periodo", "anno", "mes", F.col("venta_neta").alias("venta_real"),
        _missing().alias("forecast"), _missing().alias("fc_lo"), _missing().alias("fc_hi"),
        F.lit(TAG_HISTORY).alias("tipo"),
    )
    one = series.withColumn("_all", F.lit(1))
    steps = forecast_quantiles(one, ["_all"], "venta_neta", horizon, model, cfg)
    month = F.add_months(F.trunc("ultimo", "month"), F.col("h").cast("int"))
    future = steps.withColumn("periodo", month).select(
        "periodo", F.year("periodo").cast("bigint").alias("anno"), F.month("periodo").cast("bigint").alias("mes"),
        _missing().alias("venta_real"),
        *[round_ratio(F.col(name), 2).alias(name) for name in ("forecast", "fc_lo", "fc_hi")],
        F.lit(TAG_FORECAST).alias("tipo"),
    )
    return past.unionByName(future)


def forecast_productos(
    series: DataFrame,
    calendar: DataFrame | None = None,
    horizon: int | None = None,
    model: Model | None = None,
    anchor: str = "product",
    cfg: Settings = DEFAULTS,
) -> DataFrame:
    """Every product's months followed by its forecast months, with the columns of the product table.

    The model sees the zero-filled series up to the last month of all. ``anchor="product"`` dates the
    forecast from the product's own last month with sales, ``"global"`` from the last month of all.
    """
    if anchor not in ("product", "global"):
        raise ValueError("anchor is 'product' or 'global'")

    def label() -> Column:
        names = F.array(*[F.lit(name) for name in MONTHS_ES])
        return F.concat_ws(" ", F.element_at(names, F.col("mes").cast("int")), F.col("anno").cast("string"))

    columns = FORECAST_PRODUCTS_SCHEMA.names
    past = series.select(
        "producto", "marca", "periodo", "anno", "mes", F.col("unidades").cast("double").alias("uds_real"),
        _missing().alias("fc_uds"), _missing().alias("fc_lo"), _missing().alias("fc_hi"),
        label().alias("mes_label"), F.lit(TAG_HISTORY).alias("tipo"),
    )
    # The own last month rides along as a key, so that the quantiles need no join to get it back.
    grid = zero_fill_grid(series, calendar, last="_own")
    steps = forecast_quantiles(grid, ["producto", "marca", "_own"], "unidades", horizon, model, cfg)
    start = F.col("_own") if anchor == "product" else F.col("ultimo")
    future = (
        steps.withColumn("periodo", F.add_months(F.trunc(start, "month"), F.col("h").cast("int")))
        .withColumn("anno", F.year("periodo").cast("bigint"))
        .withColumn("mes", F.month("periodo").cast("bigint"))
        .withColumn("uds_real", _missing())
        .withColumn("fc_uds", round_ratio(F.col("forecast"), 1))
        .withColumn("fc_lo", round_ratio(F.col("fc_lo"), 1))
        .withColumn("fc_hi", round_ratio(F.col("fc_hi"), 1))
        .withColumn("mes_label", label())
        .withColumn("tipo", F.lit(TAG_FORECAST))
    )
    return past.unionByName(future.select(*columns))


def read_forecast_total(table: DataFrame) -> DataFrame:
    return table.orderBy("periodo")


def read_forecast_productos(table: DataFrame, producto: str | None = None) -> DataFrame:
    """The product table in order, of one product if named."""
    found = table.filter(F.col("producto") == producto) if producto else table
    return found.orderBy("producto", "periodo")


def forecast_catalogo(table: DataFrame) -> DataFrame:
    """Distinct (brand, product) of the forecast rows.

    A table of the older layout has no brand; then all its products are listed without one.
    """
    if "marca" not in table.columns:
        pairs = table.select(F.lit(NO_BRAND).alias("marca"), "producto")
    else:
        forecast = table.filter(F.col("tipo").isin(TAG_FORECAST_PLAIN, TAG_FORECAST))
        pairs = forecast.select(or_text("marca", NO_BRAND).alias("marca"), "producto")
    return pairs.distinct().orderBy("marca", "producto")


def forecast_rollup_3m(table: DataFrame, limit: int | None = None) -> DataFrame:
    """Whole bottles per product over the horizon, products with most first, all or ``limit``; a null counts as 0."""

    def bottles(name: str) -> Column:
        return round_ratio(F.sum(F.coalesce(name, F.lit(0.0))), 0)

    by_product = table.groupBy("producto").agg(
        bottles("fc_uds").cast("bigint").alias("fc_uds"),
        bottles("fc_lo").cast("bigint").alias("fc_lo"),
        bottles("fc_hi").cast("bigint").alias("fc_hi"),
        F.sum(F.coalesce("fc_uds", F.lit(0.0))).alias("_exact"),
    )
    return first_rows(by_product.orderBy(F.desc(F.round("_exact", 6)), "producto"), limit).drop("_exact")
