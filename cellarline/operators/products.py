"""Dimensions, shares, rankings, margins and price bands of products, brands, origins and sellers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarline.config import DEFAULTS, NO_BRAND, NO_ORIGIN, NO_TYPE, Settings
from cellarline.functions.exprs import exact_sum, first_match, money_sum, or_text, percent, round_ratio, safe_div, whole_sum
from cellarline.functions.frames import first_rows, page, rank_rows, totals
from cellarline.sources.fact import in_year

SALE, MARGIN = "venta_neta_mn", "margen_mn"


def _margin_pct() -> Column:
    return percent(exact_sum(MARGIN), exact_sum(SALE))


def dim_pais(sales: DataFrame, anno: int | None = None, limit: int | None = None) -> DataFrame:
    """Revenue, margin, units, orders and customers per origin country."""
    by_country = in_year(sales, anno).groupBy("pais_origen_producto").agg(
        money_sum(SALE).alias("venta_neta"),
        money_sum(MARGIN).alias("margen_neto"),
        F.sum("cantidad").alias("unidades"),
        F.count_distinct("cod_venta").alias("pedidos"),
        F.count_distinct("cliente").alias("clientes"),
    )
    ordered = by_country.orderBy(F.desc("venta_neta"), "pais_origen_producto")
    return ordered if limit is None else ordered.limit(limit)


def dim_tipo(sales: DataFrame, anno: int | None = None) -> DataFrame:
    """Revenue, units and share of all revenue per product type."""
    by_type = in_year(sales, anno).groupBy("nombre_tipo_bebida").agg(
        exact_sum(SALE).alias("_exact"), F.sum("cantidad").alias("unidades")
    )
    whole = totals(by_type, sale=F.sum("_exact"))
    return by_type.select(
        "nombre_tipo_bebida",
        F.round("_exact", 0).cast("double").alias("venta_neta"),
        "unidades",
        percent(F.col("_exact"), whole["sale"]).alias("pct_venta"),
    ).orderBy(F.desc("venta_neta"), "nombre_tipo_bebida")


def dim_marca(sales: DataFrame, anno: int | None = None, limit: int | None = None) -> DataFrame:
    """Brands by revenue: all of them, or the first ``limit`` (``Settings.brand_limit`` on the first page)."""
    by_brand = in_year(sales, anno).groupBy("marca_producto").agg(
        money_sum(SALE).alias("venta_neta"),
        money_sum(MARGIN).alias("margen_neto"),
        F.sum("cantidad").alias("unidades"),
    )
    return first_rows(by_brand.orderBy(F.desc("venta_neta"), "marca_producto"), limit)


def margen_marca(sales: DataFrame, limit: int | None = None, cfg: Settings = DEFAULTS, anno: int | None = None) -> DataFrame:
    """Brands above a revenue limit by margin %: all of them, or the first ``limit``."""
    by_brand = in_year(sales, anno).groupBy("marca_producto").agg(
        _margin_pct().alias("margen_pct"),
        money_sum(SALE).alias("venta_neta"),
        F.sum("cantidad").alias("unidades"),
        exact_sum(SALE).alias("_exact"),
    )
    kept = by_brand.filter(F.col("_exact") > cfg.brand_min_revenue).drop("_exact")
    return first_rows(kept.orderBy(F.desc("margen_pct"), "marca_producto"), limit)


def cost_banded(sales: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Lines with units and their band of unit cost as ``segmento``."""
    unit_cost = safe_div(F.col("costo_mn_total"), F.col("cantidad"))
    rules = [(unit_cost < limit, text) for limit, text in cfg.cost_bands if limit is not None]
    return sales.filter(F.col("cantidad") > 0).withColumn("segmento", first_match(rules, cfg.cost_bands[-1][1]))


def segmento_precio_costo(sales: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Units, share of volume, revenue and margin % per band of unit cost."""
    return band_shares(cost_banded(sales, cfg))


def band_shares(banded: DataFrame) -> DataFrame:
    """``segmento_precio_costo`` of lines, or of sums, that have their band."""
    by_band = banded.groupBy("segmento").agg(
        F.sum("cantidad").alias("unidades"), money_sum(SALE).alias("venta_neta"), _margin_pct().alias("margen_pct")
    )
    whole = totals(by_band, units=F.sum("unidades"))
    return by_band.select(
        "segmento", "unidades", percent(F.col("unidades"), whole["units"]).alias("pct_volumen"), "venta_neta", "margen_pct"
    ).orderBy("segmento")


def segmento_precio_venta(sales: DataFrame, anno: int | None = None, cfg: Settings = DEFAULTS) -> DataFrame:
    """Revenue and bottles per band of unit price; lines without units have no price and drop out.

    The limits are compared as decimals: revenue against limit x units decides the same as the price
    against the limit, without the division.
    """
    sale, units = F.col(SALE), F.col("cantidad")

    def scaled(limit: str) -> Column:
        return F.lit(limit).cast("decimal(12,2)") * F.abs(units).cast("decimal(10,0)")

    worth = F.when(units > 0, sale).otherwise(-sale)
    rules = [(worth < scaled(cfg.price_below[0]), 1)]
    rules += [
        ((worth >= scaled(low)) & (worth <= scaled(high)), position)
        for position, (low, high, _) in enumerate(cfg.price_between, start=2)
    ]
    last = len(rules) + 1
    texts = [cfg.price_below[1], *[text for *_, text in cfg.price_between], cfg.price_rest]
    priced = in_year(sales, anno).filter(units.isNotNull() & (units != 0) & sale.isNotNull())
    banded = priced.withColumn("orden", first_match(rules, last).cast("bigint"))
    by_band = banded.groupBy("orden").agg(money_sum(SALE).alias("venta_neta"), F.sum("cantidad").alias("botellas"))
    names = F.element_at(F.array(*[F.lit(text) for text in texts]), F.col("orden").cast("int"))
    return by_band.select(names.alias("segmento"), "orden", "venta_neta", "botellas").orderBy("orden")


def rentabilidad_origen(sales: DataFrame, anno: int | None = None) -> DataFrame:
    """Revenue, margin and units per country with positive revenue."""
    by_country = in_year(sales, anno).groupBy("pais_origen_producto").agg(
        money_sum(SALE).alias("venta_neta"), money_sum(MARGIN).alias("margen_neto"), F.sum("cantidad").alias("unidades")
    )
    return (
        by_country.filter(F.col("venta_neta") > 0)
        .select(or_text("pais_origen_producto", NO_ORIGIN).alias("pais"), "venta_neta", "margen_neto", "unidades")
        .orderBy(F.desc("margen_neto"), "pais")
    )


def market_share_tipo(sales: DataFrame, anno: int | None = None) -> DataFrame:
    """Share of each product type in its country's revenue.

    The country total counts all types, also those that the positive-revenue filter then drops. The window
    runs over the aggregate, whose groups are as large as the list of product types.
    """
    pairs = in_year(sales, anno).groupBy(
        or_text("pais_origen_producto", NO_ORIGIN).alias("pais"), or_text("nombre_tipo_bebida", NO_TYPE).alias("tipo")
    ).agg(exact_sum(SALE).alias("_exact"))
    country = F.sum("_exact").over(Window.partitionBy("pais"))
    return (
        pairs.withColumn("_country", country)
        .select(
            "pais",
            "tipo",
            F.round("_exact", 0).cast("double").alias("venta_neta"),
            percent(F.col("_exact"), F.col("_country")).alias("share_pct"),
        )
        .filter(F.col("venta_neta") > 0)
        .orderBy("pais", F.desc("share_pct"), "tipo")
    )


def dependencia_marca(sales: DataFrame, anno: int | None = None) -> DataFrame:
    """Per country its anchor brand and that brand's share of the country's positive brands.

    The anchor is the least (-revenue, brand), an aggregate that combines before the shuffle, so no task
    ever holds all brands of a country.
    """
    pairs = in_year(sales, anno).groupBy(
        or_text("pais_origen_producto", NO_ORIGIN).alias("pais"), or_text("marca_producto", NO_BRAND).alias("marca")
    ).agg(exact_sum(SALE).alias("_sale"))
    by_country = pairs.filter(F.col("_sale") > 0).groupBy("pais").agg(
        F.min(F.struct((-F.col("_sale")).alias("minus"), F.col("marca"))).alias("_top"), F.sum("_sale").alias("_total")
    )
    anchor = -F.col("_top.minus")
    return by_country.select(
        "pais",
        F.col("_top.marca").alias("marca_ancla"),
        F.round(anchor, 0).cast("double").alias("venta_ancla"),
        F.round("_total", 0).cast("double").alias("venta_total_pais"),
        percent(anchor, F.col("_total")).alias("dependencia_pct"),
    ).orderBy(F.desc("dependencia_pct"), "pais")


def brand_type_fit(sales: DataFrame, anno: int | None = None, cfg: Settings = DEFAULTS) -> DataFrame:
    """Share of each product type within the brands with most revenue.

    One scan: brand totals are summed from the (brand, type) aggregate, whose shuffle both uses share.
    """
    pairs = in_year(sales, anno).groupBy(
        or_text("marca_producto", NO_BRAND).alias("marca"), or_text("nombre_tipo_bebida", NO_TYPE).alias("tipo")
    ).agg(exact_sum(SALE).alias("_sale"))
    brands = pairs.groupBy("marca").agg(F.sum("_sale").alias("_brand")).filter(F.col("_brand") > 0)
    top = brands.orderBy(F.desc("_brand"), "marca").limit(cfg.fit_brands)
    # The broadcast side has at most cfg.fit_brands rows.
    return (
        pairs.join(F.broadcast(top), "marca")
        .select(
            "marca",
            "tipo",
            F.round("_sale", 0).cast("double").alias("venta_tipo"),
            percent(F.col("_sale"), F.col("_brand")).alias("share_pct"),
        )
        .filter(F.col("venta_tipo") > 0)
        .orderBy("marca", F.desc("share_pct"), "tipo")
    )


def productos_mix_pais(sales: DataFrame, anno: int | None = None, cfg: Settings = DEFAULTS) -> DataFrame:
    """Country profile (money, margin %, number of types and products) with a suggested action."""
    by_country = in_year(sales, anno).groupBy("pais_origen_producto").agg(
        money_sum(SALE).alias("venta_neta"),
        money_sum("costo_mn_total").alias("costo_total"),
        money_sum(MARGIN).alias("margen_neto"),
        _margin_pct().alias("pct_margen"),
        F.count_distinct("nombre_tipo_bebida").alias("lineas"),
        F.count_distinct("producto").alias("skus"),
    )
    rules, margin, revenue = cfg.origin, F.col("pct_margen"), F.col("venta_neta")
    action = first_match(
        [
            ((margin > rules.star_margin) & (revenue > rules.star_revenue), rules.star),
            ((margin > rules.good_margin) & (revenue > rules.mid_revenue), rules.consolidate),
            ((margin < rules.low_margin) & (revenue > rules.mid_revenue), rules.review),
            ((margin > rules.star_margin) & (revenue < rules.mid_revenue), rules.boost),
            ((F.col("skus") < rules.few_products) & (margin > rules.good_margin), rules.widen),
            (margin < rules.bad_margin, rules.restructure),
        ],
        rules.keep,
    )
    named = by_country.withColumnRenamed("pais_origen_producto", "pais").withColumn("pais", or_text("pais", NO_ORIGIN))
    return named.filter(revenue > 0).withColumn("accion", action).orderBy(F.desc("venta_neta"), "pais")


def _product_stats(sales: DataFrame) -> DataFrame:
    return sales.groupBy("producto", "nombre_tipo_bebida").agg(
        F.sum("cantidad").alias("unidades"),
        money_sum(SALE).alias("venta_neta"),
        money_sum(MARGIN).alias("margen_neto"),
        _margin_pct().alias("margen_pct"),
    )


def top_productos(sales: DataFrame, limit: int | None = None) -> DataFrame:
    """Products by units with their share of all units and rank; ``limit`` asks for the first ranks only."""
    stats = _product_stats(sales)
    whole = totals(stats, units=F.sum("unidades"))
    shared = stats.withColumn("pct_total_uds", percent(F.col("unidades"), whole["units"]))
    order = [F.desc("unidades"), F.asc("producto"), F.asc("nombre_tipo_bebida")]
    return rank_rows(shared, order, limit=limit)


def top_productos_year(sales: DataFrame, anno: int = 0, limit: int | None = None) -> DataFrame:
    """Products of a year (0: all) by revenue, all or the first ``limit``, with the number of products behind the list."""
    stats = in_year(sales, anno).groupBy(
        "producto", or_text("marca_producto", NO_BRAND).alias("marca"), or_text("nombre_tipo_bebida", NO_TYPE).alias("tipo")
    ).agg(money_sum(SALE).alias("venta_neta"), money_sum(MARGIN).alias("margen"), _margin_pct().alias("pct_margen"))
    whole = totals(stats, rows=F.count("*"))
    counted = stats.withColumn("total_productos", whole["rows"])
    return first_rows(counted.orderBy(F.desc("venta_neta"), "producto", "marca", "tipo"), limit)


def _shares(stats: DataFrame, *order: str) -> DataFrame:
    """Keep positive revenue and give each row its share of what is kept."""
    kept = stats.filter(F.col("venta_neta") > 0)
    whole = totals(kept, sale=whole_sum("venta_neta"))
    shared = kept.withColumn("share_pct", percent(F.col("venta_neta"), whole["sale"]))
    return shared.orderBy(F.desc("venta_neta"), *order)


def productos_all(sales: DataFrame, anno: int | None = None) -> DataFrame:
    """(product, brand) with positive revenue and share."""
    stats = in_year(sales, anno).groupBy("producto", or_text("marca_producto", NO_BRAND).alias("marca"))
    return _shares(stats.agg(money_sum(SALE).alias("venta_neta")), "producto", "marca")


def marcas_all(sales: DataFrame, anno: int | None = None) -> DataFrame:
    """Brands with positive revenue and share."""
    stats = in_year(sales, anno).groupBy(or_text("marca_producto", NO_BRAND).alias("marca"))
    return _shares(stats.agg(money_sum(SALE).alias("venta_neta")), "marca")


def productos_detalle(sales: DataFrame, anno: int | None = None) -> DataFrame:
    """(product, type, brand) with units, revenue, margin and margin %."""
    return in_year(sales, anno).groupBy("producto", "nombre_tipo_bebida", "marca_producto").agg(
        F.sum("cantidad").alias("unidades"),
        money_sum(SALE).alias("venta_neta"),
        money_sum(MARGIN).alias("margen"),
        _margin_pct().alias("margen_pct"),
    )


def vendedores(sales: DataFrame) -> DataFrame:
    """Sellers with revenue, orders and share of revenue."""
    by_seller = sales.groupBy("vendedor").agg(exact_sum(SALE).alias("_exact"), F.count_distinct("cod_venta").alias("pedidos"))
    whole = totals(by_seller, sale=F.sum("_exact"))
    return by_seller.select(
        "vendedor",
        F.round("_exact", 0).cast("double").alias("venta_neta"),
        "pedidos",
        percent(F.col("_exact"), whole["sale"]).alias("share_pct"),
    ).orderBy(F.desc("venta_neta"), "vendedor")


def _product_order() -> list[Column]:
    return [F.desc("venta_neta"), F.asc("producto"), F.asc("marca_producto"), F.asc("nombre_tipo_bebida")]


def filter_products(
    details: DataFrame,
    name: str | None = None,
    tipo: str | None = None,
    marca: str | None = None,
    margin: tuple[float | None, float | None] = (None, None),
    number: int = 1,
    size: int = 50,
) -> DataFrame:
    """A page of ``productos_detalle`` by name (substring, any case), type, brand and margin % range."""
    found = details
    if name:
        found = found.filter(F.contains(F.lower("producto"), F.lit(name.lower())))
    if tipo:
        found = found.filter(F.col("nombre_tipo_bebida") == tipo)
    if marca:
        found = found.filter(F.col("marca_producto") == marca)
    low, high = margin
    if low is not None:
        found = found.filter(F.col("margen_pct") >= low)
    if high is not None:
        found = found.filter(F.col("margen_pct") <= high)
    return page(found, _product_order(), number, size)


def search_products(details: DataFrame, text: str, number: int = 1, size: int = 50) -> DataFrame:
    """A page of the products whose name or brand contains ``text``, in any case."""
    wanted = F.lit(text.lower())
    in_name = F.contains(F.lower("producto"), wanted)
    in_brand = F.contains(F.lower("marca_producto"), wanted)
    return page(details.filter(in_name | in_brand), _product_order(), number, size)
