"""Customer rankings, segments, basket mix, retention, frequency and strategic groups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarline.config import DEFAULTS, Settings
from cellarline.functions.exprs import (
    as_python_date,
    contains_any,
    days_since,
    exact_sum,
    first_match,
    money_sum,
    month_start,
    percent,
    round_ratio,
    safe_div,
    whole_sum,
)
from cellarline.functions.frames import first_rows, page, rank_rows, totals
from cellarline.sources.fact import in_year

Day = dt.date | str | None
SALE, MARGIN = "venta_neta_mn", "margen_mn"


def _loyalty_label(orders: str, money: str, cfg: Settings) -> Column:
    rules, days = cfg.loyalty, F.col("dias_sin_compra")
    return first_match(
        [
            ((days <= rules.vip_days) & (F.col(money) > rules.vip_money), rules.vip),
            ((days <= rules.loyal_days) & (F.col(orders) >= rules.loyal_orders), rules.loyal),
            (days <= rules.active_days, rules.active),
            (days <= rules.risk_days, rules.at_risk),
        ],
        rules.inactive,
    )


def _rfm_segment(days: Column, orders: Column, money: Column, cfg: Settings) -> Column:
    """Six segments; the order of the rules matters."""
    rules = cfg.rfm
    return first_match(
        [
            ((days <= rules.hot_days) & (orders >= rules.high_orders) & (money >= rules.high_money), rules.champions),
            ((days <= rules.warm_days) & ((orders >= rules.mid_orders) | (money >= rules.mid_money)), rules.loyal),
            ((days <= rules.hot_days) & (orders < rules.mid_orders), rules.promising),
            ((days > rules.warm_days) & (days <= rules.cold_days), rules.at_risk),
            (days > rules.cold_days, rules.lost),
        ],
        rules.developing,
    )


def top_clientes(sales: DataFrame, as_of: Day = None, limit: int | None = None, cfg: Settings = DEFAULTS) -> DataFrame:
    """Customers by revenue with share, recency, rank and label; ``limit`` asks for the first ranks only.

    Recency counts from the first day of the last month with a purchase.
    """
    stats = sales.groupBy("cliente").agg(
        F.count_distinct("cod_venta").alias("pedidos"),
        money_sum(SALE).alias("venta_neta"),
        F.max(month_start()).alias("ultima_compra"),
    )
    whole = totals(stats, sale=whole_sum("venta_neta"))
    shared = stats.withColumn("share_pct", percent(F.col("venta_neta"), whole["sale"])).withColumn(
        "dias_sin_compra", days_since(F.col("ultima_compra"), as_of)
    )
    ranked = rank_rows(shared, [F.desc("venta_neta"), F.asc("cliente")], limit=limit)
    return ranked.select(
        "ranking",
        "cliente",
        "pedidos",
        "venta_neta",
        "share_pct",
        _loyalty_label("pedidos", "venta_neta", cfg).alias("segmento_rfm"),
        "dias_sin_compra",
        "ultima_compra",
    )


def _year_stats(sales: DataFrame, anno: int | None, as_of: Day) -> DataFrame:
    stats = in_year(sales, anno).groupBy("cliente").agg(
        money_sum(SALE).alias("venta_neta"),
        F.count_distinct("cod_venta").alias("pedidos"),
        F.sum("cantidad").alias("unidades"),
        F.max("fecha").alias("_last"),
    )
    return stats.select(
        "cliente",
        "venta_neta",
        "pedidos",
        "unidades",
        days_since(F.col("_last"), as_of).alias("dias_sin_compra"),
        F.date_format("_last", "yyyy-MM-dd").alias("ultima_compra"),
    )


def top_clientes_year(sales: DataFrame, anno: int | None = None, limit: int | None = None, as_of: Day = None) -> DataFrame:
    """Customers of a year (0: all; None: the running year) by revenue; all of them or the first ``limit``.

    The share and the customer count are over all customers, not over the listed ones.
    """
    anno = as_python_date(as_of).year if anno is None else anno
    stats = _year_stats(sales, anno, as_of)
    whole = totals(stats, sale=whole_sum("venta_neta"), rows=F.count("*"))
    shared = stats.withColumn("total_clientes", whole["rows"]).withColumn(
        "share_pct", percent(F.col("venta_neta"), whole["sale"])
    )
    return first_rows(shared.orderBy(F.desc("venta_neta"), "cliente"), limit)


def top_clientes_anno_mat(sales: DataFrame, as_of: Day = None, limit: int | None = None) -> DataFrame:
    """The table of the running year's customers, or of the first ``limit``."""
    year = as_python_date(as_of).year
    stats = _year_stats(sales, year, as_of).withColumn("anno", F.lit(year).cast("bigint"))
    return first_rows(stats.orderBy(F.desc("venta_neta"), "cliente"), limit)


def rfm_basic(sales: DataFrame, as_of: Day = None, limit: int | None = None, cfg: Settings = DEFAULTS) -> DataFrame:
    """Recency (from the month start), frequency and money of every customer with the five-way label."""
    stats = sales.groupBy("cliente").agg(
        F.max(month_start()).alias("ultima_compra"),
        F.count_distinct("cod_venta").alias("frecuencia"),
        money_sum(SALE).alias("valor_monetario"),
    )
    labelled = stats.withColumn("dias_sin_compra", days_since(F.col("ultima_compra"), as_of)).withColumn(
        "segmento_rfm", _loyalty_label("frecuencia", "valor_monetario", cfg)
    )
    ordered = labelled.orderBy(F.desc("valor_monetario"), "cliente")
    return ordered if limit is None else ordered.limit(limit)


def _rfm(sales: DataFrame, anno: int | None, as_of: Day, cfg: Settings, *extra: Column) -> DataFrame:
    metrics = in_year(sales, anno).groupBy("cliente").agg(
        F.max("fecha").alias("ultima_compra"),
        F.count_distinct("cod_venta").alias("frecuencia"),
        exact_sum(SALE).alias("total_pen"),
        *extra,
    )
    days = days_since(F.col("ultima_compra"), as_of)
    return metrics.withColumn("dias_sin_compra", days).withColumn(
        "segmento", _rfm_segment(F.col("dias_sin_compra"), F.col("frecuencia"), F.col("total_pen"), cfg)
    )


def rfm_details(sales: DataFrame, anno: int | None = None, as_of: Day = None, cfg: Settings = DEFAULTS) -> DataFrame:
    """Every customer's recency (from the real date), frequency, money and segment."""
    detailed = _rfm(sales, anno, as_of, cfg).withColumn("total_pen", F.col("total_pen").cast("double"))
    return detailed.orderBy(F.desc("total_pen"), "cliente")


def rfm_stats(sales: DataFrame, anno: int | None = None, as_of: Day = None, cfg: Settings = DEFAULTS) -> DataFrame:
    """Customers and money per segment; the customer without a name adds money but no count."""
    by_segment = _rfm(sales, anno, as_of, cfg).groupBy("segmento").agg(
        F.count("cliente").alias("n_clientes"), F.round(F.sum("total_pen"), 0).cast("double").alias("valor_pen")
    )
    return by_segment.orderBy(F.desc("valor_pen"), "segmento")


def _mix(cfg: Settings, yes: tuple[Column, ...], no: tuple[Column, ...]) -> Column:
    """Six-way basket mix from "bought" and "did not buy" tests for red, white and sparkling."""
    red, white, sparkling = yes
    no_red, no_white, no_sparkling = no
    texts = cfg.mix
    return first_match(
        [
            (red & no_white & no_sparkling, texts.only_red),
            (red & white & no_sparkling, texts.red_white),
            (red & no_white & sparkling, texts.red_sparkling),
            (red & white & sparkling, texts.full),
            (no_red & (white | sparkling), texts.no_red),
        ],
        texts.other,
    )


def _kinds(cfg: Settings) -> tuple[Column, Column, Column]:
    kind = F.upper("nombre_tipo_bebida")
    return tuple(contains_any(kind, p) for p in (cfg.mix.red, cfg.mix.white, cfg.mix.sparkling))


def rfm_cross_sell(sales: DataFrame, anno: int | None = None, cfg: Settings = DEFAULTS) -> DataFrame:
    """Customers, mean and total money per basket mix, the mix taken from any purchase of a kind."""
    red, white, sparkling = _kinds(cfg)
    by_customer = in_year(sales, anno).groupBy("cliente").agg(
        F.bool_or(red).alias("red"), F.bool_or(white).alias("white"), F.bool_or(sparkling).alias("sparkling"),
        exact_sum(SALE).alias("_total"),
    )
    flags = tuple(F.col(c) for c in ("red", "white", "sparkling"))
    mixed = by_customer.withColumn("mix_type", _mix(cfg, flags, tuple(~f for f in flags)))
    by_mix = mixed.groupBy("mix_type").agg(
        F.count("cliente").alias("n_clientes"),
        round_ratio(safe_div(F.sum("_total"), F.count("_total")), 0).alias("avg_pen"),
        F.sum("_total").cast("double").alias("total_pen"),
    )
    return by_mix.orderBy(F.desc("n_clientes"), "mix_type")


def rfm_mix_details(sales: DataFrame, anno: int | None = None, as_of: Day = None, cfg: Settings = DEFAULTS) -> DataFrame:
    """Every customer's money and share per kind, segment and mix.

    The mix is taken from the amounts (> 0, = 0), so purchases that net to zero or less count differently
    from ``rfm_cross_sell``.
    """
    names = ("tinto", "blanco", "espumoso")
    amounts = [
        exact_sum(F.when(kind, F.col(SALE)).otherwise(F.lit(0).cast("decimal(18,4)"))).alias(f"{name}_pen")
        for name, kind in zip(names, _kinds(cfg), strict=True)
    ]
    base = _rfm(sales, anno, as_of, cfg, *amounts)
    columns = [F.col(f"{name}_pen") for name in names]
    mix = _mix(cfg, tuple(c > 0 for c in columns), tuple(c == 0 for c in columns))
    return base.select(
        "cliente",
        F.col("total_pen").cast("double").alias("total_pen"),
        "ultima_compra",
        "frecuencia",
        *[c.cast("double").alias(f"{name}_pen") for name, c in zip(names, columns, strict=True)],
        "segmento",
        *[percent(c, F.col("total_pen")).alias(f"pct_{name}") for name, c in zip(names, columns, strict=True)],
        mix.alias("mix_type"),
    ).orderBy(F.desc("total_pen"), "cliente")


def retencion(sales: DataFrame, since: int | None = None, as_of: Day = None, cfg: Settings = DEFAULTS) -> DataFrame:
    """Per year against the previous year present: active, kept, new and lost customers, lost revenue.

    A customer's years are numbered by their place among all years present; "kept" is then a
    neighbouring number in the customer's own history and "lost" a missing one, so no year is joined with
    another. The window groups hold one row per customer and year. A null customer is one customer.
    """
    first = cfg.retention_from if since is None else since
    yearly = sales.filter(F.col("anno") >= first).groupBy("cliente", "anno").agg(exact_sum(SALE).alias("_sale"))
    # The list of years has as many entries as the calendar. It stays a subquery: as a column it would
    # travel with every row through the shuffles below.
    years = totals(yearly, list=F.sort_array(F.collect_set("anno")))["list"]
    own = Window.partitionBy("cliente").orderBy("anno")
    numbered = yearly.withColumn("_n", F.array_position(years, F.col("anno")).cast("bigint"))
    known = F.lag("_n").over(own) == F.col("_n") - 1
    stays = F.lead("_n").over(own) == F.col("_n") + 1
    history = numbered.select(
        "_n", "_sale", F.coalesce(known, F.lit(False)).alias("known"), F.coalesce(stays, F.lit(False)).alias("stays")
    )
    zero = F.lit(0).cast("decimal(38,4)")
    sale = F.coalesce("_sale", zero).cast("decimal(38,4)")

    def effect(n: Column, active: Column, kept: Column, lost: Column, money: Column) -> Column:
        return F.struct(
            n.alias("n"),
            active.cast("bigint").alias("active"),
            kept.cast("bigint").alias("kept"),
            lost.cast("bigint").alias("lost"),
            money.alias("money"),
        )

    none = F.lit(0)
    effects = F.array(
        effect(F.col("_n"), F.lit(1), F.col("known"), none, zero),
        effect(F.col("_n") + 1, none, none, ~F.col("stays"), F.when(F.col("stays"), zero).otherwise(sale)),
    )
    by_year = history.select(F.inline(effects)).groupBy("n").agg(
        F.sum("active").alias("active"), F.sum("kept").alias("kept"), F.sum("lost").alias("lost"), F.sum("money").alias("money")
    )
    count = F.size(years)
    valid = by_year.filter((F.col("n") >= 2) & (F.col("n") <= count))
    named = valid.withColumn("_year", F.element_at(years, F.col("n").cast("int"))).withColumn(
        "_before", F.element_at(years, (F.col("n") - 1).cast("int"))
    )
    # The running year, when it is the last one, is compared with the calendar year before it.
    running = F.lit(as_python_date(as_of).year)
    gap = (F.col("n") == count) & (F.col("_year") == running) & (F.col("_before") != F.col("_year") - 1)
    return named.select(
        F.concat(F.col("_before").cast("string"), F.lit("→"), F.col("_year").cast("string")).alias("anno"),
        F.col("active").alias("clientes_actuales"),
        F.col("kept").alias("retenidos"),
        (F.col("active") - F.col("kept")).alias("nuevos"),
        F.when(gap, 0).otherwise(F.col("lost")).cast("bigint").alias("perdidos"),
        F.when(gap, 0.0).otherwise(F.col("money").cast("double")).alias("perdida_usd"),
    ).orderBy("anno")


def retencion_listado(sales: DataFrame, p1: int, p2: int, tipo: str) -> DataFrame:
    """Customers that are new in ``p2``, kept from ``p1``, or lost after ``p1``, by revenue.

    One aggregate with a sum and a presence flag per year replaces the joins between the two years.
    """
    one, two = F.col("anno") == p1, F.col("anno") == p2
    both = sales.filter(F.col("anno").isin(p1, p2)).groupBy("cliente").agg(
        F.bool_or(one).alias("in1"), F.bool_or(two).alias("in2"),
        exact_sum(F.when(one, F.col(SALE))).cast("double").alias("v1"),
        exact_sum(F.when(two, F.col(SALE))).cast("double").alias("v2"),
    )
    wanted = {
        "nuevos": (~F.col("in1") & F.col("in2"), [F.col("v2").alias("venta")]),
        "retenidos": (F.col("in1") & F.col("in2"), [F.col("v2").alias("venta"), F.col("v1").alias("venta_anterior")]),
        "perdidos": (F.col("in1") & ~F.col("in2"), [F.col("v1").alias("venta")]),
    }
    if tipo not in wanted:
        raise ValueError(f"tipo must be one of {sorted(wanted)}")
    keep, columns = wanted[tipo]
    return both.filter(keep).select("cliente", *columns).orderBy(F.desc("venta"), "cliente")


def frecuencia_compra(sales: DataFrame, anno: int | None = None, cfg: Settings = DEFAULTS) -> DataFrame:
    """Histogram of orders per customer."""
    orders = F.col("pedidos")
    per_customer = in_year(sales, anno).groupBy("cliente").agg(F.count_distinct("cod_venta").alias("pedidos"))
    bounded = [(last, position) for position, (last, _) in enumerate(cfg.frequency_bands, start=1) if last is not None]
    # Orders without an id count 0 and belong, like the largest counts, to the last range.
    lowest = F.when(orders < 1, len(cfg.frequency_bands))
    order = F.coalesce(lowest, first_match([(orders <= last, position) for last, position in bounded], len(cfg.frequency_bands)))
    by_range = per_customer.groupBy(order.alias("_order")).agg(F.count("cliente").alias("cantidad_clientes"))
    names = F.element_at(F.array(*[F.lit(text) for _, text in cfg.frequency_bands]), F.col("_order"))
    return by_range.orderBy("_order").select(names.alias("rango_frecuencia"), "cantidad_clientes")


def _expert_counts(sales: DataFrame, dims: tuple[str, ...], as_of: Day, vip_money: int, cfg: Settings) -> DataFrame:
    """One row with the six group sizes.

    Kept as it was defined: a year's amount is the largest over its (type, ...) rows, not their sum, and
    orders are summed over those rows, so an order with two types counts twice.
    """
    rules, year = cfg.expert, as_python_date(as_of).year
    base = sales.groupBy("cliente", "anno", *dims).agg(
        exact_sum(SALE).alias("venta"),
        exact_sum(MARGIN).alias("margen"),
        F.count_distinct("cod_venta").alias("pedidos"),
        F.max("fecha").alias("ultima"),
    )
    zero = F.lit(0).cast("decimal(28,4)")
    by_customer = base.groupBy("cliente").agg(
        F.sum("venta").alias("total"),
        F.sum("pedidos").alias("orders"),
        F.max("ultima").alias("last"),
        # A customer buys few types: a set in the aggregate saves the shuffles of a distinct count.
        F.size(F.collect_set("nombre_tipo_bebida")).alias("kinds"),
        F.max(F.when(F.col("anno") == year, F.col("venta")).otherwise(zero)).alias("now"),
        F.max(F.when(F.col("anno") == year - 1, F.col("venta")).otherwise(zero)).alias("before"),
        safe_div(F.sum("margen"), F.sum("venta")).alias("margin"),
    )
    idle = days_since(F.col("last"), as_of)
    now, before, orders = F.col("now"), F.col("before"), F.col("orders")
    return by_customer.agg(
        F.count_if((now == 0) & (before > vip_money) & (orders > rules.vip_orders)).alias("vip"),
        F.count_if((F.col("total") > rules.whale_money) & (idle > rules.whale_days)).alias("whale"),
        F.count_if((before > 0) & idle.between(*rules.drift_days)).alias("drift"),
        F.count_if((now > 0) & (F.col("kinds") == 1) & (orders > rules.mono_orders)).alias("mono"),
        F.count_if(orders == 1).alias("once"),
        F.count_if((now > 0) & (F.col("margin") < rules.thin_margin)).alias("margin"),
    )


def analisis_experto(sales: DataFrame, as_of: Day = None, cfg: Settings = DEFAULTS) -> DataFrame:
    """Six strategic groups with their size, action and priority: one pass, unpivoted to six rows."""
    counts = _expert_counts(sales, ("nombre_tipo_bebida",), as_of, cfg.expert.vip_money, cfg)
    year = as_python_date(as_of).year
    rows = []
    for name in ("vip", "whale", "drift", "mono", "once", "margin"):
        text, action, priority = getattr(cfg.expert, name)
        rows.append(
            F.struct(
                F.lit(text.format(year=year)).alias("segmento"),
                F.col(name).alias("n_clientes"),
                F.lit(action).alias("accion"),
                F.lit(priority).alias("prioridad"),
            )
        )
    return counts.select(F.inline(F.array(*rows)))


def analisis_clientes_wide(sales: DataFrame, as_of: Day = None, cfg: Settings = DEFAULTS) -> DataFrame:
    """The six sizes in one row; the base rows are also split by brand and the VIP limit is higher."""
    dims = ("nombre_tipo_bebida", "marca_producto")
    counts = _expert_counts(sales, dims, as_of, cfg.expert.vip_money_wide, cfg)
    year = as_python_date(as_of).year
    return counts.select(
        F.col("vip").alias(f"vip_inactivo_{year}"),
        F.col("mono").alias("potencial_cross_sell"),
        F.col("drift").alias("frecuencia_en_caida"),
        F.col("whale").alias("ballenas_perdidas"),
        F.col("margin").alias("volumen_bajo_margen"),
        F.col("once").alias("una_sola_compra"),
    )


def clientes_detalle(sales: DataFrame, anno: int | None = None) -> DataFrame:
    """First and last month, orders, active months, money and margin per customer."""
    return in_year(sales, anno).groupBy("cliente").agg(
        F.min(month_start()).alias("primera_compra"),
        F.max(month_start()).alias("ultima_compra"),
        F.count_distinct("cod_venta").alias("frecuencia"),
        F.count_distinct(month_start()).alias("meses_activos"),
        money_sum(SALE).alias("valor_monetario"),
        money_sum(MARGIN).alias("margen_total"),
    )


def cross_sell_opportunity(sales: DataFrame, anno: int, cfg: Settings = DEFAULTS) -> DataFrame:
    """Customers with red and no white purchases, and the potential their number stands for.

    The meaning is that of NOT IN: one white purchase without a customer name empties the result. Two
    flags per customer decide it; an anti join would have to broadcast all white-wine customers.
    """
    kind = F.col("nombre_tipo_bebida")
    no = F.lit(False)
    by_customer = in_year(sales, anno).groupBy("cliente").agg(
        F.coalesce(F.bool_or(kind.contains(cfg.mix.red_exact)), no).alias("red"),
        F.coalesce(F.bool_or(kind.contains(cfg.mix.white_exact)), no).alias("white"),
        exact_sum(SALE).alias("sale"),
    )
    named = F.col("cliente").isNotNull()
    result = by_customer.agg(
        F.count_if(named & F.col("red") & ~F.col("white")).alias("_only_red"),
        F.coalesce(F.bool_or(~named & F.col("white")), no).alias("_blocked"),
        F.count("cliente").alias("clientes"),
        F.sum("sale").alias("_total"),
    )
    total = F.when(F.coalesce(F.col("_total"), F.lit(0)) == 0, 1.0).otherwise(F.col("_total").cast("double"))
    count = F.when(F.col("_blocked"), 0).otherwise(F.col("_only_red")).cast("bigint")
    # Text format and the value for an empty year are fixed values.
    potential = F.concat(F.lit("S/ "), (count * (total / 10000.0)).cast("bigint").cast("string"), F.lit("K"))
    return result.select(
        count.alias("clientes_solo_tinto"),
        "clientes",
        total.alias("venta_total"),
        F.when(total > 1, potential).otherwise(F.lit("S/ 99K")).alias("potencial"),
    )


def filter_customers(
    details: DataFrame,
    name: str | None = None,
    days: tuple[int | None, int | None] = (None, None),
    segment: str | None = None,
    number: int = 1,
    size: int = 50,
) -> DataFrame:
    """A page of ``rfm_details`` by name (substring, any case), days without purchase and segment."""
    found = details
    if name:
        found = found.filter(F.contains(F.lower("cliente"), F.lit(name.lower())))
    low, high = days
    if low is not None:
        found = found.filter(F.col("dias_sin_compra") >= low)
    if high is not None:
        found = found.filter(F.col("dias_sin_compra") <= high)
    if segment:
        found = found.filter(F.col("segmento") == segment)
    return page(found, [F.desc("total_pen"), F.asc("cliente")], number, size)


def search_customers(ranking: DataFrame, text: str, number: int = 1, size: int = 50) -> DataFrame:
    """A page of a customer list (with ``cliente`` and ``venta_neta``) whose name contains ``text``."""
    found = ranking.filter(F.contains(F.lower("cliente"), F.lit(text.lower())))
    return page(found, [F.desc("venta_neta"), F.asc("cliente")], number, size)
