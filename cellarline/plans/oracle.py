"""The SQL each registered query must agree with, over the same star tables.

Written apart from the operators: plain joins, subqueries and windows, and the parameters of
``cellarline.plans.sample``. Used for checking only.
"""

from __future__ import annotations

from cellarline.config import DEFAULT_EXCHANGE_RATE, MONTHS_ES, NO_BRAND, NO_ORIGIN, NO_TYPE, NOT_FOUND
from cellarline.config import TAG_FORECAST, TAG_HISTORY
from cellarline.operators.forecast import SMOOTHING
from cellarline.plans.sample import ACCOUNT, AS_OF, CFG, PERIOD, YEAR, YEARS

DAY = f"DATE '{AS_OF.isoformat()}'"
THIS = AS_OF.year
# Key columns and measures of wider frames, as they appear in the long rows of the first page and of the views.
TOP_CLIENTES = ("cliente segmento_rfm ultima_compra", "ranking pedidos venta_neta share_pct dias_sin_compra")
VENDEDORES = ("vendedor", "venta_neta pedidos share_pct")
SEGMENTOS = ("segmento", "unidades pct_volumen venta_neta margen_pct")
TOP_CLIENTES_ANNO = ("cliente ultima_compra anno", "venta_neta pedidos unidades dias_sin_compra")
METRICS = ("venta_neta", "margen", "pct_margen", "unidades", "clientes", "pedidos", "pedido_promedio")

SALES = """sales AS (
  SELECT t.*, CAST(year(fecha) AS BIGINT) AS anno, CAST(month(fecha) AS BIGINT) AS mes,
         date_trunc('month', fecha)::DATE AS periodo, venta - costo AS margen
  FROM (
    SELECT o_orderkey AS cod_venta, c_name AS cliente, CAST(o_orderdate AS DATE) AS fecha, p_name AS producto,
           p_brand AS marca, p_type AS tipo, n_name AS pais, s_name AS vendedor,
           CAST(l_quantity AS BIGINT) AS cantidad, o_orderstatus AS estado,
           CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS venta,
           CAST(0.6 AS DECIMAL(2,1)) * CAST(p_retailprice AS DECIMAL(12,2)) * CAST(l_quantity AS DECIMAL(6,0)) AS costo
    FROM lineitem
    JOIN orders ON o_orderkey = l_orderkey
    JOIN customer ON c_custkey = o_custkey
    JOIN part ON p_partkey = l_partkey
    JOIN supplier ON s_suppkey = l_suppkey
    JOIN nation ON n_nationkey = s_nationkey
  ) t)"""
GUARDED = "g AS (SELECT * FROM sales WHERE pais IS NOT NULL AND pais <> '')"
GUARDED_YEAR = f"gy AS (SELECT * FROM g WHERE anno = {YEAR})"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join((SALES, GUARDED, GUARDED_YEAR, *ctes)) + "\n"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def money(x: str, digits: int = 0) -> str:
    return dbl(f"round(sum({x}), {digits})")


def rr(x: str, digits: int = 1) -> str:
    scale = f"{10**digits}.0"
    return f"(sign({x}) * floor(abs({x}) * {scale} + 0.500001) / {scale} + 0.0)"


def ratio(num: str, den: str) -> str:
    return f"({dbl(num)} / nullif({dbl(den)}, 0))"


def pct(num: str, den: str, digits: int = 1) -> str:
    return rr(f"({ratio(num, den)} * 100.0)", digits)


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


MARGIN = pct("sum(margen)", "sum(venta)")


def figures(names=METRICS) -> str:
    exprs = (
        money("venta"), money("margen"), MARGIN, big("sum(cantidad)"), "count(DISTINCT cliente)",
        "count(DISTINCT cod_venta)", rr(ratio("sum(venta)", "count(DISTINCT cod_venta)"), 0),
    )
    return ", ".join(f"{e} AS {n}" for e, n in zip(exprs, names, strict=True))


def kpi_rows(anno: int) -> str:
    cut = f"AND strftime(fecha, '%m-%d') <= '{AS_OF:%m-%d}'" if anno == THIS else ""
    sides = [
        f"SELECT '{side}' AS periodo, {big(year)} AS anno, {figures()} FROM g WHERE anno = {year} {cut}"
        for side, year in (("current", anno), ("previous", anno - 1))
    ]
    return " UNION ALL ".join(sides)


def loyalty(orders: str, value: str) -> str:
    r = CFG.loyalty
    return f"""CASE WHEN dias_sin_compra <= {r.vip_days} AND {value} > {r.vip_money} THEN {text(r.vip)}
      WHEN dias_sin_compra <= {r.loyal_days} AND {orders} >= {r.loyal_orders} THEN {text(r.loyal)}
      WHEN dias_sin_compra <= {r.active_days} THEN {text(r.active)}
      WHEN dias_sin_compra <= {r.risk_days} THEN {text(r.at_risk)} ELSE {text(r.inactive)} END"""


def segment() -> str:
    r = CFG.rfm
    return f"""CASE WHEN dias <= {r.hot_days} AND frecuencia >= {r.high_orders} AND total >= {r.high_money} THEN {text(r.champions)}
      WHEN dias <= {r.warm_days} AND (frecuencia >= {r.mid_orders} OR total >= {r.mid_money}) THEN {text(r.loyal)}
      WHEN dias <= {r.hot_days} AND frecuencia < {r.mid_orders} THEN {text(r.promising)}
      WHEN dias BETWEEN {r.warm_days + 1} AND {r.cold_days} THEN {text(r.at_risk)}
      WHEN dias > {r.cold_days} THEN {text(r.lost)} ELSE {text(r.developing)} END"""


def rfm_cte(source: str, extra: str = "") -> str:
    return f"""r AS (SELECT *, {segment()} AS segmento FROM (
      SELECT cliente, max(fecha) AS ultima_compra, count(DISTINCT cod_venta) AS frecuencia, sum(venta) AS total,
             date_diff('day', max(fecha), {DAY}) AS dias {extra} FROM {source} GROUP BY cliente))"""


def like_any(column: str, patterns) -> str:
    return "(" + " OR ".join(f"upper({column}) LIKE '%{p}%'" for p in patterns) + ")"


KINDS = [like_any("tipo", p) for p in (CFG.mix.red, CFG.mix.white, CFG.mix.sparkling)]


def mix(yes: tuple[str, str, str], no: tuple[str, str, str]) -> str:
    m = CFG.mix
    return f"""CASE WHEN {yes[0]} AND {no[1]} AND {no[2]} THEN {text(m.only_red)}
      WHEN {yes[0]} AND {yes[1]} AND {no[2]} THEN {text(m.red_white)}
      WHEN {yes[0]} AND {no[1]} AND {yes[2]} THEN {text(m.red_sparkling)}
      WHEN {yes[0]} AND {yes[1]} AND {yes[2]} THEN {text(m.full)}
      WHEN {no[0]} AND ({yes[1]} OR {yes[2]}) THEN {text(m.no_red)} ELSE {text(m.other)} END"""


def products_sql() -> dict[str, str]:
    stats = "unidades, venta_neta, margen, margen_pct"
    detail = f"""d AS (SELECT producto, tipo AS nombre_tipo_bebida, marca AS marca_producto, {big('sum(cantidad)')} AS unidades,
      {money('venta')} AS venta_neta, {money('margen')} AS margen, {MARGIN} AS margen_pct FROM sales GROUP BY 1, 2, 3)"""
    detail_order = "ORDER BY venta_neta DESC, producto, marca_producto, nombre_tipo_bebida"
    cost = [f"WHEN {dbl('costo')} / cantidad < {limit} THEN {text(name)}" for limit, name in CFG.cost_bands if limit]
    cost_case = f"CASE {' '.join(cost)} ELSE {text(CFG.cost_bands[-1][1])} END"
    inner = [
        f"WHEN venta BETWEEN {low} * cantidad AND {high} * cantidad THEN {n}"
        for n, (low, high, _) in enumerate(CFG.price_between, start=2)
    ]
    price_case = f"CASE WHEN venta < {CFG.price_below[0]} * cantidad THEN 1 {' '.join(inner)} ELSE 5 END"
    price_names = [CFG.price_below[1], *[name for *_, name in CFG.price_between], CFG.price_rest]
    o = CFG.origin
    action = f"""CASE WHEN pct_margen > {o.star_margin} AND venta_neta > {o.star_revenue} THEN {text(o.star)}
      WHEN pct_margen > {o.good_margin} AND venta_neta > {o.mid_revenue} THEN {text(o.consolidate)}
      WHEN pct_margen < {o.low_margin} AND venta_neta > {o.mid_revenue} THEN {text(o.review)}
      WHEN pct_margen > {o.star_margin} AND venta_neta < {o.mid_revenue} THEN {text(o.boost)}
      WHEN skus < {o.few_products} AND pct_margen > {o.good_margin} THEN {text(o.widen)}
      WHEN pct_margen < {o.bad_margin} THEN {text(o.restructure)} ELSE {text(o.keep)} END"""
    pais = f"coalesce(pais, {text(NO_ORIGIN)})"
    marca = f"coalesce(marca, {text(NO_BRAND)})"
    tipo = f"coalesce(tipo, {text(NO_TYPE)})"
    return {
        "dim_pais": with_() + f"""SELECT pais AS pais_origen_producto, {money('venta')} AS venta_neta, {money('margen')} AS margen_neto,
            {big('sum(cantidad)')} AS unidades, count(DISTINCT cod_venta) AS pedidos, count(DISTINCT cliente) AS clientes
            FROM sales GROUP BY 1""",
        "dim_tipo": with_() + f"""SELECT tipo AS nombre_tipo_bebida, {money('venta')} AS venta_neta, {big('sum(cantidad)')} AS unidades,
            {pct('sum(venta)', '(SELECT sum(venta) FROM sales)')} AS pct_venta FROM sales GROUP BY 1""",
        "dim_marca_all": with_() + f"""SELECT marca AS marca_producto, {money('venta')} AS venta_neta, {money('margen')} AS margen_neto,
            {big('sum(cantidad)')} AS unidades FROM sales GROUP BY 1""",
        "margen_marca_all": with_() + f"""SELECT marca AS marca_producto, {MARGIN} AS margen_pct, {money('venta')} AS venta_neta,
            {big('sum(cantidad)')} AS unidades FROM sales GROUP BY 1 HAVING sum(venta) > {CFG.brand_min_revenue}""",
        "segmento_precio_costo": with_() + f"""SELECT {cost_case} AS segmento, {big('sum(cantidad)')} AS unidades,
            {pct('sum(cantidad)', '(SELECT sum(cantidad) FROM sales WHERE cantidad > 0)')} AS pct_volumen,
            {money('venta')} AS venta_neta, {MARGIN} AS margen_pct FROM sales WHERE cantidad > 0 GROUP BY 1""",
        "segmento_precio_venta": with_() + f"""SELECT ({[n for n in price_names]})[orden] AS segmento, {big('orden')} AS orden,
            {money('venta')} AS venta_neta, {big('sum(cantidad)')} AS botellas
            FROM (SELECT *, {price_case} AS orden FROM gy WHERE cantidad <> 0) GROUP BY orden""",
        "rentabilidad_origen": with_() + f"""SELECT {pais} AS pais, {money('venta')} AS venta_neta, {money('margen')} AS margen_neto,
            {big('sum(cantidad)')} AS unidades FROM gy GROUP BY 1 HAVING round(sum(venta), 0) > 0""",
        "market_share_tipo": with_(f"t AS (SELECT {pais} AS p, sum(venta) AS total FROM gy GROUP BY 1)")
        + f"""SELECT p AS pais, {tipo} AS tipo, {money('venta')} AS venta_neta, {pct('sum(venta)', 'any_value(total)')} AS share_pct
            FROM gy JOIN t ON {pais} = p GROUP BY 1, 2 HAVING round(sum(venta), 0) > 0""",
        "dependencia_marca": with_(f"""b AS (SELECT {pais} AS pais, {marca} AS marca, sum(venta) AS v FROM gy GROUP BY 1, 2
            HAVING sum(venta) > 0)""",
            "k AS (SELECT *, row_number() OVER (PARTITION BY pais ORDER BY v DESC, marca) AS n, sum(v) OVER (PARTITION BY pais) AS total FROM b)")
        + f"""SELECT pais, marca AS marca_ancla, {dbl('round(v, 0)')} AS venta_ancla, {dbl('round(total, 0)')} AS venta_total_pais,
            {pct('v', 'total')} AS dependencia_pct FROM k WHERE n = 1""",
        "brand_type_fit": with_(f"""top AS (SELECT {marca} AS m, sum(venta) AS total FROM gy GROUP BY 1 HAVING sum(venta) > 0
            ORDER BY total DESC, m LIMIT {CFG.fit_brands})""")
        + f"""SELECT m AS marca, {tipo} AS tipo, {money('venta')} AS venta_tipo, {pct('sum(venta)', 'any_value(total)')} AS share_pct
            FROM gy JOIN top ON {marca} = m GROUP BY 1, 2 HAVING round(sum(venta), 0) > 0""",
        "productos_mix_pais": with_() + f"""SELECT *, {action} AS accion FROM (SELECT {pais} AS pais, {money('venta')} AS venta_neta,
            {money('costo')} AS costo_total, {money('margen')} AS margen_neto, {MARGIN} AS pct_margen,
            count(DISTINCT tipo) AS lineas, count(DISTINCT producto) AS skus FROM gy GROUP BY 1) WHERE venta_neta > 0""",
        "top_productos": with_(f"""p AS (SELECT producto, tipo AS nombre_tipo_bebida, {big('sum(cantidad)')} AS unidades,
            {money('venta')} AS venta_neta, {money('margen')} AS margen_neto, {MARGIN} AS margen_pct FROM sales GROUP BY 1, 2)""")
        + f"""SELECT *, {pct('unidades', '(SELECT sum(unidades) FROM p)')} AS pct_total_uds,
            row_number() OVER (ORDER BY unidades DESC, producto, nombre_tipo_bebida) AS ranking FROM p""",
        "top_productos_year": with_(f"""p AS (SELECT producto, {marca} AS marca, {tipo} AS tipo, {money('venta')} AS venta_neta,
            {money('margen')} AS margen, {MARGIN} AS pct_margen FROM gy GROUP BY ALL)""")
        + """SELECT *, (SELECT count(*) FROM p) AS total_productos FROM p""",
        "productos_all": with_(f"""p AS (SELECT producto, {marca} AS marca, {money('venta')} AS venta_neta FROM gy GROUP BY 1, 2
            HAVING round(sum(venta), 0) > 0)""")
        + f"SELECT *, {pct('venta_neta', '(SELECT sum(venta_neta) FROM p)')} AS share_pct FROM p",
        "marcas_all": with_(f"p AS (SELECT {marca} AS marca, {money('venta')} AS venta_neta FROM gy GROUP BY 1 HAVING round(sum(venta), 0) > 0)")
        + f"SELECT *, {pct('venta_neta', '(SELECT sum(venta_neta) FROM p)')} AS share_pct FROM p",
        "productos_detalle": with_(detail) + f"SELECT producto, nombre_tipo_bebida, marca_producto, {stats} FROM d",
        "vendedores": with_() + f"""SELECT vendedor, {money('venta')} AS venta_neta, count(DISTINCT cod_venta) AS pedidos,
            {pct('sum(venta)', '(SELECT sum(venta) FROM sales)')} AS share_pct FROM sales GROUP BY 1""",
        "filter_products": with_(detail) + f"""SELECT * FROM d WHERE producto ILIKE '%red%' AND nombre_tipo_bebida = 'PROMO'
            AND margen_pct BETWEEN 60 AND 90 {detail_order} LIMIT 20 OFFSET 20""",
        "search_products": with_(detail) + f"""SELECT * FROM d WHERE producto ILIKE '%brand#1%' OR marca_producto ILIKE '%brand#1%'
            {detail_order} LIMIT 50""",
        "search_from_index": with_(detail) + """SELECT * FROM d WHERE producto ILIKE '%brand#1%' OR marca_producto ILIKE '%brand#1%'
            OR producto ILIKE '%widget%' OR marca_producto ILIKE '%widget%'""",
        "page_from_index": with_(detail) + f"""SELECT *, {big(f'row_number() OVER ({detail_order})')} AS puesto FROM d
            QUALIFY puesto BETWEEN 201 AND 300""",
    }


def time_sql() -> dict[str, str]:
    serie = f"""SELECT periodo, anno, mes, strftime(periodo, '%b %Y') AS periodo_label, {money('venta', 2)} AS venta_neta,
      {money('margen', 2)} AS margen_neto, {big('sum(cantidad)')} AS unidades, count(DISTINCT cod_venta) AS pedidos,
      {rr(ratio('sum(venta)', 'count(DISTINCT cod_venta)'), 2)} AS aov FROM sales"""
    months = f"m AS (SELECT anno, mes, min(periodo) AS periodo, {money('venta')} AS venta_mes FROM sales GROUP BY 1, 2)"
    means = "y AS (SELECT anno, sum(venta_mes) / count(*) AS media FROM m GROUP BY 1)"
    index = rr("(venta_mes / media * 100.0)", 0)
    levels = " ".join(f"WHEN venta_mes / media > {limit} THEN {text(name)}" for limit, name in CFG.season_levels)
    cells = ", ".join(f"coalesce(max(CASE WHEN mes = {m} THEN {index} END), 0.0) AS m{m:02d}" for m in range(1, 13))
    pair = [money(f"CASE WHEN anno = {year} THEN venta END", 2) for year in (YEAR, YEAR - 1)]
    yearly = ", ".join(
        f"{pct(f'sum(CASE WHEN anno = {y} THEN margen END)', f'sum(CASE WHEN anno = {y} THEN venta END)')} AS margen_{y}"
        for y in YEARS
    )
    deltas = " UNION ALL ".join(
        f"""SELECT '{m}' AS metrica, {dbl('c.' + m)} AS actual, {dbl('p.' + m)} AS anterior,
            {dbl(f'c.{m} - p.{m}')} AS delta, {pct(f'c.{m} - p.{m}', f'p.{m}')} AS delta_pct,
            CASE WHEN coalesce(p.{m}, 0) = 0 THEN 'neutral' WHEN c.{m} >= p.{m} THEN 'up' ELSE 'down' END AS direccion FROM c, p"""
        for m in METRICS
    )
    view = ("venta_neta_total", "margen_neto_total", "pct_margen_bruto", "unidades_total", "clientes_activos", "num_pedidos", "aov")
    prev = ", ".join(f"p.{m} AS {m}_prev" for m in METRICS)

    def year_to_date(source: str) -> str:
        ytd = f"strftime(fecha, '%m-%d') <= '{AS_OF:%m-%d}'"
        return with_(
            f"c AS (SELECT {figures()} FROM {source} WHERE anno = {THIS} AND {ytd})",
            f"p AS (SELECT {figures()} FROM {source} WHERE anno = {THIS - 1} AND {ytd})",
        ) + f"SELECT {big(THIS)} AS anno, '{AS_OF.isoformat()}' AS fecha_corte, c.*, {prev} FROM c, p"

    return {
        "kpi_global": with_() + f"SELECT {figures(view)} FROM sales",
        "kpi_year": with_() + kpi_rows(YEAR),
        "kpi_year_running": with_() + kpi_rows(THIS),
        "kpi_year_all": with_() + f"SELECT 'current' AS periodo, 0::BIGINT AS anno, {figures()} FROM g",
        "kpi_ytd": year_to_date("sales"),
        "kpi_ytd_live": year_to_date("g"),
        "kpi_yoy_delta": with_(
            f"c AS (SELECT {figures()} FROM g WHERE anno = {YEAR})", f"p AS (SELECT {figures()} FROM g WHERE anno = {YEAR - 1})"
        ) + deltas,
        "serie_mensual": with_() + serie + " GROUP BY 1, 2, 3",
        "serie_mensual_year": with_() + serie + f" WHERE anno = {YEAR} GROUP BY 1, 2, 3",
        "estacionalidad": with_(months, means) + f"""SELECT anno, mes, strftime(periodo, '%b') AS mes_label, venta_mes,
            {index} AS indice_estacional, CASE {levels} ELSE {text(CFG.season_rest)} END AS nivel FROM m JOIN y USING (anno)""",
        "estacionalidad_matrix": with_(months, means) + f"SELECT anno, {cells} FROM m JOIN y USING (anno) GROUP BY anno",
        "yoy_mensual": with_() + f"""SELECT mes, strftime(make_date({YEAR}, mes, 1), '%b') AS mes_label, a AS venta_actual, b AS venta_anterior,
            {pct('a - b', 'b')} AS delta_pct FROM (SELECT mes, {pair[0]} AS a, {pair[1]} AS b FROM sales
            WHERE anno IN ({YEAR - 1}, {YEAR}) GROUP BY mes)""",
        "margen_marca_anno": with_() + f"SELECT marca AS marca_producto, {yearly} FROM sales GROUP BY 1",
    }


def customers_sql() -> dict[str, str]:
    base = f"""c AS (SELECT cliente, count(DISTINCT cod_venta) AS pedidos, {money('venta')} AS venta_neta, max(periodo) AS ultima_compra,
      date_diff('day', max(periodo), {DAY}) AS dias_sin_compra FROM sales GROUP BY cliente)"""
    ranking = f"""SELECT row_number() OVER (ORDER BY venta_neta DESC, cliente) AS ranking, cliente, pedidos, venta_neta,
      {pct('venta_neta', '(SELECT sum(venta_neta) FROM c)')} AS share_pct, {loyalty('pedidos', 'venta_neta')} AS segmento_rfm,
      dias_sin_compra, ultima_compra FROM c"""

    def year_stats(source: str) -> str:
        return f"""SELECT cliente, {money('venta')} AS venta_neta, count(DISTINCT cod_venta) AS pedidos, {big('sum(cantidad)')} AS unidades,
          date_diff('day', max(fecha), {DAY}) AS dias_sin_compra, strftime(max(fecha), '%Y-%m-%d') AS ultima_compra
          FROM {source} GROUP BY cliente"""

    rfm_columns = f"cliente, ultima_compra, frecuencia, {dbl('total')} AS total_pen, dias AS dias_sin_compra, segmento"
    flags = ", ".join(f"bool_or({kind}) AS {name}" for kind, name in zip(KINDS, "rwe", strict=True))
    amounts = ", " + ", ".join(
        f"sum(CASE WHEN {kind} THEN venta ELSE 0 END) AS {name}" for kind, name in zip(KINDS, ("tinto", "blanco", "espumoso"), strict=True)
    )
    kinds = ("tinto", "blanco", "espumoso")
    mix_flags = mix(("r", "w", "e"), ("NOT r", "NOT w", "NOT e"))
    mix_amounts = mix(tuple(f"{k} > 0" for k in kinds), tuple(f"{k} = 0" for k in kinds))
    money_columns = ", ".join(f"{dbl(k)} AS {k}_pen, {pct(k, 'total')} AS pct_{k}" for k in kinds)

    retention = with_(
        f"cy AS (SELECT cliente, anno, sum(venta) AS v FROM g WHERE anno >= {CFG.retention_from} GROUP BY 1, 2)",
        "ys AS (SELECT anno, row_number() OVER (ORDER BY anno) AS i FROM (SELECT DISTINCT anno FROM cy))",
        "n AS (SELECT cy.*, i FROM cy JOIN ys USING (anno))",
        "j AS (SELECT coalesce(a.i, b.i + 1) AS i, a.i AS ai, b.i AS bi, b.v AS bv FROM n a FULL JOIN n b "
        "ON a.cliente IS NOT DISTINCT FROM b.cliente AND a.i = b.i + 1)",
    ) + f"""SELECT any_value(p.anno) || '→' || any_value(y.anno) AS anno, count(ai) AS clientes_actuales,
        count(*) FILTER (WHERE ai IS NOT NULL AND bi IS NOT NULL) AS retenidos, count(*) FILTER (WHERE bi IS NULL) AS nuevos,
        count(*) FILTER (WHERE ai IS NULL) AS perdidos, {dbl('coalesce(sum(bv) FILTER (WHERE ai IS NULL), 0)')} AS perdida_usd
        FROM j JOIN ys y ON y.i = j.i JOIN ys p ON p.i = j.i - 1 GROUP BY j.i"""
    years = with_(
        f"a AS (SELECT cliente, {dbl('sum(venta)')} AS v FROM g WHERE anno = {YEAR - 1} GROUP BY 1)",
        f"b AS (SELECT cliente, {dbl('sum(venta)')} AS v FROM g WHERE anno = {YEAR} GROUP BY 1)",
    )
    same = "a.cliente IS NOT DISTINCT FROM b.cliente"
    cases, low = [], 1
    for position, (last, name) in enumerate(CFG.frequency_bands, start=1):
        cases.append(f"WHEN pedidos BETWEEN {low} AND {last} THEN {text(name)}" if last else f"ELSE {text(name)}")
        low = (last or 0) + 1

    def expert(dims: str, source: str, vip: int) -> tuple[str, str, dict[str, str]]:
        e = CFG.expert
        b = f"""b AS (SELECT cliente, anno, {dims}, sum(venta) AS v, sum(margen) AS m, count(DISTINCT cod_venta) AS p, max(fecha) AS f
          FROM {source} GROUP BY ALL)"""
        k = f"""k AS (SELECT cliente, sum(v) AS total, sum(p) AS orders, count(DISTINCT tipo) AS kinds,
          max(CASE WHEN anno = {THIS} THEN v ELSE 0 END) AS now, max(CASE WHEN anno = {THIS - 1} THEN v ELSE 0 END) AS prev,
          {ratio('sum(m)', 'sum(v)')} AS margin, date_diff('day', max(f), {DAY}) AS idle FROM b GROUP BY cliente)"""
        tests = {
            "vip": f"now = 0 AND prev > {vip} AND orders > {e.vip_orders}",
            "whale": f"total > {e.whale_money} AND idle > {e.whale_days}",
            "drift": f"prev > 0 AND idle BETWEEN {e.drift_days[0]} AND {e.drift_days[1]}",
            "mono": f"now > 0 AND kinds = 1 AND orders > {e.mono_orders}",
            "once": "orders = 1",
            "margin": f"now > 0 AND margin < {e.thin_margin}",
        }
        return b, k, tests

    b, k, tests = expert("tipo", "g", CFG.expert.vip_money)
    groups = []
    for name, test in tests.items():
        label, action, priority = getattr(CFG.expert, name)
        groups.append(
            f"SELECT {text(label.format(year=THIS))} AS segmento, count(*) FILTER (WHERE {test}) AS n_clientes, "
            f"{text(action)} AS accion, {text(priority)} AS prioridad FROM k"
        )
    expert_rows = with_(b, k) + " UNION ALL ".join(groups)
    b, k, tests = expert("tipo, marca", "sales", CFG.expert.vip_money_wide)
    wide_names = {
        "vip": f"vip_inactivo_{THIS}", "mono": "potencial_cross_sell", "drift": "frecuencia_en_caida",
        "whale": "ballenas_perdidas", "margin": "volumen_bajo_margen", "once": "una_sola_compra",
    }
    wide = with_(b, k) + "SELECT " + ", ".join(f"count(*) FILTER (WHERE {tests[n]}) AS {c}" for n, c in wide_names.items()) + " FROM k"
    red, white = CFG.mix.red_exact, CFG.mix.white_exact
    detail = f"""d AS (SELECT cliente, min(periodo) AS primera_compra, max(periodo) AS ultima_compra, count(DISTINCT cod_venta) AS frecuencia,
      count(DISTINCT periodo) AS meses_activos, {money('venta')} AS valor, {money('margen')} AS margen_total FROM sales GROUP BY 1)"""
    return {
        "top_clientes": with_(base) + ranking,
        "top_clientes_first": with_(base) + ranking + " ORDER BY ranking LIMIT 20",
        "top_clientes_year": with_(f"c AS ({year_stats('gy')})") + f"""SELECT *, (SELECT count(*) FROM c) AS total_clientes,
            {pct('venta_neta', '(SELECT sum(venta_neta) FROM c)')} AS share_pct FROM c""",
        "top_clientes_anno_mat": with_(f"c AS ({year_stats(f'(SELECT * FROM sales WHERE anno = {THIS})')})")
        + f"SELECT *, {big(THIS)} AS anno FROM c",
        "rfm_basic": with_(base) + f"""SELECT cliente, ultima_compra, pedidos AS frecuencia, venta_neta AS valor_monetario, dias_sin_compra,
            {loyalty('pedidos', 'venta_neta')} AS segmento_rfm FROM c""",
        "rfm_details": with_(rfm_cte("g")) + f"SELECT {rfm_columns} FROM r",
        "rfm_stats": with_(rfm_cte("g")) + f"SELECT segmento, count(cliente) AS n_clientes, {money('total')} AS valor_pen FROM r GROUP BY 1",
        "rfm_cross_sell": with_(f"f AS (SELECT cliente, {flags}, sum(venta) AS total FROM gy GROUP BY 1)")
        + f"""SELECT {mix_flags} AS mix_type, count(cliente) AS n_clientes, {rr(ratio('sum(total)', 'count(total)'), 0)} AS avg_pen,
            {dbl('sum(total)')} AS total_pen FROM f GROUP BY 1""",
        "rfm_mix_details": with_(rfm_cte("gy", amounts)) + f"""SELECT cliente, {dbl('total')} AS total_pen, ultima_compra, frecuencia,
            {money_columns}, segmento, {mix_amounts} AS mix_type FROM r""",
        "retencion": retention,
        "retencion_listado_nuevos": years + f"SELECT b.cliente, b.v AS venta FROM b LEFT JOIN a ON {same} WHERE a.v IS NULL",
        "retencion_listado_retenidos": years + f"SELECT b.cliente, b.v AS venta, a.v AS venta_anterior FROM b JOIN a ON {same}",
        "retencion_listado_perdidos": years + f"SELECT a.cliente, a.v AS venta FROM a LEFT JOIN b ON {same} WHERE b.v IS NULL",
        "frecuencia_compra": with_("f AS (SELECT cliente, count(DISTINCT cod_venta) AS pedidos FROM gy GROUP BY 1)")
        + f"SELECT CASE {' '.join(cases)} END AS rango_frecuencia, count(cliente) AS cantidad_clientes FROM f GROUP BY 1",
        "analisis_experto": expert_rows,
        "analisis_clientes_wide": wide,
        "clientes_detalle": with_(detail) + "SELECT * EXCLUDE (valor), valor AS valor_monetario FROM d",
        "cross_sell_opportunity": with_(f"""n AS (SELECT count(DISTINCT cliente) AS n FROM gy WHERE tipo LIKE '%{red}%' AND cliente NOT IN
            (SELECT cliente FROM gy WHERE tipo LIKE '%{white}%'))""",
            f"t AS (SELECT coalesce(nullif({dbl('sum(venta)')}, 0), 1.0) AS total, count(DISTINCT cliente) AS clientes FROM gy)")
        + f"""SELECT n AS clientes_solo_tinto, clientes, total AS venta_total, CASE WHEN total > 1
            THEN 'S/ ' || {big('trunc(n * (total / 10000.0))')} || 'K' ELSE 'S/ 99K' END AS potencial FROM n, t""",
        "filter_customers": with_(rfm_cte("g")) + f"""SELECT {rfm_columns} FROM r WHERE cliente ILIKE '%customer#%' AND dias BETWEEN 0 AND 180
            AND segmento = {text(CFG.rfm.loyal)} ORDER BY total DESC, cliente LIMIT 25 OFFSET 25""",
        "search_customers": with_(detail) + """SELECT * EXCLUDE (valor), valor AS venta_neta FROM d WHERE cliente LIKE '%1%'
            ORDER BY valor DESC, cliente LIMIT 50""",
    }


def finance_sql() -> dict[str, str]:
    def entry(account: str, name: str, debit: str, credit: str, where: str = "true", period: str = "mes") -> str:
        entity = "NULL" if account == "2011" else "cliente"
        return f"""SELECT '{account}' AS cta, '{name}' AS nombre, anno AS ejercicio, {big(period)} AS periodo, {debit} AS debe,
          {credit} AS haber, fecha, cod_venta, {entity} AS cliente, vendedor FROM sales WHERE {where}"""

    ledger = "l AS (" + " UNION ALL ".join(
        (
            entry("1212", "Facturas por cobrar", "venta", "0"),
            entry("7011", "Ventas de mercaderías", "0", "venta"),
            entry("6911", "Costo de ventas", "costo", "0"),
            entry("2011", "Mercaderías", "0", "costo"),
            entry("10", "Efectivo", "venta", "0", "estado = 'F'"),
            entry("1212", "Facturas por cobrar", "venta", "0", "mes = 1", "0"),
            entry("6911", "Costo de ventas", "costo", "0", "mes = 1", "0"),
        )
    ) + ")"
    statement = f"""SELECT cta AS cuenta, nombre, ejercicio, periodo, {dbl('sum(debe)')} AS debe, {dbl('sum(haber)')} AS haber
      FROM l WHERE ejercicio IN ({YEAR - 1}, {YEAR})"""
    return {
        "fin_balance": with_(ledger) + statement + " AND regexp_matches(cta, '^[1-5]') GROUP BY 1, 2, 3, 4",
        "fin_resultados": with_(ledger) + statement + " AND regexp_matches(cta, '^[67]') AND periodo <> 0 GROUP BY 1, 2, 3, 4",
        "fin_flujo": with_(ledger) + f"""SELECT ejercicio, periodo, {dbl('sum(debe)')} AS ingresos, {dbl('sum(haber)')} AS egresos,
            {dbl('sum(debe - haber)')} AS flujo_neto FROM l WHERE cta LIKE '10%' AND ejercicio = {YEAR} GROUP BY 1, 2""",
        "fin_detalle": with_(ledger) + f"""SELECT fecha, 'R-' || cod_venta AS registro, 'Venta ' || cod_venta AS glosa, '01' AS doc_tipo,
            CAST(cod_venta AS VARCHAR) AS doc_numero, coalesce(cliente, vendedor) AS entidad, {dbl('debe')} AS debe,
            {dbl('haber')} AS haber, 'PEN' AS moneda FROM l WHERE ejercicio = {YEAR} AND cta = '{ACCOUNT}' AND periodo = {PERIOD}""",
        "ledger_profile_years": with_(ledger) + "SELECT ejercicio, count(*) AS filas FROM l GROUP BY 1",
        "ledger_profile_accounts": with_(ledger)
        + "SELECT cta AS nro_cta, nombre AS nombre_cuenta, count(*) AS filas FROM l GROUP BY 1, 2",
    }


def forecast_sql() -> dict[str, str]:
    h, season = CFG.horizon, CFG.season_length
    total = f"""SELECT periodo, anno, mes, {money('venta', 2)} AS venta_neta, {money('margen', 2)} AS margen_neto,
      {big('sum(cantidad)')} AS unidades, count(DISTINCT cod_venta) AS pedidos FROM sales GROUP BY 1, 2, 3"""
    base = r"trim(regexp_replace(regexp_replace(producto, '\s*(19\d{2}|20[0-4]\d)\b', '', 'g'), '\s{2,}', ' ', 'g'))"
    vintage = "v AS (SELECT * EXCLUDE (producto), producto || ' ' || anno AS producto FROM sales)"
    units = f"""u AS (SELECT {base} AS producto, coalesce(marca, {text(NO_BRAND)}) AS marca, periodo, anno, mes, cantidad
      FROM v WHERE cantidad > 0)"""
    brand = f"""b AS (SELECT producto, marca, uds AS unidades_marca FROM (SELECT producto, marca, {big('sum(cantidad)')} AS uds,
      row_number() OVER (PARTITION BY producto ORDER BY sum(cantidad) DESC, marca) AS n FROM u GROUP BY 1, 2) WHERE n = 1)"""
    series = f"""s AS (SELECT * EXCLUDE (meses) FROM (SELECT *, count(*) OVER (PARTITION BY producto) AS meses FROM (
      SELECT producto, b.marca, periodo, anno, mes, {big('sum(cantidad)')} AS unidades FROM u JOIN b USING (producto)
      GROUP BY ALL)) WHERE meses >= {CFG.min_series_months})"""
    grid = """grid AS (SELECT p.producto, p.marca, p.propio, m.periodo, coalesce(s.unidades, 0) AS unidades
      FROM (SELECT producto, marca, max(periodo) AS propio FROM s GROUP BY 1, 2) p
      CROSS JOIN (SELECT CAST(unnest(generate_series(min(periodo), max(periodo), INTERVAL 1 MONTH)) AS DATE) AS periodo FROM sales) m
      LEFT JOIN s ON s.producto = p.producto AND s.periodo = m.periodo)"""
    products = (vintage, units, brand, series, grid)

    def quantiles(source: str, keys: str) -> tuple[str, str, str]:
        part = f"PARTITION BY {keys} ORDER BY periodo"
        k = f"""k AS (SELECT *, row_number() OVER ({part}) AS rn, y - lag(y, {season}) OVER ({part}) AS d FROM {source})"""
        q = f"""q AS (SELECT {keys}, max(periodo) AS ultimo, count(*) AS n, sum(y) / count(*) AS media, quantile_cont(d, 0.1) AS lo,
          quantile_cont(d, 0.5) AS mid, quantile_cont(d, 0.9) AS hi FROM k GROUP BY {keys})"""
        on = " AND ".join(f"k.{key} = q.{key}" for key in keys.split(", "))
        own = ", ".join(f"q.{key}" for key in keys.split(", "))

        def level(name: str, short: str) -> str:
            return f"greatest(0.0, CASE WHEN n > {season} THEN k.y + {name} ELSE {short} END)"

        f = f"""f AS (SELECT {own}, ultimo, h, {level('mid', 'media')} AS forecast, {level('lo', '0.0')} AS fc_lo,
          {level('hi', 'media * 1.5 + 1.0')} AS fc_hi FROM q CROSS JOIN range(1, {h + 1}) r(h)
          LEFT JOIN k ON {on} AND k.rn = q.n - {season} + h)"""
        return k, q, f

    total_ctes = (f"m AS ({total})", "x AS (SELECT 1 AS one, periodo, venta_neta AS y FROM m)", *quantiles("x", "one"))
    future = "CAST(ultimo + to_months(CAST(h AS INTEGER)) AS DATE)"
    null = "CAST(NULL AS DOUBLE)"
    total_table = with_(*total_ctes) + f"""SELECT periodo, anno, mes, venta_neta AS venta_real, {null} AS forecast, {null} AS fc_lo,
        {null} AS fc_hi, {text(TAG_HISTORY)} AS tipo FROM m UNION ALL
        SELECT {future}, {big(f'year({future})')}, {big(f'month({future})')}, {null}, {rr('forecast', 2)}, {rr('fc_lo', 2)},
        {rr('fc_hi', 2)}, {text(TAG_FORECAST)} FROM f"""
    product_ctes = (*products, "x AS (SELECT producto, marca, propio, periodo, CAST(unidades AS DOUBLE) AS y FROM grid)")
    product_ctes = (*product_ctes, *quantiles("x", "producto, marca, propio"))
    names = str(list(MONTHS_ES))

    def product_table(anchor: str) -> str:
        day = f"CAST({anchor} + to_months(CAST(h AS INTEGER)) AS DATE)"
        return f"""t AS (SELECT *, ({names})[mes] || ' ' || anno AS mes_label FROM (
          SELECT producto, marca, periodo, anno, mes, {dbl('unidades')} AS uds_real, {null} AS fc_uds, {null} AS fc_lo, {null} AS fc_hi,
          {text(TAG_HISTORY)} AS tipo FROM s UNION ALL
          SELECT producto, marca, {day}, {big(f'year({day})')}, {big(f'month({day})')}, {null}, {rr('forecast', 1)}, {rr('fc_lo', 1)},
          {rr('fc_hi', 1)}, {text(TAG_FORECAST)} FROM f))"""

    params = ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE, {p}::DOUBLE)" for i, (a, b, p) in enumerate(SMOOTHING))
    short = f"""z AS (SELECT producto, marca, periodo, CAST(unidades AS DOUBLE) AS y, row_number() OVER (PARTITION BY producto ORDER BY periodo) AS rn
        FROM (SELECT * FROM grid QUALIFY row_number() OVER (PARTITION BY producto ORDER BY periodo DESC) <= 9)),
      params(i, a, b, p) AS (VALUES {params}),
      fold AS (SELECT one.producto, one.marca, i, a, b, p, 1 AS t, one.y AS l, two.y - one.y AS d, 0::DOUBLE AS sse, []::DOUBLE[] AS errors
        FROM z one JOIN z two ON two.producto = one.producto AND one.rn = 1 AND two.rn = 2, params
        UNION ALL SELECT fold.producto, fold.marca, i, a, b, p, t + 1, (l + p * d) + a * (y - (l + p * d)), p * d + b * (y - (l + p * d)),
          sse + (y - (l + p * d)) * (y - (l + p * d)), list_append(errors, y - (l + p * d))
        FROM fold JOIN z ON z.producto = fold.producto AND rn = t + 1),
      last AS (SELECT producto, max(periodo) AS ultimo, max(rn) AS n FROM z GROUP BY 1),
      fit AS (SELECT fold.*, ultimo, n FROM fold JOIN last USING (producto) WHERE t = n QUALIFY row_number() OVER (PARTITION BY producto ORDER BY sse, i) = 1),
      sim AS (SELECT producto, marca, ultimo, a, b, p, errors, k, 0 AS h, l, d, 0::DOUBLE AS y FROM fit, range(0, 8) r(k)
        UNION ALL SELECT producto, marca, ultimo, a, b, p, errors, k, h + 1, (l + p * d) + a * errors[1 + (k + h) % 8],
          p * d + b * errors[1 + (k + h) % 8], (l + p * d) + errors[1 + (k + h) % 8] FROM sim WHERE h < {h}),
      sq AS (SELECT producto, marca, ultimo, h, greatest(0, quantile_cont(y, 0.5)) AS forecast, greatest(0, quantile_cont(y, 0.1)) AS fc_lo,
        greatest(0, quantile_cont(y, 0.9)) AS fc_hi FROM sim WHERE h > 0 GROUP BY ALL)"""
    own = with_(*product_ctes, product_table("propio"))
    rollup = ", ".join(f"{big(rr(f'sum(coalesce({c}, 0.0))', 0))} AS {c}" for c in ("fc_uds", "fc_lo", "fc_hi"))
    return {
        "fc_serie_total": with_() + total,
        "strip_vintage": with_(vintage) + f"SELECT producto, {base} AS producto_base, count(*) AS filas FROM v GROUP BY 1, 2",
        "dominant_brand": with_(vintage, units, brand) + "SELECT * FROM b",
        "fc_serie_productos": with_(vintage, units, brand, series) + "SELECT * FROM s",
        "zero_fill_grid": with_(*products) + f"SELECT producto, marca, periodo, {big('unidades')} AS unidades FROM grid",
        "forecast_quantiles": with_(*product_ctes) + f"""SELECT producto, marca, ultimo, {big('h')} AS h, {rr('forecast', 4)} AS forecast,
            {rr('fc_lo', 4)} AS fc_lo, {rr('fc_hi', 4)} AS fc_hi FROM f""",
        "forecast_quantiles_short": with_(*products, short).replace("WITH ", "WITH RECURSIVE ", 1) + f"""SELECT producto, marca, ultimo,
            {big('h')} AS h, {rr('forecast', 4)} AS forecast, {rr('fc_lo', 4)} AS fc_lo, {rr('fc_hi', 4)} AS fc_hi FROM sq""",
        "forecast_total": total_table,
        "forecast_productos": own + "SELECT * FROM t",
        "forecast_productos_global": with_(*product_ctes, product_table("ultimo")) + "SELECT * FROM t",
        "read_forecast_total": total_table,
        "read_forecast_productos": own + "SELECT * FROM t WHERE producto = 'red widget'",
        "forecast_catalogo": own + f"SELECT DISTINCT marca, producto FROM t WHERE tipo = {text(TAG_FORECAST)}",
        "forecast_rollup_3m": own + f"""SELECT producto, {rollup} FROM t GROUP BY 1""",
        "write_truncate": total_table,
        "export_csv": own + f"SELECT * FROM t WHERE tipo = {text(TAG_FORECAST)}",
    }


def source_sql() -> dict[str, str]:
    sheet = """o AS (SELECT o_orderkey + 7 AS row_no, o_orderkey, o_custkey, o_orderstatus = 'P' AS blank,
      CASE WHEN o_orderkey % 2 = 0 THEN '' END AS nothing, substring(o_orderpriority, 1, 1) AS serie FROM orders)"""

    def cell(x: str) -> str:
        return f"CASE WHEN blank THEN nothing ELSE CAST({x} AS VARCHAR) END"

    columns = f"{cell('o_orderkey')} AS codigo_venta, {cell('serie')} AS serie, {cell('o_orderkey + 1000')} AS numero, {cell('o_custkey')} AS cliente"
    lookup = f"""d AS (SELECT CASE WHEN l_returnflag = 'R' THEN '' ELSE CAST(l_orderkey AS VARCHAR) END AS codigo_venta,
      CAST(l_partkey AS VARCHAR) AS codigo, l_quantity / 2 AS cant, CASE WHEN l_returnflag = 'R' THEN NULL
      WHEN o_orderkey IS NULL THEN {text(NOT_FOUND)} ELSE serie || '-' || (o_orderkey + 1000) END AS factura
      FROM lineitem LEFT JOIN o ON o_orderkey = l_orderkey AND NOT blank)"""
    number = "CASE WHEN value IS NULL OR isnan(value) THEN '' WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END"
    events = f"""SELECT coalesce(CAST(event_id AS VARCHAR), '') AS event_id, coalesce(strftime(ts, '%d/%m/%Y'), '') AS ts,
      coalesce(CAST(user_id AS VARCHAR), '') AS user_id, coalesce(event_type, '') AS event_type, {number} AS value,
      coalesce(props, '') AS props FROM events"""
    every = {**time_sql(), **products_sql(), **customers_sql()}

    def top(name: str, order: str, limit: int) -> str:
        return f"SELECT * FROM ({every[name]}) ORDER BY {order} LIMIT {limit}"

    # Section or view -> its rows, key columns and measures.
    figures_of = "venta_neta margen pct_margen unidades clientes pedidos pedido_promedio"
    view_figures = "venta_neta_total margen_neto_total pct_margen_bruto unidades_total clientes_activos num_pedidos aov"
    brand = (top("dim_marca_all", "venta_neta DESC, marca_producto", CFG.brand_limit), "marca_producto", "venta_neta margen_neto unidades")
    margins = (top("margen_marca_all", "margen_pct DESC, marca_producto", CFG.brand_limit), "marca_producto", "margen_pct venta_neta unidades")
    country = ("pais_origen_producto", "venta_neta margen_neto unidades pedidos clientes")
    kind = (every["dim_tipo"], "nombre_tipo_bebida", "venta_neta unidades pct_venta")
    ranked = ("producto nombre_tipo_bebida", "unidades venta_neta margen_neto margen_pct pct_total_uds ranking")
    season = (every["estacionalidad"], "anno mes mes_label nivel", "venta_mes indice_estacional")
    month = ("periodo anno mes periodo_label", "venta_neta margen_neto unidades pedidos aov")
    rfm = ("cliente ultima_compra segmento_rfm", "frecuencia valor_monetario dias_sin_compra")
    sections = {
        "kpis": (every["kpi_year"], "periodo anno", figures_of),
        "serie": (every["serie_mensual_year"], *month),
        "pais": (top("dim_pais", "venta_neta DESC, pais_origen_producto", 10), *country),
        "tipo": kind,
        "marca": brand,
        "top_cli": (top("top_clientes", "ranking", 500), *TOP_CLIENTES),
        "top_prd": (top("top_productos", "ranking", 6), *ranked),
        "vendedores": (every["vendedores"], *VENDEDORES),
        "segmentos": (every["segmento_precio_costo"], *SEGMENTOS),
        "margenes": margins,
        "rfm": (top("rfm_basic", "valor_monetario DESC, cliente", 8), *rfm),
        "heat": season,
    }
    previous = " ".join(f"{m}_prev" for m in METRICS)
    views = {
        "kpi_global": (every["kpi_global"], "", view_figures),
        "serie_mensual": (every["serie_mensual"], *month),
        "dimension_pais": (every["dim_pais"], *country),
        "dimension_tipo": kind,
        "dimension_marca": brand,
        "top_clientes": (every["top_clientes"], *TOP_CLIENTES),
        "top_productos": (every["top_productos"], *ranked),
        "vendedores": sections["vendedores"],
        "segmento_precio": sections["segmentos"],
        "margen_marca": margins,
        "rfm": (every["rfm_basic"], *rfm),
        "estacionalidad": season,
        "kpi_ytd": (every["kpi_ytd"], "anno fecha_corte", f"{figures_of} {previous}"),
        "top_clientes_anno": (every["top_clientes_anno_mat"], *TOP_CLIENTES_ANNO),
    }
    base = f"""SELECT 'ventas_dashboard' AS seccion, concat_ws('|', CAST(anno AS VARCHAR), CAST(mes AS VARCHAR)) AS clave, 'venta' AS medida,
        {dbl('round(sum(venta), 2)')} AS valor FROM sales GROUP BY anno, mes"""

    def long(parts: dict[str, tuple[str, str, str]]) -> str:
        found = []
        for name, (sql, keys, measures) in parts.items():
            key = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys.split()) or "''"
            pairs = ", ".join(f"{{'m': '{m}', 'v': {dbl(m)}}}" for m in measures.split())
            found.append(f"""SELECT '{name}' AS seccion, concat_ws('|', {key}) AS clave, u.m AS medida, u.v AS valor
                FROM (SELECT *, unnest([{pairs}]) AS u FROM ({sql}))""")
        return " UNION ALL ".join(found)

    line = f"""cod_venta, cliente, fecha, mes, producto, marca AS marca_producto, tipo AS nombre_tipo_bebida,
            pais AS pais_origen_producto, vendedor, cantidad, {dbl('venta')} AS venta_neta_mn, {dbl('costo')} AS costo_mn_total,
            {dbl('margen')} AS margen_mn, estado AS estado_pedido, anno"""
    dims = products_sql()
    return {
        "sales_fact": with_() + f"SELECT {line} FROM sales",
        "guarded_sales": with_() + f"SELECT {line} FROM g",
        "lower_columns": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
        "year_window": with_() + f"""SELECT {line},
            CASE WHEN anno = {THIS} THEN 'Current' WHEN anno = {THIS - 1} THEN 'Previous' ELSE 'Older' END AS temporalidad
            FROM sales WHERE anno >= {THIS - 1}""",
        "rfm_header_join": with_() + f"""SELECT {line}, CASE WHEN cod_venta % 10 = 0
            THEN {DEFAULT_EXCHANGE_RATE} ELSE (350 + cod_venta % 50) / 100.0::DOUBLE END::DOUBLE AS tc FROM g""",
        "materialize_views": f"{long(views)} UNION ALL ({with_()}{base})",
        "dashboard_bundle": long(sections),
        "resolve_materialized": f"""SELECT pais_origen_producto AS nombre, venta_neta, unidades FROM ({dims['dim_pais']}) UNION ALL
            SELECT nombre_tipo_bebida, venta_neta, unidades FROM ({dims['dim_tipo']})""",
        "promote_header": f"WITH {sheet} SELECT row_no, {columns} FROM o",
        "select_trimmed": f"WITH {sheet} SELECT row_no, {cell('o_orderkey')} AS codigo_venta, {cell('o_orderkey + 1000')} AS numero FROM o",
        "drop_blank_rows": f"WITH {sheet} SELECT row_no, {columns} FROM o WHERE NOT blank",
        "invoice_key": f"""WITH {sheet} SELECT row_no, CAST(o_orderkey AS VARCHAR) AS codigo_venta,
            serie || '-' || (o_orderkey + 1000) AS factura FROM o WHERE NOT blank""",
        "lookup_first": f"WITH {sheet}, {lookup} SELECT codigo_venta, codigo, factura FROM d",
        "inventory_key_sales": f"""WITH {sheet}, {lookup} SELECT codigo_venta, cant, CASE WHEN codigo_venta <> ''
            THEN factura || codigo || {big('round_even(cant, 0)')} END AS clave_inventario FROM d""",
        "inventory_key_movement": f"""SELECT l_suppkey AS almacen, l_returnflag || '-' || l_orderkey || l_partkey ||
            {big('round_even(l_quantity / 2, 0)')} AS clave_inventario FROM lineitem""",
        "normalize_cells": events,
        "incremental_append": events,
        "append_rows": events,
        "cost_by_occurrence": f"""WITH l AS (SELECT *, l_orderkey * 10 + l_linenumber AS place, l_returnflag || '-' || l_linenumber
              || (l_partkey % 50) || {big('round_even(l_quantity / 2, 0)')} AS clave FROM lineitem),
            v AS (SELECT clave, row_number() OVER (PARTITION BY clave ORDER BY place) AS n, place AS venta FROM l WHERE l_orderkey % 4 <> 0),
            m AS (SELECT clave, row_number() OVER (PARTITION BY clave ORDER BY place, l_extendedprice) AS n, place AS movimiento,
              l_extendedprice AS costo FROM l WHERE l_orderkey % 3 <> 0)
            SELECT clave, n, CAST(venta AS VARCHAR) AS venta, CAST(movimiento AS VARCHAR) AS movimiento, costo, CASE WHEN movimiento IS NULL THEN 'sin movimiento' WHEN venta IS NULL THEN 'sin venta'
              ELSE 'emparejado' END AS estado FROM v FULL JOIN m USING (clave, n)""",
        "csv_rows": """SELECT row_number() OVER (ORDER BY event_id) AS row_no, CAST(event_id AS VARCHAR) AS event_id,
            '"' || event_type || '", ' || props || chr(10) || 'fin' AS nota, CAST(user_id AS VARCHAR) AS user_id FROM events""",
        "transactional_append": """SELECT 'events' AS fuente, event_id AS clave, 'ok' AS estado FROM events WHERE event_id IS NOT NULL
            UNION ALL SELECT 'orders', o_orderkey, 'error' FROM orders WHERE o_orderkey % 3 = 0""",
    }


def all_sql() -> dict[str, str]:
    every = {**source_sql(), **time_sql(), **products_sql(), **customers_sql(), **finance_sql(), **forecast_sql()}

    def first(name: str, order: str, limit: int) -> str:
        return f"SELECT * FROM ({every[name]}) ORDER BY {order} LIMIT {limit}"

    def in_year(sql: str) -> str:
        """The same over the lines of one year."""
        whole = SALES.replace("sales AS (", "sales_all AS (", 1)
        return sql.replace(SALES, f"{whole},\nsales AS (SELECT * FROM sales_all WHERE anno = {YEAR})", 1)

    lists = ("dim_pais", "dim_tipo", "productos_detalle", "clientes_detalle")
    return {
        **every,
        **{f"{name}_year": in_year(every[name]) for name in lists},
        "dim_marca_year": in_year(every["dim_marca_all"]),
        "margen_marca_year": in_year(every["margen_marca_all"]),
        "dim_marca": first("dim_marca_all", "venta_neta DESC, marca_producto", CFG.brand_limit),
        "margen_marca": first("margen_marca_all", "margen_pct DESC, marca_producto", CFG.brand_limit),
        "margen_marca_anno_all": every["margen_marca_anno"],
        "refresh_years": every["materialize_views"],
        "kpi_year_states": every["kpi_year"],
        "kpi_ytd_states": every["kpi_ytd"],
        "top_productos_year_first": first("top_productos_year", "venta_neta DESC, producto, marca, tipo", 500),
        "top_clientes_year_first": first("top_clientes_year", "venta_neta DESC, cliente", 500),
    }
