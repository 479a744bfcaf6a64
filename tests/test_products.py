from __future__ import annotations

import random
from dataclasses import replace
from decimal import Decimal

import pytest

from cellarline.config import DEFAULTS
from cellarline.functions.frames import rank_rows
from cellarline.operators import products
from pyspark.sql import functions as F
from tests.conftest import by, rows


def test_dimensions_keep_null_group(sales):
    df = sales(dict(tipo=None, venta=25), dict(tipo="Vino Blanco", venta=75))
    got = by(products.dim_tipo(df), "nombre_tipo_bebida")
    assert got[None]["pct_venta"] == 25.0 and got["Vino Blanco"]["pct_venta"] == 75.0


def test_ties_are_broken_by_name(sales):
    df = sales(*[dict(marca=m, venta=10) for m in "DCBA"])
    assert [r["marca_producto"] for r in rows(products.dim_marca(df, limit=2))] == ["A", "B"]


def test_margin_needs_more_revenue_than_the_limit(sales):
    df = sales(dict(marca="at", venta=50_000), dict(marca="above", venta=50_001))
    assert [r["marca_producto"] for r in rows(products.margen_marca(df))] == ["above"]


PRICES = ["-5", "68.99", "69", "149.99", "149.995", "150", "299.99", "299.995", "300", "600", "600.01"]


def expected_band(price: Decimal) -> int:
    if price < 69:
        return 1
    for low, high, band in (("69", "149.99", 2), ("150", "299.99", 3), ("300", "600", 4)):
        if Decimal(low) <= price <= Decimal(high):
            return band
    return 5


@pytest.mark.parametrize("units", [1, 3, -2])
def test_price_bands_and_their_gaps(sales, units):
    df = sales(*[dict(venta=Decimal(p) * units, cantidad=units) for p in PRICES], dict(cantidad=0), dict(cantidad=None))
    want: dict[int, int] = {}
    for p in PRICES:
        want[expected_band(Decimal(p))] = want.get(expected_band(Decimal(p)), 0) + units
    assert {r["orden"]: r["botellas"] for r in rows(products.segmento_precio_venta(df))} == want


def test_cost_bands_need_units(sales):
    df = sales(dict(costo=74.99), dict(costo=75), dict(costo=480), dict(costo=1, cantidad=0))
    got = rows(products.segmento_precio_costo(df))
    assert [r["segmento"][0] for r in got] == ["1", "2", "4"] and [r["pct_volumen"] for r in got] == [33.3, 33.3, 33.3]


def test_share_total_counts_types_that_are_then_dropped(sales):
    df = sales(dict(tipo="a", venta=150), dict(tipo="b", venta=-50), dict(tipo=None, venta=100))
    got = by(products.market_share_tipo(df), "tipo")
    assert set(got) == {"a", "Desconocido"} and got["a"]["share_pct"] == 75.0


def test_anchor_brand(sales):
    df = sales(
        dict(pais="X", marca="b", venta=60), dict(pais="X", marca="a", venta=60), dict(pais="X", marca="n", venta=-30),
        dict(pais="Y", marca=None, venta=10),
    )
    got = by(products.dependencia_marca(df), "pais")
    assert got["X"]["marca_ancla"] == "a" and got["X"]["dependencia_pct"] == 50.0
    assert got["Y"]["marca_ancla"] == "Sin Marca" and got["Y"]["dependencia_pct"] == 100.0


def test_brand_fit_takes_top_brands_only(sales):
    df = sales(dict(marca="big", venta=90, tipo="t"), dict(marca="big", venta=10, tipo="u"), dict(marca="small", venta=5))
    got = rows(products.brand_type_fit(df, cfg=replace(DEFAULTS, fit_brands=1)))
    assert [(r["marca"], r["tipo"], r["share_pct"]) for r in got] == [("big", "t", 90.0), ("big", "u", 10.0)]


@pytest.mark.parametrize(
    ("venta", "costo", "action"),
    [
        (200_000, 100_000, "Estrella principal"),
        (60_000, 40_000, "Consolidar"),
        (60_000, 50_000, "Revisar precios"),
        (40_000, 20_000, "Ampliar impulso"),
        (40_000, 27_000, "Ampliar portafolio"),
        (40_000, 36_000, "Reestructurar"),
        (40_000, 32_000, "Mantener"),
    ],
)
def test_country_action(sales, venta, costo, action):
    assert rows(products.productos_mix_pais(sales(dict(venta=venta, costo=costo))))[0]["accion"] == action


def test_origin_without_name_and_without_revenue(sales):
    df = sales(dict(pais=None, venta=10), dict(pais="Z", venta=-1))
    assert [r["pais"] for r in rows(products.rentabilidad_origen(df))] == ["Sin Origen"]


def test_year_ranking_counts_all_products(sales):
    df = sales(*[dict(producto=f"p{i}", venta=i, fecha="2024-01-01") for i in range(1, 8)], dict(fecha="2023-01-01"))
    got = rows(products.top_productos_year(df, 2024, 2))
    assert [r["producto"] for r in got] == ["p7", "p6"] and got[0]["total_productos"] == 7
    assert len(rows(products.top_productos_year(df, 0, 0))) == 8


def test_shares_are_of_positive_rows(sales):
    df = sales(dict(marca="a", venta=30), dict(marca="b", venta=10), dict(marca="c", venta=-40))
    assert [(r["marca"], r["share_pct"]) for r in rows(products.marcas_all(df))] == [("a", 75.0), ("b", 25.0)]
    assert len(rows(products.productos_all(df))) == 2


def test_product_pages(sales):
    df = sales(*[dict(producto=f"Malbec {i:02d}", marca="Casa", venta=100 - i) for i in range(30)], dict(producto="Otro", marca="x"))
    details = products.productos_detalle(df)
    second = rows(products.search_products(details, "CASA", number=2, size=20))
    assert [r["producto"] for r in second] == [f"Malbec {i:02d}" for i in range(20, 30)]
    assert rows(products.search_products(details, "100%")) == []
    found = rows(products.filter_products(details, name="malbec", margin=(None, 30.0)))
    assert found and all(r["margen_pct"] <= 30.0 for r in found)


def test_distributed_rank_equals_sorted_order(spark):
    rng = random.Random(5)
    # A third of the rows share one value.
    values = [(0 if rng.random() < 0.34 else rng.randrange(500), f"k{i:04d}") for i in range(3000)]
    df = spark.createDataFrame(values, "v bigint, k string").repartition(7)
    got = {r["k"]: r["ranking"] for r in rank_rows(df, [F.desc("v"), F.asc("k")]).collect()}
    want = {k: i for i, (_, k) in enumerate(sorted(values, key=lambda r: (-r[0], r[1])), start=1)}
    assert got == want


def test_rank_with_limit(sales):
    df = sales(*[dict(producto=f"p{i}", cantidad=i) for i in range(1, 10)])
    got = rows(products.top_productos(df, limit=3))
    assert [(r["ranking"], r["producto"]) for r in got] == [(1, "p9"), (2, "p8"), (3, "p7")]
    assert got[0]["pct_total_uds"] == 20.0


def test_no_limit_means_all_rows(sales):
    df = sales(*[dict(marca=f"M{n:02d}", producto=f"P{n}", venta=100 + n) for n in range(30)])
    cfg = replace(DEFAULTS, brand_min_revenue=0)
    for limit, count in ((None, 30), (0, 30), (8, 8)):
        assert products.dim_marca(df, limit=limit).count() == count
        assert products.margen_marca(df, limit=limit, cfg=cfg).count() == count
        assert products.top_productos_year(df, 0, limit).count() == count
