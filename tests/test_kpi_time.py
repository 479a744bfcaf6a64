from __future__ import annotations

import datetime as dt
from dataclasses import replace

from cellarline.config import DEFAULTS
from cellarline.operators import kpi, timeops
from cellarline.sources.fact import guarded
from tests.conftest import by, rows

TODAY = dt.date(2024, 6, 15)


def test_kpi_global_ignores_null_customer_in_count(sales):
    df = sales(
        dict(cod=1, cliente="A", venta=100), dict(cod=1, cliente="A", venta=50), dict(cod=2, cliente=None, venta=25)
    )
    got = rows(kpi.kpi_global(df))[0]
    assert got["clientes_activos"] == 1 and got["num_pedidos"] == 2
    assert got["venta_neta_total"] == 175.0 and got["aov"] == 88.0  # 87.5 rounds up


def test_kpi_of_nothing(sales):
    got = rows(kpi.kpi_global(sales(dict()).limit(0)))[0]
    assert got["venta_neta_total"] is None and got["pct_margen_bruto"] is None and got["num_pedidos"] == 0


def test_kpi_zero_revenue_has_no_margin_percent(sales):
    got = rows(kpi.kpi_global(sales(dict(venta=10), dict(venta=-10))))[0]
    assert got["pct_margen_bruto"] is None


def test_running_year_is_cut_on_both_sides(sales):
    df = sales(
        dict(cod=1, fecha="2024-06-15", venta=10), dict(cod=2, fecha="2024-06-16", venta=20),
        dict(cod=3, fecha="2023-06-15", venta=5), dict(cod=4, fecha="2023-12-01", venta=7),
    )
    running = by(kpi.kpi_year(df, 2024, TODAY), "periodo")
    assert running["current"]["venta_neta"] == 10.0 and running["previous"]["venta_neta"] == 5.0
    closed = by(kpi.kpi_year(df, 2024, dt.date(2025, 1, 1)), "periodo")
    assert closed["current"]["venta_neta"] == 30.0 and closed["previous"]["venta_neta"] == 12.0


def test_missing_previous_year_keeps_its_row(sales):
    df = sales(dict(fecha="2024-03-01"))
    previous = by(kpi.kpi_year(df, 2024, TODAY), "periodo")["previous"]
    assert previous["venta_neta"] is None and previous["pedidos"] == 0 and previous["anno"] == 2023
    delta = by(kpi.kpi_yoy_delta(df, 2024, TODAY), "metrica")
    assert delta["venta_neta"]["direccion"] == "neutral" and delta["venta_neta"]["delta_pct"] is None
    assert delta["clientes"]["direccion"] == "neutral"


def test_ytd_row(sales):
    df = sales(dict(fecha="2024-03-01", venta=120), dict(fecha="2023-02-01", venta=100), dict(fecha="2023-11-01", venta=900))
    got = rows(kpi.kpi_ytd(df, TODAY))
    assert len(got) == 1 and got[0]["venta_neta"] == 120.0 and got[0]["venta_neta_prev"] == 100.0
    assert got[0]["anno"] == 2024 and got[0]["fecha_corte"] == "2024-06-15"


def test_delta_direction(sales):
    df = sales(dict(fecha="2024-03-01", venta=80), dict(fecha="2023-02-01", venta=100))
    got = by(kpi.kpi_yoy_delta(df, 2024, TODAY), "metrica")["venta_neta"]
    assert got["delta_pct"] == -20.0 and got["direccion"] == "down"


def test_monthly_series_label_and_order(sales):
    df = sales(dict(fecha="2024-02-03"), dict(fecha="2023-12-31", cod=2), dict(fecha="2024-02-20", cod=3))
    got = rows(timeops.serie_mensual(df))
    assert [r["periodo_label"] for r in got] == ["Dec 2023", "Feb 2024"]
    assert got[1]["pedidos"] == 2
    assert len(rows(timeops.serie_mensual(df, 2023))) == 1


def test_seasonal_levels(sales):
    df = sales(
        dict(fecha="2024-01-01", venta=120), dict(fecha="2024-02-01", venta=101),
        dict(fecha="2024-03-01", venta=90), dict(fecha="2024-04-01", venta=89),
    )
    got = by(timeops.estacionalidad(df), "mes")
    assert [got[m]["nivel"] for m in (1, 2, 3, 4)] == ["Muy alto", "Alto", "Normal", "Normal"]
    assert got[1]["indice_estacional"] == 120.0
    strict = replace(DEFAULTS, season_levels=((1.5, "x"),), season_rest="y")
    assert {r["nivel"] for r in rows(timeops.estacionalidad(df, strict))} == {"y"}


def test_seasonal_matrix_fills_missing_months(sales):
    got = rows(timeops.estacionalidad_matrix(sales(dict(fecha="2023-05-01"), dict(fecha="2024-01-01"))))
    assert [r["anno"] for r in got] == [2024, 2023]
    assert got[0]["m01"] == 100.0 and got[0]["m05"] == 0.0


def test_yoy_month_without_predecessor(sales):
    df = sales(dict(fecha="2024-01-05", venta=110), dict(fecha="2023-01-05", venta=100), dict(fecha="2024-02-05"))
    got = by(timeops.yoy_mensual(df, 2024), "mes")
    assert got[1]["delta_pct"] == 10.0 and got[2]["delta_pct"] is None and got[2]["mes_label"] == "Feb"


def test_brand_margin_matrix(sales):
    df = sales(dict(fecha="2024-01-05", marca="M"), dict(fecha="2023-01-05", marca=None))
    got = by(timeops.margen_marca_anno(df, (2023, 2024)), "marca_producto")
    assert got["M"]["margen_2024"] == 40.0 and got["M"]["margen_2023"] is None and got[None]["margen_2023"] == 40.0


def test_year_window_labels(sales):
    df = sales(dict(fecha="2024-01-05"), dict(fecha="2023-01-05"), dict(fecha="2022-01-05"))
    assert [r["temporalidad"] for r in rows(timeops.year_window(df, TODAY).orderBy("fecha"))] == ["Previous", "Current"]


def test_guard_drops_null_and_empty_country(sales):
    assert guarded(sales(dict(pais=None), dict(pais=""), dict(pais="Chile"))).count() == 1


def test_all_years_and_absolute_change(spark, sales):
    df = sales(dict(fecha="2023-05-01", venta=50), dict(fecha="2024-05-01", venta=80), dict(fecha="2020-01-01", venta=7))
    whole = kpi.kpi_year(df, None).collect()
    assert [(r["periodo"], r["anno"], r["venta_neta"]) for r in whole] == [("current", 0, 137.0)]
    assert kpi.kpi_year(df, 0).collect() == whole
    deltas = by(kpi.kpi_yoy_delta(df, 2024, "2025-01-01"), "metrica")
    assert (deltas["venta_neta"]["delta"], deltas["venta_neta"]["delta_pct"]) == (30.0, 60.0)
