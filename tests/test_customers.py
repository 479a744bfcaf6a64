from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict
from dataclasses import replace

import pytest

from cellarline.config import DEFAULTS
from cellarline.operators import customers
from tests.conftest import by, rows

TODAY = dt.date(2024, 6, 30)


def days_ago(n: int) -> str:
    return (TODAY - dt.timedelta(days=n)).isoformat()


def test_ranking_counts_recency_from_the_month_start(sales):
    df = sales(dict(cliente="A", fecha="2024-06-20", venta=300), dict(cliente="B", fecha="2024-01-31", venta=100))
    got = by(customers.top_clientes(df, TODAY), "cliente")
    assert got["A"]["dias_sin_compra"] == 29 and got["A"]["ultima_compra"] == dt.date(2024, 6, 1)
    assert got["A"]["share_pct"] == 75.0 and got["A"]["ranking"] == 1
    assert got["B"]["segmento_rfm"] == "🔴 Inactivo"
    assert [r["cliente"] for r in rows(customers.top_clientes(df, TODAY, limit=1))] == ["A"]


def test_loyalty_labels(sales):
    vip = [dict(cliente="vip", fecha="2024-06-01", venta=150_001)]
    loyal = [dict(cliente="loyal", cod=i, fecha="2024-05-01", venta=1) for i in range(80)]
    df = sales(*vip, *loyal, dict(cliente="active", fecha="2024-04-01"), dict(cliente="risk", fecha="2024-01-10"))
    got = {k: v["segmento_rfm"] for k, v in by(customers.rfm_basic(df, TODAY), "cliente").items()}
    assert got == {"vip": "🏆 VIP", "loyal": "⭐ Leal", "active": "🟢 Activo", "risk": "🔴 Inactivo"}


def test_year_ranking_share_is_over_all(sales):
    df = sales(dict(cliente="A", fecha="2024-01-01", venta=60), dict(cliente="B", fecha="2024-01-02", venta=40))
    got = rows(customers.top_clientes_year(df, None, 1, TODAY))
    assert got == [
        dict(cliente="A", venta_neta=60.0, pedidos=1, unidades=1, dias_sin_compra=181, ultima_compra="2024-01-01",
             total_clientes=2, share_pct=60.0)
    ]
    assert rows(customers.top_clientes_anno_mat(df, TODAY))[0]["anno"] == 2024


@pytest.mark.parametrize(
    ("days", "orders", "money", "segment"),
    [
        (60, 10, 50_000, "Champions"),
        (60, 10, 49_999, "Leales"),
        (90, 5, 1, "Leales"),
        (90, 1, 20_000, "Leales"),
        (60, 4, 1, "Prometedores"),
        (91, 9, 1, "En Riesgo"),
        (180, 9, 90_000, "En Riesgo"),
        (181, 9, 90_000, "Perdidos"),
        (75, 4, 1, "En Desarrollo"),
    ],
)
def test_rfm_rules(sales, days, orders, money, segment):
    lines = [dict(cod=i, fecha=days_ago(days + i), venta=0) for i in range(orders)]
    lines[0]["venta"] = money
    got = rows(customers.rfm_details(sales(*lines), None, TODAY))[0]
    assert got["segmento"] == segment and got["dias_sin_compra"] == days and got["frecuencia"] == orders


def test_rfm_stats_do_not_count_the_null_customer(sales):
    df = sales(dict(cliente=None, venta=10, fecha=days_ago(200)), dict(cliente="A", venta=5, fecha=days_ago(300)))
    assert rows(customers.rfm_stats(df, None, TODAY)) == [dict(segmento="Perdidos", n_clientes=1, valor_pen=15.0)]


MIXES = {
    "red": ("Solo Tinto", ["Tinto"]),
    "rw": ("Tinto+Blanco", ["Tinto", "Blanco"]),
    "rs": ("Tinto+Espumoso", ["Tinto", "Espumante"]),
    "all": ("Full Portfolio", ["Tinto", "Blanco", "Cava"]),
    "w": ("Blanco/Esp s.Tinto", ["Blanco"]),
    "none": ("Otros", ["Cerveza"]),
}


def test_six_mixes(sales):
    lines = [dict(cliente=c, tipo=f"Vino {t}") for c, (_, kinds) in MIXES.items() for t in kinds]
    details = by(customers.rfm_mix_details(sales(*lines), None, TODAY), "cliente")
    assert {c: details[c]["mix_type"] for c in MIXES} == {c: text for c, (text, _) in MIXES.items()}
    assert details["rw"]["pct_tinto"] == 50.0
    counts = by(customers.rfm_cross_sell(sales(*lines)), "mix_type")
    assert {m: counts[m]["n_clientes"] for m in counts} == {text: 1 for text, _ in MIXES.values()}
    assert counts["Full Portfolio"]["avg_pen"] == 300.0


def test_mix_by_amount_differs_when_amounts_net_to_zero(sales):
    df = sales(dict(tipo="Tinto", venta=10), dict(tipo="Tinto", venta=-10), dict(tipo="Blanco", venta=5))
    assert rows(customers.rfm_mix_details(df, None, TODAY))[0]["mix_type"] == "Blanco/Esp s.Tinto"
    assert rows(customers.rfm_cross_sell(df))[0]["mix_type"] == "Tinto+Blanco"


def test_unknown_kinds_are_other(sales):
    assert rows(customers.rfm_cross_sell(sales(dict(tipo=None))))[0]["mix_type"] == "Otros"


def brute_retention(lines, since):
    sold = defaultdict(dict)
    for c, y, v in lines:
        if y >= since:
            sold[y][c] = sold[y].get(c, 0) + v
    years = sorted(sold)
    out = []
    for before, year in zip(years, years[1:]):
        old, new = sold[before], sold[year]
        lost = [c for c in old if c not in new]
        out.append((f"{before}→{year}", len(new), len(set(new) & set(old)), len(set(new) - set(old)), len(lost), float(sum(old[c] for c in lost))))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_retention_equals_set_arithmetic(sales, seed):
    rng = random.Random(seed)
    years = [2021, 2022, 2023, 2025]
    lines = [(rng.choice([None, *"ABCDEFGH"]), rng.choice(years), rng.randrange(1, 50)) for _ in range(40)]
    df = sales(*[dict(cliente=c, fecha=f"{y}-03-01", venta=v) for c, y, v in lines])
    got = [tuple(r.asDict().values()) for r in customers.retencion(df, as_of=TODAY).collect()]
    assert got == brute_retention(lines, 2022)


def test_retention_of_the_running_year_looks_at_the_calendar_year_before(sales):
    df = sales(dict(cliente="A", fecha="2022-01-01"), dict(cliente="B", fecha="2024-01-01"))
    got = rows(customers.retencion(df, as_of=TODAY))[0]
    assert got["perdidos"] == 0 and got["perdida_usd"] == 0.0 and got["nuevos"] == 1
    later = rows(customers.retencion(df, as_of=dt.date(2025, 1, 1)))[0]
    assert later["perdidos"] == 1 and later["perdida_usd"] == 100.0


def test_retention_with_one_year_is_empty(sales):
    assert rows(customers.retencion(sales(dict(fecha="2024-01-01")), as_of=TODAY)) == []


def test_retention_lists(sales):
    df = sales(
        dict(cliente="new", fecha="2024-01-01", venta=1), dict(cliente="kept", fecha="2024-01-01", venta=2),
        dict(cliente="kept", fecha="2023-01-01", venta=3), dict(cliente=None, fecha="2023-01-01", venta=4),
        dict(cliente="lost", fecha="2023-01-01", venta=5),
    )
    assert rows(customers.retencion_listado(df, 2023, 2024, "nuevos")) == [dict(cliente="new", venta=1.0)]
    assert rows(customers.retencion_listado(df, 2023, 2024, "retenidos")) == [dict(cliente="kept", venta=2.0, venta_anterior=3.0)]
    assert [r["cliente"] for r in rows(customers.retencion_listado(df, 2023, 2024, "perdidos"))] == ["lost", None]
    with pytest.raises(ValueError):
        customers.retencion_listado(df, 2023, 2024, "otros")


def test_frequency_ranges_in_order(sales):
    counts = {"a": 1, "b": 2, "c": 3, "d": 4, "e": 11, "f": 50, "g": 51}
    df = sales(*[dict(cliente=c, cod=i * 1000 + ord(c)) for c, n in counts.items() for i in range(n)])
    got = [(r["rango_frecuencia"], r["cantidad_clientes"]) for r in rows(customers.frecuencia_compra(df))]
    assert got == [("1 compra", 1), ("2-3", 2), ("4-10", 1), ("11-50", 2), (">50", 1)]


def test_expert_groups_keep_the_defined_arithmetic(sales):
    # 2023: two types of 6,000 each; their largest, not their sum, is compared with 10,000.
    split = [dict(cliente="split", cod=i, tipo=t, fecha="2023-02-01", venta=1000) for t in ("a", "b") for i in range(6)]
    vip = [dict(cliente="vip", cod=i, fecha="2023-02-01", venta=2000) for i in range(6)]
    # One order over two types counts as two.
    once = [dict(cliente="mixed", tipo="a", fecha="2024-06-01"), dict(cliente="mixed", tipo="b", fecha="2024-06-01")]
    df = sales(*split, *vip, *once, dict(cliente="single", fecha="2024-06-01"))
    got = {r["segmento"]: r["n_clientes"] for r in rows(customers.analisis_experto(df, TODAY))}
    assert got["VIPs en Fuga (Inactivos 2024)"] == 1
    assert got["Reactivación (1 sola compra)"] == 1
    assert got["Ballenas Perdidas (Histórico >10K)"] == 2
    assert got["Deriva de Frecuencia"] == 0 and len(got) == 6
    wide = rows(customers.analisis_clientes_wide(df, TODAY))[0]
    assert wide["vip_inactivo_2024"] == 0 and wide["una_sola_compra"] == 1


def test_customer_details_count_months(sales):
    df = sales(dict(fecha="2024-01-05", cod=1), dict(fecha="2024-01-25", cod=2), dict(fecha="2023-11-01", cod=3))
    got = rows(customers.clientes_detalle(df))[0]
    assert got["meses_activos"] == 2 and got["frecuencia"] == 3 and got["primera_compra"] == dt.date(2023, 11, 1)


def test_cross_sell_counts_red_without_white(sales):
    df = sales(
        dict(cliente="A", tipo="Vino Tinto", venta=20_000), dict(cliente="B", tipo="Vino Tinto"),
        dict(cliente="B", tipo="Vino Blanco"), dict(cliente="C", tipo="VINO TINTO"),
    )
    got = rows(customers.cross_sell_opportunity(df, 2024))[0]
    assert got["clientes_solo_tinto"] == 1 and got["clientes"] == 3 and got["potencial"] == "S/ 2K"


def test_null_white_customer_empties_the_cross_sell(sales):
    df = sales(dict(cliente="A", tipo="Vino Tinto"), dict(cliente=None, tipo="Vino Blanco"))
    assert rows(customers.cross_sell_opportunity(df, 2024))[0]["clientes_solo_tinto"] == 0


def test_cross_sell_of_an_empty_year(sales):
    got = rows(customers.cross_sell_opportunity(sales(dict(fecha="2020-01-01")), 2024))[0]
    assert got["potencial"] == "S/ 99K" and got["venta_total"] == 1.0


def test_customer_pages(sales):
    df = sales(*[dict(cliente=f"Bodega {i:02d}", venta=1000 - i, fecha=days_ago(200)) for i in range(30)])
    details = customers.rfm_details(df, None, TODAY)
    page = rows(customers.filter_customers(details, name="BODEGA", days=(180, None), segment="Perdidos", number=2, size=25))
    assert [r["cliente"] for r in page] == [f"Bodega {i}" for i in range(25, 30)]
    found = rows(customers.search_customers(customers.top_clientes_year(df, 0, as_of=TODAY), "bodega 1"))
    assert len(found) == 10


def test_settings_change_the_rules(sales):
    strict = replace(DEFAULTS, rfm=replace(DEFAULTS.rfm, cold_days=10, warm_days=5, hot_days=1))
    assert rows(customers.rfm_details(sales(dict(fecha=days_ago(50))), None, TODAY, strict))[0]["segmento"] == "Perdidos"
