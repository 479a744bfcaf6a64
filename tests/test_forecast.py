from __future__ import annotations

import datetime as dt
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellarline.operators import forecast as fc
from pyspark.sql import functions as F
from tests.conftest import by, rows


def months(start: str, n: int) -> list[dt.date]:
    y, m = map(int, start.split("-"))
    return [dt.date(y + (m - 1 + i) // 12, (m - 1 + i) % 12 + 1, 1) for i in range(n)]


@pytest.fixture
def series(spark):
    def build(**products: dict):
        data = [
            (name, "M", day, day.year, day.month, units)
            for name, points in products.items()
            for day, units in points.items()
        ]
        return spark.createDataFrame(data, "producto string, marca string, periodo date, anno bigint, mes bigint, unidades bigint")

    return build


def python_strip(name: str) -> str:
    return re.sub(r"\s{2,}", " ", re.sub(r"\s*(19\d\d|20[0-4]\d)\b", "", name)).strip()


NAMES = ["X 2019", "2019 X", "X 1899", "X12019", "A 2015 B 2016", "A  B", " 2050 ", "Z 2049", "Ñandú 2020", "X 20199", "2020"]


def test_strip_vintage_cases(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "p string").select("p", fc.strip_vintage(F.col("p")).alias("b"))
    assert {r["p"]: r["b"] for r in df.collect()} == {n: python_strip(n) for n in NAMES}
    assert spark.sql("select cast(null as string) p").select(fc.strip_vintage(F.col("p")).alias("b")).first()["b"] == "None"


@settings(max_examples=5, deadline=None)
@given(names=st.lists(st.text(alphabet="ab 0129\t", max_size=14), min_size=40, max_size=40))
def test_strip_vintage_random(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "p string").select("p", fc.strip_vintage(F.col("p")).alias("b"))
    assert all(r["b"] == python_strip(r["p"]) for r in df.collect())


def test_dominant_brand_and_series(sales):
    lines = [dict(producto=f"X {2018 + i % 2}", marca="a", cantidad=1, fecha=d.isoformat()) for i, d in enumerate(months("2023-01", 6))]
    lines.append(dict(producto="X", marca="b", cantidad=50, fecha="2023-01-20"))
    lines.append(dict(producto="X", marca="c", cantidad=-90, fecha="2023-02-20"))
    lines += [dict(producto="short", fecha=d.isoformat()) for d in months("2023-01", 5)]
    df = sales(*lines)
    assert by(fc.dominant_brand(df), "producto")["X"]["marca"] == "b"
    got = sorted(rows(fc.fc_serie_productos(df)), key=lambda r: r["periodo"])
    assert {r["producto"] for r in got} == {"X"} and {r["marca"] for r in got} == {"b"}
    assert [r["unidades"] for r in got] == [51, 1, 1, 1, 1, 1]


def test_zero_fill_over_calendar(spark, series):
    s = series(a={dt.date(2023, 2, 1): 5, dt.date(2023, 4, 1): 7})
    calendar = spark.createDataFrame([(d,) for d in months("2023-01", 5)], "periodo date")
    got = [r["unidades"] for r in fc.zero_fill_grid(s, calendar).orderBy("periodo").collect()]
    assert got == [0, 5, 0, 7, 0]


def smoothed(y, a, b, p):
    level, trend, errors = y[0], y[1] - y[0], []
    for value in y[1:]:
        ahead = level + p * trend
        errors.append(value - ahead)
        level, trend = ahead + a * errors[-1], p * trend + b * errors[-1]
    return sum(e * e for e in errors), level, trend, errors


def expected(y: list[float], horizon: int):
    if 3 <= len(y) <= 12:
        y = [float(v) for v in y]
        fits = [(*smoothed(y, *g), g) for g in fc.SMOOTHING]
        _, start, slope, errors, (a, b, p) = min(fits, key=lambda f: f[0])
        paths = []
        for k in range(len(errors)):
            level, trend, path = start, slope, []
            for h in range(horizon):
                ahead, error = level + p * trend, errors[(k + h) % len(errors)]
                level, trend = ahead + a * error, p * trend + b * error
                path.append(ahead + error)
            paths.append(path)
        quantiles = np.percentile(np.array(paths), [50, 10, 90], axis=0).clip(0)
        return [tuple(column) for column in quantiles.T]
    if len(y) <= 12:
        mean = float(np.mean(y))
        return [(max(0.0, mean), 0.0, max(0.0, mean * 1.5 + 1))] * horizon
    changes = [b - a for a, b in zip(y, y[12:])]
    out = []
    for h in range(horizon):
        base = y[len(y) - 12 + h % 12]
        lo, mid, hi = (max(0.0, base + np.percentile(changes, q)) for q in (10, 50, 90))
        out.append((mid, lo, hi))
    return out


@pytest.mark.parametrize(("n", "horizon"), [(1, 3), (2, 3), (3, 3), (4, 1), (6, 3), (9, 14), (12, 3), (13, 3), (30, 3), (30, 14)])
def test_quantiles_equal_numpy(series, n, horizon):
    rng = np.random.default_rng(n)
    y = rng.integers(-20, 60, n).tolist()
    s = series(a=dict(zip(months("2020-01", n), y)))
    got = fc.forecast_quantiles(s, ["producto"], "unidades", horizon).orderBy("h").collect()
    assert len(got) == horizon
    for row, want in zip(got, expected(y, horizon)):
        assert (row["forecast"], row["fc_lo"], row["fc_hi"]) == pytest.approx(want)
        assert row["fc_lo"] <= row["forecast"] <= row["fc_hi"]


def test_short_series_get_a_trend_without_python(series):
    s = series(**{f"up{n}": dict(zip(months("2023-01", n), range(10, 10 + 5 * n, 5))) for n in (3, 6, 12)})
    found = fc.forecast_quantiles(s, ["producto"], "unidades", 3)
    for r in found.collect():
        n = int(r["producto"][2:])
        last = 10 + 5 * (n - 1)
        assert last < r["forecast"] <= last + 5 * r["h"] + 5
    plan = found._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
    flat = series(z=dict(zip(months("2023-01", 5), [7] * 5)))
    assert {tuple(r)[2:] for r in fc.forecast_quantiles(flat, ["producto"], "unidades", 2).drop("h").withColumn("h", F.lit(0)).collect()} == {(7.0, 7.0, 7.0, 0)}


def test_both_paths_agree_below_three_points(series):
    s = series(a=dict(zip(months("2023-01", 2), [4, 8])), b=dict(zip(months("2023-01", 1), [3])))
    own = sorted(map(tuple, fc.forecast_quantiles(s, ["producto"], "unidades", 2).collect()))
    assert own == sorted(map(tuple, fc.forecast_quantiles(s, ["producto"], "unidades", 2, lambda v, h: 1 / 0).collect()))


def test_model_runs_per_series(series):
    s = series(a=dict(zip(months("2023-01", 4), [1, 2, 3, 4])), b=dict(zip(months("2023-01", 2), [10, 20])))

    def last(values, horizon):
        return [values[-1]] * horizon, [-1.0] * horizon, [values[-1] + 1] * horizon

    got = {(r["producto"], r["h"]): r for r in fc.forecast_quantiles(s, ["producto"], "unidades", 2, last).collect()}
    assert got[("a", 1)]["forecast"] == 4.0 and got[("a", 2)]["fc_lo"] == 0.0 and got[("a", 1)]["fc_hi"] == 5.0
    # Two points are too few for a model.
    assert got[("b", 1)]["forecast"] == 15.0 and got[("b", 1)]["fc_hi"] == 23.5


def test_total_table(sales):
    df = sales(*[dict(fecha=d.isoformat(), venta=100 + i) for i, d in enumerate(months("2022-11", 14))])
    got = sorted(rows(fc.forecast_total(fc.fc_serie_total(df))), key=lambda r: r["periodo"])
    assert fc.forecast_total(fc.fc_serie_total(df)).columns == fc.FORECAST_TOTAL_SCHEMA.names
    assert [r["tipo"] for r in got] == ["histórico"] * 14 + ["pronóstico"] * 3
    assert [r["periodo"] for r in got[-3:]] == months("2024-01", 3)
    assert got[-1]["venta_real"] is None and got[-3]["forecast"] == 114.0 and got[0]["forecast"] is None


def test_product_table_dates_follow_the_anchor(spark, series):
    s = series(a=dict(zip(months("2023-01", 6), range(6))))
    calendar = spark.createDataFrame([(d,) for d in months("2023-01", 9)], "periodo date")
    own = fc.forecast_productos(s, calendar)
    assert own.columns == fc.FORECAST_PRODUCTS_SCHEMA.names
    future = sorted(rows(own.filter("tipo = 'pronóstico'")), key=lambda r: r["periodo"])
    assert [r["mes_label"] for r in future] == ["Jul 2023", "Ago 2023", "Set 2023".replace("Set", "Sep")]
    shared = fc.forecast_productos(s, calendar, anchor="global").filter("tipo = 'pronóstico'")
    assert sorted(r["periodo"] for r in rows(shared)) == months("2023-10", 3)
    want = expected([0, 1, 2, 3, 4, 5, 0, 0, 0], 3)  # the zero-filled nine months
    assert [r["fc_uds"] for r in future] == pytest.approx([round(w[0], 1) for w in want], abs=0.051)
    with pytest.raises(ValueError):
        fc.forecast_productos(s, anchor="x")


def test_catalog_and_rollup(spark):
    data = [
        ("p", None, "pronostico", 1.4, 1.0, 2.0), ("p", None, "pronóstico", 1.2, None, 2.0), ("q", "M", "pronóstico", 9.0, 1.0, 9.0),
        ("r", "M", "histórico", None, None, None),
    ]
    table = spark.createDataFrame(data, "producto string, marca string, tipo string, fc_uds double, fc_lo double, fc_hi double")
    assert [tuple(r) for r in fc.forecast_catalogo(table).collect()] == [("M", "q"), ("Sin Marca", "p")]
    assert [tuple(r) for r in fc.forecast_catalogo(table.drop("marca")).collect()] == [("Sin Marca", p) for p in "pqr"]
    got = rows(fc.forecast_rollup_3m(table))
    assert [(r["producto"], r["fc_uds"], r["fc_lo"], r["fc_hi"]) for r in got] == [("q", 9, 1, 9), ("p", 3, 1, 4), ("r", 0, 0, 0)]
    assert rows(fc.read_forecast_productos(table.withColumn("periodo", F.current_date()), "p o'p")) == []
