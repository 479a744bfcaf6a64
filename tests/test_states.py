"""Views from year states against the operators over the fact, and what a refresh reads."""

from __future__ import annotations

import datetime as dt
import os
import random
from glob import glob

import pytest

from cellarline.operators import kpi, timeops
from cellarline.plans import materialize
from cellarline.plans.states import States, year_signatures

TODAY = dt.date(2024, 6, 30)


def lines(seed: int, count: int, years=(2022, 2023, 2024)):
    rng = random.Random(seed)
    return [
        dict(
            cod=rng.randrange(60),
            cliente=rng.choice(["A", "B", "C", "D", None]),
            fecha=f"{rng.choice(years)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 28):02d}",
            producto=rng.choice(["P", "Q", "R"]),
            marca=rng.choice(["M", "N"]),
            tipo=rng.choice(["T", "U"]),
            pais=rng.choice(["Chile", "Perú", "", None]),
            vendedor=rng.choice(["V", "W"]),
            cantidad=rng.choice([0, 1, 2, 12, -1]),
            venta=f"{rng.randrange(-500, 10**6)}.{rng.randrange(10**4):04d}",
            costo=f"{rng.randrange(10**4)}.{rng.randrange(10**4):04d}",
        )
        for _ in range(count)
    ]


def values(df):
    return [tuple(sorted(r.asDict().items())) for r in df.orderBy(*df.columns).collect()]


def agree(states, fact, names):
    full = materialize.view_definitions(fact, TODAY, states.cfg) | {materialize.BASE: lambda: timeops.monthly_revenue(fact)}
    ours = states.views(TODAY)
    assert ours.keys() == full.keys()
    for name in names or full:
        assert values(ours[name]()) == values(full[name]()), name
    for year, guard in ((2023, True), (2024, False)):
        seen = fact.where("pais_origen_producto <> ''") if guard else fact
        assert values(states.kpi_year(year, TODAY, guard)) == values(kpi.kpi_year(seen, year, TODAY))
        assert values(states.kpi_ytd(TODAY, guard)) == values(kpi.kpi_ytd(seen, TODAY))


def test_only_the_changed_year_is_read_and_all_views_agree(spark, sales, tmp_path):
    base = str(tmp_path / "fact")
    sales(*lines(1, 400)).coalesce(2).write.partitionBy("anno").parquet(base)
    states = States(spark, base, str(tmp_path / "states"))
    assert states.refresh() == ["anno=2022", "anno=2023", "anno=2024"] and states.refresh() == []
    agree(states, spark.read.parquet(base), ["kpi_global", "segmento_precio", "vendedores"])

    sales(*lines(2, 60, years=(2023,))).coalesce(1).write.mode("append").partitionBy("anno").parquet(base)
    # The other years' files can no longer be read; they look as before.
    others = [f for year in (2022, 2024) for f in glob(f"{base}/anno={year}/*.parquet")]
    kept = {}
    for name in others:
        with open(name, "rb") as file:
            kept[name] = (file.read(), os.stat(name))
        with open(name, "wb") as file:
            file.write(b"x" * len(kept[name][0]))
        os.utime(name, ns=(kept[name][1].st_atime_ns, kept[name][1].st_mtime_ns))
    assert states.refresh() == ["anno=2023"]
    assert all("/anno=2023/" in f for f in states.years(["anno=2023"]).inputFiles())
    for name, (data, stat) in kept.items():
        with open(name, "wb") as file:
            file.write(data)
        os.utime(name, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert states.refresh() == []
    agree(states, spark.read.parquet(base), None)


def test_years_come_and_go(spark, sales, tmp_path):
    base = str(tmp_path / "fact")
    states = States(spark, base, str(tmp_path / "states"))
    for years in ((2023,), (2024, 2023), (2024,)):
        sales(*lines(len(years), 80, years)).write.mode("overwrite").partitionBy("anno").parquet(base)
        states.refresh()
        agree(states, spark.read.parquet(base), ["kpi_global", "dimension_pais"])
    assert list(year_signatures(spark, base)) == ["anno=2024"]
    ids = states.read("order_keys")
    assert ids.count() == ids.select("id").distinct().count() == ids.select("clave").distinct().count()
    with pytest.raises(ValueError):
        States(spark, base, str(tmp_path / "none")).read("orders")


def test_states_without_rows(spark, sales, tmp_path):
    """Lines without units are in no band, and lines without keys in no set."""
    base = str(tmp_path / "fact")
    sales(dict(cod=None, cliente=None, cantidad=0, fecha="2023-05-01"), dict(cod=None, cliente=None, fecha="2024-02-01", cantidad=0)).write.partitionBy("anno").parquet(base)
    states = States(spark, base, str(tmp_path / "states"))
    assert states.refresh() == ["anno=2023", "anno=2024"] and states.refresh() == []
    agree(states, spark.read.parquet(base), ["kpi_global", "segmento_precio", "dimension_pais"])


def test_figures_do_not_scan_the_fact(spark, sales, tmp_path):
    base, root = str(tmp_path / "fact"), str(tmp_path / "states")
    sales(*lines(5, 50)).write.partitionBy("anno").parquet(base)
    states = States(spark, base, root)
    states.refresh()
    for df in (states.kpi_year(2024, TODAY), states.kpi_ytd(TODAY)):
        assert df.inputFiles() and all("/states/" in f for f in df.inputFiles())


def test_bitmaps_are_made_behind_the_shuffle(spark, sales):
    """A bitmap has 4 KB: made by each task of the join and shuffled, they outgrow their numbers with the number of tasks."""
    from cellarline.plans.states import day_sets
    from tools.plans import final_plan

    keys = spark.range(1, 61).selectExpr("id - 1 as clave", "id")
    sets = day_sets(sales(*lines(5, 300)), keys, "cod_venta")
    plan = final_plan(sets)
    between = plan[: plan.index("partial_bitmap_construct_agg")]
    assert "bitmap_construct_agg" in between and "Exchange" not in between
    counted = sets.selectExpr("anno", "fecha", "con_origen", "bitmap_count(bits) as n").orderBy("fecha", "con_origen")
    wanted = sales(*lines(5, 300)).selectExpr("anno", "fecha", "nvl(pais_origen_producto <> '', false) as con_origen", "cod_venta")
    wanted = wanted.groupBy("anno", "fecha", "con_origen").agg({"cod_venta": "count"}).count(), wanted.distinct().count()
    assert (counted.count(), counted.agg({"n": "sum"}).first()[0]) == wanted


def test_sums_stand_beside_keys(spark, sales, tmp_path):
    """Amounts come once a group, not for nearly every line; the keys beside them are each there once."""
    base = str(tmp_path / "fact")
    sales(*lines(7, 300)).write.partitionBy("anno").parquet(base)
    states, fact = States(spark, base, str(tmp_path / "states")), spark.read.parquet(base)
    states.refresh()
    for state, group, keys in (("countries", "pais_origen_producto", ["cliente", "cod_venta"]), ("sellers", "vendedor", ["cod_venta"])):
        rows = states.read(state)
        sums = rows.where("cantidad is not null")
        assert sums.count() == fact.select("anno", group).distinct().count()
        assert values(sums.groupBy("anno", group).agg({"venta_neta_mn": "sum"})) == values(fact.groupBy("anno", group).agg({"venta_neta_mn": "sum"}))
        beside = rows.where("cantidad is null")
        assert beside.where("venta_neta_mn is not null or costo_mn_total is not null or margen_mn is not null").isEmpty()
        assert values(beside.select("anno", group, *keys)) == values(fact.select("anno", group, *keys).distinct())


def test_days_and_sets_are_made_from_orders(spark, sales, tmp_path, monkeypatch):
    from cellarline.plans import states as module

    base, read = str(tmp_path / "fact"), []
    sales(*lines(8, 100, (2023,))).write.partitionBy("anno").parquet(base)
    for name in ("days", "day_sets"):
        made = getattr(module, name)
        monkeypatch.setattr(module, name, lambda rows, *args, made=made: read.extend(rows.inputFiles()) or made(rows, *args))
    States(spark, base, str(tmp_path / "states")).refresh()
    assert read and all("/orders/" in file for file in read)
    monkeypatch.undo()
    # States of another layout are not taken.
    monkeypatch.setattr(module, "VERSION", "next")
    assert States(spark, base, str(tmp_path / "states")).refresh() == ["anno=2023"]
