from __future__ import annotations

import datetime as dt
import os
import shutil
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellarline.operators import products
from cellarline.plans import materialize, warehouse
from cellarline.plans.dashboard import dashboard_bundle
from cellarline.plans.warehouse import sales_table
from cellarline.sources import fact, storage
from cellarline.streaming.incremental import append_new, append_stream, new_rows, sync_sources
from tests.conftest import DATA, by, rows

TODAY = dt.date(2024, 6, 30)


def test_exchange_rate_defaults_and_fan_out(spark, sales):
    header = spark.createDataFrame([(1, "3.9"), (2, "n/d"), (2, "4.0")], "cod_venta bigint, tipo_cambio_venta string")
    got = fact.with_exchange_rate(sales(dict(cod=1), dict(cod=2), dict(cod=3)), header)
    assert sorted((r["cod_venta"], r["tc"]) for r in got.collect()) == [(1, 3.9), (2, 3.75), (2, 4.0), (3, 3.75)]


def test_fact_money_is_exact(spark):
    tables = {
        "lineitem": "select 1L l_orderkey, 1L l_partkey, 1L l_suppkey, 3d l_quantity, 1000.55d l_extendedprice, 0.07d l_discount",
        "orders": "select 1L o_orderkey, 1L o_custkey, timestamp_ntz'2024-02-29 23:30:00' o_orderdate, 'F' o_orderstatus",
        "customer": "select 1L c_custkey, 'c' c_name", "nation": "select 1 n_nationkey, 'n' n_name",
        "part": "select 1L p_partkey, 'p' p_name, 'b' p_brand, 't' p_type, 100.10d p_retailprice",
        "supplier": "select 1L s_suppkey, 's' s_name, 1 s_nationkey",
    }
    got = fact.sales_fact({name: spark.sql(sql) for name, sql in tables.items()})
    row = got.first()
    assert str(row["venta_neta_mn"]) == "930.5115" and str(row["costo_mn_total"]) == "180.1800"
    assert str(row["margen_mn"]) == "750.3315" and (row["anno"], row["mes"]) == (2024, 2)
    assert [f.dataType for f in got.schema] == [f.dataType for f in fact.SALES_SCHEMA]


def test_lower_columns(spark):
    assert fact.lower_columns(spark.sql("select 1 as CLIENTE, 2 as Venta")).columns == ["cliente", "venta"]


def test_table_checks(spark, tmp_path):
    spark.range(1).createOrReplaceTempView("ventas_v")
    assert storage.table_exists(spark, "ventas_v") and not storage.table_exists(spark, "no_such_view")
    schema = storage.table_schema({"b": spark.range(1), "a": spark.sql("select 1d x, 'y' y")})
    assert [tuple(r) for r in schema.collect()] == [("a", 1, "x", "double"), ("a", 2, "y", "string"), ("b", 1, "id", "bigint")]
    assert not storage.path_exists(spark, str(tmp_path / "none"))


def test_truncate_replaces_and_csv_has_a_header(spark, tmp_path):
    path = str(tmp_path / "t")
    storage.write_truncate(spark.range(5), path)
    storage.write_truncate(spark.range(2), path)
    assert storage.read_table(spark, path).count() == 2
    storage.export_csv(spark.sql("select date'2024-01-02' d, 'pronóstico' t, cast(null as double) x"), str(tmp_path / "c"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()] == [("2024-01-02", "pronóstico", None)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_written_fact_follows_its_input(spark, tmp_path):
    folder = str(tmp_path / "star")
    shutil.copytree(DATA, folder)
    first = sales_table(spark, folder)
    assert sales_table(spark, folder).inputFiles() == first.inputFiles()
    before = first.count()
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").limit(100)
    lines.write.mode("overwrite").parquet(f"{tmp_path}/new")
    os.chmod(folder, 0o755)
    part = next(f for f in os.listdir(f"{tmp_path}/new") if f.endswith(".parquet"))
    os.replace(f"{tmp_path}/new/{part}", f"{folder}/lineitem.parquet")
    assert before > 100 and sales_table(spark, folder).count() == 100


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_year_filter_prunes_folders(spark):
    df = products.rentabilidad_origen(fact.guarded(sales_table(spark, DATA)), 2000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "anno" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_views_refresh_one_by_one(spark, sales, tmp_path, monkeypatch):
    df, root = sales(dict(fecha="2024-06-01"), dict(fecha="2023-06-01", cliente="B")), str(tmp_path)
    monkeypatch.setattr(materialize.products, "vendedores", lambda _: 1 / 0)
    report = {view: state for view, _, state, _ in materialize.materialize_views(df, root, TODAY)}
    assert len(report) == 15 and report.pop("vendedores") == "error: ZeroDivisionError" and set(report.values()) == {"ok"}
    written = materialize.resolve_materialized("kpi_ytd", sales(), root, TODAY)
    assert written.first()["venta_neta"] == 100.0
    # Without a twin the view is computed.
    computed = materialize.resolve_materialized("dimension_pais", df, str(tmp_path / "empty"), TODAY)
    assert computed.first()["unidades"] == 2


def test_first_page_sections(sales):
    frames = dashboard_bundle(sales(dict(), dict(cliente="B")), 2024, TODAY)
    assert len(frames) == 12
    assert by(frames["kpis"], "periodo")["current"]["clientes"] == 2 and len(rows(frames["top_cli"])) == 2


def test_append_new_rows_only(spark, tmp_path):
    sink = str(tmp_path / "sink")
    source = spark.range(1, 11).withColumnRenamed("id", "row_no")
    assert append_new(source.filter("row_no <= 4"), sink) == 0
    assert append_new(source, sink) == 4
    assert append_new(source, sink) == 10
    assert append_new(source.filter("row_no <= 3"), sink) == 10
    assert sorted(r["row_no"] for r in spark.read.parquet(sink).collect()) == list(range(1, 11))
    assert new_rows(source, 8).count() == 2


def test_stream_takes_each_drop_once(spark, tmp_path):
    drops, sink, check = (str(tmp_path / n) for n in ("drops", "sink", "check"))
    drop = spark.range(500).selectExpr("id", "timestamp'2024-01-02 03:04:05' as ts")
    drop.coalesce(1).write.parquet(drops)
    for expected in (500, 500):
        append_stream(spark, drops, drop.schema, sink, check)
        assert spark.read.parquet(sink).count() == expected
    drop.selectExpr("id + 500 as id", "ts").coalesce(1).write.mode("append").parquet(drops)
    append_stream(spark, drops, drop.schema, sink, check)
    got = spark.read.parquet(sink)
    assert got.count() == 1000 and got.distinct().count() == 1000 and got.first()["ts"] == "02/01/2024"


def test_failing_source_leaves_the_others(spark):
    done = []
    states = sync_sources({"a": lambda: 1 / 0, "b": lambda: done.append(1)})
    assert states == {"a": "error: ZeroDivisionError", "b": "ok"} and done == [1]


def test_shuffles_are_sized_by_the_input(spark):
    from cellarline.session import INITIAL_PARTITIONS, MOST_PARTITIONS, size_shuffles

    try:
        size_shuffles(spark, 1 << 30)
        assert spark.conf.get(INITIAL_PARTITIONS, None) is None  # 4 partitions are enough
        size_shuffles(spark, 10 << 30)
        assert spark.conf.get(INITIAL_PARTITIONS) == "40"
        size_shuffles(spark, 100 << 40)
        assert spark.conf.get(INITIAL_PARTITIONS) == "409600"  # a larger folder after a smaller one raises it
        size_shuffles(spark, 10 << 30)
        assert spark.conf.get(INITIAL_PARTITIONS) == "409600"
        spark.conf.set(INITIAL_PARTITIONS, "7")
        size_shuffles(spark, 100 << 40)
        assert spark.conf.get(INITIAL_PARTITIONS) == "7"  # the user's own value stays
        spark.conf.unset(INITIAL_PARTITIONS)
        spark.conf.set(MOST_PARTITIONS, "1000")
        size_shuffles(spark, 100 << 40)
        assert spark.conf.get(INITIAL_PARTITIONS) == "1000"
    finally:
        spark.conf.unset(INITIAL_PARTITIONS)
        spark.conf.unset(MOST_PARTITIONS)


def test_refresh_that_breaks_leaves_the_old_rows(spark, sales, tmp_path):
    df, root = sales(dict(venta=10), dict(venta=20, cliente="B")), str(tmp_path)
    materialize.materialize_views(df, root, TODAY, only=("kpi_global",))
    path = materialize.twin_path(root, "kpi_global")
    broken = df.select(F.raise_error(F.lit("stopped half way")).alias("x"))
    with pytest.raises(Exception, match="stopped half way"):
        storage.write_truncate(broken, path)
    with open(f"{path}/current-000000002", "w") as unfinished:
        unfinished.write(path)  # without the line feed that ends a finished pointer
    assert materialize.written_twin(spark, root, "kpi_global").first()["venta_neta_total"] == 30
    storage.write_truncate(df.limit(1).select("cliente"), path)
    assert materialize.written_twin(spark, root, "kpi_global").columns == ["cliente"]
    assert materialize.written_twin(spark, root, "rfm") is None


def test_files_state_looks_at_files(spark, tmp_path):
    folder = tmp_path / "table.parquet"
    (folder / "year=1").mkdir(parents=True)
    (folder / "year=1" / "part.bin").write_bytes(b"abcd")
    os.utime(folder / "year=1" / "part.bin", (1_000_000, 1_000_000))
    state, size = storage.files_state(spark, [str(folder)])
    assert size == 4
    os.utime(folder, (5_000_000, 5_000_000))
    assert storage.files_state(spark, [str(folder)])[0] == state
    (folder / "year=1" / "part.bin").write_bytes(b"efgh")
    os.utime(folder / "year=1" / "part.bin", (2_000_000, 2_000_000))
    assert storage.files_state(spark, [str(folder)])[0] != state


def test_shared_dir_is_the_same_at_every_call(spark):
    assert storage.shared_dir(spark) == storage.shared_dir(spark)


def test_derived_tables_are_named_by_their_parameters(spark, tmp_path):
    folder = str(tmp_path / "star")
    shutil.copytree(DATA, folder)
    build = lambda n: warehouse.derived_table(spark, folder, "probe", T.StructType([T.StructField("id", T.LongType())]), lambda: spark.range(n), n)  # noqa: E731, E501
    assert [build(3).count(), build(5).count(), build(3).count()] == [3, 5, 3]


def test_writers_at_once_all_finish(spark, tmp_path):
    path = str(tmp_path / "t")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda n: storage.write_truncate(spark.range(n), path), [1, 2, 3, 4]))
    found = storage.versions(spark, path)
    assert [number for number, _ in found] == [1, 2, 3, 4]
    assert sorted(spark.read.parquet(rows).count() for _, rows in found) == [1, 2, 3, 4]
    assert storage.read_table(spark, path).count() == spark.read.parquet(found[-1][1]).count()


def test_clean_up_keeps_versions_and_their_readers(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(1, 6):
        storage.write_truncate(spark.range(n), path)
    old = storage.versions(spark, path)
    reader = spark.read.parquet(old[3][1])
    os.makedirs(f"{path}/rows-under-way")
    assert storage.clean_up(spark, path, keep=2) == []  # all is young
    assert [n for n, _ in storage.versions(spark, path)] == [4, 5] and reader.count() == 4
    removed = storage.clean_up(spark, path, keep=2, older_than=0)
    assert len(removed) == 4 and f"{path}/rows-under-way" in removed
    assert reader.count() == 4 and storage.read_table(spark, path).count() == 5
    storage.write_truncate(spark.range(9), path)
    assert storage.versions(spark, path)[-1][0] == 6 and storage.read_table(spark, path).count() == 9
    with pytest.raises(ValueError):
        storage.clean_up(spark, path, keep=0)


def test_star_shuffles_stay_small_whatever_the_input(spark, monkeypatch):
    """A task of the fact's build sorts its lines twice: their number per task must not grow with the input."""
    from cellarline.plans import warehouse
    from cellarline.session import ADVISED_SIZE, INITIAL_PARTITIONS

    try:
        monkeypatch.setattr(warehouse, "star_state", lambda *_: ("x", 5 << 30))
        warehouse.size_star(spark, "unused")
        assert int(spark.conf.get(INITIAL_PARTITIONS)) == 640
        assert spark.conf.get(ADVISED_SIZE) == str(16 << 20)
        spark.conf.set(ADVISED_SIZE, "5m")
        warehouse.size_star(spark, "unused")
        assert spark.conf.get(ADVISED_SIZE) == "5m"  # the user's own value stays
    finally:
        spark.conf.unset(INITIAL_PARTITIONS)
        spark.conf.unset(ADVISED_SIZE)
