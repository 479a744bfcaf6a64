from __future__ import annotations

import datetime as dt
import random

import pytest

from cellarline.sources import sheets
from pyspark.sql import functions as F
from tests.conftest import by, rows


@pytest.fixture
def raw(spark):
    data = [(i, "informe", None, None) for i in range(1, 6)]
    data += [
        (6, " Codigo Venta ", "Serie", "Doc.Ref. Serie"), (7, "1", "F1", "x"), (8, None, "", None), (9, "2", "", "y"),
    ]
    return spark.createDataFrame(data, "row_no bigint, c1 string, c2 string, c3 string")


def test_header_on_row_six(raw):
    sheet = sheets.promote_header(raw, 6)
    assert sheet.columns == ["row_no", " Codigo Venta ", "Serie", "Doc.Ref. Serie"] and sheet.count() == 3
    with pytest.raises(ValueError):
        sheets.promote_header(raw, 60)


def test_blank_and_repeated_headers_keep_the_old_name(spark):
    df = spark.createDataFrame([(1, "a", "a", None), (2, "x", "y", "z")], "row_no bigint, c1 string, c2 string, c3 string")
    assert sheets.promote_header(df, 1).columns == ["row_no", "a", "c2", "c3"]


def test_columns_by_trimmed_name_in_list_order(raw):
    sheet = sheets.promote_header(raw, 6)
    got = sheets.select_trimmed(sheet, ("Doc.Ref. Serie", "Missing", "Codigo Venta"))
    assert got.columns == ["Doc.Ref. Serie", "Codigo Venta"]


def test_blank_rows_go(raw):
    sheet = sheets.promote_header(raw, 6)
    assert [r["row_no"] for r in sheets.drop_blank_rows(sheet).collect()] == [7, 9]


def test_invoice_key_needs_a_first_cell(spark):
    df = spark.createDataFrame([("1", "F", "9"), ("", "F", "9"), (None, "F", "9"), ("2", None, "7")], "c string, Serie string, Numero string")
    assert [r["Factura"] for r in sheets.invoice_key(df, "c").collect()] == ["F-9", None, None, "-7"]


def brute_lookup(detail, header):
    out = []
    for key in detail:
        if not key:
            out.append(None)
            continue
        out.append(next((value for k, value in header if k == key), "No encontrado"))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_first_match_lookup_equals_a_scan(spark, seed):
    rng = random.Random(seed)
    header = [(rng.choice(["", None, *"abcdef"]), rng.choice([None, "v1", "v2", "v3"])) for _ in range(30)]
    # A third of the detail rows is blank, a third has one key.
    detail = [rng.choice(["", None, "a", "a", "b", "z", "A"]) for _ in range(60)]
    h = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(header)], "row_no bigint, k string, Factura string").repartition(5)
    d = spark.createDataFrame([(i, k) for i, k in enumerate(detail)], "n bigint, k string").repartition(3)
    got = sheets.lookup_first(d, h, "k", "Factura").orderBy("n").collect()
    assert [r["Factura"] for r in got] == brute_lookup(detail, header)


def test_inventory_keys_round_half_to_even(spark):
    df = spark.createDataFrame([("1", "F-9", "P", q) for q in ("2.5", "3.5", "-2.5", "4")], "c string, Factura string, Codigo string, Cant string")
    assert [r["Clave_Inventario"] for r in sheets.inventory_key_sales(df, "c").collect()] == ["F-9P2", "F-9P4", "F-9P-2", "F-9P4"]
    moves = spark.createDataFrame([("i", "F", "9", "P", 2.5), (None, "F", "9", "P", 1.0)], "a string, Serie string, NroDoc string, `Código` string, Cantidad double")
    assert [r["Clave_Inventario"] for r in sheets.inventory_key_movement(moves, "a").collect()] == ["F-9P2", None]


def test_cells(spark):
    schema = "d date, t timestamp, x double, s string, n bigint, b float"
    data = [
        (dt.date(2024, 3, 9), dt.datetime(2024, 3, 9, 5), 3.0, "a", 7, 2.5),
        (None, None, float("nan"), None, None, None),
        (dt.date(2024, 1, 1), dt.datetime(2024, 1, 1), 3.5, "", -1, -4.0),
        (None, None, 1e30, "x", 0, float("inf")),
    ]
    got = [tuple(r) for r in sheets.normalize_cells(spark.createDataFrame(data, schema)).collect()]
    assert got[0] == ("09/03/2024", "09/03/2024", "3", "a", "7", "2.5")
    assert got[1] == ("", "", "", "", "", "")
    assert got[2] == ("01/01/2024", "01/01/2024", "3.5", "", "-1", "-4")
    assert got[3][2] == "1.0E30" and got[3][5] == "Infinity"


def test_whole_sales_export(spark):
    """Header and detail sheets through all steps to the inventory key."""
    head = [(i, "x", None, None) for i in range(1, 6)] + [(6, "Codigo Venta", "Serie ", "Numero"), (7, "1", "F", "10"), (8, "1", "F", "11")]
    items = [(i, "x", None, None) for i in range(1, 6)] + [(6, "Codigo Venta", "Codigo", "Cant"), (7, "1", "P", "2"), (8, "5", "P", "1")]
    schema = "row_no bigint, c1 string, c2 string, c3 string"

    def load(data, header_row, columns):
        sheet = sheets.drop_blank_rows(sheets.promote_header(spark.createDataFrame(data, schema), header_row))
        return sheets.select_trimmed(sheet, columns, keep=("row_no",))

    header = sheets.invoice_key(load(head, sheets.SALES_HEADER_ROW, sheets.SALES_COLUMNS), "Codigo Venta")
    detail = load(items, sheets.DETAIL_HEADER_ROW, sheets.DETAIL_COLUMNS)
    keyed = sheets.inventory_key_sales(sheets.lookup_first(detail, header, "Codigo Venta", "Factura"), "Codigo Venta")
    assert {r["Codigo Venta"]: r["Clave_Inventario"] for r in keyed.collect()} == {"1": "F-10P2", "5": "No encontradoP1"}
    assert len(sheets.SALES_COLUMNS) == 39 and len(sheets.INVENTORY_COLUMNS) == 27


def test_raw_csv_keeps_filler_rows_and_order(spark, tmp_path):
    path = tmp_path / "ventas.csv"
    path.write_text('Informe\n,,\n Serie ,Numero,"a, ""b"""\nF1,10,x\nF2,11,y\n', encoding="utf-8")
    raw = sheets.read_raw_csv(spark, str(path), 3)
    got = sheets.promote_header(raw, 3) if raw.filter("row_no = 3 and c1 = ' Serie '").count() else None
    # Spark's CSV reader skips empty lines only; a line of separators is a row.
    assert got is not None and got.columns == ["row_no", " Serie ", "Numero", 'a, "b"']
    assert [(r["row_no"], r["Numero"]) for r in got.collect()] == [(4, "10"), (5, "11")]


def test_numbers_without_exponent_and_in_keys(spark):
    values = [12345678.5, 0.0005, 3.0, 1e17, 0.1, -2.25, float("nan"), None, 1e300]
    got = sheets.normalize_cells(spark.createDataFrame([(v,) for v in values], "v double")).collect()
    assert [r["v"] for r in got] == ["12345678.5", "0.0005", "3", "100000000000000000", "0.1", "-2.25", "", "", "1.0E300"]
    keyed = sheets.invoice_key(spark.createDataFrame([("x", "A", 1234.0)], "c string, Serie string, Numero double"), first="c")
    assert keyed.first()["Factura"] == "A-1234"


def test_unreadable_quantity_counts_as_zero(spark):
    rows = [("x", "F1", "P", ""), ("x", "F1", "P", "two"), ("x", "F1", "P", "2.5"), ("x", "F1", "P", None)]
    df = spark.createDataFrame(rows, "c string, Factura string, Codigo string, Cant string")
    assert [r["Clave_Inventario"] for r in sheets.inventory_key_sales(df, first="c").collect()] == ["F1P0", "F1P0", "F1P2", "F1P0"]


def test_empty_lines_of_a_csv_count(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text('report\n\nCode,"Name, full"\n1,"a ""b"""\r\n\n2,c\n')
    sheet = sheets.promote_header(sheets.read_raw_csv(spark, str(path), 2), 3)
    assert sheet.columns == ["row_no", "Code", "Name, full"]
    assert [tuple(r) for r in sheets.drop_blank_rows(sheet).orderBy("row_no").collect()] == [(4, "1", 'a "b"'), (6, "2", "c")]


def test_hot_key_of_the_lookup_is_split(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        detail = spark.range(30_000).selectExpr("IF(id % 3 = 0, 'hot', 'k' || id) AS code", "'text ' || id AS other").repartition(8)
        header = spark.range(30_000).selectExpr("id AS row_no", "IF(id = 7, 'hot', 'k' || id) AS code", "'F' || id AS Factura")
        joined = sheets.lookup_first(detail, header, "code", "Factura")
        rows = joined.groupBy().agg(F.count("*").alias("n"), F.sum((F.col("Factura") == "F7").cast("int")).alias("hot"))
        assert rows.first().asDict() == {"n": 30_000, "hot": 10_000}
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
