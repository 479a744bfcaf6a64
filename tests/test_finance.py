from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cellarline.operators import finance
from cellarline.sources.fact import LEDGER_COLUMNS, ledger
from tests.conftest import by, rows

SCHEMA = (
    "nro_cta string, nombre_cuenta string, ejercicio bigint, periodo bigint, mto_debe decimal(18,4), mto_haber decimal(18,4), "
    "fec_mov date, reg_ctb string, glosa string, tip_doc string, nro_doc string, cliente string, proveedor string, mda_origen string"
)


@pytest.fixture
def book(spark):
    def row(account, period, debit, credit, year=2024, day=1, client=None, vendor="v", number="1"):
        from decimal import Decimal

        amount = [None if x is None else Decimal(x) for x in (debit, credit)]
        return (account, f"n{account}", year, period, *amount, dt.date(year, max(period, 1), day), "r", "g", "01", number, client, vendor, "PEN")

    return spark.createDataFrame(
        [
            row("10", 1, 100, 30), row("104", 1, None, 5), row("12", 0, 50, 0), row("12", 1, 7, 0, client="c"),
            row("12", 1, 9, 0, year=2023), row("59", 1, 0, 1), row("60", 0, 11, 0), row("60", 2, 12, 0),
            row("79", 2, 0, 13), row("90", 2, 99, 0), row("12", 3, 1, 0, day=20, number="b"), row("12", 3, 1, 0, day=2, number="a"),
        ],
        SCHEMA,
    )


def test_balance_has_accounts_1_to_5_with_opening(book):
    got = {(r["cuenta"], r["ejercicio"], r["periodo"]): r["debe"] for r in rows(finance.fin_balance(book, 2024))}
    assert got[("12", 2024, 0)] == 50.0 and got[("12", 2023, 1)] == 9.0 and ("59", 2024, 1) in got
    assert {c for c, *_ in got} == {"10", "104", "12", "59"}
    assert got[("104", 2024, 1)] is None


def test_income_statement_drops_opening(book):
    got = [(r["cuenta"], r["periodo"], r["debe"], r["haber"]) for r in rows(finance.fin_resultados(book, 2024).orderBy("cuenta"))]
    assert got == [("60", 2, 12.0, 0.0), ("79", 2, 0.0, 13.0)]


def test_cash_flow_net_skips_rows_with_a_missing_side(book):
    got = rows(finance.fin_flujo(book, 2024))
    assert got == [dict(ejercicio=2024, periodo=1, ingresos=100.0, egresos=35.0, flujo_neto=70.0)]


def test_detail_is_oldest_first_with_limit(book):
    got = rows(finance.fin_detalle(book, 2024, "12", 3))
    assert [r["doc_numero"] for r in got] == ["a", "b"] and got[0]["entidad"] == "v"
    assert rows(finance.fin_detalle(book, 2024, "12", 1))[0]["entidad"] == "c"
    assert len(rows(finance.fin_detalle(book, 2024, "12", limit=2))) == 2


def test_profiles(book):
    assert by(finance.ledger_profile_years(book), "ejercicio")[2023]["filas"] == 1
    assert [r["nro_cta"] for r in rows(finance.ledger_profile_accounts(book, 2))] == ["10", "104"]


def test_derived_ledger(sales):
    book = ledger(sales(dict(fecha="2024-01-05", estado="F"), dict(fecha="2024-02-05", estado="O")))
    assert tuple(book.columns) == LEDGER_COLUMNS
    assert book.count() == (5 + 2) + 4
    assert book.filter("periodo = 0").count() == 2
    # Apart from cash and opening rows, debit equals credit.
    assert book.filter("periodo > 0 and nro_cta <> '10'").selectExpr("sum(mto_debe) - sum(mto_haber) as d").first()["d"] == 0


def test_ledger_of_lines_with_nulls(spark, sales):
    """Entries by account with an unknown state, month or amount."""
    lines = sales(dict(cod=1, fecha="2024-01-05"), dict(cod=2, estado=None), dict(cod=3, fecha="2023-01-09", estado="O", cliente=None))
    lines = lines.withColumn("mes", F.when(F.col("cod_venta") != 2, F.col("mes")))
    lines = lines.withColumn("venta_neta_mn", F.when(F.col("cod_venta") != 2, F.col("venta_neta_mn")))
    found = [
        (r.nro_doc, r.nro_cta, r.periodo, r.mto_debe, r.mto_haber, r.cliente, r.glosa)
        for r in ledger(lines).collect()
    ]
    wanted = []
    for cod, month, sale, who, cash in (("1", 1, 100, "A", True), ("2", None, None, "A", False), ("3", 1, 100, None, False)):
        entries = [("1212", month, sale, 0, who), ("7011", month, 0, sale, who), ("6911", month, 60, 0, who), ("2011", month, 0, 60, None)]
        entries += [("10", month, sale, 0, who)] * cash + [("1212", 0, sale, 0, who), ("6911", 0, 60, 0, who)] * (month == 1)
        wanted += [(cod, *entry, f"Venta {cod}") for entry in entries]
    exact = [(*w[:3], *[v if v is None else Decimal(f"{v}.0000") for v in w[3:5]], *w[5:]) for w in wanted]
    assert sorted(found, key=str) == sorted(exact, key=str)


def test_statements_read_the_year_of_the_fact(spark):
    """No ledger of all lines is written for the entries of one account and month."""
    import __spark_entry__ as entry
    from tests.conftest import DATA
    from tools.plans import final_plan

    for name in ("fin_detalle", "fin_flujo"):
        plan = final_plan(entry.queries()[name](spark, DATA))
        assert "/sales/" in plan and "/ledger/" not in plan
        assert re.search(r"PartitionFilters: \[[^\]]*anno[^\]]*= 2000", plan)
