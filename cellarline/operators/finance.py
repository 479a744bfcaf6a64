"""Financial statements from journal entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarline.functions.exprs import exact_sum
from cellarline.functions.frames import first_rows


def _statement(ledger: DataFrame, accounts: str) -> DataFrame:
    """Debit and credit per account and period for accounts that start with one of ``accounts``."""
    wanted = F.substring("nro_cta", 1, 1).isin(*accounts)
    return ledger.filter(wanted).groupBy(
        F.col("nro_cta").alias("cuenta"), F.col("nombre_cuenta").alias("nombre"), "ejercicio", "periodo"
    ).agg(exact_sum("mto_debe").cast("double").alias("debe"), exact_sum("mto_haber").cast("double").alias("haber"))


def _with_year_before(ledger: DataFrame, anno: int | None) -> DataFrame:
    return ledger if anno is None else ledger.filter(F.col("ejercicio").isin(anno, anno - 1))


def fin_balance(ledger: DataFrame, anno: int | None = None) -> DataFrame:
    """Balance sheet accounts (1 to 5), opening period included; a year comes with the one before it."""
    return _statement(_with_year_before(ledger, anno), "12345")


def fin_resultados(ledger: DataFrame, anno: int | None = None) -> DataFrame:
    """Income statement accounts (6 and 7) without the opening period."""
    return _statement(_with_year_before(ledger, anno).filter(F.col("periodo") != 0), "67")


def fin_flujo(ledger: DataFrame, anno: int | None = None) -> DataFrame:
    """Cash in, out and net per period from the cash accounts (10...).

    Net sums the row differences, so a row with a missing side adds nothing to it.
    """
    cash = ledger.filter(F.col("nro_cta").startswith("10"))
    if anno is not None:
        cash = cash.filter(F.col("ejercicio") == anno)
    return cash.groupBy("ejercicio", "periodo").agg(
        exact_sum("mto_debe").cast("double").alias("ingresos"),
        exact_sum("mto_haber").cast("double").alias("egresos"),
        exact_sum(F.col("mto_debe") - F.col("mto_haber")).cast("double").alias("flujo_neto"),
    )


def fin_detalle(
    ledger: DataFrame, anno: int, cta: str, periodo: int | None = None, limit: int | None = None
) -> DataFrame:
    """The entries behind one account, oldest first; all of them unless ``limit`` asks for the first."""
    found = ledger.filter((F.col("ejercicio") == anno) & (F.col("nro_cta") == cta))
    if periodo is not None:
        found = found.filter(F.col("periodo") == periodo)
    entries = found.select(
        F.col("fec_mov").alias("fecha"),
        F.col("reg_ctb").alias("registro"),
        "glosa",
        F.col("tip_doc").alias("doc_tipo"),
        F.col("nro_doc").alias("doc_numero"),
        F.coalesce("cliente", "proveedor").alias("entidad"),
        F.col("mto_debe").alias("debe"),
        F.col("mto_haber").alias("haber"),
        F.col("mda_origen").alias("moneda"),
    )
    ordered = entries.orderBy("fecha", "registro", "entidad", "debe", "haber", "glosa", "doc_tipo", "doc_numero")
    return first_rows(ordered, limit).withColumns({name: F.col(name).cast("double") for name in ("debe", "haber")})


def ledger_profile_years(ledger: DataFrame) -> DataFrame:
    """Rows per fiscal year."""
    return ledger.groupBy("ejercicio").agg(F.count("*").alias("filas")).orderBy("ejercicio")


def ledger_profile_accounts(ledger: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows per (account, name) by account, all of them unless ``limit`` asks for the first."""
    rows = ledger.groupBy("nro_cta", "nombre_cuenta").agg(F.count("*").alias("filas"))
    return first_rows(rows.orderBy("nro_cta", "nombre_cuenta"), limit)
