"""Spreadsheet-style exports: header promotion, column choice, keys, first-match lookup, cell texts.

A raw sheet is a DataFrame of text columns with a row number; the header sits on one of its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellarline.config import NOT_FOUND
from cellarline.sources.csvscan import read_cells

# Header rows and columns of the three known exports.
SALES_HEADER_ROW = 6
DETAIL_HEADER_ROW = 6
INVENTORY_HEADER_ROW = 4
SALES_COLUMNS = (
    "Codigo Venta", "Ejercicio", "Periodo", "Registro Ctb.", "Fecha Mov.", "Tipo Doc.", "Serie", "Numero",
    "TDI Cliente", "Doc. Cliente", "Cliente", "Fecha Emi.", "Fecha Vnc.", "Forma Pago", "Cod. Moneda", "Moneda",
    "Tipo Cambio", "TDI Vendedor", "Doc. Vendedor", "Vendedor", "Anulado", "Valor", "Descuento", "Valor Afe.",
    "Valor Ina.", "Igv", "Total", "Retención", "Total Venta", "Observacion", "Doc.Ref. Fecha",
    "Doc.Ref. Tipo Doc.", "Doc.Ref. Serie", "Doc.Ref. Numero", "Doc. Elect.", "Doc. Elect. Envio Sunat",
    "Doc. Elect. Descrip. Resp.", "Fecha Reg.", "Usuario Reg.",
)
DETAIL_COLUMNS = (
    "Codigo Venta", "Codigo", "Producto / Servicio", "Cant", "Valor Unitario", "Importe", "IGV", "Total Neto",
)
INVENTORY_COLUMNS = (
    "Código Inventario", "Fecha Movimiento", "Ejercicio", "Registro Contable", "Tipo Operación",
    "Tipo Movimiento", "Código", "Descripción", "Almacén", "Indicador Entrada - Salida", "Cantidad",
    "Costo Moneda Nacional", "Costo Total Moneda Nacional", "Costo Moneda Extranjera",
    "Costo Total Moneda Extranjera", "Moneda", "Tipo de Cambio", "Usuario Creación", "Fecha Registro",
    "Usuario Modificación", "Fecha Modificación", "Tip. Doc. Auxiliar", "Nro. Doc. Auxiliar", "Nombre Auxiliar",
    "Tip. Doc.", "Serie", "NroDoc",
)
DATE_FORMAT = "dd/MM/yyyy"


def _name(column: str) -> Column:
    """A column by its literal name; export headers contain dots."""
    return F.col("`" + column.replace("`", "``") + "`")


def read_raw_csv(spark: SparkSession, path: str, width: int, separator: str = ",") -> DataFrame:
    """A sheet saved as CSV: text columns c1..c<width> and ``row_no`` 1..n without gaps, empty lines counted.

    Cells may hold line breaks in quotes, and the files are read in as many splits as there are.
    """
    return read_cells(spark, path, width, separator)


def promote_header(raw: DataFrame, header_row: int, row_no: str = "row_no") -> DataFrame:
    """Name the columns after the cells of row ``header_row`` and keep the rows below it.

    The header row is the one row that is brought to the driver. A blank header cell, or one that repeats
    an earlier text, leaves its column under the old name.
    """
    header = raw.filter(_name(row_no) == header_row).first()
    if header is None:
        raise ValueError(f"the sheet has no row {header_row}")
    names, seen = [], {row_no}
    for column in raw.columns:
        text = row_no if column == row_no else header[column]
        if column != row_no and (text is None or not str(text).strip() or text in seen):
            text = column
        seen.add(text)
        names.append(str(text))
    return raw.filter(_name(row_no) > header_row).toDF(*names)


def select_trimmed(df: DataFrame, wanted: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The ``wanted`` columns in that order, matched on trimmed names; missing ones are left out.

    The first of several equal names wins. The output carries the trimmed name. ``keep`` names columns
    (a row number) to carry along in front.
    """
    by_name: dict[str, str] = {}
    for column in df.columns:
        by_name.setdefault(column.strip(), column)
    found = [name.strip() for name in wanted if name.strip() in by_name]
    return df.select(*[_name(k) for k in keep], *[_name(by_name[name]).alias(name) for name in found])


def _blank(column: Column) -> Column:
    return column.isNull() | (column.cast("string") == "")


def drop_blank_rows(df: DataFrame, ignore: Sequence[str] = ("row_no",)) -> DataFrame:
    """Drop rows whose cells are all empty (null or empty text), the ``ignore`` columns apart."""
    filled = F.lit(False)
    for column in df.columns:
        if column not in ignore:
            filled = filled | ~_blank(_name(column))
    return df.filter(filled)


def _text(df: DataFrame, column: str) -> Column:
    """A key part: a number as the sheet shows it (1234, not 1234.0)."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return _cell(_name(column), kind)
    return F.coalesce(_name(column).cast("string"), F.lit(""))


def invoice_key(df: DataFrame, first: str, serie: str = "Serie", numero: str = "Numero", out: str = "Factura") -> DataFrame:
    """Add ``serie-numero`` where the row's first cell is not blank."""
    key = F.concat(_text(df, serie), F.lit("-"), _text(df, numero))
    return df.withColumn(out, F.when(~_blank(_name(first)), key))


def lookup_first(
    detail: DataFrame,
    header: DataFrame,
    key: str,
    value: str,
    row_no: str = "row_no",
    out: str = "Factura",
    not_found: str = NOT_FOUND,
) -> DataFrame:
    """Bring ``value`` of the first header row (by ``row_no``) whose key text equals the detail row's.

    Without a match the text ``not_found`` is set; a blank key stays empty. The first header row per key is
    an aggregate that combines before the shuffle; it is dealt by key and hash, so that the join deals both of its
    sides anew and Spark can split a hot key. Blank keys take no part in the join: each gets a key of
    its own that matches nothing, so they spread over the tasks instead of meeting in one.
    """
    keyed_header = header.filter(~_blank(_name(key))).withColumn("_key", _text(header, key))
    firsts = keyed_header.groupBy("_key", F.xxhash64("_key").alias("_hash")).agg(
        F.min_by(F.struct(_name(value).alias("value")), _name(row_no)).alias("_hit")
    ).drop("_hash")
    blank = _blank(_name(key))
    # A text that starts with NUL matches no header key. The row's own hash follows, not a random number:
    # a task that runs again after a lost executor must send each row to the same place.
    spread = F.concat(F.lit("\u0000"), F.xxhash64(*[_name(c) for c in detail.columns]).cast("string"))
    keyed = detail.withColumn("_key", F.when(blank, spread).otherwise(_text(detail, key)))
    joined = keyed.join(firsts, "_key", "left")
    result = F.when(blank, F.lit(None)).when(F.col("_hit").isNull(), F.lit(not_found)).otherwise(F.col("_hit.value"))
    return joined.withColumn(out, result.cast("string")).drop("_key", "_hit")


def whole_number(column: Column) -> Column:
    """Round half to even and write without decimals."""
    return F.bround(column.cast("double"), 0).cast("bigint").cast("string")


def inventory_key_sales(
    df: DataFrame, first: str, factura: str = "Factura", codigo: str = "Codigo", cant: str = "Cant", out: str = "Clave_Inventario"
) -> DataFrame:
    """Add invoice, product code and whole quantity in one text where the first cell is not blank.

    A quantity that is missing or cannot be read as a number counts as 0.
    """
    quantity = whole_number(F.coalesce(_name(cant).try_cast("double"), F.lit(0.0)))
    key = F.concat(_text(df, factura), _text(df, codigo), quantity)
    return df.withColumn(out, F.when(~_blank(_name(first)), key))


def inventory_key_movement(
    df: DataFrame,
    first: str,
    serie: str = "Serie",
    nro_doc: str = "NroDoc",
    codigo: str = "Código",
    cantidad: str = "Cantidad",
    out: str = "Clave_Inventario",
) -> DataFrame:
    """Add ``serie-document``, product code and whole quantity in one text, as the sales key does."""
    quantity = whole_number(F.coalesce(_name(cantidad).try_cast("double"), F.lit(0.0)))
    key = F.concat(_text(df, serie), F.lit("-"), _text(df, nro_doc), _text(df, codigo), quantity)
    return df.withColumn(out, F.when(~_blank(_name(first)), key))


def _cell(column: Column, kind: T.DataType) -> Column:
    empty = F.lit("")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(F.date_format(column, DATE_FORMAT), empty)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        number = column.cast("double")
        integral = (number == F.floor(number)) & (F.abs(number) < 1e18)
        # Plain digits without exponent, where 38 digits can hold the number.
        wide = number.try_cast("decimal(38,18)")
        plain = F.when(wide.cast("double") == number, F.regexp_replace(wide.cast("string"), "0+$", ""))
        text = F.when(integral, F.when(integral, number).cast("bigint").cast("string"))
        text = text.otherwise(F.coalesce(plain, number.cast("string")))
        return F.when(number.isNull() | F.isnan(number), empty).otherwise(text)
    return F.coalesce(column.cast("string"), empty)


def normalize_cells(df: DataFrame) -> DataFrame:
    """Every cell as sheet text: nothing for null and NaN, dates as dd/MM/yyyy, 3.0 as 3."""
    return df.select(*[_cell(_name(f.name), f.dataType).alias(f.name) for f in df.schema])
