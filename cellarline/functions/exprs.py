"""Pure Column builders: safe ratios, rounding, dates, labels and pattern flags."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keeps half-way ratios on the same side in every engine that evaluates the same formula.
HALF_UP = 0.500001


def as_date(as_of: dt.date | str | None) -> Column:
    """The reference day of the day counts; None means today."""
    return F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")


def as_python_date(as_of: dt.date | str | None) -> dt.date:
    if as_of is None:
        return dt.date.today()
    return as_of if isinstance(as_of, dt.date) else dt.date.fromisoformat(as_of)


def days_since(day: Column, as_of: dt.date | str | None) -> Column:
    return F.datediff(as_date(as_of), day).cast("bigint")


def month_start(anno: str = "anno", mes: str = "mes") -> Column:
    return F.make_date(F.col(anno).cast("int"), F.col(mes).cast("int"), F.lit(1))


def exact_sum(amount: str | Column) -> Column:
    """Exact sum of decimal(18,4) amounts as a decimal, at the speed of long sums.

    Spark keeps the buffer of a decimal sum as a byte array that is rewritten for every row. Here an amount
    becomes a whole number of ten-thousandths, and its high and low 20-bit parts are summed as two longs,
    which neither lose digits nor overflow for any realistic number of rows; the decimal is made once per
    group.
    """
    column = F.col(amount) if isinstance(amount, str) else amount
    units = (column.cast("decimal(18,4)") * F.lit(10_000).cast("decimal(5,0)")).cast("bigint")
    high, low = F.sum(F.shiftright(units, 20)), F.sum(units.bitwiseAND(F.lit((1 << 20) - 1)))
    whole = high.cast("decimal(19,0)") * F.lit(1 << 20).cast("decimal(7,0)") + low.cast("decimal(19,0)")
    return (whole * F.lit("0.0001").cast("decimal(4,4)")).cast("decimal(34,4)")


def money_sum(amount: str | Column, digits: int = 0) -> Column:
    """Exact sum of amounts, rounded half away from zero, as double."""
    return F.round(exact_sum(amount), digits).cast("double")


def whole_sum(amount: str) -> Column:
    """Exact sum of doubles that hold whole numbers, as ``money_sum`` gives: a sum of doubles loses digits above 2^53."""
    return F.sum(F.col(amount).cast("decimal(28,0)"))


def safe_div(num: Column, den: Column) -> Column:
    """Division in double that gives null for a null or zero divisor."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def round_ratio(value: Column, digits: int = 1) -> Column:
    """Half-up rounding of a double; adding 0.0 turns minus zero into zero."""
    scale = float(10**digits)
    shifted = F.floor(F.abs(value) * F.lit(scale) + F.lit(HALF_UP)).cast("double")
    return F.signum(value) * shifted / F.lit(scale) + F.lit(0.0)


def percent(num: Column, den: Column, digits: int = 1) -> Column:
    return round_ratio(safe_div(num, den) * F.lit(100.0), digits)


def first_match(rules: Iterable[tuple[Column, object]], default: object) -> Column:
    """Ordered CASE: the first true condition gives the value."""
    chain = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    default = default if isinstance(default, Column) else F.lit(default)
    return default if chain is None else chain.otherwise(default)


def contains_any(column: Column, patterns: Sequence[str]) -> Column:
    """Null for a null text, like the OR of LIKE predicates."""
    found = column.contains(patterns[0])
    for pattern in patterns[1:]:
        found = found | column.contains(pattern)
    return found


def or_text(column: str, text: str) -> Column:
    return F.coalesce(F.col(column), F.lit(text))
