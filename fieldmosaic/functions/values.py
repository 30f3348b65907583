"""Coercion, missing values and row-wise arithmetic."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import names

# Plain decimal numbers that cannot overflow a double.
_NUMBER = r"^[+-]?(\d{1,200}\.?\d*|\.\d+)([eE][+-]?\d{1,2})?$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NaN and infinities become NULL."""
    c = col(c).cast("double")
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def to_number(c: Column | str) -> Column:
    """Text to double; anything that is not a plain decimal number is NULL."""
    text = F.trim(col(c).cast("string"))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def truthy(c: Column | str) -> Column:
    text = F.lower(F.trim(col(c).cast("string")))
    return F.coalesce(text.isin(names.TRUE_WORDS), F.lit(False))


def safe_divide(a: Column | str, b: Column | str) -> Column:
    """NULL for a missing or non-finite operand and for a zero denominator."""
    return F.try_divide(finite(a), finite(b))


def fill_missing(c: Column | str, constant: float | None) -> Column:
    return col(c) if constant is None else F.coalesce(finite(c), F.lit(float(constant)))


def quoted(name: str) -> str:
    return f"`{name}`"


def finite_text(name: str) -> str:
    """SQL text of ``finite`` for a column name: wide row sums are parsed once, in the JVM."""
    number = f"CAST({quoted(name)} AS DOUBLE)"
    return f"CASE WHEN abs({number}) < CAST('Infinity' AS DOUBLE) THEN {number} END"


def sum_present(names: Iterable[str]) -> Column:
    """Sum over the columns that are present; NULL when none is. Expects finite or NULL values."""
    values = [quoted(n) for n in names]
    whole = " + ".join(f"coalesce({v}, 0D)" for v in values)
    return F.expr(f"CASE WHEN coalesce({', '.join(values)}) IS NOT NULL THEN {whole} END")


def any_present(names: Iterable[str]) -> Column:
    return F.expr(f"coalesce({', '.join(quoted(n) for n in names)}) IS NOT NULL")


def all_present(names: Iterable[str]) -> Column:
    return F.expr(" AND ".join(f"{quoted(n)} IS NOT NULL" for n in names))


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns so that each is computed once per row.

    Filters on a projected column are pushed below the projection and repeat
    its expression there. They are not pushed below a generated column, so
    costly expressions are emitted as one generated row per input row.
    """
    made = F.struct(*[value.alias(name) for name, value in columns.items()])
    rest = [F.col(quoted(c)) for c in df.columns if c not in columns]
    out = df.select(*rest, F.inline(F.array(made)))
    return out.select(*[F.col(quoted(c)) for c in [*df.columns, *[n for n in columns if n not in df.columns]]])


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounded value; NULL stays NULL (``greatest`` alone would skip it)."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(c.isNotNull(), out)


def repair_raw(c: Column | str, product: str | None = None, *, fill=None, valid=None, scale=1.0, offset=0.0) -> Column:
    """Raw raster value to physical value: fill and out-of-range become NULL, then scale."""
    if product is not None:
        spec = names.PRODUCT_REPAIR[product]
        fill, valid, scale = spec["fill"], spec["valid"], spec["scale"]
    value = finite(c)
    keep = value.isNotNull()
    if fill is not None:
        keep = keep & (value != F.lit(float(fill)))
    low, high = valid or (None, None)
    if low is not None:
        keep = keep & (value >= F.lit(float(low)))
    if high is not None:
        keep = keep & (value <= F.lit(float(high)))
    return F.when(keep, value * F.lit(float(scale)) + F.lit(float(offset)))
