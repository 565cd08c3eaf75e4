"""Small building blocks shared by the column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def blank_to_null(text: Column | str) -> Column:
    """NULL for a missing or whitespace-only text."""
    text = as_col(text)
    return F.when(F.trim(text) != "", text)


def let(value: Column, use) -> Column:
    """`use(value)` with `value` evaluated once per row, however often `use` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def one_row(df: DataFrame) -> Column:
    """A one-row summary as a single struct value: read its fields from a column holding it."""
    return df.select(F.struct("*").alias("row")).scalar()


def lookup(key: Column, table: dict, default: Column | None = None) -> Column:
    """CASE over a fixed table; unlike a map it folds into codegen."""
    first, *rest = table.items()
    chain = reduce(
        lambda acc, kv: acc.when(key == F.lit(kv[0]), F.lit(kv[1])),
        rest,
        F.when(key == F.lit(first[0]), F.lit(first[1])),
    )
    return chain if default is None else chain.otherwise(default)


def compact(*items: Column) -> Column:
    """An array of the given values without the NULLs."""
    return F.array_compact(F.array(*items))


def round_half_up(value: Column, places: int) -> Column:
    """Rounding that Spark and other engines compute identically on doubles."""
    scale = float(10**places)
    return F.floor(value * scale + 0.5) / F.lit(scale)


def money_sum(value: Column, scale: int = 4) -> Column:
    """Order-independent sum of double amounts: exact decimals inside, double outside."""
    return F.sum(value.cast(f"decimal(28,{scale})")).cast("double")


def finite(value: Column) -> Column:
    """The number itself, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def percent(value: Column, places: int = 0) -> Column:
    return F.concat(F.format_string(f"%.{places}f", value * 100), F.lit("%"))


def plain_number(value: Column) -> Column:
    """A double the way a person writes it: 100, 87.5 — no trailing zeros."""
    trimmed = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value), "0+$", ""), "\\.$", "")
    return F.when(value.isNotNull(), trimmed)


def grouped(value: Column, places: int = 0) -> Column:
    """Thousands separators: 50,000."""
    return F.format_number(value, places)
