"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# The strings that data frame readers take as missing by default.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def named(name: str) -> Column:
    """A column by its exact name, also where the name holds a dot."""
    return F.col("`" + name.replace("`", "``") + "`")


def rounded(col: Column, digits: int) -> Column:
    """Round half up after a nudge far below the last digit, so exact ties fall the same way everywhere."""
    return F.round(col + F.lit(10.0 ** -(digits + 3)), digits)


def money_sum(col: Column | str) -> Column:
    """Sum of two-digit amounts without drift: exact decimal sum, returned as double."""
    col = F.col(col) if isinstance(col, str) else col
    return F.sum(col.cast("decimal(18,2)")).cast("double")


def nullify_tokens(col: Column, tokens: Sequence[str] = NA_TOKENS) -> Column:
    """Null for any of the missing-value tokens, the value otherwise."""
    return F.when(~F.trim(col).isin(*tokens), col)


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def to_number(col: Column) -> Column:
    """Numeric value of a column of any type; null where it is not a number."""
    return col.try_cast("double")


def table_key(name: Column) -> Column:
    """Normalised table name: text before the first dot, lower case, '-' as '_'."""
    return F.regexp_replace(F.lower(F.split_part(name, F.lit("."), F.lit(1))), "-", "_")


def table_name(name: str) -> str:
    """`table_key` for a name known on the driver."""
    return name.split(".", 1)[0].lower().replace("-", "_")


def month_index(ts: Column) -> Column:
    """Months since year 0, so that differences count calendar months."""
    return F.year(ts) * 12 + F.month(ts)


def hash_bucket(key: Column, buckets: int, seed: str = "") -> Column:
    """Deterministic bucket 0..buckets-1 of a key; same on every run and engine."""
    text = F.concat(key.cast("string"), F.lit(seed)) if seed else key.cast("string")
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % F.lit(buckets)


def title_of(role: Column) -> Column:
    """Display title of a role or column name: underscores as blanks, capitals at word starts."""
    return F.initcap(F.regexp_replace(role, "_", " "))


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(vec: Column) -> Column:
    return F.sqrt(dot(vec, vec))
