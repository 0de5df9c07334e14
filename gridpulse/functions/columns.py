"""Small column helpers: time, integer blocks, missing values, clipping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"

# Words read as missing in text columns, besides blanks.
NA_WORDS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def epoch_micros(column: str) -> Column:
    """Microseconds since the Unix epoch of a zone-less timestamp column."""
    return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, `{column}`)")


def from_epoch_micros(expression: str) -> Column:
    """Zone-less timestamp from a SQL expression counting microseconds."""
    return F.expr(f"timestampadd(MICROSECOND, {expression}, {_EPOCH})")


def floor_div(value: Column, size: int) -> Column:
    """Exact floor division of a BIGINT, also below zero."""
    return F.floor((value - F.pmod(value, F.lit(size))) / size)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def missing_to_null(text: Column) -> Column:
    """Trimmed text; blanks and NA words become NULL."""
    trimmed = F.trim(text)
    return F.when((trimmed != "") & ~trimmed.isin(*NA_WORDS), trimmed)


def to_number(text: Column) -> Column:
    """Plain decimal text as DOUBLE, anything else NULL."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(_NUMBER), trimmed.try_cast("double"))


def clip(value: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; missing stays missing (least/greatest skip NULLs)."""
    return F.when(
        value.isNotNull(), F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), value))
    )


_SPLITTER = 134217729.0  # 2**27 + 1 cuts a double into two halves of 26 bits


def round_nearest(value: Column, digits: int, ties_to_even: bool = True) -> Column:
    """The decimal nearest to the binary value; exact ties to even or away from zero.

    ``F.round`` rounds the shortest decimal text half up, which differs at about half
    of all values written with a final 5 (2.25, 0.35). Here the value times twice the
    power of ten is held exactly as ``near + rest``; a value is between two results
    just where that is an odd number, and ``rest`` tells on which side it lies.
    """
    twice = 2.0 * 10**digits
    split = value * _SPLITTER
    high = split - (split - value)
    near = value * twice
    rest = (high * twice - near) + (value - high) * twice
    between = (F.abs(near) % 2.0 == 1.0) & (rest != 0.0)
    if ties_to_even:
        plain = F.rint(near / 2.0)
    else:
        plain = F.signum(near) * F.floor(F.abs(near) / 2.0 + 0.5)
    return F.when(between, (near + F.signum(rest)) / 2.0).otherwise(plain) / 10.0**digits


def round_tenth(value: Column) -> Column:
    return round_nearest(value, 1)


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def present(df: DataFrame, names) -> list[str]:
    """The names that are columns of ``df``, in the given order."""
    return [name for name in names if name in df.columns]
