"""Column-expression helpers. Everything here returns a ``Column`` built from
built-in Spark functions, so it stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The default seed of the reference (random_state).
DEFAULT_SEED = 42

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)

# A plain decimal / scientific literal. Spark's cast accepts suffixes such as
# '1d' that other engines reject, so only text matching this pattern is parsed.
NUMBER_PATTERN = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def q(name: str) -> Column:
    """Column by exact name (names may contain spaces, dots or parentheses)."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_integral_type(dt: T.DataType) -> bool:
    return isinstance(dt, INTEGRAL_TYPES)


def is_datetime_type(dt: T.DataType) -> bool:
    return isinstance(dt, DATETIME_TYPES)


def hash32(value: Column, salt: str | int = DEFAULT_SEED) -> Column:
    """Portable unsigned 32-bit hash: first 8 hex digits of md5('salt:' || value).

    Identical in DuckDB as
    ``CAST('0x' || substr(md5('salt:' || CAST(v AS VARCHAR)), 1, 8) AS BIGINT)``,
    and independent of partitioning, so splits are reproducible anywhere.
    """
    text = F.concat(F.lit(f"{salt}:"), value.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def nan_to_null(c: Column) -> Column:
    """NaN is not NULL in Spark; treat both as missing."""
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def to_double(c: Column) -> Column:
    """Numeric column as double with NaN mapped to NULL."""
    return nan_to_null(c.cast("double"))


def coerce_number(c: Column) -> Column:
    """Any value → double; NULL for text that is not a plain number. Never throws
    under ANSI mode."""
    s = F.trim(c.cast("string"))
    return F.when(s.rlike(NUMBER_PATTERN), s.try_cast("double"))


def clip_nullsafe(c: Column, lower: float, upper: float) -> Column:
    """Clip to [lower, upper]; NULL stays NULL (``least``/``greatest`` skip NULLs)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(lower))), F.lit(float(upper))))


def lit_double(v) -> Column:
    return F.lit(None).cast("double") if v is None else F.lit(float(v))
