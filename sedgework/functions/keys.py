"""Keys: their types, and expressions given as a Column, as SQL, or as a Python callable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgework.errors import KeyTypeError

Expression = Column | str | Callable

STRING, UINT64 = "string", "uint64"
#: Spark's type for each key type; uint64 goes beyond bigint.
SPARK_TYPE: dict[str, T.DataType] = {STRING: T.StringType(), UINT64: T.DecimalType(20, 0)}
UINT64_MAX = 2**64 - 1


def check_key_type(key_type: str) -> str:
    if key_type not in SPARK_TYPE:
        raise KeyTypeError(f"key type {key_type!r} is none of {', '.join(SPARK_TYPE)}")
    return key_type


def literal_key(key: object, key_type: str) -> Column:
    """A key given by the caller, checked against the index's type. bool is no number here."""
    if key_type == STRING:
        if not isinstance(key, str):
            raise KeyTypeError(f"{key!r} is no string key")
        return F.lit(key)
    if isinstance(key, bool) or not isinstance(key, int) or not 0 <= key <= UINT64_MAX:
        raise KeyTypeError(f"{key!r} is no unsigned 64-bit key")
    return F.lit(str(key)).cast(SPARK_TYPE[UINT64])


def checked_key(function: Callable, key_type: str, many: bool) -> Callable:
    """A callable key function as one that gives texts, and raises KeyTypeError for a key that is of another type."""

    def text(key: object) -> str | None:
        if key is None:
            return None
        if (key_type == STRING and isinstance(key, str)) or (key_type == UINT64 and isinstance(key, int) and not isinstance(key, bool)):
            return str(key)
        raise KeyTypeError(f"{key!r} is no {key_type} key")

    def run(value: object) -> str | list[str | None] | None:
        found = function(value)
        return [text(k) for k in found or ()] if many else text(found)

    return run


def as_column(expression: Expression, returns: str | T.DataType, *args: str) -> Column:
    """The expression over a row: a Column as it is, a string as a SQL expression, a callable as a UDF of the args columns.

    A Column is pushed down and compiled; a callable is not, and sees one row at a time.
    """
    if isinstance(expression, Column):
        return expression
    if isinstance(expression, str):
        return F.expr(expression)
    return F.udf(expression, returns)(*args)


def key_column(raw: Column, key_type: str) -> Column:
    """raw as a key of that type; values outside it raise when the plan runs, null stays null."""
    kind = SPARK_TYPE[check_key_type(key_type)]
    if key_type == STRING:
        return raw.cast(kind)
    number = raw.cast(kind)
    bad = raw.isNotNull() & (number.isNull() | (number < 0) | (number > F.lit(str(UINT64_MAX)).cast(kind)))
    return F.when(bad, F.raise_error(F.concat(F.lit("no unsigned 64-bit key: "), raw.cast("string"))).cast(kind)).otherwise(number)
