"""Logical types, their Spark types, and operands coerced to them when a filter is bound."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ValidationError(ValueError):
    """A mistake in a filter, template, schema or row, named before any job starts."""


ORDERED = {"bool", "int", "float", "decimal", "string", "datetime"}


def logical(kind: T.DataType) -> str:
    """The logical type of a Spark type."""
    match kind:
        case T.BooleanType():
            return "bool"
        case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType():
            return "int"
        case T.FloatType() | T.DoubleType():
            return "float"
        case T.DecimalType():
            return "decimal"
        case T.StringType() | T.VarcharType() | T.CharType():
            return "string"
        case T.TimestampType() | T.TimestampNTZType() | T.DateType():
            return "datetime"
        case T.BinaryType():
            return "binary"
        case T.ArrayType():
            return "list"
        case T.StructType():
            return "object"
    return "json"


SPARK = {"bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType(), "decimal": T.DecimalType(38, 18), "string": T.StringType(), "datetime": T.TimestampType(), "binary": T.BinaryType(), "json": T.StringType()}


def spark_type(column: dict) -> T.DataType:
    """The Spark type of a column description ``{type, scale?, item?, fields?}``."""
    kind = column["type"]
    if kind == "list":
        item = column["item"]
        return T.ArrayType(spark_type(item), item.get("nullable", True))
    if kind == "object":
        return T.StructType([T.StructField(f["name"], spark_type(f), f.get("nullable", True)) for f in column["fields"]])
    if kind == "decimal":
        return T.DecimalType(38, column.get("scale", 18))
    if kind not in SPARK:
        raise ValidationError(f"unknown type {kind!r}")
    return SPARK[kind]


def parse_time(value: Any, name: str) -> dt.datetime:
    """Text in ISO form, epoch milliseconds, or a datetime; UTC, without a zone."""
    if isinstance(value, dt.datetime):
        return value.astimezone(dt.UTC).replace(tzinfo=None) if value.tzinfo else value
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    if isinstance(value, int) and not isinstance(value, bool):
        return dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=value)
    if isinstance(value, str):
        try:
            return parse_time(dt.datetime.fromisoformat(value.replace("Z", "+00:00")), name)
        except ValueError:
            pass
    raise ValidationError(f"{name}: {value!r} is not a datetime")


def coerce(value: Any, kind: T.DataType, name: str) -> Any:
    """An operand as a value of the column's type; an error names the column."""
    what = logical(kind)
    wrong = ValidationError(f"{name}: {value!r} is not of type {what}")
    if what == "bool":
        if isinstance(value, str) and value.lower() in ("true", "false"):
            return value.lower() == "true"
        if isinstance(value, bool):
            return value
        raise wrong
    if what == "int":
        if isinstance(value, str) and re.fullmatch(r"[+-]?\d+", value):
            value = int(value)
        if isinstance(value, float) and value.is_integer():
            value = int(value)
        if isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63:
            return value
        raise wrong
    if what == "float":
        if isinstance(value, bool):
            raise wrong
        try:
            return float(value)
        except (TypeError, ValueError):
            raise wrong from None
    if what == "decimal":
        if isinstance(value, bool) or (isinstance(value, float) and not math.isfinite(value)):
            raise wrong
        try:
            return decimal.Decimal(str(value))
        except decimal.InvalidOperation:
            raise wrong from None
    if what == "string":
        if isinstance(value, bool) or not isinstance(value, str | int | float | decimal.Decimal):
            raise wrong
        return str(value)
    if what == "datetime":
        return parse_time(value, name)
    raise ValidationError(f"{name}: type {what} can't be compared")


def literal(value: Any, kind: T.DataType) -> Column:
    """A literal of the column's own type, so that the column is never cast and filters reach the scan."""
    if isinstance(kind, T.DecimalType):
        digits = value.as_tuple()
        scale = max(0, -digits.exponent)
        return F.lit(value).cast(T.DecimalType(38, min(38, scale)))
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType) and not -(2**31) <= value < 2**31:
        return F.lit(value).cast("long")
    if isinstance(kind, T.FloatType):
        return F.lit(value).cast("double")
    return F.lit(value).cast(kind)
