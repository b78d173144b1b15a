"""The filter language: JSON objects compiled to Columns, with two-valued logic.

A condition on a null is false and its negation true. The compiler carries the polarity down the tree: what stands
positive is emitted bare, so that it reaches the Parquet scan, and what stands negated becomes ``IS NULL OR inverse``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.values import ORDERED, ValidationError, coerce, literal, logical

COMPARE = {"eq", "ne", "gt", "gte", "lt", "lte"}
TEXT = {"contains", "icontains", "startsWith"}
NESTED = {"any": "list", "all": "list", "match": "object"}
#: Operands from which ``in`` is a join in ``where``.
MANY = 1000


class Node:
    """A bound condition: ``column(get, positive)`` compiles it, ``test(value)`` evaluates it on a Python row."""

    def __init__(self, compile_: Callable[[Callable[[str], Column], bool], Column], test: Callable[[Any], bool]) -> None:
        self.column, self.test = compile_, test


def _both(parts: list[Node]) -> Node:
    def build(get, positive):
        if not parts:
            return F.lit(positive)
        return reduce(lambda a, b: a & b if positive else a | b, [p.column(get, positive) for p in parts])

    return Node(build, lambda row: all(p.test(row) for p in parts))


def _either(parts: list[Node]) -> Node:
    def build(get, positive):
        if not parts:
            return F.lit(not positive)
        return reduce(lambda a, b: a | b if positive else a & b, [p.column(get, positive) for p in parts])

    return Node(build, lambda row: any(p.test(row) for p in parts))


def _negated(part: Node) -> Node:
    return Node(lambda get, positive: part.column(get, not positive), lambda row: not part.test(row))


def _is_null(name: str, wanted: bool) -> Node:
    return Node(lambda get, positive: get(name).isNull() if wanted == positive else get(name).isNotNull(), lambda row: (row.get(name) is None) == wanted)


def _constant(value: bool) -> Node:
    return Node(lambda get, positive: F.lit(value == positive), lambda row: value)


def _nan(value: Any) -> bool:
    return isinstance(value, float) and math.isnan(value)


def _leaf(name: str, positive_: Callable[[Column], Column], negative: Callable[[Column], Column], test: Callable[[Any], bool]) -> Node:
    def build(get, positive):
        c = get(name)
        return positive_(c) if positive else c.isNull() | negative(c)

    return Node(build, lambda row: row.get(name) is not None and test(row[name]))


def _comparison(op: str, name: str, kind: T.DataType, value: Any) -> Node:
    if value is None:
        if op not in ("eq", "ne"):
            raise ValidationError(f"{name}: {op} needs a value")
        return _is_null(name, op == "eq")
    value = coerce(value, kind, name)
    real = logical(kind) == "float"
    if _nan(value):
        return _is_null(name, False) if op == "ne" else _constant(False)
    lit = literal(value, kind)
    same = lambda v: not _nan(v) and v == value
    match op:
        case "eq":
            return _leaf(name, lambda c: c == lit, lambda c: c != lit, same)
        case "ne":
            return _leaf(name, lambda c: c != lit, lambda c: c == lit, lambda v: not same(v))
        case "gt":
            return _leaf(name, lambda c: (c > lit) & ~F.isnan(c) if real else c > lit, lambda c: (c <= lit) | F.isnan(c) if real else c <= lit, lambda v: not _nan(v) and v > value)
        case "gte":
            return _leaf(name, lambda c: (c >= lit) & ~F.isnan(c) if real else c >= lit, lambda c: (c < lit) | F.isnan(c) if real else c < lit, lambda v: not _nan(v) and v >= value)
        # Spark puts NaN above all numbers, so a lower bound on it needs no guard
        case "lt":
            return _leaf(name, lambda c: c < lit, lambda c: c >= lit, lambda v: not _nan(v) and v < value)
    return _leaf(name, lambda c: c <= lit, lambda c: c > lit, lambda v: not _nan(v) and v <= value)


def _membership(name: str, kind: T.DataType, values: Any) -> Node:
    if not isinstance(values, list | tuple | set):
        raise ValidationError(f"{name}: in needs a list")
    wanted = [coerce(v, kind, name) for v in values if v is not None]
    wanted = list(dict.fromkeys(v for v in wanted if not _nan(v)))
    if not wanted:
        return _constant(False)
    held = set(wanted)
    lits = [literal(v, kind) for v in wanted]
    return _leaf(name, lambda c: c.isin(lits), lambda c: ~c.isin(lits), lambda v: v in held)


def _text(op: str, name: str, kind: T.DataType, value: Any) -> Node:
    if logical(kind) != "string" or not isinstance(value, str):
        raise ValidationError(f"{name}: {op} needs text on either side")
    if op == "contains":
        make = lambda c: c.contains(value)
        return _leaf(name, make, lambda c: ~make(c), lambda v: value in v)
    if op == "startsWith":
        return _leaf(name, lambda c: c.startswith(value), lambda c: ~c.startswith(value), lambda v: v.startswith(value))
    low = value.lower()
    return _leaf(name, lambda c: F.lower(c).contains(low), lambda c: ~F.lower(c).contains(low), lambda v: low in v.lower())


ITEM = ""  # the name under which the item itself is known inside any and all


def _items(op: str, name: str, kind: T.ArrayType, inner: Any) -> Node:
    item = kind.elementType
    if isinstance(item, T.StructType):
        bound, guard = bind(inner, item), True
        get = lambda x: (lambda field: x.getField(field))
        unwrap = lambda v: v
    else:
        condition = inner if isinstance(inner, dict) else {"eq": inner}
        bound, guard = _conditions(ITEM, item, condition), False
        get = lambda x: (lambda _: x)
        unwrap = lambda v: {ITEM: v}

    def yes(x):
        made = bound.column(get(x), True)
        return x.isNotNull() & made if guard else made

    def no(x):
        made = bound.column(get(x), False)
        return x.isNull() | made if guard else made

    def build(outer, positive):
        c = outer(name)
        if op == "any":
            return F.exists(c, lambda x: F.coalesce(yes(x), F.lit(False))) if positive else c.isNull() | F.forall(c, lambda x: F.coalesce(no(x), F.lit(False)))
        return c.isNotNull() & F.forall(c, lambda x: F.coalesce(yes(x), F.lit(False))) if positive else c.isNull() | F.exists(c, lambda x: F.coalesce(no(x), F.lit(False)))

    def test(row):
        items = row.get(name)
        if items is None:
            return False
        return (any if op == "any" else all)((not guard or v is not None) and bound.test(unwrap(v)) for v in items)

    return Node(build, test)


def _match(name: str, kind: T.StructType, inner: Any) -> Node:
    bound = bind(inner, kind)

    def build(outer, positive):
        c = outer(name)
        made = bound.column(lambda field: c.getField(field), positive)
        return c.isNotNull() & made if positive else c.isNull() | made

    return Node(build, lambda row: row.get(name) is not None and bound.test(row[name]))


def _conditions(name: str, kind: T.DataType, condition: Any) -> Node:
    if not isinstance(condition, dict):
        condition = {"eq": condition}
    if not condition:
        raise ValidationError(f"{name}: an empty condition")
    parts, what = [], logical(kind)
    for op, value in condition.items():
        if op == "isNull":
            if not isinstance(value, bool):
                raise ValidationError(f"{name}: isNull needs true or false")
            parts.append(_is_null(name, value))
        elif op in NESTED:
            if what != NESTED[op]:
                raise ValidationError(f"{name}: {op} is for type {NESTED[op]}, not {what}")
            parts.append(_match(name, kind, value) if op == "match" else _items(op, name, kind, value))
        elif op in TEXT:
            parts.append(_text(op, name, kind, value))
        elif op in COMPARE or op == "in":
            if op in ("eq", "ne") and value is None:
                parts.append(_is_null(name, op == "eq"))
            elif what not in ORDERED:
                raise ValidationError(f"{name}: type {what} can't be compared")
            else:
                parts.append(_membership(name, kind, value) if op == "in" else _comparison(op, name, kind, value))
        else:
            raise ValidationError(f"{name}: unknown operator {op!r}")
    return parts[0] if len(parts) == 1 else _both(parts)


def bind(filter_: Any, schema: T.StructType) -> Node:
    """Check a filter against a schema; mistakes are named before any job starts."""
    if isinstance(filter_, str):
        filter_ = json.loads(filter_)
    if not isinstance(filter_, dict):
        raise ValidationError("a filter is an object")
    fields, parts = {f.name: f.dataType for f in schema.fields}, []
    for key, value in filter_.items():
        if key in ("and", "or"):
            if not isinstance(value, list):
                raise ValidationError(f"{key} needs a list of filters")
            inner = [bind(v, schema) for v in value]
            parts.append(_both(inner) if key == "and" else _either(inner))
        elif key == "not":
            parts.append(_negated(bind(value, schema)))
        elif key in fields:
            parts.append(_conditions(key, fields[key], value))
        else:
            raise ValidationError(f"unknown or hidden column {key!r}")
    return parts[0] if len(parts) == 1 else _both(parts)


def compile_filter(filter_: Any, df: DataFrame) -> Column:
    """The filter as a predicate for ``df.filter``; null means no match there."""
    return bind(filter_, df.schema).column(lambda name: df[f"`{name}`"], True)


def as_value(filter_: Any, df: DataFrame) -> Column:
    """The filter as a true or false value, for ``select``, ``when`` and conditional aggregates."""
    return F.coalesce(compile_filter(filter_, df), F.lit(False))


def predicate(filter_: Any, schema: T.StructType) -> Callable[[dict], bool]:
    """The same filter over Python rows."""
    return bind(filter_, schema).test


def where(df: DataFrame, filter_: Any) -> DataFrame:
    """``df.filter``; a long top-level ``in`` becomes a semi join, whose side Spark broadcasts only if it is small."""
    filter_ = json.loads(filter_) if isinstance(filter_, str) else filter_
    if isinstance(filter_, dict):
        for name, condition in filter_.items():
            if isinstance(condition, dict) and set(condition) == {"in"} and isinstance(condition["in"], list) and len(condition["in"]) > MANY and name in df.columns:
                kind = df.schema[name].dataType
                bind({name: {"in": condition["in"][:1]}}, df.schema)
                values = {v for x in condition["in"] if x is not None and not _nan(v := coerce(x, kind, name))}
                keys = df.sparkSession.createDataFrame([(v,) for v in values], T.StructType([T.StructField(name, kind)]))
                rest = {k: v for k, v in filter_.items() if k != name}
                return where(df, rest).join(keys, name, "left_semi").select(*df.columns)
    return df.filter(compile_filter(filter_, df))
