"""Fluent queries: a lazy chain over a DataFrame whose file order, if any, is its ``_row_id``.

Lambdas get a row proxy whose attributes are Columns, so a whole chain is one plan for Catalyst. Null comparisons follow
the filter language: conditions on nulls are false, and ``~`` of a condition is taken as written by SQL, so use
``filter`` with a ``not`` for two-valued negation.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.values import ValidationError, logical
from tabulon.operators.filters import where
from tabulon.operators.orders import ROW_ID, cut, with_row_ids
from tabulon.operators.rows import batches
from tabulon.sources.scratch import persist


class RowProxy:
    """Columns by attribute or item; unknown names are an error when the lambda is traced."""

    def __init__(self, df: DataFrame, alias: str | None = None) -> None:
        self._df, self._alias = df, alias

    def __getitem__(self, name: str) -> Column:
        if name not in self._df.columns:
            raise ValidationError(f"unknown or hidden column {name!r}")
        return F.col(f"{self._alias}.`{name}`") if self._alias else self._df[f"`{name}`"]

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__"):
            raise AttributeError(name)
        return self[name]


def truthy(df: DataFrame, name: str) -> Column:
    """A bare column as a condition: true, not empty, not 0, or present, by type."""
    c, kind = df[name], logical(df.schema[name].dataType)
    return {"bool": c == F.lit(True), "string": c != "", "int": c != 0, "float": (c != 0) & ~F.isnan(c) if kind == "float" else c}.get(kind, c.isNotNull())


def icontains(column: Column, text: str) -> Column:
    return F.lower(column).contains(text.lower())


def _named(made: Any) -> list[Column]:
    """A projection: one Column, a list of them, or a dict of names to Columns."""
    if isinstance(made, dict):
        return [(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in made.items()]
    return list(made) if isinstance(made, list | tuple) else [made]


def _keys(made: Any) -> list[Column]:
    return list(made.values()) if isinstance(made, dict) else list(made) if isinstance(made, list | tuple) else [made]


class Group:
    """What a group's result selector gets: aggregates over the group, traced to Columns."""

    def __init__(self, df: DataFrame) -> None:
        self._row, self._order = RowProxy(df), ROW_ID in df.columns

    def _value(self, fn: Callable[[RowProxy], Column] | str) -> Column:
        return self._row[fn] if isinstance(fn, str) else fn(self._row)

    def count(self, fn: Callable[[RowProxy], Column] | None = None) -> Column:
        return F.count(F.lit(1)) if fn is None else F.count(F.when(fn(self._row), 1))

    def sum(self, fn: Callable[[RowProxy], Column] | str) -> Column:
        return F.coalesce(F.sum(self._value(fn).cast("double")), F.lit(0.0))

    def min(self, fn: Callable[[RowProxy], Column] | str) -> Column:
        return F.min(self._value(fn))

    def max(self, fn: Callable[[RowProxy], Column] | str) -> Column:
        return F.max(self._value(fn))

    def average(self, fn: Callable[[RowProxy], Column] | str) -> Column:
        return F.avg(self._value(fn))

    def first(self, fn: Callable[[RowProxy], Column] | str) -> Column:
        if not self._order:
            raise ValidationError("first needs a frame with row ids")
        return F.min_by(self._value(fn), self._row[ROW_ID])


class Query:
    def __init__(self, df: DataFrame, order: tuple[tuple[Column, bool], ...] = (), notes: tuple[str, ...] = (), cut_: tuple[int, int | None] | None = None) -> None:
        self._whole, self._order, self._notes, self._cut = df, order, notes, cut_

    @cached_property
    def _df(self) -> DataFrame:
        """The frame with its skips and takes, which are planned as one when something else follows."""
        return self._whole if self._cut is None else cut(self._whole, self._sorted(), *self._cut)

    @property
    def row(self) -> RowProxy:
        return RowProxy(self._df)

    def _with(self, df: DataFrame, *, order: Any = None, note: str = "") -> Query:
        return Query(df, self._order if order is None else order, (*self._notes, note) if note else self._notes)

    # -- restriction, projection, order
    def where(self, fn: Callable[[RowProxy], Column], *values: Any) -> Query:
        return self._with(self._df.filter(fn(self.row, *values)), note="where")

    def filter(self, filter_: Any) -> Query:
        return self._with(where(self._df, filter_), note="filter")

    def where_udf(self, fn: Callable[[Any], bool], *columns: str) -> Query:
        """Any Python predicate, row by row over Arrow batches; opt in, as it can't be pushed down."""
        @F.pandas_udf(T.BooleanType())
        def test(*parts: pd.Series) -> pd.Series:
            return pd.Series([bool(fn(*x)) for x in zip(*parts, strict=True)], dtype=bool)

        return self._with(self._df.filter(test(*columns)), note="where in Python")

    def select(self, fn: Callable[..., Any], index: str | None = None) -> Query:
        """``fn(row)``; with ``index`` the name of a column that holds the row's place in the current order."""
        if index:
            order, df = self._sorted(), self._df
            if not self._order and ROW_ID not in df.columns:
                df, order = persist(df.withColumn("_place", F.monotonically_increasing_id()), "placed"), [F.col("_place")]
            numbered = with_row_ids(df, *order, into=index)
            return Query(numbered.select(*_named(fn(RowProxy(numbered)))), (), (*self._notes, "select with index"))
        keep = [F.col(ROW_ID)] if ROW_ID in self._df.columns else []
        made = _named(fn(self.row))
        names = self._df.select(*made).columns
        return Query(self._df.select(*made, *([] if ROW_ID in names else keep)), () if self._order else self._order, (*self._notes, "select"))

    def _key(self, fn: Any) -> Column:
        return self.row[fn] if isinstance(fn, str) else fn(self.row)

    def order_by(self, fn: Any) -> Query:
        return self._with(self._df, order=((self._key(fn), False),), note="order")

    def order_by_descending(self, fn: Any) -> Query:
        return self._with(self._df, order=((self._key(fn), True),), note="order")

    def then_by(self, fn: Any, descending: bool = False) -> Query:
        if not self._order:
            raise ValidationError("then_by must follow order_by")
        return self._with(self._df, order=(*self._order, (self._key(fn), descending)))

    def then_by_descending(self, fn: Any) -> Query:
        return self.then_by(fn, True)

    def reverse(self) -> Query:
        order = tuple((c, not down) for c, down in self._order)
        tie = (F.col(ROW_ID), True)
        had = order and str(order[-1][0]) == str(tie[0])
        return self._with(self._df, order=order if had else (*order, tie), note="reverse")

    def _sorted(self) -> list[Column]:
        out = [c.desc_nulls_last() if down else c.asc_nulls_first() for c, down in self._order]
        return [*out, F.col(ROW_ID).asc()] if ROW_ID in self._whole.columns else out or [F.lit(0)]

    def frame(self) -> DataFrame:
        """The DataFrame in its current order."""
        return self._df.orderBy(*self._sorted()) if self._order else self._df

    def skip(self, n: int) -> Query:
        offset, limit = self._cut or (0, None)
        return Query(self._whole, self._order, (*self._notes, f"skip {n}"), (offset + n, None if limit is None else max(limit - n, 0)))

    def take(self, n: int) -> Query:
        offset, limit = self._cut or (0, None)
        return Query(self._whole, self._order, (*self._notes, f"take {n}"), (offset, n if limit is None else min(limit, n)))

    # -- joins; null keys match null keys
    def _joined(self, inner: Any, outer_key: Callable, inner_key: Callable, how: str) -> DataFrame:
        other = inner._df if isinstance(inner, Query) else inner
        left, right = self._df.alias("o"), other.alias("i")
        mine, theirs = _keys(outer_key(RowProxy(self._df, "o"))), _keys(inner_key(RowProxy(other, "i")))
        on = reduce(lambda a, b: a & b, [a.eqNullSafe(b) for a, b in zip(mine, theirs, strict=True)])
        return left.join(right, on, how)

    def join(self, inner: Any, outer_key: Callable, inner_key: Callable, result: Callable[[RowProxy, RowProxy], Any]) -> Query:
        other = inner._df if isinstance(inner, Query) else inner
        both = self._joined(inner, outer_key, inner_key, "inner")
        return Query(both.select(*_named(result(RowProxy(self._df, "o"), RowProxy(other, "i")))), (), (*self._notes, "join"))

    def left_join(self, inner: Any, outer_key: Callable, inner_key: Callable, result: Callable[[RowProxy, RowProxy], Any]) -> Query:
        other = inner._df if isinstance(inner, Query) else inner
        both = self._joined(inner, outer_key, inner_key, "left")
        return Query(both.select(*_named(result(RowProxy(self._df, "o"), RowProxy(other, "i")))), (), (*self._notes, "left join"))

    def group_join(self, inner: Any, outer_key: Callable, inner_key: Callable, name: str = "rows") -> Query:
        """Each row with the list of its matches, empty if none; matches keep their file order."""
        other = inner._df if isinstance(inner, Query) else inner
        keys = _keys(inner_key(RowProxy(other)))
        order = [F.col(ROW_ID)] if ROW_ID in other.columns else []
        items = F.collect_list(F.struct(*order, *(F.col(f"`{c}`") for c in other.columns if c != ROW_ID)))
        packed = other.groupBy(*(k.alias(f"_k{i}") for i, k in enumerate(keys))).agg((F.array_sort(items) if order else items).alias(name))
        mine = _keys(outer_key(self.row))
        on = reduce(lambda a, b: a & b, [k.eqNullSafe(packed[f"_k{i}"]) for i, k in enumerate(mine)])
        out = self._df.join(packed, on, "left").drop(*(f"_k{i}" for i in range(len(keys))))
        empty = F.array().cast(packed.schema[name].dataType)
        return self._with(out.withColumn(name, F.coalesce(name, empty)), note="group join")

    # -- correlated sub-queries
    def where_exists(self, inner: Any, outer_key: Callable, inner_key: Callable, negate: bool = False) -> Query:
        """Rows that a row of ``inner`` has the keys of, or with ``negate`` none; null keys match null keys."""
        return self._with(self._joined(inner, outer_key, inner_key, "left_anti" if negate else "left_semi"), note="exists")

    def with_related(self, inner: Any, outer_key: Callable, inner_key: Callable, result: Callable[[Group], dict[str, Column]]) -> Query:
        """Each row with aggregates over the rows of ``inner`` that have its keys; null where there are none."""
        other = inner._df if isinstance(inner, Query) else inner
        keys = [k.alias(f"_k{i}") for i, k in enumerate(_keys(inner_key(RowProxy(other))))]
        grouped = other.groupBy(*keys).agg(*_named(result(Group(other))))
        on = reduce(lambda a, b: a & b, [k.eqNullSafe(grouped[f"_k{i}"]) for i, k in enumerate(_keys(outer_key(self.row)))])
        return self._with(self._df.join(grouped, on, "left").drop(*(f"_k{i}" for i in range(len(keys)))), note="related")

    # -- grouping and sets
    def group_by(self, key: Callable[[RowProxy], Any], result: Callable[[Group], dict[str, Column]]) -> Query:
        """One row a group: the keys and the result's aggregates, in order of first appearance where rows have ids."""
        made = key(self.row)
        keys = _named(made if isinstance(made, dict | list | tuple) else {"key": made})
        extra = [F.min(ROW_ID).alias(ROW_ID)] if ROW_ID in self._df.columns else []
        return Query(self._df.groupBy(*keys).agg(*_named(result(Group(self._df))), *extra), (), (*self._notes, "group"))

    def group_rows(self, *keys: str, function: Callable, schema: str) -> Query:
        """Any Python function over a group's rows as a pandas frame; a group must fit a task's memory."""
        return Query(self._df.groupBy(*keys).applyInPandas(function, schema), (), (*self._notes, "group in Python"))

    def distinct(self) -> Query:
        return Query(self._df.drop(ROW_ID).distinct(), (), (*self._notes, "distinct"))

    def select_many(self, fn: Callable[[RowProxy], Column], name: str = "item") -> Query:
        return self._with(self._df.withColumn(name, F.explode(fn(self.row))), note="flatten")

    def _set(self, op: str, other: Any) -> Query:
        theirs = (other._df if isinstance(other, Query) else other).drop(ROW_ID)
        return Query(getattr(self._df.drop(ROW_ID), op)(theirs), (), (*self._notes, op))

    def union(self, other: Any) -> Query:
        return self._set("unionByName", other).distinct()

    def concat(self, other: Any) -> Query:
        return self._set("unionByName", other)

    def intersect(self, other: Any) -> Query:
        return self._set("intersect", other)

    def except_(self, other: Any) -> Query:
        return self._set("subtract", other)

    def zip(self, other: Any, result: Callable[[RowProxy, RowProxy], Any]) -> Query:
        """Rows side by side by place; both need row ids without gaps."""
        return self.join(other, lambda r: r[ROW_ID], lambda r: r[ROW_ID], result)

    def cast(self, name: str, kind: str | T.DataType) -> Query:
        return self._with(self._df.withColumn(name, F.col(name).cast(kind)))

    def of_type(self, name: str, kind: str) -> Query:
        """Rows whose value can be read as the type."""
        return self._with(self._df.filter(F.col(name).try_cast(kind).isNotNull()))

    # -- terminals
    def count(self, fn: Callable[[RowProxy], Column] | None = None) -> int:
        return (self._df if fn is None else self._df.filter(fn(self.row))).count()

    def any(self, fn: Callable[[RowProxy], Column] | None = None) -> bool:
        return not (self._df if fn is None else self._df.filter(fn(self.row))).isEmpty()

    def all(self, fn: Callable[[RowProxy], Column]) -> bool:
        return self._df.filter(~F.coalesce(fn(self.row), F.lit(False))).isEmpty()

    def first(self, fn: Callable[[RowProxy], Column] | None = None) -> Any:
        found = self.first_or_default(None, fn)
        if found is None:
            raise LookupError("no row")
        return found

    def first_or_default(self, default: Any = None, fn: Callable[[RowProxy], Column] | None = None) -> Any:
        rows = (self if fn is None else self.where(fn)).take(1).to_list()
        return rows[0] if rows else default

    def last(self, fn: Callable[[RowProxy], Column] | None = None) -> Any:
        return (self if fn is None else self.where(fn)).reverse().first()

    def single(self, fn: Callable[[RowProxy], Column] | None = None) -> Any:
        rows = (self if fn is None else self.where(fn)).take(2).to_list()
        if len(rows) != 1:
            raise LookupError("not just one row")
        return rows[0]

    def element_at(self, n: int) -> Any:
        rows = self.skip(n).take(1).to_list()
        if not rows:
            raise LookupError(f"no row {n}")
        return rows[0]

    def default_if_empty(self, row: dict) -> Query:
        spare = self._df.sparkSession.createDataFrame([row], self._df.drop(ROW_ID).schema)
        return self if self.any() else Query(spare)

    def contains(self, row: dict) -> bool:
        return self.any(lambda r: reduce(lambda a, b: a & b, [r[k].eqNullSafe(v) for k, v in row.items()]))

    def sequence_equal(self, other: Query) -> bool:
        return self.to_list() == other.to_list()

    def to_set(self, name: str) -> set:
        return {r[0] for r in self._df.select(name).distinct().collect()}

    def fold(self, seed: Any, fn: Callable[[Any, Any], Any]) -> Any:
        """A fold in order, streamed to the driver partition by partition."""
        return reduce(fn, self, seed)

    def _one(self, agg: Column) -> Any:
        return self._df.agg(agg).first()[0]

    def sum(self, fn: Any) -> float:
        return self._one(Group(self._df).sum(fn))

    def min(self, fn: Any) -> Any:
        return self._one(Group(self._df).min(fn))

    def max(self, fn: Any) -> Any:
        return self._one(Group(self._df).max(fn))

    def average(self, fn: Any) -> Any:
        return self._one(Group(self._df).average(fn))

    def __iter__(self):
        """Rows in order; the driver holds those of a partition or two at a time."""
        names = [c for c in self._df.columns if c != ROW_ID]
        return (r.asDict(recursive=True) for r in self.frame().select(*(f"`{n}`" for n in names)).toLocalIterator(prefetchPartitions=True))

    def to_list(self) -> list[dict]:
        df = self._df.orderBy(*self._sorted())
        return [{k: v for k, v in r.asDict(recursive=True).items() if k != ROW_ID} for r in df.collect()]

    def batches(self):
        """Arrow batches of the rows in order, streamed."""
        return batches(self.frame())

    def explain(self) -> dict:
        from tabulon.plans.introspect import explain

        return explain(self.frame()) | {"steps": list(self._notes)}


def from_(source: Any, spark: Any = None) -> Query:
    """A query over a DataFrame, or over an iterable of dicts or dataclasses."""
    if isinstance(source, Query):
        return source
    if isinstance(source, DataFrame):
        return Query(source)
    from dataclasses import asdict, is_dataclass

    rows = [asdict(r) if is_dataclass(r) else dict(r) for r in source]
    return Query(spark.createDataFrame([{**r, ROW_ID: i} for i, r in enumerate(rows)]))
