"""Sorting, paging and top-k; the file order is an explicit ``_row_id``."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.text import sort_key
from tabulon.functions.values import ValidationError
from tabulon.sources.scratch import persist

ROW_ID = "_row_id"


def with_row_ids(df: DataFrame, *order: str | Column, into: str = ROW_ID) -> DataFrame:
    """Row ids from 0, gapless, in the given total order, as the column ``into``.

    Rows are ranged by the order and written once with their range and place in it; both the counts and the ids are
    made from what was written, so they speak of the same ranges however the plan is cut. No task sees all rows.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    written = persist(ranged.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))), "ranged")
    counts = written.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = F.broadcast(counts.select("_part", before.alias("_before")))  # broadcast: a row for each partition
    return written.join(begins, "_part").withColumn(into, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def sort_columns(df: DataFrame, keys: list[Any]) -> list[Column]:
    """``"a"``, ``"-b"`` or ``{column, nocase?, natural?, descending?, utf16?}`` to sort columns, nulls first ascending."""
    out = []
    for key in keys:
        spec = dict(key) if isinstance(key, dict) else {"column": key.removeprefix("-"), "descending": key.startswith("-")}
        name = spec.pop("column")
        if name not in df.columns:
            raise ValidationError(f"unknown or hidden column {name!r}")
        down = spec.pop("descending", False)
        for c in sort_key(df[name], **spec) if spec else [df[name]]:
            out.append(c.desc_nulls_last() if down else c.asc_nulls_first())
    return out


def ordered(df: DataFrame, keys: list[Any], reverse: bool = False) -> DataFrame:
    """Stable: ties in file order where the frame has row ids. ``reverse`` turns ties round too."""
    columns = _stable(df, keys, reverse)
    return df.orderBy(*columns) if columns else df


def _stable(df: DataFrame, keys: list[Any], reverse: bool) -> list[Column]:
    if reverse:
        return [_turned(df, k) for k in [*keys, *([ROW_ID] if ROW_ID in df.columns else [])]]
    return sort_columns(df, keys) + ([F.col(ROW_ID).asc()] if ROW_ID in df.columns else [])


def _turned(df: DataFrame, key: Any) -> Column:
    name, down = (key["column"], key.get("descending", False)) if isinstance(key, dict) else (key.removeprefix("-"), key.startswith("-"))
    return df[name].asc_nulls_first() if down else df[name].desc_nulls_last()


#: Rows that a sorted template query reads at most, which is what a task holds for a page, and those that it gives by default.
KEPT, PAGE = 100_000, 100


def cut(df: DataFrame, order: list[Column], offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in order.

    Spark plans a bounded top-k for a limit with or without an offset, but takes all rows into one task for an offset
    alone. So the rows before are then counted for each row id, and those rows left out, as many of an id as were counted,
    for ids may repeat; beyond ``KEPT`` rows they are told by places from ranges that are written once. Rows without ids
    can't be told apart, and do go through one task.
    """
    if not offset or (limit is not None and offset + limit <= KEPT) or ROW_ID not in df.columns:
        out = df.orderBy(*order) if order else df
        out = out.offset(offset) if offset else out
        return out if limit is None else out.limit(limit)
    if limit is None and offset <= KEPT:
        first = df.orderBy(*order).limit(offset).withColumn("_place", F.lit(0))
    else:
        first = with_row_ids(df, *order, into="_place").where(F.col("_place") < offset + (limit or 0))
    told = first.groupBy(F.col(ROW_ID).alias("_told")).agg(F.count_if(F.col("_place") < offset).alias("_from"), F.count(F.lit(1)).alias("_to"))
    rows = df.join(told, F.col(ROW_ID).eqNullSafe(F.col("_told")), "left" if limit is None else "inner")
    nth = F.row_number().over(Window.partitionBy(ROW_ID).orderBy(*order))
    keep = (F.col("_nth") > F.coalesce("_from", F.lit(0))) & (F.lit(limit is None) | (F.col("_nth") <= F.col("_to")))
    return rows.withColumn("_nth", nth).where(keep).drop("_nth", "_told", "_from", "_to").orderBy(*order)


def page(df: DataFrame, keys: list[Any], offset: int = 0, limit: int | None = None, reverse: bool = False) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in order."""
    return cut(df, _stable(df, keys, reverse), offset, limit)


def template_query(df: DataFrame, filter_: Any = None, select: list[str] | None = None, order_by: str | None = None, reverse: bool = False, offset: int = 0, limit: int = PAGE) -> DataFrame:
    """A page of the rows that a filter keeps, by one column (``"a"`` or ``"-a"``) or in file order, perhaps the last first."""
    from tabulon.operators.filters import where
    from tabulon.operators.rows import select as pick

    if order_by and reverse:
        raise ValidationError("order_by and reverse go separately: reverse reads the file last first")
    if order_by and offset + limit > KEPT:
        raise ValidationError(f"a sorted query reads the first {KEPT} rows; narrow it with a filter")
    rows = df if filter_ is None else where(df, filter_)
    return pick(page(rows, [order_by] if order_by else [], offset, limit, reverse), select)


def after(df: DataFrame, key: str, last: Any, limit: int) -> DataFrame:
    """Keyset paging: the page after a known key."""
    from tabulon.operators.filters import where

    return where(df, {key: {"gt": last}}).orderBy(key).limit(limit)


def top_per_group(df: DataFrame, groups: list[str], keys: list[Any], k: int) -> DataFrame:
    """The first k rows of each group; Spark keeps k rows a group before the shuffle."""
    columns = sort_columns(df, keys) + ([F.col(ROW_ID)] if ROW_ID in df.columns else [])
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*columns))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def out_of_order(df: DataFrame, keys: list[Any]) -> DataFrame:
    """Rows that sort before the row ahead of them in file order, by keys of any kind; a join by place, so partition edges count too."""
    spec = [dict(k) if isinstance(k, dict) else {"column": k.removeprefix("-"), "descending": k.startswith("-")} for k in keys]
    down = [s.get("descending", False) for s in spec]
    parts: list[tuple[str, Column, bool]] = []
    for i, s in enumerate(spec):
        if s["column"] not in df.columns:
            raise ValidationError(f"unknown or hidden column {s['column']!r}")
        more = {k: v for k, v in s.items() if k not in ("column", "descending")}
        for j, c in enumerate(sort_key(df[s["column"]], **more) if more else [df[s["column"]]]):
            parts.append((f"_k{i}_{j}", c, down[i]))
    rows = df.select("*", *(c.alias(n) for n, c, _ in parts))
    before = df.select((F.col(ROW_ID) + 1).alias(ROW_ID), *(c.alias(f"{n}_before") for n, c, _ in parts))
    joined, bad = rows.join(before, ROW_ID), F.lit(False)
    for n, _, falls in reversed(parts):
        now, then = F.col(n), F.col(f"{n}_before")
        less = F.coalesce(now > then, now.isNotNull() & then.isNull()) if falls else F.coalesce(now < then, now.isNull() & then.isNotNull())
        bad = less | (now.eqNullSafe(then) & bad)
    return joined.where(bad).select(*df.columns)
