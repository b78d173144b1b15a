"""Rows and columns handed to Python: Arrow batches, column arrays, dataclasses."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tabulon.functions.values import ValidationError
from tabulon.operators.filters import where
from tabulon.operators.orders import ROW_ID, page

#: The greatest whole number that a float holds exactly.
EXACT = 2**53


def select(df: DataFrame, names: list[str] | None) -> DataFrame:
    """The named columns; an unknown one is an error."""
    if names is None:
        return df
    if unknown := [n for n in names if n not in df.columns]:
        raise ValidationError(f"unknown or hidden column {unknown[0]!r}")
    return df.select(*(f"`{n}`" for n in names))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, batch.schema) as writer:
            writer.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["batch"])


def batches(df: DataFrame, filter_: Any = None, names: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    """Arrow batches of the rows in order; the driver holds those of a partition or two at a time."""
    rows = select(df if filter_ is None else where(df, filter_), names)
    for row in rows.mapInArrow(_packed, "batch binary").toLocalIterator(prefetchPartitions=True):
        yield from pa.ipc.open_stream(row.batch)


def column_arrays(df: DataFrame, filter_: Any = None, names: list[str] | None = None, offset: int = 0, limit: int | None = None) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each column its values and where they are null; whole numbers that a float can't hold are refused."""
    rows = df if filter_ is None else where(df, filter_)
    if offset or limit is not None or ROW_ID in rows.columns:
        rows = page(rows, [], offset, limit)
    table, out = select(rows, names).toArrow(), {}
    for name in table.column_names:
        column = table.column(name)
        values, nulls = column.to_pandas().to_numpy() if not pa.types.is_integer(column.type) else np.asarray(column.fill_null(0)), np.asarray(column.is_null())
        if pa.types.is_integer(column.type) and len(values) and max(abs(int(values.min())), abs(int(values.max()))) > EXACT:
            raise ValidationError(f"{name}: a whole number beyond 2^53")
        out[name] = (values, nulls)
    return out


def typed(df: DataFrame, kind: type, names: dict[str, str] | None = None) -> Iterator[Any]:
    """Rows as dataclasses; only the mapped columns are read. ``names``: field to column."""
    fields = {f.name: (names or {}).get(f.name, f.name) for f in dataclasses.fields(kind)}
    for row in select(df, list(fields.values())).toLocalIterator():
        yield kind(**{f: row[c] for f, c in fields.items()})


def from_objects(spark: SparkSession, objects: list[Any], names: dict[str, str] | None = None) -> DataFrame:
    """A frame with row ids from dataclasses or dicts. ``names``: field to column."""
    rows = [dataclasses.asdict(o) if dataclasses.is_dataclass(o) else dict(o) for o in objects]
    named = [{(names or {}).get(k, k): v for k, v in r.items()} for r in rows]
    return spark.createDataFrame([{**r, ROW_ID: i} for i, r in enumerate(named)])
