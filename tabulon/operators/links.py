"""Declared links between tables, and the check that every linked row exists once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.values import ValidationError, logical


@dataclass(frozen=True)
class Link:
    name: str
    table: str
    columns: tuple[str, ...]
    to_table: str
    to_columns: tuple[str, ...]

    @classmethod
    def of(cls, spec: dict) -> Link:
        return cls(spec["name"], spec["from"]["table"], tuple(spec["from"]["columns"]), spec["to"]["table"], tuple(spec["to"]["columns"]))

    def spec(self) -> dict:
        return {"name": self.name, "from": {"table": self.table, "columns": list(self.columns)}, "to": {"table": self.to_table, "columns": list(self.to_columns)}}

    def check(self, tables: dict[str, DataFrame]) -> None:
        for table in (self.table, self.to_table):
            if table not in tables:
                raise ValidationError(f"link {self.name}: unknown table {table!r}")
        if not self.columns or len(self.columns) != len(self.to_columns):
            raise ValidationError(f"link {self.name}: as many columns on either side")
        for a, b in zip(self.columns, self.to_columns, strict=True):
            kinds = [logical(tables[t].schema[c].dataType) if c in tables[t].columns else None for t, c in ((self.table, a), (self.to_table, b))]
            if None in kinds or kinds[0] != kinds[1]:
                raise ValidationError(f"link {self.name}: {a!r} and {b!r} must be columns of one type")


def _present(df: DataFrame, columns: tuple[str, ...]):
    """Rows that can be linked: no key is null or NaN."""
    bare = lambda c: df[c].isNotNull() & ~F.isnan(df[c]) if logical(df.schema[c].dataType) == "float" else df[c].isNotNull()
    return reduce(lambda a, b: a & b, [bare(c) for c in columns])


def missing(link: Link, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows whose link finds nothing."""
    rows, target = tables[link.table], tables[link.to_table]
    keys = target.select(*(target[c].alias(f"_to{i}") for i, c in enumerate(link.to_columns)))
    on = reduce(lambda a, b: a & b, [rows[c] == keys[f"_to{i}"] for i, c in enumerate(link.columns)])
    return rows.where(_present(rows, link.columns)).join(keys, on, "left_anti")


def duplicates(link: Link, tables: dict[str, DataFrame]) -> DataFrame:
    """Target keys that occur more than once, null keys among them, with their number."""
    return tables[link.to_table].groupBy(*link.to_columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_links(links: list[Link], tables: dict[str, DataFrame], limit: int = 10) -> list[dict]:
    """A report for each link; examples are a bounded sample of the rows found."""
    out = []
    for link in links:
        link.check(tables)
        rows, lost, twice = tables[link.table], missing(link, tables), duplicates(link, tables)
        empty = rows.where(~_present(rows, link.columns)).count()
        out.append({
            "name": link.name, "rows": rows.count(), "empty": empty, "missing": lost.count(),
            "examples": [r.asDict() for r in lost.select(*link.columns).limit(limit).collect()],
            "duplicateTargets": twice.count(), "duplicateExamples": [r.asDict() for r in twice.drop("n").limit(limit).collect()],
        })
    return out
