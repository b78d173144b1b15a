"""What a key may see: partitions of rows, groups of columns, masked values, until a grant expires."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.text import DOTS, mask
from tabulon.functions.values import ValidationError
from tabulon.operators.filters import as_value


@dataclass(frozen=True)
class Mask:
    """A column that is masked where ``rows`` says so; ``show`` is a rule, or ``column:name`` for another column."""

    column: str
    show: str = "none"
    n: int = 4
    rows: dict | None = None


@dataclass(frozen=True)
class Policy:
    partition_by: str | None = None
    groups: dict[str, tuple[str, ...]] = field(default_factory=dict)  # columns in no group are open to all
    masks: tuple[Mask, ...] = ()


@dataclass(frozen=True)
class Grant:
    rows: tuple | str = "*"
    columns: tuple[str, ...] | str = "*"
    expires: dt.datetime | None = None
    unmasked: tuple[str, ...] = ()
    edit: tuple[str, ...] | str = ()


def check_live(grant: Grant, now: dt.datetime | None = None) -> None:
    now = now or dt.datetime.now(dt.UTC).replace(tzinfo=None)
    if grant.expires is not None and now > grant.expires:
        raise PermissionError("the grant has expired")


def masked(df: DataFrame, m: Mask, unmasked: bool = False) -> Column:
    """The value, or what is shown of it in masked rows; null stays null."""
    c = F.col(f"`{m.column}`")
    if unmasked:
        return c
    text = c.cast("string")
    shown = F.coalesce(F.col(f"`{m.show[7:]}`").cast("string"), F.lit(DOTS)) if m.show.startswith("column:") else mask(text, m.show, m.n)
    hidden = F.when(c.isNotNull(), shown)
    return hidden if m.rows is None else F.when(as_value(m.rows, df), hidden).otherwise(text)


def view(df: DataFrame, policy: Policy, grant: Grant, now: dt.datetime | None = None) -> DataFrame:
    """The rows and columns of a grant; the partition filter prunes and hidden columns are never read."""
    check_live(grant, now)
    rows = df
    if grant.rows != "*":
        if policy.partition_by is None:
            raise ValidationError("rows are granted by partition")
        part = F.col(f"`{policy.partition_by}`")
        wanted = [r for r in grant.rows if r not in ("", None)]
        keep = part.isin(wanted) if wanted else F.lit(False)
        rows = rows.where(keep | part.isNull() if len(wanted) < len(grant.rows) else keep)
    hidden = set()
    if grant.columns != "*":
        hidden = {c for g, cols in policy.groups.items() if g not in grant.columns for c in cols}
    masks = {m.column: m for m in policy.masks}
    return rows.select(*(masked(rows, masks[c], c in grant.unmasked).alias(c) if c in masks else F.col(f"`{c}`") for c in df.columns if c not in hidden))


def views(tables: dict[str, DataFrame], policies: dict[str, Policy], grant: Grant, now: dt.datetime | None = None) -> dict[str, DataFrame]:
    """All tables under one grant, so links and templates see what the key may see."""
    return {n: view(t, policies[n], grant, now) if n in policies else t for n, t in tables.items()}


def may_edit(grant: Grant, column: str) -> bool:
    return grant.edit == "*" or column in grant.edit
