"""Change files and submissions: edits made elsewhere, merged with conflict detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.values import ValidationError
from tabulon.operators.access import Grant, may_edit
from tabulon.operators.orders import ROW_ID


def _on(keys: list[str], a: str, b: str):
    return reduce(lambda x, y: x & y, [F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`")) for k in keys])


def diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """A change row for each key that differs: op, keys, ``set`` and ``before`` structs of the other columns."""
    values = [c for c in before.columns if c not in (*keys, ROW_ID)]
    pack = lambda df, name: df.select(*(f"`{k}`" for k in keys), F.struct(*(F.col(f"`{c}`") for c in values)).alias(name))
    both = pack(before, "before").alias("b").join(pack(after, "set").alias("a"), _on(keys, "b", "a"), "full")
    op = F.when(F.col("before").isNull(), "insert").when(F.col("set").isNull(), "delete").when(~F.col("before").eqNullSafe(F.col("set")), "update")
    named = [F.when(F.col("set").isNull(), F.col(f"b.`{k}`")).otherwise(F.col(f"a.`{k}`")).alias(k) for k in keys]
    return both.select(op.alias("op"), *named, "set", "before").where("op is not null")


def classify(current: DataFrame, changes: DataFrame, keys: list[str], grant: Grant | None = None) -> DataFrame:
    """Changes with ``conflict``: changed, exists, missing, refused, or null."""
    values = [c for c in current.columns if c not in (*keys, ROW_ID)]
    now = current.select(*(F.col(f"`{k}`") for k in keys), F.struct(*(F.col(f"`{c}`") for c in values)).alias("now"))
    both = changes.alias("c").join(now.alias("n"), _on(keys, "c", "n"), "left")
    conflict = (
        F.when((F.col("op") == "insert") & F.col("now").isNotNull(), "exists")
        .when((F.col("op") != "insert") & F.col("now").isNull(), "missing")
        .when((F.col("op") != "insert") & ~F.col("now").eqNullSafe(F.col("c.before")), "changed")
    )
    if grant is not None:
        touched = [F.col("c.set").getField(v).eqNullSafe(F.col("c.before").getField(v)) for v in values if not may_edit(grant, v)]
        held = reduce(lambda a, b: a & b, touched, F.lit(True))
        conflict = F.when((F.col("op") == "update") & ~F.coalesce(held, F.lit(False)), "refused").otherwise(conflict)
    return both.select("c.*", conflict.alias("conflict"))


def apply_changes(current: DataFrame, changes: DataFrame, keys: list[str], overwrite: bool = False, grant: Grant | None = None) -> tuple[DataFrame, DataFrame]:
    """The table after the changes, and the changes with their conflicts; with ``overwrite`` only refusals hold back."""
    judged = classify(current, changes, keys, grant)
    good = judged.where("conflict is null or conflict not in ('refused')" if overwrite else "conflict is null")
    values = [c for c in current.columns if c not in (*keys, ROW_ID)]
    both = current.drop(ROW_ID).alias("o").join(good.alias("g"), _on(keys, "o", "g"), "full")
    kept = both.where("g.op is null or g.op <> 'delete'")
    key = [F.when(F.col("g.op").isNull(), F.col(f"o.`{k}`")).otherwise(F.col(f"g.`{k}`")).alias(k) for k in keys]
    rest = [F.when(F.col("g.op").isNull(), F.col(f"o.`{v}`")).otherwise(F.col("g.set").getField(v)).alias(v) for v in values]
    made = {k: c for k, c in zip([*keys, *values], [*key, *rest], strict=True)}
    return kept.select(*(made[c] for c in current.columns if c != ROW_ID)), judged


def merge_submission(current: DataFrame, rows: DataFrame, keys: list[str], partition: str, own: str, existing: str = "merge") -> DataFrame:
    """Rows sent by a key holder into their own partition; ``existing`` keys are merged, replaced or skipped.

    Merging takes the fields that are not empty; rows of another partition are an error when they are read.
    """
    if existing not in ("merge", "replace", "skip"):
        raise ValidationError("existing is merge, replace or skip")
    sent = rows.withColumn(partition, F.when(F.coalesce(F.col(partition), F.lit(own)) == own, F.lit(own)).otherwise(F.raise_error(F.lit("a row of another partition"))))
    both = current.drop(ROW_ID).alias("o").join(sent.alias("n"), _on(keys, "o", "n") & (F.col(f"o.`{partition}`") == own), "full")
    old, new = F.col(f"o.`{partition}`").isNotNull() | F.col(f"o.`{keys[0]}`").isNotNull(), F.col(f"n.`{partition}`").isNotNull()

    def pick(c: str):
        a, b = F.col(f"o.`{c}`"), F.col(f"n.`{c}`") if c in rows.columns or c == partition else F.lit(None)
        filled = F.coalesce(F.nullif(b, F.lit("")) if current.schema[c].dataType.typeName() == "string" else b, a)
        return F.when(~new, a).when(~old, b).otherwise({"merge": filled, "replace": b, "skip": a}[existing]).alias(c)

    return both.select(*(pick(c) for c in current.columns if c != ROW_ID))
