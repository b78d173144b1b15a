"""Schema inference: one pass of type flags over all rows, for text columns and for JSON objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INT, FLOAT, BOOL = r"^[+-]?[0-9]{1,18}$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$", r"^(true|false)$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"


def text_types(df: DataFrame, dates: bool = False) -> dict[str, str]:
    """For columns of text: int, float or bool if every present value is, else string; without values, string."""
    def all_match(c: str, pattern: str) -> Column:
        return F.min(F.when(F.col(f"`{c}`").isNotNull(), F.col(f"`{c}`").rlike(pattern)))

    tests = {"int": INT, "float": FLOAT, "bool": BOOL} | ({"datetime": DATE} if dates else {})
    aggs = [all_match(c, p).alias(f"{i}_{k}") for i, c in enumerate(df.columns) for k, p in tests.items()]
    row = df.agg(*aggs).first() if aggs else {}
    return {c: next((k for k in tests if row[f"{i}_{k}"]), "string") for i, c in enumerate(df.columns)}


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns to their types; what can't be read is an error under ANSI rules."""
    spark = {"int": "bigint", "float": "double", "bool": "boolean", "datetime": "timestamp", "binary": "binary"}

    def one(c: str) -> Column:
        kind = types.get(c, "string")
        if kind == "binary":
            return F.unbase64(F.col(f"`{c}`")).alias(c)
        if kind.startswith("decimal"):
            return F.col(f"`{c}`").cast(kind).alias(c)
        return F.col(f"`{c}`").cast(spark[kind]).alias(c) if kind in spark else F.col(f"`{c}`").alias(c)

    return df.select(*map(one, df.columns))


def merge(a: str | None, b: str | None) -> str:
    """The type of a column that holds both: int and float are float, datetime and string are string, else json."""
    kinds = {a, b} - {None}
    if len(kinds) < 2:
        return next(iter(kinds), "string")
    return "float" if kinds == {"int", "float"} else "string" if kinds == {"datetime", "string"} else "json"


def object_types(values: DataFrame, dates: bool = False) -> dict[str, tuple[str, bool]]:
    """``values(at long, value variant)`` to the columns in first-seen order: (type, nullable).

    Every key of every object is a row of a partial aggregate, so the result has a row for each key and type.
    """
    pairs = values.select("at", F.explode(F.expr("cast(value as map<string, variant>)")).alias("key", "item"), F.expr("schema_of_variant(value)").alias("s"))
    kind = F.expr("schema_of_variant(item)")
    text = F.when(kind == "STRING", F.expr("cast(item as string)"))
    named = (
        F.when(F.expr("is_variant_null(item)"), None).when(kind == "BIGINT", "int").when(kind == "BOOLEAN", "bool")
        .when(kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), "float")
        .when(kind == "STRING", F.when(text.rlike(DATE), "datetime").otherwise("string") if dates else F.lit("string")).otherwise("json")
    )
    found = pairs.select("at", "key", named.alias("kind")).groupBy("key", "kind").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).collect()  # bounded by keys, not rows
    total, out = values.count(), {}
    for key in sorted({r.key for r in found}, key=lambda k: min((r.first, r.key) for r in found if r.key == k)):
        rows = [r for r in found if r.key == key]
        what = None
        for r in rows:
            what = r.kind if what is None else merge(what, r.kind) if r.kind else what
        out[key] = (what or "string", sum(r.n for r in rows if r.kind) < total)
    return out
