"""JSON, JSON Lines, CSV and XML in and out, with the rules of the data model."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from typing import Any
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.values import ValidationError, spark_type
from tabulon.operators.orders import ROW_ID
from tabulon.operators.shapes import exportable, to_xml
from tabulon.sources.inference import object_types, text_types, typed

#: Stands for an unquoted empty field while Spark parses, so that a quoted one stays an empty text.
_NOTHING = "\x00nothing\x00"


# -- JSON
def _json_rows(df: DataFrame, columns: list[dict] | None, dates: bool) -> DataFrame:
    """``df(at, value variant)``, one object a row, to typed columns and a row id."""
    if columns is None:
        types = object_types(df, dates)
        columns = [{"name": k, "type": t, "nullable": n} for k, (t, n) in types.items()]
    out = [F.col("at").alias(ROW_ID)]
    for c in columns:
        item = F.variant_get("value", "$[" + json.dumps(c["name"]).replace("'", "\\'") + "]", "variant") if not re.fullmatch(r"\w+", c["name"]) else F.variant_get("value", f"$.{c['name']}", "variant")
        kind = c["type"]
        if kind == "json":
            made = F.when(~F.is_variant_null(item), F.to_json(item))
        elif kind == "datetime":
            made = F.try_variant_get(item, "$", "string").cast("timestamp")
        elif kind == "binary":
            made = F.unbase64(F.try_variant_get(item, "$", "string"))
        else:
            made = F.variant_get(item, "$", spark_type(c).simpleString())
        out.append(made.alias(c["name"]))
    return df.select(*out)


def read_json(spark: SparkSession, path: str, columns: list[dict] | None = None, lines: bool = True, dates: bool = False) -> DataFrame:
    """JSON Lines (split among tasks), or files that each hold one array of objects."""
    text = spark.read.text(path, wholetext=not lines)
    if lines:
        rows = text.where(F.trim("value") != "").select(F.parse_json("value").alias("value"))
    else:
        rows = text.select(F.explode(F.expr("cast(parse_json(value) as array<variant>)")).alias("value"))
    return _json_rows(rows.withColumn("at", F.monotonically_increasing_id()), columns, dates)


def from_json(spark: SparkSession, source: str | Iterable[dict], columns: list[dict] | None = None, dates: bool = False) -> DataFrame:
    items = json.loads(source) if isinstance(source, str) else list(source)
    rows = spark.createDataFrame([(i, json.dumps(x, default=str)) for i, x in enumerate(items)], "at long, text string")
    return _json_rows(rows.select("at", F.parse_json("text").alias("value")), columns, dates)


def export_columns(df: DataFrame) -> DataFrame:
    return df.select(*(exportable(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields if f.name != ROW_ID))


def write_json(df: DataFrame, path: str, omit_nulls: bool = False) -> None:
    """JSON Lines, a file for each task."""
    export_columns(df).write.mode("overwrite").json(path, ignoreNullFields=omit_nulls)


def json_string(df: DataFrame, pretty: bool = False, omit_nulls: bool = False) -> str:
    """One JSON array in file order, streamed to the driver."""
    ordered = df.orderBy(ROW_ID) if ROW_ID in df.columns else df
    rows = export_columns(ordered).select(F.to_json(F.struct("*"), {"ignoreNullFields": str(omit_nulls).lower()}).alias("j"))
    parts = [r.j for r in rows.toLocalIterator()]
    return json.dumps([json.loads(p) for p in parts], indent=2, ensure_ascii=False) if pretty else "[" + ",".join(parts) + "]"


# -- CSV
def csv_records(text: str, delimiter: str = ",") -> Iterator[list[str | None]]:
    """RFC 4180 records; an unquoted empty field is None, a quoted one is an empty text."""
    field, record, quoted, inside, i, seen = [], [], False, False, 0, False
    while i < len(text):
        c = text[i]
        if inside:
            if c == '"':
                if text[i + 1 : i + 2] == '"':
                    field.append('"')
                    i += 1
                else:
                    inside = False
            else:
                field.append(c)
        elif c == '"' and not field and not quoted:
            quoted = inside = seen = True
        elif c == delimiter:
            record.append("".join(field) if field or quoted else None)
            field, quoted, seen = [], False, True
        elif c in "\r\n":
            if c == "\r" and text[i + 1 : i + 2] == "\n":
                i += 1
            if seen or field:
                yield [*record, "".join(field) if field or quoted else None]
            field, record, quoted, seen = [], [], False, False
        else:
            field.append(c)
            seen = True
        i += 1
    if inside:
        raise ValidationError("a quoted field that doesn't end")
    if seen or field:
        yield [*record, "".join(field) if field or quoted else None]


def headers(names: list[str | None]) -> list[str]:
    """Blank headers become columnN; names that repeat are an error."""
    out = [n.strip() if n and n.strip() else f"column{i + 1}" for i, n in enumerate(names)]
    if len(set(out)) < len(out):
        raise ValidationError("two columns of one name")
    return out


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", infer: bool = True, columns: list[dict] | None = None, dates: bool = False) -> DataFrame:
    """Files with a header, parsed by tasks; with ``columns`` matched by header name. A row with too many fields is an error."""
    first = spark.read.text(path).where("value <> ''").first()
    names = headers(next(csv_records(first[0], delimiter), [])) if first else []
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    if columns is not None and (unknown := set(names) - {c["name"] for c in columns}):
        raise ValidationError(f"unknown columns {sorted(unknown)}")
    extra = "_too_many"
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))] + [T.StructField(extra, T.StringType())])
    raw = spark.read.schema(schema).csv(path, header=True, enforceSchema=True, sep=delimiter, quote='"', escape='"', multiLine=True, nullValue=_NOTHING, emptyValue="", mode="PERMISSIVE")
    check = F.when(F.col(extra).isNotNull() & (F.col(extra) != _NOTHING), F.raise_error(F.lit("a row with too many fields")).cast("string"))
    df = raw.select(*(F.coalesce(check, F.col(f"c{i}")).alias(n) if i == 0 else F.col(f"c{i}").alias(n) for i, n in enumerate(names)))
    types = {c["name"]: c["type"] for c in columns} if columns is not None else text_types(df, dates) if infer else {}
    return typed(df, types)


def from_csv(spark: SparkSession, text: str, delimiter: str = ",", infer: bool = True, columns: list[dict] | None = None) -> DataFrame:
    """CSV text on the driver; tells unquoted empty fields, which are null, from quoted ones."""
    records = csv_records(text, delimiter)
    names = headers(next(records, []))
    rows = []
    for n, r in enumerate(records, 2):
        if len(r) > len(names):
            raise ValidationError(f"row {n} has too many fields")
        rows.append((*r, *[None] * (len(names) - len(r)), n - 2))
    df = spark.createDataFrame(rows, ", ".join([f"`{n}` string" for n in names] + [f"{ROW_ID} long"]))
    if columns is not None and (unknown := set(names) - {c["name"] for c in columns}):
        raise ValidationError(f"unknown columns {sorted(unknown)}")
    body = df.drop(ROW_ID)
    types = {c["name"]: c["type"] for c in columns} if columns is not None else text_types(body) if infer else {}
    return typed(df, types | {ROW_ID: "int"})


def csv_text(df: DataFrame, delimiter: str = ",") -> str:
    """RFC 4180 text in file order: null is an unquoted empty field, an empty text a quoted one."""
    ordered = df.orderBy(ROW_ID) if ROW_ID in df.columns else df
    rows = export_columns(ordered)
    text = rows.select(*((F.to_json(F.struct(F.col(f"`{f.name}`").alias("v"))) if isinstance(f.dataType, T.ArrayType | T.StructType) else F.col(f"`{f.name}`").cast("string")).alias(f.name) for f in rows.schema.fields))

    def cell(v: str | None) -> str:
        if v is None:
            return ""
        return '"' + v.replace('"', '""') + '"' if v == "" or any(c in v for c in (delimiter, '"', "\n", "\r")) else v

    lines = [delimiter.join(cell(n) for n in rows.columns)]
    lines += [delimiter.join(map(cell, r)) for r in text.toLocalIterator()]
    return "\r\n".join(lines) + "\r\n"


def write_csv(df: DataFrame, path: str, delimiter: str = ",") -> None:
    export_columns(df).write.mode("overwrite").csv(path, header=True, sep=delimiter, quote='"', escape='"', emptyValue='""', nullValue="")


# -- XML
def xml_rows(text: str) -> Iterator[dict[str, str | None]]:
    """Rows of ``<root><row><column>``; ``<field name=...>`` names a column that XML can't; no DTD."""
    if "<!DOCTYPE" in text:
        raise ValidationError("a document type is not read")
    for row in ElementTree.fromstring(text):
        out: dict[str, str | None] = {}
        for field in row:
            name = field.get("name") if field.tag == "field" and "name" in field.attrib else field.tag
            if name in out:
                raise ValidationError(f"column {name!r} occurs twice in a row")
            out[name] = ElementTree.tostring(field, encoding="unicode", method="text").rstrip("\n") if len(field) else field.text or ""
        yield out


def from_xml(spark: SparkSession, text: str, infer: bool = True) -> DataFrame:
    rows = list(xml_rows(text))
    names = list(dict.fromkeys(n for r in rows for n in r))
    df = spark.createDataFrame([(*(r.get(n) for n in names), i) for i, r in enumerate(rows)], ", ".join([f"`{n}` string" for n in names] + [f"{ROW_ID} long"]))
    return typed(df, (text_types(df.drop(ROW_ID)) if infer else {}) | {ROW_ID: "int"})


def read_xml(spark: SparkSession, path: str, row_tag: str = "row", columns: list[str] | None = None, infer: bool = True) -> DataFrame:
    """Files split by row tag and parsed by tasks; ``<field name=...>`` columns are matched by name."""
    body = spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", False).option("nullValue", _NOTHING)
    df = body.load(path)
    if "field" in df.columns:
        kind = df.schema["field"].dataType
        fields = F.col("field") if isinstance(kind, T.ArrayType) else F.array("field")
        pairs = F.map_from_entries(F.transform(fields, lambda x: F.struct(x["_name"], x["_VALUE"])))
        names = columns or [r[0] for r in df.select(F.explode(fields).alias("f")).select("f._name").distinct().orderBy("_name").collect()]
        df = df.withColumns({n: pairs[n] for n in names if n not in df.columns}).drop("field")
    return typed(df, text_types(df)) if infer else df


def xml_string(df: DataFrame, root: str = "rows", item: str = "row") -> str:
    ordered = df.orderBy(ROW_ID) if ROW_ID in df.columns else df
    rows: list[Any] = [json.loads(r.j) for r in export_columns(ordered).select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()]
    return to_xml(rows, root, item)
