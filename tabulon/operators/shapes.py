"""Export templates: nested JSON or XML from one table and the tables linked to it.

A template is compiled bottom-up. Each list becomes an aggregate of its own table (``collect_list`` of structs, sorted
and cut), each link a left join of a child that was aggregated by its link columns, so a parent row never multiplies.
In a set context (the root, or an item of a group) names are first values and ``$count``, ``$sum``, ``$min``, ``$max``
aggregates; in a row context names are columns. Every mistake is named with its path before a job starts.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from typing import Any
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.text import iso_time
from tabulon.functions.values import ORDERED, ValidationError, logical
from tabulon.operators.filters import as_value, where
from tabulon.operators.orders import ROW_ID

AGGREGATES = ("$count", "$sum", "$min", "$max")
LIST_KEYS = {"$rows", "$filter", "$groupBy", "$sort", "$limit", "$from", "$on", "$one", "$xmlItem"}

#: Bytes of its files that a task of a link's join takes; the planner deals tables that have less than ``SMALL`` in all.
SHARE, SMALL = 8 << 20, 64 << 20


def _fail(path: str, text: str) -> None:
    raise ValidationError(f"{path or 'template'}: {text}")


def _ids(df: DataFrame) -> DataFrame:
    return df if ROW_ID in df.columns else df.withColumn(ROW_ID, F.monotonically_increasing_id())


def _dealt(df: DataFrame) -> int:
    """The number of tasks that a link deals a large table to, or 0.

    Spark joins partitions until their compressed shuffle has some size; keys compress so well that one task may then sort
    and hash millions of rows. A number that is asked for stays, and grows with the table.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size < SMALL or size >= 1 << 62:  # such a size stands for an unknown one
        return 0
    return max(_conf(df).numShufflePartitions(), -(-size // SHARE))


def _conf(df: DataFrame) -> Any:
    return df.sparkSession._jsparkSession.sessionState().conf()


def _broadcast(df: DataFrame) -> bool:
    """Whether the planner takes the frame for small enough to be sent to every task."""
    most = _conf(df).autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most


def _sum(c: Column, kind: T.DataType) -> Column:
    match logical(kind):
        case "int":
            return F.sum(c.cast("decimal(38,0)"))
        case "float":
            return F.sum(F.when(~F.isnan(c), c))
    return F.sum(c)


def _extreme(fn: Any, c: Column, kind: T.DataType) -> Column:
    return fn(F.when(~F.isnan(c), c)) if logical(kind) == "float" else fn(c)


class Compiler:
    def __init__(self, tables: dict[str, DataFrame], meta: dict | None = None) -> None:
        self.tables, self.meta, self._n = {n: _ids(t) for n, t in tables.items()}, meta or {}, 0

    def _name(self) -> str:
        self._n += 1
        return f"_x{self._n}"

    def _column(self, df: DataFrame, name: Any, path: str) -> Column:
        if not isinstance(name, str) or name not in df.columns or name.startswith("_x") or name == ROW_ID:
            _fail(path, f"unknown or hidden column {name!r}")
        return F.col(f"`{name}`")

    def _constant(self, node: Any) -> Column | None:
        if node is None or isinstance(node, bool | int | float):
            return F.lit(node)
        if isinstance(node, dict) and set(node) == {"$value"}:
            return F.lit(node["$value"]) if not isinstance(node["$value"], dict | list) else F.parse_json(F.lit(json.dumps(node["$value"])))
        if isinstance(node, dict) and set(node) == {"$meta"}:
            value = self.meta.get(node["$meta"])
            return F.lit(value) if not isinstance(value, dict | list) else F.parse_json(F.lit(json.dumps(value)))
        return None

    # -- row context: a Column over df, which may have gained joined columns
    def row(self, node: Any, df: DataFrame, path: str) -> tuple[Column, DataFrame]:
        constant = self._constant(node)
        if constant is not None:
            return constant, df
        if isinstance(node, str):
            return self._column(df, node, path), df
        if not isinstance(node, dict):
            _fail(path, "a name, a value or an object is expected")
        if "$from" in node:
            return self.link(node, df, path)
        if "$rows" in node:
            _fail(path, "$rows in a row needs $from or a $groupBy around it")
        for key in AGGREGATES:
            if key in node:
                _fail(path, f"{key} needs a set of rows")
        return self._object(node, df, path, self.row)

    def _object(self, node: dict, df: DataFrame, path: str, each: Any) -> tuple[Column, DataFrame]:
        parts = []
        for key, value in node.items():
            if key.startswith("$"):
                if key == "$xmlItem":
                    continue
                _fail(path, f"unknown key {key!r}")
            c, df = each(value, df, f"{path}.{key}".lstrip("."))
            parts.append(c.alias(key))
        if not parts:
            _fail(path, "an empty object")
        return F.struct(*parts), df

    # -- set context: (expression over the aggregated frame, {name: aggregate}, joins to run after it)
    def set_(self, node: Any, df: DataFrame, keys: list[str], path: str, plan: dict) -> Column:
        constant = self._constant(node)
        if constant is not None:
            return constant
        if isinstance(node, str):
            self._column(df, node, path)
            return self._aggregate(plan, F.min_by(F.col(f"`{node}`"), F.col(ROW_ID)))
        if not isinstance(node, dict):
            _fail(path, "a name, a value or an object is expected")
        used = [k for k in AGGREGATES if k in node]
        if used:
            return self._aggregate(plan, self._measure(node, used[0], df, path))
        if "$from" in node:
            plan["links"].append((node, path, name := self._name()))
            return F.col(name)
        if "$rows" in node:
            return self.list_(node, df, keys, path, plan)
        parts = []
        for key, value in node.items():
            if key == "$xmlItem":
                continue
            if key.startswith("$"):
                _fail(path, f"unknown key {key!r}")
            parts.append(self.set_(value, df, keys, f"{path}.{key}".lstrip("."), plan).alias(key))
        if not parts:
            _fail(path, "an empty object")
        return F.struct(*parts)

    def _aggregate(self, plan: dict, c: Column) -> Column:
        plan["aggs"].append(c.alias(name := self._name()))
        return F.col(name)

    def _measure(self, node: dict, key: str, df: DataFrame, path: str) -> Column:
        if set(node) - {key, "$filter"}:
            _fail(path, f"{key} stands alone")
        keep = as_value(node["$filter"], df) if "$filter" in node else None
        if key == "$count":
            return F.count(F.lit(1)) if keep is None else F.count(F.when(keep, 1))
        c, kind = self._column(df, node[key], path), df.schema[node[key]].dataType
        if logical(kind) not in ({"int", "float", "decimal"} if key == "$sum" else ORDERED):
            _fail(path, f"{key} can't read type {logical(kind)}")
        c = c if keep is None else F.when(keep, c)
        return _sum(c, kind) if key == "$sum" else _extreme(F.min if key == "$min" else F.max, c, kind)

    def _items(self, item: Column, node: dict, df: DataFrame, path: str, keep: Column | None, first: bool = False) -> Column:
        """Collected items, sorted by $sort and then in file order, cut by $limit."""
        keys = []
        for k in node.get("$sort", []):
            name = k.removeprefix("-")
            self._column(df, name, f"{path}.$sort")
            kind = df.schema[name].dataType
            if logical(kind) not in ORDERED:
                _fail(path, f"can't sort by type {logical(kind)}")
            keys.append((F.col(f"`{name}`"), k.startswith("-")))
        fields = [F.struct(c.isNotNull().alias("h"), c.alias("v")).alias(f"k{i}") for i, (c, _) in enumerate(keys)]
        packed = F.struct(*fields, F.col(ROW_ID).alias("o"), item.alias("item"))
        rows = F.collect_list(packed if keep is None else F.when(keep, packed))
        if any(down for _, down in keys):
            def compare(a: Column, b: Column) -> Column:
                out = F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)
                for i in range(len(keys) - 1, -1, -1):
                    x, y, turn = a[f"k{i}"], b[f"k{i}"], -1 if keys[i][1] else 1
                    less = F.coalesce(x["h"] < y["h"], F.lit(False)) | F.coalesce(x["h"] & y["h"] & (x["v"] < y["v"]), F.lit(False))
                    more = F.coalesce(x["h"] > y["h"], F.lit(False)) | F.coalesce(x["h"] & y["h"] & (x["v"] > y["v"]), F.lit(False))
                    out = F.when(less, -turn).when(more, turn).otherwise(out)
                return out

            rows = F.array_sort(rows, compare)
        else:
            # ascending keys and the file order are a plain sort of the structs, unless an item's field can't be compared
            rows = F.array_sort(rows, lambda a, b: _plain(a, b, len(keys)))
        rows = rows if "$limit" not in node else F.slice(rows, 1, node["$limit"])
        return F.transform(rows, lambda x: x["item"])

    def _first(self, node: dict, df: DataFrame, keys: list[str], path: str) -> DataFrame:
        """The rows of each set that $sort and $limit leave: a top-k, which Spark takes in part before it moves rows."""
        order = []
        for k in node.get("$sort", []):
            c = self._column(df, k.removeprefix("-"), f"{path}.$sort")
            if logical(df.schema[k.removeprefix("-")].dataType) not in ORDERED:
                _fail(path, f"can't sort by type {logical(df.schema[k.removeprefix('-')].dataType)}")
            order.append(c.desc_nulls_last() if k.startswith("-") else c.asc_nulls_first())
        order.append(F.col(ROW_ID).asc())
        if not keys:
            return df.orderBy(*order).limit(node["$limit"])
        place = F.row_number().over(Window.partitionBy(*(f"`{k}`" for k in keys)).orderBy(*order))
        return df.withColumn("_place", place).where(F.col("_place") <= node["$limit"]).drop("_place")

    def _check_list(self, node: dict, path: str) -> None:
        if unknown := set(node) - LIST_KEYS:
            _fail(path, f"unknown keys {sorted(unknown)}")
        if "$limit" in node and (not isinstance(node["$limit"], int) or node["$limit"] < 0):
            _fail(path, "$limit is a whole number")
        if not isinstance(node.get("$xmlItem", "item"), str) or not _XML_NAME.match(node.get("$xmlItem", "item")):
            _fail(path, "$xmlItem is a name that XML can have")
        if isinstance(node.get("$sort", []), str) or not isinstance(node.get("$groupBy", []), list | str):
            _fail(path, "$sort is a list")

    def list_(self, node: dict, df: DataFrame, keys: list[str], path: str, plan: dict) -> Column:
        self._check_list(node, path)
        keep = as_value(node["$filter"], df) if "$filter" in node else None
        if "$groupBy" not in node and "$limit" in node:  # cut before anything is collected
            item, joined = self.row(node["$rows"], self._first(node, df if keep is None else df.where(keep), keys, path), f"{path}.$rows")
            return self._separate(node, joined, keys, path, plan, item)
        if "$groupBy" not in node:
            item, joined = self.row(node["$rows"], df, f"{path}.$rows")
            if joined is not df:  # items with links of their own: a frame of its own, joined back by the keys
                return self._separate(node, joined if keep is None else joined.where(as_value(node["$filter"], df)), keys, path, plan, item)
            return self._aggregate(plan, self._items(item, node, df, path, keep))
        return self._separate(node, df if keep is None else df.where(keep), keys, path, plan, None)

    def _separate(self, node: dict, df: DataFrame, keys: list[str], path: str, plan: dict, item: Column | None) -> Column:
        child = self._grouped(node, df, keys, path) if item is None else df.groupBy(*keys).agg(self._items(item, node, df, path, None).alias("_list"))
        plan["frames"].append((child.withColumnRenamed("_list", name := self._name()), name))
        return F.coalesce(F.col(name), F.array().cast(child.schema["_list"].dataType))

    def _grouped(self, node: dict, df: DataFrame, keys: list[str], path: str) -> DataFrame:
        by = [node["$groupBy"]] if isinstance(node["$groupBy"], str) else node["$groupBy"]
        for c in by:
            self._column(df, c, f"{path}.$groupBy")
            if logical(df.schema[c].dataType) not in ORDERED:
                _fail(path, f"can't group by type {logical(df.schema[c].dataType)}")
        names = {k: f"_k{i}" for i, k in enumerate(keys)}
        rows = df.withColumns({v: F.col(f"`{k}`") for k, v in names.items()})
        inner = [*names.values(), *by]
        extra = {k.removeprefix("-") for k in node.get("$sort", [])} - set(by)
        firsts = [F.min_by(self._column(df, c, f"{path}.$sort"), F.col(ROW_ID)).alias(c) for c in sorted(extra)]
        groups, value = self.aggregate(node["$rows"], rows, inner, f"{path}.$rows", [F.min(ROW_ID).alias(ROW_ID), *firsts])
        outer = groups.groupBy(*names.values()) if names else groups.groupBy()
        return outer.agg(self._items(value, node, groups, path, None).alias("_list")).withColumnsRenamed({v: k for k, v in names.items()})

    def aggregate(self, node: Any, df: DataFrame, keys: list[str], path: str, extra: list[Column]) -> tuple[DataFrame, Column]:
        """One row for each value of ``keys`` (one in all without keys), and the node's value over it."""
        plan: dict = {"aggs": list(extra), "frames": [], "links": []}
        value = self.set_(node, df, keys, path, plan)
        need = {c for link, _, _ in plan["links"] for c in self._on(link, path)}
        plan["aggs"] += [F.min_by(self._column(df, c, path), F.col(ROW_ID)).alias(c) for c in need - set(keys)]
        out = df.groupBy(*(f"`{k}`" for k in keys)).agg(*(plan["aggs"] or [F.count(F.lit(1)).alias(self._name())]))
        for frame, name in plan["frames"]:
            out = _null_safe_join(out, frame, keys, name)
        for link, where_, name in plan["links"]:
            c, out = self.link(link, out, where_)
            out = out.withColumn(name, c)
        return out, value

    # -- links: a child aggregated by its link columns, joined to the parent's
    def _on(self, node: dict, path: str) -> dict[str, str]:
        on = node.get("$on")
        if not isinstance(on, dict) or not on:
            _fail(path, "$on maps this table's columns to the other's")
        return on

    def link(self, node: dict, df: DataFrame, path: str) -> tuple[Column, DataFrame]:
        self._check_list(node, path)
        if node["$from"] not in self.tables:
            _fail(path, f"unknown table {node['$from']!r}")
        if ("$rows" in node) == ("$one" in node):
            _fail(path, "a link has $rows or $one")
        child, on = self.tables[node["$from"]], self._on(node, path)
        for mine, theirs in on.items():
            self._column(df, mine, f"{path}.$on")
            self._column(child, theirs, f"{path}.$on")
            if logical(df.schema[mine].dataType) != logical(child.schema[theirs].dataType):
                _fail(path, f"{mine!r} and {theirs!r} are of different types")
        keys, name = list(on.values()), self._name()
        plain = all(df.schema[m].dataType == child.schema[t].dataType and logical(child.schema[t].dataType) != "float" for m, t in on.items())
        n = _dealt(df) if plain else 0  # keys that the join would cast or normalise are dealt by it alone
        own = child is df and all(m == t for m, t in on.items())
        if "$filter" in node:
            child = where(child, node["$filter"])
        if n and own:  # rows go by these keys on the other side too, so counts before that save nothing, and may be one a row
            child = child.repartition(n, *(f"`{k}`" for k in keys))
        for k in keys:  # null and NaN keys never match; dropping them first keeps them from one big group
            child = child.where(F.col(f"`{k}`").isNotNull() & ~F.isnan(F.col(f"`{k}`")) if logical(child.schema[k].dataType) == "float" else F.col(f"`{k}`").isNotNull())
        if "$one" in node:
            grouped, value = self.aggregate(node["$one"], child, keys, f"{path}.$one", [])
            packed = grouped.select(*(F.col(f"`{k}`").alias(f"{name}_{i}") for i, k in enumerate(keys)), value.alias(name))
        else:
            inner = {k: v for k, v in node.items() if k not in ("$from", "$on", "$filter")}
            if "$groupBy" in inner:
                made = self._grouped(inner, child, keys, path)
            else:
                if "$limit" in inner:
                    child = self._first(inner, child, keys, path)
                item, joined = self.row(node["$rows"], child, f"{path}.$rows")
                made = joined.groupBy(*(f"`{k}`" for k in keys)).agg(self._items(item, inner, joined, path, None).alias("_list"))
            packed = made.select(*(F.col(f"`{k}`").alias(f"{name}_{i}") for i, k in enumerate(keys)), F.col("_list").alias(name))
        cond = reduce(lambda a, b: a & b, [F.col(f"`{m}`") == F.col(f"{name}_{i}") for i, m in enumerate(on)])
        if n and (own or not _broadcast(packed)):
            df = df.repartition(n, *(f"`{m}`" for m in on))
            if not own and n > _conf(df).numShufflePartitions():  # else the join would take the fewer parts of the child's groups
                packed = packed.repartition(n, *(f"{name}_{i}" for i in range(len(keys))))
        out = df.join(packed, cond, "left").drop(*(f"{name}_{i}" for i in range(len(keys))))
        c = F.col(name)
        return (c if "$one" in node else F.coalesce(c, F.array().cast(packed.schema[name].dataType))), out


def _plain(a: Column, b: Column, n: int) -> Column:
    out = F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)
    for i in range(n - 1, -1, -1):
        x, y = a[f"k{i}"], b[f"k{i}"]
        out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
    return out


def _null_safe_join(out: DataFrame, frame: DataFrame, keys: list[str], name: str) -> DataFrame:
    if not keys:
        row = frame.select(F.lit(1).alias("_one"), name)
        return out.withColumn("_one", F.lit(1)).join(row, "_one", "left").drop("_one")  # one row on either side
    right = frame.select(*(F.col(f"`{k}`").alias(f"_j{i}") for i, k in enumerate(keys)), name)
    cond = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"_j{i}")) for i, k in enumerate(keys)])
    return out.join(right, cond, "left").drop(*(f"_j{i}" for i in range(len(keys))))


def shape(template: Any, tables: dict[str, DataFrame], table: str, filter_: Any = None, meta: dict | None = None) -> DataFrame:
    """One row with the column ``value``, the template over the table's rows that the filter keeps."""
    compiler = Compiler(tables, meta)
    df = compiler.tables[table]
    df = df if filter_ is None else where(df, filter_)
    frame, value = compiler.aggregate(template, df, [], "", [])
    return frame.select(value.alias("value"))


def row_shape(template: Any, tables: dict[str, DataFrame], table: str, filter_: Any = None, meta: dict | None = None) -> DataFrame:
    """A row for each row of the table: the form of an export that is written in parallel."""
    compiler = Compiler(tables, meta)
    df = compiler.tables[table]
    value, df = compiler.row(template, df if filter_ is None else where(df, filter_), "")
    return df.select(ROW_ID, value.alias("value"))


# -- sinks ------------------------------------------------------------------------------------------------------------


def exportable(c: Column, kind: T.DataType) -> Column:
    """Values as JSON has them: times in ISO form with milliseconds, bytes in base 64, no NaN or infinity, nested too."""
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return iso_time(c)
    if isinstance(kind, T.BinaryType):
        return F.base64(c)
    if isinstance(kind, T.FloatType | T.DoubleType):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: exportable(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(exportable(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields)))
    return c


def json_text(df: DataFrame, column: str = "value", omit_nulls: bool = False) -> DataFrame:
    c, kind = F.col(column), df.schema[column].dataType
    made = exportable(c, kind)
    if isinstance(kind, T.StructType | T.ArrayType | T.VariantType):
        return df.withColumn(column, F.to_json(made, {"ignoreNullFields": str(omit_nulls).lower()}))
    return df.withColumn(column, F.get_json_object(F.to_json(F.struct(made.alias("v")), {"ignoreNullFields": "false"}), "$.v"))


def to_json(df: DataFrame, pretty: bool = False, omit_nulls: bool = False) -> str:
    """The one document of ``shape``, on the driver."""
    text = json_text(df, omit_nulls=omit_nulls).first()[0]
    return json.dumps(json.loads(text), indent=2, ensure_ascii=False) if pretty else text


_XML_NAME = re.compile(r"[A-Za-z_][\w.-]*\Z")
_XML_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def to_xml(value: Any, name: str = "export", item: str = "row", template: Any = None) -> str:
    """A JSON value as XML: nulls are left out, names that XML can't have become ``<field name=...>``.

    With the value's ``template``, each list's items are named by its ``$xmlItem``, or ``item``.
    """
    if not _XML_NAME.match(name):
        raise ValidationError(f"{name!r} is not a name that XML can have")

    def tag(key: str, body: str) -> str:
        if _XML_NAME.match(key) and not key.lower().startswith("xml"):
            return f"<{key}>{body}</{key}>"
        return f'<field name="{escape(key, {chr(34): "&quot;"})}">{body}</field>'

    def text(v: Any) -> str:
        if isinstance(v, bool):
            return "true" if v else "false"
        out = str(v)
        if _XML_BAD.search(out):
            raise ValidationError("a character that XML can't have")
        return escape(out)

    def body(v: Any, node: Any) -> str:
        spec = node if isinstance(node, dict) else {}
        if isinstance(v, dict):
            spec = spec.get("$one", spec)
            return "".join(tag(k, body(x, spec.get(k) if isinstance(spec, dict) else None)) for k, x in v.items() if x is not None)
        if isinstance(v, list):
            each = spec.get("$xmlItem", "item" if template is not None else item)
            return "".join(tag(each, body(x, spec.get("$rows"))) for x in v if x is not None)
        return text(v)

    return '<?xml version="1.0" encoding="UTF-8"?>' + tag(name, body(value, template))


def json_schema(kind: T.DataType) -> dict:
    """JSON Schema of a compiled template's value."""
    match kind:
        case T.StructType():
            return {"type": "object", "properties": {f.name: json_schema(f.dataType) for f in kind.fields}, "required": [f.name for f in kind.fields], "additionalProperties": False}
        case T.ArrayType():
            return {"type": "array", "items": json_schema(kind.elementType)}
    plain = {"bool": "boolean", "int": "integer", "float": "number", "decimal": "string"}.get(logical(kind), "string")
    return {"type": [plain, "null"]} | ({"format": "date-time"} if logical(kind) == "datetime" else {})


class Saved:
    """Named templates kept with a dataset; one may be the default of its table."""

    MOST = 1000

    def __init__(self, shapes: dict[str, dict] | None = None) -> None:
        self.shapes = dict(shapes or {})

    def put(self, name: str, template: Any, table: str, default: bool = False, groups: list[str] | None = None) -> None:
        if not name or (name not in self.shapes and len(self.shapes) >= self.MOST):
            raise ValidationError("a name, and not more than 1000 templates")
        if default:
            for s in self.shapes.values():
                s["default"] = s["default"] and s["table"] != table
        self.shapes[name] = {"template": template, "table": table, "default": default, "groups": groups}

    def get(self, name: str | None, table: str | None = None, groups: set[str] | None = None) -> dict:
        found = self.shapes.get(name) if name else next((s for s in self.shapes.values() if s["default"] and s["table"] == table), None)
        if found is None or (found["groups"] and groups is not None and not groups & set(found["groups"])):
            raise ValidationError(f"unknown template {name!r}")
        return found
