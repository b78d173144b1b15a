"""More registered queries: what goes through datasets, formats, streams, terminals and reports, with SQL for the same rows."""

from __future__ import annotations

import dataclasses
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import text as tx
from tabulon.functions.values import ValidationError
from tabulon.operators import access, changes, links, orders, rows, shapes
from tabulon.operators.filters import as_value, where
from tabulon.operators.orders import ROW_ID
from tabulon.operators.query import from_
from tabulon.plans import introspect
from tabulon.plans.catalog import _numbered, _orders, _tables, register, table
from tabulon.sources import text_io
from tabulon.sources.dataset import Dataset
from tabulon.sources.scratch import shared_dir
from tabulon.streaming import ingest


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _data(spark: SparkSession, tables: dict[str, DataFrame], options: dict | None = None, **more) -> Dataset:
    return Dataset.create(spark, _path(spark, "dataset"), tables, options, **more)


def _cust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")


def _one(spark: SparkSession, schema: str, *values) -> DataFrame:
    return spark.createDataFrame([values], schema)


_C = "c_custkey, c_name, c_nationkey, c_acctbal"


# -- scans handed to Python
@register("scan_04_select", "SELECT o_orderpriority, o_orderkey FROM orders")
def _(spark, sf_dir):
    return rows.select(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderkey"])


@register("scan_07_batches", "SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS total FROM orders WHERE o_orderstatus = 'O'")
def _(spark, sf_dir):
    parts = [(b.num_rows, sum(b.column(0).to_pylist())) for b in rows.batches(table(spark, sf_dir, "orders"), {"o_orderstatus": "O"}, ["o_orderkey"])]
    return _one(spark, "n long, total long", sum(p[0] for p in parts), sum(p[1] for p in parts))


@register("scan_08_column_arrays", "SELECT sum(s_suppkey)::BIGINT AS total, count(*) FILTER (WHERE s_acctbal < 0) AS low FROM supplier")
def _(spark, sf_dir):
    got = rows.column_arrays(table(spark, sf_dir, "supplier"), None, ["s_suppkey", "s_acctbal"])
    return _one(spark, "total long, low long", int(got["s_suppkey"][0].sum()), int((got["s_acctbal"][0] < 0).sum()))


@dataclasses.dataclass
class _Nation:
    key: int
    name: str


@register("scan_09_typed_rows", "SELECT n_nationkey::BIGINT AS key, n_name AS name FROM nation")
def _(spark, sf_dir):
    made = rows.typed(table(spark, sf_dir, "nation"), _Nation, {"key": "n_nationkey", "name": "n_name"})
    return rows.from_objects(spark, list(made)).select(F.col("key").cast("long").alias("key"), "name")


@register("scan_12_default_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice, o_orderkey LIMIT 100 OFFSET 5")
def _(spark, sf_dir):
    return orders.template_query(_orders(spark, sf_dir), {"o_orderstatus": "P"}, ["o_orderkey", "o_totalprice"], "o_totalprice", offset=5)


@register("scan_ids_of_lineitem", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS id FROM lineitem")
def _(spark, sf_dir):
    return orders.with_row_ids(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", into="id").select("l_orderkey", "l_linenumber", "id")


# -- filters
@register("flt_08_contains_inside", "SELECT c_custkey, c_name FROM customer WHERE contains(c_name, 'r#00000001')")
def _(spark, sf_dir):
    return where(table(spark, sf_dir, "customer"), {"c_name": {"contains": "r#00000001"}}).select("c_custkey", "c_name")


_MISTAKES = [
    ("unknown column", {"nope": 1}, True), ("unknown operator", {"c_custkey": {"near": 1}}, True), ("text for a number", {"c_custkey": "x"}, True), ("list without in", {"c_custkey": [1]}, True),
    ("number as text", {"c_custkey": "7"}, False), ("empty and", {"and": []}, False), ("null", {"c_name": None}, False),
]


@register("flt_21_validation", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {str(b).lower()})" for n, _, b in _MISTAKES) + ") t(what, refused)")
def _(spark, sf_dir):
    df, out = table(spark, sf_dir, "customer"), []
    for what, filter_, _bad in _MISTAKES:
        try:
            where(df, filter_)
            out.append((what, False))
        except ValidationError:
            out.append((what, True))
    return spark.createDataFrame(out, "what string, refused boolean")


@register("lam_04_decimal_bounds", "SELECT o_orderkey FROM orders WHERE o_totalprice::DECIMAL(18, 2) > 150000.005 AND o_totalprice::DECIMAL(18, 2) <= 150900.1")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(18,2)"))
    return where(df, {"price": {"gt": "150000.005", "lte": 150900.1}}).select("o_orderkey")


# -- fluent queries and their terminals
@register("qry_01_from_rows", "SELECT * FROM (VALUES (2::BIGINT, 'b'), (3::BIGINT, NULL)) t(a, b)")
def _(spark, sf_dir):
    return from_([{"a": 1, "b": "a"}, {"a": 2, "b": "b"}, {"a": 3, "b": None}], spark).skip(1).frame().drop(ROW_ID)


_SORTED = "SELECT c_custkey, row_number() OVER (ORDER BY {}) - 1 AS i FROM customer"


@register("qry_05_order_by_descending", _SORTED.format("c_nationkey DESC, c_custkey"))
def _(spark, sf_dir):
    q = from_(table(spark, sf_dir, "customer").withColumn(ROW_ID, F.col("c_custkey")))
    return q.order_by_descending("c_nationkey").select(lambda r: {"c_custkey": r.c_custkey, "i": r.i}, index="i").frame()


@register("qry_06_then_by", _SORTED.format("c_nationkey, c_mktsegment, c_custkey"))
def _(spark, sf_dir):
    q = from_(table(spark, sf_dir, "customer").withColumn(ROW_ID, F.col("c_custkey")))
    return q.order_by("c_nationkey").then_by("c_mktsegment").select(lambda r: {"c_custkey": r.c_custkey, "i": r.i}, index="i").frame()


@register("qry_07_then_by_descending", _SORTED.format("c_mktsegment, c_acctbal DESC, c_custkey"))
def _(spark, sf_dir):
    q = from_(table(spark, sf_dir, "customer").withColumn(ROW_ID, F.col("c_custkey")))
    return q.order_by("c_mktsegment").then_by_descending("c_acctbal").select(lambda r: {"c_custkey": r.c_custkey, "i": r.i}, index="i").frame()


@register("qry_08_reverse", _SORTED.format("c_nationkey DESC, c_custkey DESC"))
def _(spark, sf_dir):
    q = from_(table(spark, sf_dir, "customer").withColumn(ROW_ID, F.col("c_custkey")))
    return q.order_by("c_nationkey").reverse().select(lambda r: {"c_custkey": r.c_custkey, "i": r.i}, index="i").frame()


@register("qry_17_terminals", """SELECT bool_or(o_totalprice > 400000) AS rich, bool_and(o_totalprice > 0) AS paid, arg_min(o_orderkey, o_orderkey)::BIGINT AS first,
  arg_max(o_orderkey, o_totalprice)::BIGINT AS top, -1::BIGINT AS none, count(*) FILTER (WHERE o_orderstatus = 'F') AS closed, max(o_orderkey)::BIGINT AS last FROM orders""")
def _(spark, sf_dir):
    q = from_(_orders(spark, sf_dir))
    return _one(
        spark, "rich boolean, paid boolean, first long, top long, none long, closed long, last long",
        q.any(lambda r: r.o_totalprice > 400000), q.all(lambda r: r.o_totalprice > 0), q.first()["o_orderkey"], q.order_by_descending("o_totalprice").first()["o_orderkey"],
        (q.first_or_default({"o_orderkey": -1}, lambda r: r.o_orderkey < 0))["o_orderkey"], q.count(lambda r: r.o_orderstatus == "F"), q.last()["o_orderkey"],
    )


@register("qry_23_to_list", "SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation")
def _(spark, sf_dir):
    q = from_(table(spark, sf_dir, "nation").withColumn(ROW_ID, F.col("n_nationkey").cast("long"))).order_by_descending("n_name")
    assert [r["n_name"] for r in q] == [r["n_name"] for r in q.to_list()]
    return spark.createDataFrame([(int(r["n_nationkey"]), r["n_name"]) for r in q], "k long, name string")


@register("qry_24_explain", "SELECT true AS pushed, 2::BIGINT AS columns, 1::BIGINT AS joins, 'where, join' AS steps FROM range(1)")
def _(spark, sf_dir):
    q = from_(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")).where(lambda r: r.c_acctbal > 0)
    plan = q.explain()
    joined = q.join(table(spark, sf_dir, "orders"), lambda c: c.c_custkey, lambda o: o.o_custkey, lambda c, o: {"k": o.o_orderkey}).explain()
    return _one(spark, "pushed boolean, columns long, joins long, steps string", any("c_acctbal" in p for p in plan["pushed"]), len(plan["columns"]), len(joined["joins"]), ", ".join(joined["steps"]))


@register("lnq_07_fold", "SELECT string_agg(n_name, '>' ORDER BY n_name DESC) AS names FROM nation")
def _(spark, sf_dir):
    q = from_(table(spark, sf_dir, "nation").withColumn(ROW_ID, F.col("n_nationkey").cast("long"))).order_by_descending("n_name")
    return _one(spark, "names string", q.fold("", lambda a, r: f"{a}>{r['n_name']}" if a else r["n_name"]))


@register("lnq_08_default_if_empty_row", "SELECT 0 AS a, -1::BIGINT AS k UNION ALL SELECT 1, n_nationkey::BIGINT FROM nation")
def _(spark, sf_dir):
    q = from_(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k")))
    empty = q.where(lambda r: r.k < 0).default_if_empty({"k": -1}).frame().select(F.lit(0).alias("a"), "k")
    return empty.unionAll(q.default_if_empty({"k": -1}).frame().select(F.lit(1).alias("a"), "k"))


@register("lnq_09_predicate_terminals", "SELECT count(*) FILTER (WHERE c_acctbal < 0) AS n, min(c_custkey) FILTER (WHERE c_acctbal < 0) AS first, max(c_custkey) FILTER (WHERE c_acctbal < 0) AS last, 7::BIGINT AS single FROM customer")
def _(spark, sf_dir):
    q = from_(table(spark, sf_dir, "customer").withColumn(ROW_ID, F.col("c_custkey")))
    low = lambda r: r.c_acctbal < 0
    return _one(spark, "n long, first long, last long, single long", q.count(low), q.first(low)["c_custkey"], q.last(low)["c_custkey"], q.single(lambda r: r.c_custkey == 7)["c_custkey"])


@register("lnq_12_sets_and_sequences", "SELECT count(DISTINCT c_mktsegment) AS kinds, true AS equal, true AS has, false AS lacks FROM customer")
def _(spark, sf_dir):
    q = from_(table(spark, sf_dir, "customer").withColumn(ROW_ID, F.col("c_custkey")))
    return _one(spark, "kinds long, equal boolean, has boolean, lacks boolean", len(q.to_set("c_mktsegment")), q.order_by("c_name").sequence_equal(q.order_by("c_name")), q.contains({"c_custkey": 3}), q.contains({"c_custkey": -3}))


@register("lnq_13_related", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _(spark, sf_dir):
    o = from_(table(spark, sf_dir, "orders"))
    q = from_(table(spark, sf_dir, "customer")).where_exists(o.filter({"o_totalprice": {"gt": 300000}}), lambda c: c.c_custkey, lambda r: r.o_custkey)
    return q.with_related(o, lambda c: c.c_custkey, lambda r: r.o_custkey, lambda g: {"top": g.max("o_totalprice"), "n": g.count()}).frame().select("c_custkey", "top", "n")


# -- templates
@register("agg_03_template_decimal_sum", "SELECT l_linestatus AS s, sum(l_extendedprice::DECIMAL(18, 2))::VARCHAR AS total FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_extendedprice").cast("decimal(18,2)")).withColumn(ROW_ID, F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    made = shapes.shape({"g": {"$groupBy": "l_linestatus", "$rows": {"s": "l_linestatus", "total": {"$sum": "p"}}}}, {"lineitem": df}, "lineitem")
    return made.select(F.inline("value.g")).select("s", F.col("total").cast("string").alias("total"))


@register("agg_04_template_float_sum", "SELECT o_orderstatus AS s, round(sum(o_totalprice) FILTER (WHERE o_orderkey % 7 <> 0), 2) AS total FROM orders GROUP BY 1")
def _(spark, sf_dir):
    df = _orders(spark, sf_dir).withColumn("p", F.expr("CASE WHEN o_orderkey % 7 = 0 THEN double('NaN') ELSE o_totalprice END"))
    made = shapes.shape({"g": {"$groupBy": "o_orderstatus", "$rows": {"s": "o_orderstatus", "total": {"$sum": "p"}}}}, {"orders": df}, "orders")
    return made.select(F.inline("value.g")).select("s", F.round("total", 2).alias("total"))


@register("agg_06_template_first_values", "SELECT o_custkey AS c, arg_min(CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE o_orderstatus END, o_orderkey) AS first FROM orders GROUP BY 1")
def _(spark, sf_dir):
    df = _orders(spark, sf_dir).withColumn("st", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")))
    made = shapes.row_shape({"g": {"$from": "o", "$on": {"c_custkey": "o_custkey"}, "$one": {"c": "o_custkey", "first": "st"}}}, {"o": df, "customer": _tables(spark, sf_dir)["customer"]}, "customer")
    return made.where("value.g is not null").select(F.col("value.g.c").alias("c"), F.coalesce("value.g.first", F.lit("none")).alias("first"))


@register("agg_15_statistics", "SELECT count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi, 0::BIGINT AS empty FROM orders")
def _(spark, sf_dir):
    found = introspect.files(table(spark, sf_dir, "orders"))
    return found.agg(F.sum("rows").alias("n"), F.min("min_o_orderkey").alias("lo"), F.max("max_o_orderkey").alias("hi"), F.sum("nulls_o_orderkey").alias("empty"))


@register("join_10_self_link", "SELECT a.n_nationkey AS k, count(b.n_nationkey) AS n FROM nation a LEFT JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey > 4 GROUP BY 1")
def _(spark, sf_dir):
    link = {"$from": "nation", "$on": {"n_regionkey": "n_regionkey"}, "$filter": {"n_nationkey": {"gt": 4}}, "$rows": {"k": "n_nationkey"}}
    made = shapes.row_shape({"k": "n_nationkey", "same": link}, _tables(spark, sf_dir), "nation")
    return made.select("value.k", F.size("value.same").cast("long").alias("n"))


@register("shp_03_values_and_meta", "SELECT r_regionkey AS k, '{\"a\":[1,2]}' AS v, 'me' AS m, 2.5::DOUBLE AS x FROM region")
def _(spark, sf_dir):
    template = {"k": "r_regionkey", "v": {"$value": {"a": [1, 2]}}, "m": {"$meta": "who"}, "x": 2.5}
    made = shapes.row_shape(template, _tables(spark, sf_dir), "region", meta={"who": "me"})
    return made.select("value.k", F.to_json("value.v").alias("v"), "value.m", "value.x")


@register("shp_09_limit_in_groups", "SELECT o_orderpriority AS p, o_orderkey AS k FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def _(spark, sf_dir):
    item = {"p": "o_orderpriority", "top": {"$sort": ["-o_totalprice"], "$limit": 3, "$rows": {"k": "o_orderkey"}}}
    made = shapes.shape({"g": {"$groupBy": "o_orderpriority", "$rows": item}}, _tables(spark, sf_dir), "orders")
    return made.select(F.inline("value.g")).select("p", F.inline("top"))


@register("shp_15_composite_on", "SELECT l_orderkey AS o, l_linenumber AS n, count(*) AS same FROM lineitem GROUP BY 1, 2")
def _(spark, sf_dir):
    link = {"$from": "lineitem", "$on": {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber"}, "$one": {"same": {"$count": True}}}
    made = shapes.row_shape({"o": "l_orderkey", "n": "l_linenumber", "one": link}, _tables(spark, sf_dir), "lineitem")
    return made.select("value.o", "value.n", "value.one.same").distinct()


_BAD_TEMPLATES = [("unknown column", {"a": "nope"}), ("sum of text", {"a": {"$sum": "n_name"}}), ("empty object", {"a": {}}), ("list in a row", {"a": {"$rows": {"b": {"$rows": "n_name"}}}}), ("unknown table", {"a": {"$from": "x", "$on": {"n_name": "n_name"}, "$rows": "n_name"}}), ("unknown key", {"a": {"$rows": "n_name", "$top": 1}})]


@register("shp_17_validation", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', true)" for n, _ in _BAD_TEMPLATES) + ") t(what, path)")
def _(spark, sf_dir):
    out = []
    for what, template in _BAD_TEMPLATES:
        try:
            shapes.shape(template, _tables(spark, sf_dir), "nation")
            out.append((what, None))
        except ValidationError as e:
            out.append((what, str(e).startswith("a")))
    return spark.createDataFrame(out, "what string, path boolean")


@register("shp_19_xml", "SELECT '<?xml version=\"1.0\" encoding=\"UTF-8\"?><out><regions>' || string_agg('<region><key>' || r_regionkey || '</key><name>' || r_name || '</name></region>', '' ORDER BY r_regionkey) || '</regions></out>' AS x FROM region")
def _(spark, sf_dir):
    template = {"regions": {"$rows": {"key": "r_regionkey", "name": "r_name", "none": None}, "$xmlItem": "region"}}
    value = json.loads(shapes.to_json(shapes.shape(template, _tables(spark, sf_dir), "region")))
    return _one(spark, "x string", shapes.to_xml(value, "out", template=template))


@register("shp_20_json_schema", "SELECT * FROM (VALUES ('k', 'integer', NULL), ('at', 'string', 'date-time'), ('p', 'number', NULL), ('s', 'string', NULL)) t(name, kind, format)")
def _(spark, sf_dir):
    made = shapes.row_shape({"k": "o_orderkey", "at": "o_orderdate", "p": "o_totalprice", "s": "o_orderstatus"}, _tables(spark, sf_dir), "orders")
    found = shapes.json_schema(made.schema["value"].dataType)["properties"]
    return spark.createDataFrame([(n, v["type"][0], v.get("format")) for n, v in found.items()], "name string, kind string, format string")


@register("shp_21_saved_templates", "SELECT r_name AS name, 'brief' AS chosen FROM region")
def _(spark, sf_dir):
    saved = shapes.Saved()
    saved.put("long", {"k": "r_regionkey", "name": "r_name"}, "region", default=True)
    saved.put("brief", {"name": "r_name"}, "region", default=True, groups=["staff"])
    chosen = saved.get(None, "region", {"staff"})
    name = next(n for n, s in saved.shapes.items() if s is chosen)
    return shapes.row_shape(chosen["template"], _tables(spark, sf_dir), "region").select("value.name", F.lit(name).alias("chosen"))


# -- text orders
@register("srt_06_natural_names", "SELECT row_number() OVER (ORDER BY p_partkey) AS n, p_partkey FROM part")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("name", F.concat(F.lit("Part "), F.col("p_partkey").cast("string"), F.lit("b")))
    return _numbered(df, [*tx.sort_key(F.col("name"), natural=True), F.col("p_partkey")], "p_partkey")


@register("srt_07_nocase_natural_mixed", "SELECT row_number() OVER (ORDER BY c_nationkey DESC, c_custkey % 10, c_custkey) AS n, c_custkey FROM customer")
def _(spark, sf_dir):
    name = F.concat(F.when(F.col("c_custkey") % 2 == 0, "KIND ").otherwise("kind "), (F.col("c_custkey") % 10).cast("string"))
    df = table(spark, sf_dir, "customer").withColumn("name", name)
    folded = tx.sort_key(F.col("name"), nocase=True, natural=True)[0]
    return _numbered(df, [-F.col("c_nationkey"), folded, F.col("c_custkey")], "c_custkey")


@register("srt_04_declared_order", "SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey DESC, c_custkey) - 1 AS id FROM customer")
def _(spark, sf_dir):
    data = _data(spark, {"c": _cust(spark, sf_dir)}, {"c": {"sortedBy": ["-c_nationkey", "c_custkey"]}})
    assert orders.out_of_order(data.table("c"), ["-c_nationkey", "c_custkey"]).isEmpty()
    return data.table("c").select("c_custkey", F.col(ROW_ID).alias("id"))


# -- sources and sinks, there and back
@register("snk_01_json_lines_round_trip", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(spark, sf_dir):
    path = _path(spark, "json")
    text_io.write_json(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    columns = [{"name": "s_suppkey", "type": "int"}, {"name": "s_name", "type": "string"}, {"name": "s_acctbal", "type": "float"}]
    return text_io.read_json(spark, path, columns).drop(ROW_ID)


@register("src_01_json_inferred", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def _(spark, sf_dir):
    return text_io.from_json(spark, text_io.json_string(table(spark, sf_dir, "nation"))).drop(ROW_ID)


@register("snk_02_csv_round_trip", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, sf_dir):
    path = _path(spark, "csv")
    text_io.write_csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path, ";")
    return text_io.read_csv(spark, path, ";")


@register("src_03_csv_text", "SELECT s_suppkey::BIGINT AS s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN '' ELSE 'a, \"b\"' || chr(10) || s_name END AS t FROM supplier")
def _(spark, sf_dir):
    made = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN '' ELSE concat('a, \"b\"\n', s_name) END AS t")
    return text_io.from_csv(spark, text_io.csv_text(made)).drop(ROW_ID)


@register("src_04_csv_given_columns", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::BIGINT AS o_custkey FROM orders")
def _(spark, sf_dir):
    path = _path(spark, "csv")
    text_io.write_csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), path)
    return text_io.read_csv(spark, path, columns=[{"name": "o_custkey", "type": "int"}, {"name": "o_orderkey", "type": "string"}])


@register("src_05_xml_round_trip", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name || ' <&>' AS \"a name\" FROM nation")
def _(spark, sf_dir):
    made = table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit(" <&>")).alias("a name"))
    return text_io.from_xml(spark, text_io.xml_string(made)).drop(ROW_ID)


@register("snk_05_dataset_round_trip", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, row_number() OVER (ORDER BY o_orderkey) - 1 AS id FROM orders")
def _(spark, sf_dir):
    data = _data(spark, {"orders": table(spark, sf_dir, "orders")}, {"orders": {"sortedBy": ["o_orderkey"]}}, metadata={"from": "orders"})
    assert data.verify() == []
    return Dataset(spark, data.path).table("orders").withColumnRenamed(ROW_ID, "id")


# -- changes of datasets
def _changed(name: str, sql: str, change: Callable[[Dataset, SparkSession, str], None], options: dict | None = None) -> None:
    """A dataset of customers, changed; its rows at the end, after it has been verified."""

    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = _data(spark, {"c": _cust(spark, sf_dir)}, {"c": options or {"sortedBy": ["c_custkey"]}})
        change(data, spark, sf_dir)
        assert data.verify() == []
        return data.table("c").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")

    register(name, sql)(make)


def _new(df: DataFrame, name: str) -> DataFrame:
    return df.select("c_custkey", F.lit(name).alias("c_name"), "c_nationkey", F.lit(None).cast("double").alias("c_acctbal"))


_UP = f"SELECT {_C} FROM customer WHERE c_custkey % 100 <> 3 UNION ALL SELECT c_custkey, 'new', c_nationkey, NULL FROM customer WHERE c_custkey % 100 = 3 UNION ALL SELECT -1, 'new', c_nationkey, NULL FROM customer WHERE c_custkey = 1"


def _hundredth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row in a hundred, changed, and a new one."""
    c = _cust(spark, sf_dir)
    return _new(c.where("c_custkey % 100 = 3"), "new").unionAll(_new(c.where("c_custkey = 1").withColumn("c_custkey", F.lit(-1).cast("long")), "new"))


_changed("mut_01_insert_sorted", f"SELECT {_C} FROM customer UNION ALL SELECT 0, 'zero', 5, 1.5", lambda d, s, f: d.update("c", insert=[{"c_custkey": 0, "c_name": "zero", "c_nationkey": 5, "c_acctbal": 1.5}]))
_changed("mut_02_upsert", _UP, lambda d, s, f: d.update("c", upsert=_hundredth(s, f), key_columns=["c_custkey"]))
_changed("mut_03_delete", f"SELECT {_C} FROM customer WHERE NOT c_acctbal < 0", lambda d, s, f: d.update("c", delete={"c_acctbal": {"lt": 0}}))
_changed("mut_04_set", "SELECT c_custkey, CASE WHEN c_nationkey = 4 THEN 'X' ELSE c_name END AS c_name, c_nationkey, CASE WHEN c_nationkey = 4 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer", lambda d, s, f: d.update("c", set_={"c_name": "X", "c_acctbal": None}, where={"c_nationkey": 4}))
_changed("mut_09_append", f"SELECT {_C} FROM customer WHERE c_nationkey <> 7 UNION ALL SELECT c_custkey + 1000000000, c_name, c_nationkey, c_acctbal FROM customer WHERE c_nationkey = 2", lambda d, s, f: d.append("c", insert=_cust(s, f).where("c_nationkey = 2").withColumn("c_custkey", F.col("c_custkey") + 1_000_000_000), delete={"c_nationkey": 7}))
_changed("mut_09_append_upsert", _UP, lambda d, s, f: d.append("c", upsert=_hundredth(s, f), key_columns=["c_custkey"]), {"partitionBy": "c_nationkey"})
_changed("mut_11_transaction", f"SELECT {_C} FROM customer WHERE c_nationkey >= 7 UNION ALL SELECT -5, 'last', 1, NULL", lambda d, s, f: d.begin().add("c", delete={"c_nationkey": {"lt": 5}}).add("c", delete={"c_nationkey": {"lt": 7}}).add("c", insert=[{"c_custkey": -5, "c_name": "last", "c_nationkey": 1}]).commit(), {"partitionBy": "c_nationkey"})


@register("mut_04_set_counts", "SELECT count(*) FILTER (WHERE c_nationkey = 4) AS updated, count(*) AS rows, 0::BIGINT AS inserted, 0::BIGINT AS deleted FROM customer")
def _(spark, sf_dir):
    got = _data(spark, {"c": _cust(spark, sf_dir)}).update("c", set_={"c_name": "X"}, where={"c_nationkey": 4})
    return _one(spark, "updated long, rows long, inserted long, deleted long", got["updated"], got["rowCount"], got["inserted"], got["deleted"])


@register("mut_05_rows_move_to_their_place", "SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_nationkey = 4 THEN -1000000.0 ELSE c_acctbal END, c_custkey) - 1 AS id FROM customer")
def _(spark, sf_dir):
    data = _data(spark, {"c": _cust(spark, sf_dir)}, {"c": {"sortedBy": ["c_acctbal", "c_custkey"]}})
    data.update("c", set_={"c_acctbal": -1000000}, where={"c_nationkey": 4})
    return data.table("c").select("c_custkey", F.col(ROW_ID).alias("id"))


@register("mut_06_several_tables", "SELECT 'n' AS t, count(*) FILTER (WHERE n_regionkey <> 1) AS n, 1::BIGINT AS versions FROM nation UNION ALL SELECT 'r', count(*) + 1, 1 FROM region")
def _(spark, sf_dir):
    data = _data(spark, {"n": table(spark, sf_dir, "nation"), "r": table(spark, sf_dir, "region")})
    before = data.version
    data.update_tables({"n": {"delete": {"n_regionkey": 1}}, "r": {"insert": [{"r_regionkey": 99, "r_name": "new"}]}})
    return spark.createDataFrame([(t, data.table(t).count(), data.version - before) for t in ("n", "r")], "t string, n long, versions long")


@register("mut_07_tables", "SELECT 'b' AS t, count(*) AS n FROM nation UNION ALL SELECT 'c', count(*) FROM supplier")
def _(spark, sf_dir):
    data = _data(spark, {"a": table(spark, sf_dir, "nation"), "x": table(spark, sf_dir, "region")})
    data.add_table("c", table(spark, sf_dir, "supplier"))
    data.rename_table("a", "b")
    data.remove_table("x")
    return spark.createDataFrame([(t, df.count()) for t, df in data.tables().items()], "t string, n long")


@register("mut_08_new_order", "SELECT n_name, row_number() OVER (ORDER BY n_regionkey DESC, n_nationkey) - 1 AS id FROM nation")
def _(spark, sf_dir):
    data = _data(spark, {"n": table(spark, sf_dir, "nation")}, {"n": {"sortedBy": ["n_nationkey"]}})
    data.update("n", sorted_by=["-n_regionkey", "n_nationkey"])
    return data.table("n").select("n_name", F.col(ROW_ID).alias("id"))


@register("mut_10_order_of_appends", "SELECT * FROM (VALUES ('after', true), ('before', false)) t(what, taken)")
def _(spark, sf_dir):
    data, out = _data(spark, {"c": _cust(spark, sf_dir)}, {"c": {"sortedBy": ["-c_custkey"]}}), []
    for what, key in (("after", -5), ("before", 10**9)):
        try:
            data.append("c", insert=[{"c_custkey": key}])
            out.append((what, True))
        except ValidationError:
            out.append((what, False))
    return spark.createDataFrame(out, "what string, taken boolean")


@register("mut_12_clashes", "SELECT * FROM (VALUES ('delete', true), ('upsert', true), ('insert', false)) t(what, refused)")
def _(spark, sf_dir):
    data, out = _data(spark, {"c": _cust(spark, sf_dir)}), []
    for what, call in (("delete", {"delete": {"c_custkey": -9}}), ("upsert", {"upsert": [{"c_custkey": -9}], "key_columns": ["c_custkey"]}), ("insert", {"insert": [{"c_custkey": -9}]})):
        t = data.begin().add("c", insert=[{"c_custkey": -9}])
        try:
            t.add("c", **call)
            out.append((what, False))
        except ValidationError:
            out.append((what, True))
        t.rollback()
    return spark.createDataFrame(out, "what string, refused boolean")


@register("mut_14_compact", "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS id FROM customer WHERE c_nationkey <> 3")
def _(spark, sf_dir):
    data = _data(spark, {"c": _cust(spark, sf_dir)}, {"c": {"sortedBy": ["c_custkey"]}})
    data.append("c", delete={"c_nationkey": 3})
    data.compact("c")
    data.vacuum()
    assert data.storage()["unused"] == 0 and data.verify() == []
    return data.table("c").select("c_custkey", F.col(ROW_ID).alias("id"))


@register("mut_15_regroup", "SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1 AS id FROM customer")
def _(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").withColumn(ROW_ID, F.col("c_custkey"))
    data = _data(spark, {"c": base}, {"c": {"partitionBy": "c_nationkey"}})
    data.compact("c", regroup=True)
    return data.table("c").select("c_custkey", F.col(ROW_ID).alias("id"))


@register("mut_16_apply_changes", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE s_name END AS s_name, s_acctbal FROM supplier WHERE s_suppkey % 5 <> 0")
def _(spark, sf_dir):
    before = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    after = before.where("s_suppkey % 5 <> 0").withColumn("s_name", F.when(F.col("s_suppkey") % 3 == 0, "new").otherwise(F.col("s_name")))
    return changes.apply_changes(before, changes.diff(before, after, ["s_suppkey"]), ["s_suppkey"])[0]


@register("mut_16_conflicts", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'missing' WHEN s_suppkey % 3 = 0 THEN 'changed' END AS conflict FROM supplier")
def _(spark, sf_dir):
    before = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    made = changes.diff(before, before.withColumn("s_name", F.lit("mine")), ["s_suppkey"])
    now = before.where("s_suppkey % 2 <> 0").withColumn("s_name", F.when(F.col("s_suppkey") % 3 == 0, "theirs").otherwise(F.col("s_name")))
    return changes.classify(now, made, ["s_suppkey"]).select("s_suppkey", "conflict")


@register("mut_17_submission", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0 THEN 'sent' ELSE c_name END AS c_name, c_mktsegment FROM customer UNION ALL SELECT -1, 'mine', 'BUILDING'")
def _(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    sent = base.where("c_mktsegment = 'BUILDING'").withColumn("c_name", F.when(F.col("c_custkey") % 2 == 0, "sent").otherwise(""))
    sent = sent.unionAll(spark.createDataFrame([(-1, "mine", None)], "c_custkey long, c_name string, c_mktsegment string"))
    return changes.merge_submission(base, sent, ["c_custkey"], "c_mktsegment", "BUILDING")


@register("mut_19_versions", "SELECT 'old' AS v, count(*) AS n FROM nation UNION ALL SELECT 'new', count(*) FILTER (WHERE n_regionkey <> 2) FROM nation")
def _(spark, sf_dir):
    data = _data(spark, {"n": table(spark, sf_dir, "nation")})
    old = Dataset(spark, data.path)
    data.append("n", delete={"n_regionkey": 2})
    return spark.createDataFrame([("old", old.table("n").count()), ("new", ingest.poll(old).table("n").count())], "v string, n long")


@register("mut_20_single_writer", "SELECT true AS refused, true AS free FROM range(1)")
def _(spark, sf_dir):
    data = _data(spark, {"r": table(spark, sf_dir, "region")})
    other, refused = Dataset(spark, data.path), False
    data.append("r", insert=[{"r_regionkey": 9, "r_name": "x"}])
    try:
        other.append("r", insert=[{"r_regionkey": 10, "r_name": "y"}])
    except ValidationError:
        refused = True
    return _one(spark, "refused boolean, free boolean", refused, not data.files.exists("writer.lock"))


@register("mut_23_metadata", "SELECT * FROM (VALUES ('a', '1'), ('b', '2')) t(k, v)")
def _(spark, sf_dir):
    data = _data(spark, {"r": table(spark, sf_dir, "region")}, metadata={"a": "0"})
    data.merge_metadata({"a": "1", "b": "2"})
    return spark.createDataFrame(list(Dataset(spark, data.path).manifest["metadata"].items()), "k string, v string")


# -- grants
@register("acc_03_grant_inside_links", "SELECT n_nationkey AS k, count(c_custkey) AS n FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_mktsegment = 'BUILDING' GROUP BY 1")
def _(spark, sf_dir):
    t = _tables(spark, sf_dir)
    seen = access.views({"nation": t["nation"], "customer": t["customer"]}, {"customer": access.Policy("c_mktsegment")}, access.Grant(rows=("BUILDING",)))
    made = shapes.row_shape({"k": "n_nationkey", "c": {"$from": "customer", "$on": {"n_nationkey": "c_nationkey"}, "$rows": "c_custkey"}}, seen, "nation")
    return made.select("value.k", F.size("value.c").cast("long").alias("n"))


@register("acc_05_keep_format", "SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(c_name, '[0-9]', '0', 'g'), '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g') AS form, c_mktsegment AS other FROM customer")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    policy = access.Policy(masks=(access.Mask("c_name", "keepFormat"), access.Mask("c_acctbal", "column:c_mktsegment")))
    return access.view(df, policy, access.Grant()).select("c_custkey", F.col("c_name").alias("form"), F.col("c_acctbal").alias("other"))


@register("acc_07_expiry", "SELECT * FROM (VALUES ('past', true), ('future', false)) t(what, refused)")
def _(spark, sf_dir):
    import datetime as dt

    out = []
    for what, year in (("past", 2001), ("future", 2999)):
        try:
            access.check_live(access.Grant(expires=dt.datetime(year, 1, 1)))
            out.append((what, False))
        except PermissionError:
            out.append((what, True))
    return spark.createDataFrame(out, "what string, refused boolean")


# -- reports
@register("int_01_explain", "SELECT true AS pushed, 'o_orderkey,o_totalprice' AS columns FROM range(1)")
def _(spark, sf_dir):
    plan = introspect.explain(where(table(spark, sf_dir, "orders"), {"o_totalprice": {"gt": 1000}}).select("o_orderkey", "o_totalprice"))
    return _one(spark, "pushed boolean, columns string", any("o_totalprice" in p for p in plan["pushed"]), ",".join(plan["columns"]))


@register("int_02_analyze", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 200000")
def _(spark, sf_dir):
    return _one(spark, "n long", introspect.analyze(table(spark, sf_dir, "orders"), {"o_totalprice": {"gt": 200000}})["rows"])


@register("int_03_estimate", "SELECT count(*) AS total, 0::BIGINT AS none FROM orders")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return _one(spark, "total long, none long", introspect.estimate(df, {"o_orderkey": {"gte": 1}})["candidateRows"], introspect.estimate(df, {"o_orderkey": {"lt": -1}})["candidateRows"])


@register("int_07_check_links", "SELECT (SELECT count(*) FROM documents) AS rows, (SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS missing, (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1)) AS twice")
def _(spark, sf_dir):
    t = {n: table(spark, sf_dir, n) for n in ("documents", "labels")}
    [report] = links.check_links([links.Link("x", "documents", ("doc_id",), "labels", ("doc_id",))], t)
    return _one(spark, "rows long, missing long, twice long", report["rows"], report["missing"], report["duplicateTargets"])


@register("int_08_inspect", "SELECT 'c_custkey' AS name, false AS sorted UNION ALL SELECT 'c_name', false UNION ALL SELECT 'c_nationkey', true UNION ALL SELECT 'c_acctbal', false")
def _(spark, sf_dir):
    t = _data(spark, {"c": _cust(spark, sf_dir)}, {"c": {"sortedBy": ["c_nationkey"]}}).inspect()["tables"]["c"]
    return spark.createDataFrame([(c["name"], c["name"] in t["options"]["sortedBy"]) for c in t["columns"]], "name string, sorted boolean")


# -- streams
def _stream(spark: SparkSession, df: DataFrame, files: int) -> DataFrame:
    path = _path(spark, "stream")
    df.repartition(files).write.parquet(path)
    return ingest.read_files(spark, path, df.schema, per_trigger=2)


@register("str_01_append_streams", "SELECT c_custkey, 'first' AS which FROM customer UNION ALL SELECT s_suppkey, 'second' FROM supplier")
def _(spark, sf_dir):
    """Two streams into one table, the first started twice with the same checkpoint."""
    data = _data(spark, {"t": spark.createDataFrame([], "c_custkey long, which string")})
    parts = [table(spark, sf_dir, "customer").select("c_custkey", F.lit("first").alias("which")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.lit("second").alias("which"))]
    for df in parts:
        stream, checkpoint = _stream(spark, df, 4), _path(spark, "checkpoint")
        for _ in range(2):
            ingest.append_stream(stream, data.path, "t", checkpoint).awaitTermination()
    return data.refresh().table("t").drop(ROW_ID)


@register("str_04_upsert_stream", f"SELECT {_C} FROM customer WHERE c_nationkey <> 6 UNION ALL SELECT c_custkey, 'up', c_nationkey, NULL FROM customer WHERE c_nationkey = 6")
def _(spark, sf_dir):
    data = _data(spark, {"c": _cust(spark, sf_dir)})
    stream = _stream(spark, _new(_cust(spark, sf_dir).where("c_nationkey = 6"), "up"), 3)
    ingest.upsert_stream(stream, data.path, "c", ["c_custkey"], _path(spark, "checkpoint")).awaitTermination()
    return data.refresh().table("c").drop(ROW_ID)


@register("str_windowed_counts", "SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    """Event-time windows; the watermark is wider than the table, so that every row counts."""
    name = f"counts_{uuid.uuid4().hex}"
    stream = _stream(spark, table(spark, sf_dir, "events").select("ts", "event_type"), 3)
    made = ingest.windowed_counts(stream, "ts", "event_type", "1 day", "100000 days")
    made.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", _path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select("event_type", F.col("window.start").cast("timestamp_ntz").alias("day"), F.col("count").alias("n"))


# -- functions
@register("fn_fold_and_natural", "SELECT c_custkey, lower(c_mktsegment) || 'e' AS folded, c_custkey = c_custkey AS same FROM customer")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return df.select("c_custkey", tx.fold_text(F.concat("c_mktsegment", F.lit("É"))).alias("folded"), (tx.natural_key(F.concat(F.lit("n"), F.col("c_custkey").cast("string"))) == tx.natural_key(F.concat(F.lit("n"), F.col("c_custkey").cast("string")))).alias("same"))


@register("fn_json_column", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(F.col("event_id").alias("at"), F.parse_json("props").alias("value"))
    made = text_io._json_rows(df, [{"name": "k", "type": "json"}], False)
    return made.select(F.col(ROW_ID).alias("event_id"), F.get_json_object(F.concat(F.lit('{"v":'), F.col("k"), F.lit("}")), "$.v").alias("k"))


@register("fn_filter_as_value", "SELECT o_orderkey, o_totalprice > 100000 AND o_orderstatus <> 'F' AS hit FROM orders")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.select("o_orderkey", as_value({"o_totalprice": {"gt": 100000}, "o_orderstatus": {"ne": "F"}}, df).alias("hit"))
