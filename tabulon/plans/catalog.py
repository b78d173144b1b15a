"""The registered queries: one or more for each operator family, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import text as tx
from tabulon.operators import access, changes, links, orders, shapes
from tabulon.operators.filters import as_value, where
from tabulon.operators.orders import ROW_ID
from tabulon.operators.query import from_, icontains, truthy
from tabulon.sources import inference

Make = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Make] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None) -> Callable[[Make], Make]:
    def add(make: Make) -> Make:
        QUERIES[name] = make
        if sql:
            ORACLE[name] = sql
        return make

    return add


def _filter(name: str, of: str, filter_: dict, columns: str, condition: str, derive: dict[str, tuple[str, str]] | None = None) -> None:
    """A filter over a table, perhaps with derived columns: name to (Spark SQL, DuckDB SQL)."""
    derive = derive or {}

    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, of).withColumns({k: F.expr(v[0]) for k, v in derive.items()})
        return where(df, filter_).select(*(c.strip() for c in columns.split(",")))

    extra = "".join(f", {v[1]} AS {k}" for k, v in derive.items())
    register(name, f"SELECT {columns} FROM (SELECT *{extra} FROM {of}) WHERE {condition}")(make)


_STATUS = {"status": ("nullif(o_orderstatus, 'F')", "nullif(o_orderstatus, 'F')")}
_PRICE = {"price": ("CASE WHEN o_orderkey % 7 = 0 THEN double('NaN') WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END", "CASE WHEN o_orderkey % 7 = 0 THEN 'NaN'::DOUBLE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END")}
_KEY = "o_orderkey, o_orderstatus, o_totalprice"
_NOT_NAN = "price IS NOT NULL AND NOT isnan(price)"

_filter("flt_01_eq", "orders", {"status": "O"}, _KEY, "status = 'O'", _STATUS)
_filter("flt_02_ne", "orders", {"status": {"ne": "O"}}, _KEY, "status <> 'O'", _STATUS)
_filter("flt_03_gt", "orders", {"price": {"gt": 250000}}, _KEY, f"{_NOT_NAN} AND price > 250000", _PRICE)
_filter("flt_04_gte", "orders", {"price": {"gte": "250000"}}, _KEY, f"{_NOT_NAN} AND price >= 250000", _PRICE)
_filter("flt_05_lt", "orders", {"price": {"lt": 50000}}, _KEY, f"{_NOT_NAN} AND price < 50000", _PRICE)
_filter("flt_06_lte", "orders", {"price": {"lte": 50000}}, _KEY, f"{_NOT_NAN} AND price <= 50000", _PRICE)
_filter("flt_07_in", "orders", {"status": {"in": ["O", "X", None]}}, _KEY, "status IN ('O', 'X')", _STATUS)
_filter("flt_08_contains", "part", {"p_name": {"contains": "1"}}, "p_partkey, p_name", "contains(p_name, '1')")
_filter("flt_09_icontains", "customer", {"c_mktsegment": {"icontains": "bUiL"}}, "c_custkey, c_mktsegment", "contains(lower(c_mktsegment), 'buil')")
_filter("flt_10_startswith", "customer", {"c_mktsegment": {"startsWith": "A"}}, "c_custkey, c_mktsegment", "starts_with(c_mktsegment, 'A')")
_filter("flt_11_isnull", "orders", {"status": {"isNull": True}}, _KEY, "status IS NULL", _STATUS)
_filter("flt_12_and", "orders", {"and": [{"status": "O"}, {"o_totalprice": {"gte": 100000, "lt": 200000}}, {}]}, _KEY, "status = 'O' AND o_totalprice >= 100000 AND o_totalprice < 200000", _STATUS)
_filter("flt_13_or", "orders", {"or": [{"status": None}, {"o_totalprice": {"gt": 490000}}]}, _KEY, "status IS NULL OR o_totalprice > 490000", _STATUS)
_filter("flt_14_not", "orders", {"not": {"status": "O"}}, _KEY, "status IS NULL OR status <> 'O'", _STATUS)
_filter("flt_14_not_nan", "orders", {"not": {"price": {"gte": 100000}}}, _KEY, "price IS NULL OR isnan(price) OR price < 100000", _PRICE)
_filter("flt_14_de_morgan", "orders", {"not": {"or": [{"status": "O"}, {"and": [{"price": {"lt": 100000}}, {"not": {"o_orderkey": {"in": [1, 2, 3]}}}]}]}}, _KEY,
        f"(status IS NULL OR status <> 'O') AND (NOT ({_NOT_NAN} AND price < 100000) OR o_orderkey IN (1, 2, 3))", _STATUS | _PRICE)
_filter("flt_02_ne_nan", "orders", {"price": {"ne": float("nan")}}, _KEY, "price IS NOT NULL", _PRICE)
_filter("flt_12_empty_or", "orders", {"or": []}, _KEY, "false")
_filter("flt_20_coercion", "orders", {"o_orderkey": "42", "o_orderdate": {"gte": "1992-01-01T00:00:00Z"}}, _KEY, "o_orderkey = 42 AND o_orderdate >= TIMESTAMP '1992-01-01'")
_filter("flt_23_where_object", "lineitem", {"l_returnflag": "R", "l_quantity": {"gt": 45}, "l_shipdate": {"lt": "1999-01-01"}}, "l_orderkey, l_linenumber", "l_returnflag = 'R' AND l_quantity > 45 AND l_shipdate < TIMESTAMP '1999-01-01'")


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with lists of lines, of flags and of lists, and an object; some lists empty or null, some items null."""
    li = table(spark, sf_dir, "lineitem")
    item = F.when(F.col("l_linenumber") % 4 != 0, F.struct("l_linenumber", F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag")))
    packed = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", item.alias("item"))), lambda a, b: a["l_linenumber"] - b["l_linenumber"]).alias("x"))
    items, flags = F.transform("x", lambda x: x["item"]), F.transform("x", lambda x: x["item"]["flag"])
    k = F.col("l_orderkey")
    return packed.select(k.alias("id"), F.when(k % 11 != 0, F.when(k % 13 == 0, F.slice(items, 1, 0)).otherwise(items)).alias("lines"), F.when(k % 11 != 0, flags).alias("flags"), F.when(k % 3 != 0, F.struct((k % 10).alias("zip"), flags.alias("tags"))).alias("head"), F.transform("x", lambda x: F.array(x["l_linenumber"], x["l_linenumber"] + 1)).alias("grid"))


_NESTED = """WITH i AS (SELECT l_orderkey AS id, l_linenumber AS n, l_quantity AS qty, l_returnflag AS flag, l_linenumber % 4 <> 0 AS whole FROM lineitem), o AS (SELECT id, id % 11 = 0 AS none, id % 13 = 0 AS bare FROM i GROUP BY id) SELECT id FROM o WHERE """
_SOME = "EXISTS (SELECT 1 FROM i WHERE i.id = o.id AND ({}))"
_NESTED_CASES = {
    "flt_15_any": ({"lines": {"any": {"qty": {"gt": 40}, "flag": "R"}}}, "NOT none AND NOT bare AND " + _SOME.format("whole AND qty > 40 AND flag = 'R'")),
    "flt_15_not_any": ({"not": {"lines": {"any": {"qty": {"gt": 40}}}}}, "NOT (NOT none AND NOT bare AND " + _SOME.format("whole AND qty > 40") + ")"),
    "flt_16_all": ({"lines": {"all": {"qty": {"lte": 45}}}}, "NOT none AND (bare OR NOT " + _SOME.format("NOT whole OR qty > 45") + ")"),
    "flt_16_not_all": ({"not": {"lines": {"all": {"qty": {"lte": 45}}}}}, "NOT (NOT none AND (bare OR NOT " + _SOME.format("NOT whole OR qty > 45") + "))"),
    "flt_17_match": ({"head": {"match": {"zip": {"gte": 5}, "tags": {"any": "A"}}}}, "id % 3 <> 0 AND id % 10 >= 5 AND " + _SOME.format("whole AND flag = 'A'")),
    "flt_17_not_match": ({"not": {"head": {"match": {"zip": 5}}}}, "id % 3 = 0 OR id % 10 <> 5"),
    "flt_18_itself": ({"flags": {"any": "R"}}, "NOT none AND " + _SOME.format("whole AND flag = 'R'")),
    "flt_18_null_item": ({"flags": {"any": None}}, "NOT none AND " + _SOME.format("NOT whole")),
    "flt_19_lists_in_lists": ({"grid": {"any": {"all": {"gte": 6}}}}, _SOME.format("n >= 6")),
}
for _name, (_f, _sql) in _NESTED_CASES.items():
    register(_name, _NESTED + _sql)(lambda s, d, f=_f: where(_nested(s, d), f).select("id"))


@register("flt_22_compiled_value", "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 100000 AND o_orderstatus <> 'F') AS hits FROM orders GROUP BY 1")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    hit = as_value({"o_totalprice": {"gt": 100000}, "o_orderstatus": {"ne": "F"}}, df)
    return df.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(hit, 1)).alias("hits"))


@register("flt_07_long_in", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT 3 * i FROM range(0, 5000) t(i))")
def _(spark, sf_dir):
    return where(table(spark, sf_dir, "orders"), {"o_custkey": {"in": [3 * i for i in range(5000)]}}).select("o_orderkey", "o_custkey")


# -- scans, paging, order
def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose key is the file order."""
    return table(spark, sf_dir, "orders").withColumn(ROW_ID, F.col("o_orderkey"))


_O = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders "
_COLS = ["o_orderkey", "o_custkey", "o_totalprice"]


@register("scan_01_rows", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders")


@register("scan_03_get", _O + "WHERE o_orderkey = 17")
def _(spark, sf_dir):
    return _orders(spark, sf_dir).where(F.col(ROW_ID) == 17).select(*_COLS)


@register("scan_05_limit_offset", _O + "ORDER BY o_orderkey LIMIT 50 OFFSET 700")
def _(spark, sf_dir):
    return _orders(spark, sf_dir).orderBy(ROW_ID).offset(700).limit(50).select(*_COLS)


@register("scan_06_reverse", _O + "ORDER BY o_orderkey DESC LIMIT 20")
def _(spark, sf_dir):
    return from_(_orders(spark, sf_dir)).reverse().take(20).frame().select(*_COLS)


@register("scan_11_keyset", _O + "WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 25")
def _(spark, sf_dir):
    return orders.after(table(spark, sf_dir, "orders"), "o_orderkey", 500, 25).select(*_COLS)


@register("scan_12_template_page", _O + "ORDER BY o_totalprice DESC, o_orderkey LIMIT 30 OFFSET 10")
def _(spark, sf_dir):
    return orders.page(_orders(spark, sf_dir), ["-o_totalprice"], 10, 30).select(*_COLS)


@register("scan_13_page_with_total", "SELECT o_orderkey, o_custkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 10")
def _(spark, sf_dir):
    df = where(_orders(spark, sf_dir), {"o_orderstatus": "O"})
    total = df.agg(F.count(F.lit(1)).alias("total")).withColumn("_one", F.lit(1))
    return df.orderBy(ROW_ID).limit(10).withColumn("_one", F.lit(1)).join(total, "_one").select(*_COLS, "total")


@register("srt_01_multi_column", "SELECT n, o_orderkey FROM (SELECT row_number() OVER (ORDER BY nullif(o_orderstatus, 'F') ASC NULLS FIRST, o_totalprice DESC, o_orderkey) AS n, o_orderkey FROM orders) WHERE n <= 200")
def _(spark, sf_dir):
    df = _orders(spark, sf_dir).withColumn("status", F.nullif("o_orderstatus", F.lit("F")))
    return from_(orders.page(df, ["status", "-o_totalprice"], 0, 200)).order_by("status").then_by_descending("o_totalprice").select(lambda r: {"n": (r.n + 1).cast("long"), "o_orderkey": r.o_orderkey}, index="n").frame()


@register("srt_02_topk", _O + "ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(spark, sf_dir):
    return from_(_orders(spark, sf_dir)).order_by_descending(lambda r: r.o_totalprice).take(10).frame().select(*_COLS)


@register("topk_per_group", "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def _(spark, sf_dir):
    return orders.top_per_group(_orders(spark, sf_dir), ["o_custkey"], ["-o_orderdate"], 3).select("o_custkey", "o_orderkey", "o_orderdate")


@register("srt_04_order_check", "SELECT count(*)::BIGINT AS n FROM (SELECT o_totalprice, lag(o_totalprice) OVER (ORDER BY o_orderkey) AS p, o_orderkey, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS k FROM orders) WHERE k = o_orderkey - 1 AND o_totalprice < p")
def _(spark, sf_dir):
    return orders.out_of_order(_orders(spark, sf_dir), ["o_totalprice"]).agg(F.count(F.lit(1)).alias("n"))


@register("srt_05_nocase", "SELECT row_number() OVER (ORDER BY lower(c_mktsegment), c_mktsegment, c_custkey) AS n, c_custkey FROM customer")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumn(ROW_ID, F.col("c_custkey"))
    return _numbered(df, [*tx.sort_key(F.col("c_mktsegment"), nocase=True), F.col("c_custkey")], "c_custkey")


@register("srt_06_natural", "SELECT row_number() OVER (ORDER BY regexp_extract(p_name, '^[^0-9]*'), coalesce(try_cast(regexp_extract(p_name, '[0-9]+') AS BIGINT), 0), p_name, p_partkey) AS n, p_partkey FROM part WHERE regexp_full_match(p_name, '[^0-9]+[0-9]+')")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "part").where(F.col("p_name").rlike("^[^0-9]+[0-9]+$"))
    return _numbered(df, [*tx.sort_key(F.col("p_name"), natural=True), F.col("p_partkey")], "p_partkey")


def _numbered(df: DataFrame, keys: list, name: str) -> DataFrame:
    """Places in an ascending order, numbered by ranges of it, so that no task sees all rows."""
    named = {f"_s{i}": k for i, k in enumerate(keys)}
    return orders.with_row_ids(df.drop(ROW_ID).withColumns(named), *named).select((F.col(ROW_ID) + 1).alias("n"), name)


# -- fluent queries
@register("qry_02_where", _O + "WHERE o_totalprice > 200000 AND o_custkey % 2 = 0")
def _(spark, sf_dir):
    return from_(table(spark, sf_dir, "orders")).where(lambda r, least: (r.o_totalprice > least) & (r.o_custkey % 2 == 0), 200000).select(lambda r: [r[c] for c in _COLS]).frame()


@register("qry_03_select_index", "SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS i, upper(r_name) AS name FROM region")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "region").withColumn(ROW_ID, F.col("r_regionkey"))
    return from_(df).select(lambda r: {"i": r.i.cast("long"), "name": F.upper(r.r_name)}, index="i").frame()


@register("qry_11_take_skip", _O + "ORDER BY o_orderkey LIMIT 30 OFFSET 20")
def _(spark, sf_dir):
    return from_(_orders(spark, sf_dir)).take(50).skip(20).frame().select(*_COLS)


@register("qry_12_join", "SELECT c.c_name AS name, o.o_orderkey AS okey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_acctbal > 5000")
def _(spark, sf_dir):
    return from_(table(spark, sf_dir, "customer")).filter({"c_acctbal": {"gt": 5000}}).join(table(spark, sf_dir, "orders"), lambda c: c.c_custkey, lambda o: o.o_custkey, lambda c, o: {"name": c.c_name, "okey": o.o_orderkey}).frame()


@register("qry_12_join_null_keys", "SELECT a.s_suppkey AS a, b.n_nationkey AS b FROM (SELECT *, nullif(s_nationkey, 3) AS k FROM supplier) a JOIN (SELECT *, nullif(n_nationkey, 5) AS k FROM nation) b ON a.k IS NOT DISTINCT FROM b.k")
def _(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").withColumn("k", F.nullif("s_nationkey", F.lit(3)))
    b = table(spark, sf_dir, "nation").withColumn("k", F.nullif("n_nationkey", F.lit(5)))
    return from_(a).join(b, lambda r: r.k, lambda r: r.k, lambda x, y: {"a": x.s_suppkey, "b": y.n_nationkey}).frame()


@register("qry_13_group_join", "SELECT c_custkey, count(o_orderkey) AS n, coalesce(max(o_totalprice), 0) AS top FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def _(spark, sf_dir):
    joined = from_(table(spark, sf_dir, "customer")).group_join(table(spark, sf_dir, "orders"), lambda c: c.c_custkey, lambda o: o.o_custkey, "orders")
    return joined.select(lambda r: {"c_custkey": r.c_custkey, "n": F.size(r.orders).cast("long"), "top": F.coalesce(F.array_max(F.transform(r.orders, lambda o: o["o_totalprice"])), F.lit(0.0))}).frame()


@register("qry_14_group_by", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderkey) AS first FROM orders GROUP BY 1, 2")
def _(spark, sf_dir):
    q = from_(_orders(spark, sf_dir)).group_by(lambda r: {"status": r.o_orderstatus, "priority": r.o_orderpriority}, lambda g: {"n": g.count(), "total": F.round(g.sum("o_totalprice"), 2), "first": g.first("o_orderkey")})
    return q.frame().drop(ROW_ID)


@register("qry_16_count", "SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders")
def _(spark, sf_dir):
    return from_(table(spark, sf_dir, "orders")).group_by(lambda r: {}, lambda g: {"n": g.count(), "f": g.count(lambda r: r.o_orderstatus == "F")}).frame()


@register("qry_20_sum_of_nothing", "SELECT 0.0::DOUBLE AS s, NULL::DOUBLE AS lo, NULL::DOUBLE AS mean FROM range(1)")
def _(spark, sf_dir):
    return from_(table(spark, sf_dir, "orders")).where(lambda r: r.o_orderkey < 0).group_by(lambda r: {}, lambda g: {"s": g.sum("o_totalprice"), "lo": g.min("o_totalprice"), "mean": g.average("o_totalprice")}).frame()


@register("qry_21_min_max_average", "SELECT o_orderpriority AS p, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def _(spark, sf_dir):
    return from_(table(spark, sf_dir, "orders")).group_by(lambda r: {"p": r.o_orderpriority}, lambda g: {"lo": g.min("o_totalprice"), "hi": g.max("o_totalprice"), "mean": F.round(g.average("o_totalprice"), 4)}).frame()


@register("lam_06_text_methods", "SELECT c_custkey FROM customer WHERE (contains(lower(c_name), '#00000') AND starts_with(c_mktsegment, 'B')) OR c_mktsegment IN ('MACHINERY')")
def _(spark, sf_dir):
    return from_(table(spark, sf_dir, "customer")).where(lambda r: (icontains(r.c_name, "#00000") & r.c_mktsegment.startswith("B")) | r.c_mktsegment.isin("MACHINERY")).select(lambda r: r.c_custkey).frame()


@register("lam_07_truthiness", "SELECT r_regionkey FROM region WHERE r_regionkey <> 0 AND r_name <> ''")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "region")
    return df.where(truthy(df, "r_regionkey") & truthy(df, "r_name")).select("r_regionkey")


@register("lnq_01_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def _(spark, sf_dir):
    return from_(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority")).distinct().frame()


@register("lnq_02_select_many", "SELECT doc_id, unnest(string_split(source, 'r')) AS part FROM documents")
def _(spark, sf_dir):
    return from_(table(spark, sf_dir, "documents").select("doc_id", "source")).select_many(lambda r: F.split(r.source, "r"), "part").frame().drop("source")


@register("lnq_06_element_at", _O + "ORDER BY o_totalprice, o_orderkey LIMIT 1 OFFSET 99")
def _(spark, sf_dir):
    return from_(_orders(spark, sf_dir)).order_by("o_totalprice").skip(99).take(1).frame().select(*_COLS)


@register("lnq_07_aggregate", "SELECT o_custkey, sum(o_orderkey)::BIGINT AS total FROM orders GROUP BY 1")
def _(spark, sf_dir):
    folded = F.aggregate(F.array_sort(F.collect_list("o_orderkey")), F.lit(0).cast("long"), lambda a, x: a + x)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(folded.alias("total"))


@register("lnq_08_default_if_empty", "SELECT c_custkey, coalesce(o_orderkey, -1) AS okey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def _(spark, sf_dir):
    return from_(table(spark, sf_dir, "customer")).left_join(table(spark, sf_dir, "orders"), lambda c: c.c_custkey, lambda o: o.o_custkey, lambda c, o: {"c_custkey": c.c_custkey, "okey": F.coalesce(o.o_orderkey, F.lit(-1).cast("long"))}).frame()


for _name, _op, _word in (("lnq_10_union", "union", "UNION"), ("lnq_10_intersect", "intersect", "INTERSECT"), ("lnq_10_except", "except_", "EXCEPT"), ("lnq_11_concat", "concat", "UNION ALL")):
    register(_name, f"SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 8000 {_word} SELECT s_nationkey FROM supplier WHERE s_acctbal < 5000")(
        lambda s, d, op=_op: getattr(from_(table(s, d, "customer").where("c_acctbal > 8000").select(F.col("c_nationkey").alias("k"))), op)(table(s, d, "supplier").where("s_acctbal < 5000").select(F.col("s_nationkey").alias("k"))).frame()
    )


@register("lnq_11_zip", "SELECT r_name, n_name FROM region JOIN nation ON r_regionkey = n_nationkey")
def _(spark, sf_dir):
    a = table(spark, sf_dir, "region").withColumn(ROW_ID, F.col("r_regionkey").cast("long"))
    b = table(spark, sf_dir, "nation").withColumn(ROW_ID, F.col("n_nationkey").cast("long"))
    return from_(a).zip(b, lambda x, y: {"r_name": x.r_name, "n_name": y.n_name}).frame()


@register("lnq_12_of_type", "SELECT doc_id, try_cast(substr(source, 4) AS BIGINT) AS n FROM documents WHERE try_cast(substr(source, 4) AS BIGINT) IS NOT NULL")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", F.substring("source", 4, 100).alias("n"))
    return from_(df).of_type("n", "bigint").cast("n", "bigint").frame()


@register("lnq_13_correlated", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    top = o.groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    rich = where(o, {"o_totalprice": {"gt": 400000}}).select("o_custkey")
    c = table(spark, sf_dir, "customer")
    return c.join(rich, c.c_custkey == rich.o_custkey, "left_semi").join(top, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "top")


# -- aggregates
@register("agg_02_exact_int_sum", "SELECT l_returnflag, sum(l_orderkey::HUGEINT * 9000000000000)::VARCHAR AS total FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    # in decimals: the product leaves 64 bits from the key 1,024,820 on
    df = table(spark, sf_dir, "lineitem").withColumn("big", F.col("l_orderkey").cast("decimal(19,0)") * F.lit(9000000000000).cast("decimal(13,0)"))
    frame = shapes.Compiler({"t": df}).aggregate({"x": {"$sum": "big"}}, df.withColumn(ROW_ID, F.lit(0)), ["l_returnflag"], "", [])
    return frame[0].select("l_returnflag", frame[1]["x"].cast("string").alias("total"))


@register("agg_03_decimal_sum", "SELECT l_linestatus, sum(l_extendedprice::DECIMAL(18, 2))::DOUBLE AS total FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_extendedprice").cast("decimal(18,2)"))
    return df.groupBy("l_linestatus").agg(F.sum("p").cast("double").alias("total"))


@register("agg_05_nan_min_max", "SELECT o_orderstatus, min(o_totalprice) FILTER (WHERE o_orderkey % 7 <> 0) AS lo, max(o_totalprice) FILTER (WHERE o_orderkey % 7 <> 0) AS hi FROM orders GROUP BY 1")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("price", F.expr("CASE WHEN o_orderkey % 7 = 0 THEN double('NaN') ELSE o_totalprice END")).withColumn(ROW_ID, F.col("o_orderkey"))
    frame, value = shapes.Compiler({}).aggregate({"lo": {"$min": "price"}, "hi": {"$max": "price"}}, df, ["o_orderstatus"], "", [])
    return frame.select("o_orderstatus", value["lo"].alias("lo"), value["hi"].alias("hi"))


@register("agg_06_first_values", "SELECT o_custkey, arg_min(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS first FROM orders GROUP BY 1")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first"))


@register("agg_07_group_by_filtered", "SELECT l_returnflag, l_linestatus, sum(l_quantity)::BIGINT AS qty, count(*) AS n, min(l_shipdate) AS first, max(l_discount) AS top FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_discount < 0.07 GROUP BY 1, 2")
def _(spark, sf_dir):
    df = where(table(spark, sf_dir, "lineitem"), {"l_shipdate": {"gte": "1994-01-01"}, "l_discount": {"lt": 0.07}})
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("bigint").alias("qty"), F.count(F.lit(1)).alias("n"), F.min("l_shipdate").alias("first"), F.max("l_discount").alias("top"))


# -- templates, flattened so that both sides have plain columns
def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey"}
    return {n: table(spark, sf_dir, n).withColumn(ROW_ID, F.col(k).cast("long")) for n, k in keys.items()} | {"lineitem": table(spark, sf_dir, "lineitem").withColumn(ROW_ID, F.col("l_orderkey") * 10 + F.col("l_linenumber"))}


@register("shp_06_rows_filter_sort_limit", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(spark, sf_dir):
    made = shapes.shape({"list": {"$filter": {"o_orderstatus": "F"}, "$sort": ["-o_totalprice"], "$limit": 25, "$rows": {"k": "o_orderkey", "p": "o_totalprice"}}}, _tables(spark, sf_dir), "orders")
    return made.select(F.inline("value.list"))


@register("shp_08_groups", "SELECT o_orderstatus AS s, count(*) AS n, max(o_totalprice) AS top, count(*) FILTER (WHERE o_totalprice > 300000) AS big FROM orders GROUP BY 1")
def _(spark, sf_dir):
    item = {"s": "o_orderstatus", "n": {"$count": True}, "top": {"$max": "o_totalprice"}, "big": {"$count": True, "$filter": {"o_totalprice": {"gt": 300000}}}}
    return shapes.shape({"groups": {"$groupBy": "o_orderstatus", "$rows": item}}, _tables(spark, sf_dir), "orders").select(F.inline("value.groups"))


@register("shp_08_nested_groups", "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2")
def _(spark, sf_dir):
    inner = {"$groupBy": ["o_orderpriority"], "$rows": {"p": "o_orderpriority", "n": {"$count": True}}}
    made = shapes.shape({"groups": {"$groupBy": ["o_orderstatus"], "$rows": {"s": "o_orderstatus", "parts": inner}}}, _tables(spark, sf_dir), "orders")
    return made.select(F.inline("value.groups")).select("s", F.inline("parts"))


@register("shp_11_link_rows", "SELECT c_custkey AS id, o_orderkey AS okey FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus <> 'P') WHERE r <= 2")
def _(spark, sf_dir):
    link = {"$from": "orders", "$on": {"c_custkey": "o_custkey"}, "$filter": {"o_orderstatus": {"ne": "P"}}, "$sort": ["-o_orderdate"], "$limit": 2, "$rows": {"okey": "o_orderkey"}}
    made = shapes.row_shape({"id": "c_custkey", "orders": link}, _tables(spark, sf_dir), "customer")
    return made.select("value.id", F.inline("value.orders"))


@register("shp_12_link_one", "SELECT c_custkey AS id, nullif(count(o_orderkey), 0) AS n, max(o_totalprice) AS top, min(o_orderkey) AS first FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def _(spark, sf_dir):
    link = {"$from": "orders", "$on": {"c_custkey": "o_custkey"}, "$one": {"n": {"$count": True}, "top": {"$max": "o_totalprice"}, "first": "o_orderkey"}}
    made = shapes.row_shape({"id": "c_custkey", "sum": link}, _tables(spark, sf_dir), "customer")
    return made.select("value.id", "value.sum.n", "value.sum.top", "value.sum.first")


@register("shp_14_three_levels", "SELECT r_name, n_name, c_custkey, count(o_orderkey) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2, 3")
def _(spark, sf_dir):
    orders_ = {"$from": "orders", "$on": {"c_custkey": "o_custkey"}, "$rows": {"k": "o_orderkey"}}
    customers = {"$from": "customer", "$on": {"n_nationkey": "c_nationkey"}, "$rows": {"c_custkey": "c_custkey", "orders": orders_}}
    nations = {"$from": "nation", "$on": {"r_regionkey": "n_regionkey"}, "$rows": {"n_name": "n_name", "customers": customers}}
    made = shapes.row_shape({"r_name": "r_name", "nations": nations}, _tables(spark, sf_dir), "region")
    return made.select("value.r_name", F.inline("value.nations")).select("r_name", "n_name", F.inline("customers")).select("r_name", "n_name", "c_custkey", F.size("orders").cast("long").alias("n"))


@register("shp_18_json", "SELECT o_orderkey AS k, '{\"id\":' || o_orderkey || ',\"at\":\"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || 'Z\",\"none\":null}' AS j FROM orders")
def _(spark, sf_dir):
    made = shapes.row_shape({"id": "o_orderkey", "at": "o_orderdate", "none": None}, _tables(spark, sf_dir), "orders")
    made = made.withColumn("k", F.col("value.id")).select("k", F.col("value").alias("value"))
    return shapes.json_text(made).select("k", F.col("value").alias("j"))


# -- links
@register("links_08_missing", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _(spark, sf_dir):
    t = {n: table(spark, sf_dir, n) for n in ("documents", "labels")}
    return links.missing(links.Link("x", "documents", ("doc_id",), "labels", ("doc_id",)), t).select("doc_id")


@register("links_09_duplicates", "SELECT source AS source, lang AS lang, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf_dir):
    link = links.Link("x", "documents", ("source", "lang"), "documents", ("source", "lang"))
    return links.duplicates(link, {"documents": table(spark, sf_dir, "documents")})


# -- scalar functions, masks, inference
@register("fn_trigrams", "SELECT r_regionkey, unnest(list_distinct([substr(r_name, i, 3) FOR i IN range(1, length(r_name) - 1)])) AS g FROM region")
def _(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", F.explode(tx.trigrams(F.col("r_name"))).alias("g"))


@register("fn_iso_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS at FROM events")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tx.iso_time(F.col("ts")).alias("at"))


@register("acc_05_masks", "SELECT c_custkey, CASE WHEN length(c_name) > 4 THEN '••••' || right(c_name, 4) ELSE '••••' END AS tail, left(c_mktsegment, 1) || '••••' || right(c_mktsegment, 1) AS ends FROM customer")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", tx.mask(F.col("c_name"), "last").alias("tail"), tx.mask(F.col("c_mktsegment"), "firstLast").alias("ends"))


@register("acc_01_row_and_column_grant", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey = 3 THEN '••••' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_nationkey IN (3, 7)")
def _(spark, sf_dir):
    policy = access.Policy("c_nationkey", {"money": ("c_acctbal",)}, (access.Mask("c_mktsegment", rows={"c_nationkey": 3}),))
    return access.view(table(spark, sf_dir, "customer"), policy, access.Grant(rows=(3, 7), columns=()))


@register("inf_text_types", "SELECT 'int' AS a, 'float' AS b, 'string' AS c, 'bool' AS d FROM range(1)")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("a"), F.col("o_totalprice").cast("string").alias("b"), F.col("o_orderstatus").alias("c"), (F.col("o_orderkey") > 5).cast("string").alias("d"))
    return spark.createDataFrame([inference.text_types(df)], "a string, b string, c string, d string")


# -- changes, as frames
@register("mut_02_upsert_last_wins", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'v2' ELSE n_name END AS n_name FROM nation UNION ALL SELECT 100, 'v2'")
def _(spark, sf_dir):
    from tabulon.sources.dataset import last_per_key

    base = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    new = base.where("n_nationkey % 2 = 0").select("n_nationkey").unionAll(spark.range(1).select(F.lit(100).alias("n_nationkey")))
    rows = new.withColumn("n_name", F.lit("v1")).withColumn("p", F.lit(1)).unionAll(new.withColumn("n_name", F.lit("v2")).withColumn("p", F.lit(2)))
    last = last_per_key(rows, ["n_nationkey"], "p").drop("p")
    return base.join(last, "n_nationkey", "left_anti").unionByName(last)


@register("mut_03_delete_two_valued", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR NOT o_orderstatus = 'O'")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("F")))
    return where(df, {"not": {"status": "O"}}).select("o_orderkey")


@register("mut_04_set_where", "SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'X' ELSE o_orderstatus END AS status FROM orders")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.select("o_orderkey", F.when(as_value({"o_totalprice": {"gt": 250000}}, df), "X").otherwise(F.col("o_orderstatus")).alias("status"))


@register("mut_16_changes", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'delete' WHEN s_suppkey % 3 = 0 THEN 'update' END AS op FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 3 = 0")
def _(spark, sf_dir):
    before = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    after = before.where("s_suppkey % 5 <> 0").withColumn("s_name", F.when(F.col("s_suppkey") % 3 == 0, "new").otherwise(F.col("s_name")))
    return changes.diff(before, after, ["s_suppkey"]).select("s_suppkey", "op")


@register("fn_json_properties", "SELECT event_type, count(*) AS n, count(json_extract(props, '$.k')) AS k FROM events GROUP BY 1")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("v", F.try_parse_json("props"))
    return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.try_variant_get("v", "$.k", "string")).alias("k"))


@register("mut_full_cycle", """SELECT row_number() OVER (ORDER BY n_name) - 1 AS _row_id, n_nationkey, n_name, n_regionkey FROM (
  SELECT n_nationkey, CASE WHEN n_nationkey = 1 THEN 'ZZ' ELSE n_name END AS n_name, CASE WHEN n_nationkey = 1 THEN NULL ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_nationkey NOT IN (2, 3, 4)
  UNION ALL SELECT 200, 'ZZZ', NULL UNION ALL SELECT 300, 'ZZZZ', NULL)""")
def _(spark, sf_dir):
    """A dataset written, changed, appended to and compacted in the shared folder; its rows at the end."""
    import uuid

    from tabulon.sources.dataset import Dataset
    from tabulon.sources.scratch import shared_dir

    data = Dataset.create(spark, f"{shared_dir(spark)}/dataset-{uuid.uuid4().hex}", {"nation": table(spark, sf_dir, "nation")}, {"nation": {"sortedBy": ["n_name"]}})
    data.update("nation", upsert=[{"n_nationkey": 1, "n_name": "ZZ"}, {"n_nationkey": 200, "n_name": "ZZZ"}], key_columns=["n_nationkey"], delete={"n_nationkey": 2})
    data.append("nation", insert=[{"n_nationkey": 300, "n_name": "ZZZZ"}], delete={"n_nationkey": {"in": [3, 4]}})
    data.compact("nation")
    return data.table("nation")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter language to Columns over lineitem, aggregated by flag and status."""
    return QUERIES["agg_07_group_by_filtered"](spark, sf_dir)

