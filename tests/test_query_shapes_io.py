import json
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tabulon.functions import text as tx
from tabulon.functions.values import ValidationError
from tabulon.operators import orders, shapes
from tabulon.operators.orders import ROW_ID, with_row_ids
from tabulon.operators.query import from_
from tabulon.sources import text_io as io


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(0, "ann", "X", 3.0), (1, "bob", None, None), (2, "cyd", "X", 1.0), (3, "dan", "Y", 3.0)], f"{ROW_ID} long, name string, team string, pay double")


def test_terminals(people):
    q = from_(people)
    assert q.count() == 4 and q.count(lambda r: r.pay > 2) == 2
    assert q.first()["name"] == "ann" and q.last()["name"] == "dan"
    assert q.order_by_descending("pay").then_by_descending("name").first()["name"] == "dan"
    assert [r["name"] for r in q.order_by("pay").reverse().to_list()] == ["dan", "ann", "cyd", "bob"]
    assert [r["name"] for r in q.order_by("pay").to_list()] == ["bob", "cyd", "ann", "dan"]
    assert q.element_at(2)["name"] == "cyd" and q.single(lambda r: r.team == "Y")["name"] == "dan"
    assert q.sum("pay") == 7 and q.average("pay") == pytest.approx(7 / 3) and q.min("name") == "ann"
    assert q.where(lambda r: r.pay > 99).sum("pay") == 0 and q.where(lambda r: r.pay > 99).max("pay") is None
    assert q.fold(0, lambda a, r: a + (r["pay"] or 0)) == 7 and q.to_set("team") == {"X", "Y", None}
    assert not q.any(lambda r: r.pay > 99) and q.all(lambda r: F.length(r.name) == 3) and q.contains({"team": None})
    assert q.first_or_default("none", lambda r: r.pay > 99) == "none"
    assert q.where_udf(lambda n: n.startswith("c"), "name").count() == 1
    for bad in (lambda: q.then_by("pay"), lambda: q.where(lambda r: r.nope)):
        with pytest.raises(ValidationError):
            bad()
    for bad in (lambda: q.single(), lambda: q.element_at(9), lambda: q.first(lambda r: r.pay > 99)):
        with pytest.raises(LookupError):
            bad()


def test_groups_joins_and_in_memory_source(spark, people):
    got = from_(people).group_by(lambda r: r.team, lambda g: {"n": g.count(), "first": g.first("name")}).to_list()
    assert got == [{"key": "X", "n": 2, "first": "ann"}, {"key": None, "n": 1, "first": "bob"}, {"key": "Y", "n": 1, "first": "dan"}]
    teams = from_([{"t": "X", "label": "ex"}, {"t": None, "label": "none"}], spark)
    joined = from_(people).join(teams, lambda p: p.team, lambda t: t.t, lambda p, t: {"name": p.name, "label": t.label}).frame().collect()
    assert sorted(map(tuple, joined)) == [("ann", "ex"), ("bob", "none"), ("cyd", "ex")]
    grouped = from_(people).group_join(teams, lambda p: p.team, lambda t: t.t).to_list()
    assert [len(r["rows"]) for r in grouped] == [1, 1, 1, 0]


def test_row_ids_are_gapless(spark):
    df = with_row_ids(spark.range(1000).withColumn("k", F.reverse(F.col("id").cast("string"))), "k").collect()
    assert [r.k for r in sorted(df, key=lambda r: r[ROW_ID])] == sorted(str(i)[::-1] for i in range(1000))
    assert sorted(r[ROW_ID] for r in df) == list(range(1000))


def test_text_orders():
    assert sorted(["A10", "A2", "a1", "A02", "b", "9", "", "10a"], key=tx.natural) == ["", "9", "10a", "A2", "A02", "A10", "a1", "b"]
    assert [tx.fold(x) for x in ("Éa", "Straße", "İ")] == ["ea", "straße", "i"]


def test_template_output(spark, people):
    tables = {"people": people, "teams": spark.createDataFrame([("X", 1), ("X", 2), (None, 3)], "team string, size int")}
    template = {
        "n": {"$count": True}, "total": {"$sum": "pay"}, "title": {"$value": "T"}, "by": {"$meta": "who"},
        "teams": {"$groupBy": ["team"], "$rows": {"team": "team", "n": {"$count": True}, "names": {"$sort": ["-name"], "$limit": 1, "$rows": "name"}}},
        "rows": {"$filter": {"pay": {"gt": 0}}, "$sort": ["-pay"], "$rows": {"name": "name", "one": {"$from": "teams", "$on": {"team": "team"}, "$one": {"n": {"$count": True}}}}},
    }
    got = json.loads(shapes.to_json(shapes.shape(template, tables, "people", meta={"who": "me"})))
    assert got == {
        "n": 4, "total": 7.0, "title": "T", "by": "me",
        "teams": [{"team": "X", "n": 2, "names": ["cyd"]}, {"team": None, "n": 1, "names": ["bob"]}, {"team": "Y", "n": 1, "names": ["dan"]}],
        "rows": [{"name": "ann", "one": {"n": 2}}, {"name": "dan", "one": None}, {"name": "cyd", "one": {"n": 2}}],
    }
    assert shapes.to_xml({"a b": 1, "list": ["x<", None], "no": None}) == '<?xml version="1.0" encoding="UTF-8"?><export><field name="a b">1</field><list><row>x&lt;</row></list></export>'


@pytest.mark.parametrize("bad", [{"a": "nope"}, {"a": {"$sum": "name"}}, {"a": {"$rows": {"b": {"$count": True}}}}, {"a": {"$from": "gone", "$on": {"team": "team"}, "$rows": "x"}}, {"a": {"$from": "people", "$on": {"team": "pay"}, "$rows": "name"}}, {"a": {}}, {"a": {"$rows": "name", "$limit": -1}}, {"$x": 1}])
def test_template_mistakes(people, bad):
    with pytest.raises(ValidationError):
        shapes.shape(bad, {"people": people}, "people")


def test_exact_sums(spark):
    df = spark.createDataFrame([(2**63 - 1, Decimal("1.10")), (1, Decimal("2.25"))], "i long, d decimal(10,2)")
    row = shapes.shape({"i": {"$sum": "i"}, "d": {"$sum": "d"}}, {"t": df}, "t").first().value
    assert row.i == 2**63 and row.d == Decimal("3.35")


def test_csv_round_trip_and_rules(spark, tmp_path):
    text = 'id,name,,ok\r\n1,"a ""q"", b",x,true\r\n2,"",,false\r\n3,,z\r\n'
    df = io.from_csv(spark, text)
    assert [(f.name, f.dataType.simpleString()) for f in df.drop(ROW_ID).schema.fields] == [("id", "bigint"), ("name", "string"), ("column3", "string"), ("ok", "boolean")]
    rows = [tuple(r) for r in df.orderBy(ROW_ID).drop(ROW_ID).collect()]
    assert rows == [(1, 'a "q", b', "x", True), (2, "", None, False), (3, None, "z", None)]
    assert [tuple(r) for r in io.from_csv(spark, io.csv_text(df)).orderBy(ROW_ID).drop(ROW_ID).collect()] == rows
    with pytest.raises(ValidationError):
        io.from_csv(spark, "a,b\n1,2,3\n")
    with pytest.raises(ValidationError):
        io.from_csv(spark, "a,a\n1,2\n")
    (tmp_path / "f.csv").write_text("a;b\n1;x\n2;\"y;z\"\n")
    assert sorted(map(tuple, io.read_csv(spark, str(tmp_path / "f.csv"), ";").collect())) == [(1, "x"), (2, "y;z")]
    (tmp_path / "bad.csv").write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception, match="too many fields"):
        io.read_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_json_inference_and_output(spark, tmp_path):
    rows = [{"a": 1, "b": "x", "c": True, "d": [1]}, {"a": 2.5, "b": None, "e": "2020-01-01"}]
    df = io.from_json(spark, rows)
    assert {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name != ROW_ID} == {"a": "double", "b": "string", "c": "boolean", "d": "string", "e": "string"}
    assert json.loads(io.json_string(df, omit_nulls=True))[0] == {"a": 1.0, "b": "x", "c": True, "d": "[1]"}
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    assert io.read_json(spark, str(tmp_path / "r.jsonl")).count() == 2
    (tmp_path / "r.json").write_text(json.dumps(rows))
    assert sorted(r.a for r in io.read_json(spark, str(tmp_path / "r.json"), lines=False).collect()) == [1.0, 2.5]


def test_xml_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, "a<b", None), (1, 2, "", 2.5)], f"{ROW_ID} long, id long, `my name` string, x double")
    text = io.xml_string(df)
    back = io.from_xml(spark, text)
    assert sorted(tuple(r) for r in back.select("id", "my name").collect()) == [(1, "a<b"), (2, "")]
    (tmp_path / "x.xml").write_text(text)
    assert sorted(r.id for r in io.read_xml(spark, str(tmp_path / "x.xml")).collect()) == [1, 2]
    with pytest.raises(ValidationError):
        list(io.xml_rows("<!DOCTYPE x><r/>"))


def test_xml_items_and_root(spark, people):
    template = {"teams": {"$groupBy": ["team"], "$xmlItem": "team", "$rows": {"n": {"$count": True}, "people": {"$rows": "name", "$xmlItem": "who", "$limit": 1}}}, "all": {"$rows": {"x": "name"}, "$limit": 1, "$sort": ["-name"]}}
    value = json.loads(shapes.to_json(shapes.shape(template, {"people": people}, "people")))
    assert shapes.to_xml(value, "out", template=template).endswith("<out><teams><team><n>2</n><people><who>ann</who></people></team><team><n>1</n><people><who>bob</who></people></team><team><n>1</n><people><who>dan</who></people></team></teams><all><item><x>dan</x></item></all></out>")
    with pytest.raises(ValidationError):
        shapes.to_xml(value, "no name")
    with pytest.raises(ValidationError):
        shapes.shape({"a": {"$rows": "name", "$xmlItem": "1"}}, {"people": people}, "people")


def test_links_of_large_tables_are_dealt_by_size(spark, tmp_path, monkeypatch):
    rows = [(i % 50 if i % 7 else None, i % 3, i) for i in range(3000)]
    spark.createDataFrame(rows, "a long, b int, c long").write.parquet(str(tmp_path / "t"))
    spark.createDataFrame([(i, i * i) for i in range(0, 50, 2)] * 2, "k long, v long").write.parquet(str(tmp_path / "u"))
    tables = {n: spark.read.parquet(str(tmp_path / n)) for n in ("t", "u")}
    monkeypatch.setattr(shapes, "SMALL", 1, raising=False)
    monkeypatch.setattr(shapes, "SHARE", 1 << 10, raising=False)
    own = {"$from": "t", "$on": {"a": "a", "b": "b"}, "$filter": {"c": {"gt": 100}}, "$one": {"n": {"$count": True}}}
    made = shapes.row_shape({"c": "c", "one": own}, tables, "t").select("value.c", "value.one.n")
    count = Counter((a, b) for a, b, c in rows if a is not None and c > 100)
    assert {r.c: r.n for r in made.collect()} == {c: count.get((a, b)) for a, b, c in rows}
    assert made.rdd.getNumPartitions() > 8
    other = {"$from": "u", "$on": {"a": "k"}, "$rows": "v"}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for most, parts in (("-1", lambda n: n > 8), (before, lambda n: n <= 8)):  # a table to be broadcast leaves the other where it is
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
            made = shapes.row_shape({"c": "c", "v": other}, tables, "t").select("value.c", "value.v")
            assert {r.c: r.v for r in made.collect()} == {c: [a * a] * 2 if a is not None and a % 2 == 0 else [] for a, _, c in rows}
            assert parts(made.rdd.getNumPartitions())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kept", [100_000, 7])
def test_skip_and_take_in_no_single_task(spark, monkeypatch, kept):
    monkeypatch.setattr(orders, "KEPT", kept)
    rows = [(i, i * 37 % 11 if i % 6 else None, ["x", "y", "z"][: i % 4]) for i in range(60)]
    df = spark.createDataFrame(rows, f"{ROW_ID} long, k int, l array<string>").repartition(5)
    by = lambda r: (r[1] is not None, r[1] or 0, r[0])
    ranked = [r[0] for r in sorted(rows, key=by)]
    ids = lambda q: [r[0] for r in q.frame().select(ROW_ID).collect()]
    q = from_(df).order_by("k")
    for n in (0, 9, 70):
        assert ids(q.skip(n)) == ranked[n:] and ids(q.skip(n).take(4)) == ranked[n : n + 4] and ids(q.take(n).skip(2).skip(1)) == ranked[3:n]
        assert ids(q.reverse().skip(n)) == ranked[::-1][n:] and ids(from_(df).skip(n)) == list(range(60))[n:]
        assert [r[0] for r in orders.page(df, ["k"], n).select(ROW_ID).collect()] == ranked[n:]
    assert q.skip(5).where(lambda r: r.k > 4).reverse().first()["k"] == 10 and q.skip(5).take(9).count() == 9
    items = sorted(((r[0], x) for r in rows for x in r[2]), key=lambda r: (r[1], r[0]))  # ids repeat
    many = from_(df).select_many(lambda r: r.l, "x").order_by("x")
    assert [tuple(r) for r in many.skip(20).frame().select(ROW_ID, "x").collect()] == items[20:]
    assert [tuple(r) for r in many.skip(20).take(30).frame().select(ROW_ID, "x").collect()] == items[20:50]
    for one in (q.skip(5).frame(), q.skip(5).take(1).frame(), orders.page(df, ["k"], 5)):
        assert "SinglePartition" not in _plan(one)
