import math
import random

import pytest
from pyspark.sql import functions as F

from tabulon.functions.values import ValidationError
from tabulon.operators.filters import as_value, compile_filter, predicate, where
from tabulon.plans.introspect import explain

SCHEMA = "id long, name string, n int, x double, d decimal(10,2), at timestamp, ok boolean, raw binary, tags array<string>, staff array<struct<name: string, pay: int>>, head struct<city: string, zip: int>"


def table(seed, n=150):
    rng, maybe = random.Random(seed), None
    out = []
    for i in range(n):
        maybe = lambda v: None if rng.random() < 0.2 else v  # noqa: E731, B023
        staff = [maybe({"name": rng.choice("abc"), "pay": maybe(rng.randint(0, 5))}) for _ in range(rng.randint(0, 3))]
        out.append({
            "id": i, "name": maybe(rng.choice(["ann", "Bob", "Straße", "x😀", ""])), "n": maybe(rng.randint(-3, 3)),
            "x": maybe(rng.choice([0.0, -0.0, 1.5, math.nan, -2.5])), "d": None, "at": None, "ok": maybe(rng.random() < 0.5), "raw": None,
            "tags": maybe([maybe(rng.choice(["vip", "new", "old"])) for _ in range(rng.randint(0, 3))]), "staff": maybe(staff), "head": maybe({"city": maybe(rng.choice("PQ")), "zip": maybe(rng.randint(0, 4))}),
        })
    return out


def leaf(rng):
    ops = ["eq", "ne", "gt", "gte", "lt", "lte"]
    return rng.choice([
        lambda: {"n": {rng.choice(ops): rng.randint(-3, 3)}}, lambda: {"x": {rng.choice(ops): rng.choice([0.0, 1.5, -2.5])}},
        lambda: {"x": {rng.choice(["eq", "ne"]): math.nan}}, lambda: {"n": {"in": rng.sample(range(-3, 4), 3) + [None]}},
        lambda: {"name": {rng.choice(["contains", "icontains", "startsWith"]): rng.choice(["a", "B", "ß", ""])}},
        lambda: {rng.choice(["name", "n", "tags", "head", "raw"]): {"isNull": rng.random() < 0.5}}, lambda: {"name": None}, lambda: {"ok": "true"},
        lambda: {"tags": {rng.choice(["any", "all"]): rng.choice(["vip", None, {"in": ["new", "old"]}, {"ne": "vip"}])}},
        lambda: {"staff": {rng.choice(["any", "all"]): {"name": "a", "pay": {rng.choice(ops): rng.randint(0, 5)}}}},
        lambda: {"staff": {rng.choice(["any", "all"]): {"not": {"pay": rng.randint(0, 5)}}}},
        lambda: {"head": {"match": {"city": rng.choice(["P", None]), "zip": {"lte": 2}}}}, lambda: {"n": {"gte": -1, "lt": 2}},
    ])()


def tree(rng, depth):
    if depth == 0 or rng.random() < 0.25:
        return leaf(rng)
    kind = rng.choice(["and", "or", "not"])
    return {"not": tree(rng, depth - 1)} if kind == "not" else {kind: [tree(rng, depth - 1) for _ in range(rng.randint(0, 3))]}


def test_random_trees_agree_with_plain_python(spark):
    rng, rows = random.Random(5), table(5)
    df = spark.createDataFrame(rows, SCHEMA).cache()
    trees = [tree(rng, 3) for _ in range(120)]
    got = {r.id: r for r in df.select("id", *(as_value(t, df).alias(f"t{i}") for i, t in enumerate(trees))).collect()}
    for i, t in enumerate(trees):
        test = predicate(t, df.schema)
        for r in rows:
            assert got[r["id"]][f"t{i}"] == test(r), (t, r)


@pytest.mark.parametrize("bad", [{"nope": 1}, {"n": {}}, {"n": {"like": 1}}, {"n": "x"}, {"n": {"in": 3}}, {"n": {"gt": None}}, {"raw": 1}, {"name": {"any": 1}}, {"tags": "vip"}, {"n": {"contains": "1"}}, {"and": {}}, {"head": {"match": {"nope": 1}}}, {"ok": 3}, {"n": 1.5}, {"at": "never"}, []])
def test_mistakes_are_named_before_a_job(spark, bad):
    with pytest.raises(ValidationError):
        compile_filter(bad, spark.createDataFrame([], SCHEMA))


def test_filters_are_pushed_and_columns_pruned(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select("id", (F.col("id") % 7).alias("k"), F.lit("x").alias("wide")).write.parquet(path)
    df = spark.read.parquet(path)
    plan = explain(where(df, {"not": {"k": 3}, "id": {"gte": 10}}).select("id"))
    assert any("GreaterThanOrEqual(id,10)" in p for p in plan["pushed"]) and any("IsNull(k)" in p or "EqualTo(k" in p for p in plan["pushed"])
    assert plan["columns"] == ["id", "k"]


def test_long_lists_become_a_semi_join(spark):
    df = spark.range(5000).withColumn("v", F.col("id") * 2)
    got = where(df, {"v": {"in": list(range(0, 8000, 2))}, "id": {"lt": 3000}})
    assert got.count() == 3000 and explain(got)["joins"]
