import dataclasses

import pytest

from tabulon.functions.values import ValidationError
from tabulon.operators import rows
from tabulon.plans import introspect


@dataclasses.dataclass
class Person:
    id: int
    name: str | None


def test_columns_batches_and_objects(spark):
    df = rows.from_objects(spark, [Person(1, "a"), Person(2, None), Person(3, "c")])
    got = rows.column_arrays(df, {"id": {"gt": 1}}, ["id", "name"])
    assert got["id"][0].tolist() == [2, 3] and got["name"][1].tolist() == [True, False]
    assert rows.column_arrays(df, None, ["id"], 1, 1)["id"][0].tolist() == [2]
    assert list(rows.typed(df.where("id < 3"), Person)) == [Person(1, "a"), Person(2, None)]
    assert sum(b.num_rows for b in rows.batches(df)) == 3
    with pytest.raises(ValidationError):
        rows.select(df, ["nope"])
    with pytest.raises(ValidationError):
        rows.column_arrays(spark.createDataFrame([(2**60,)], "big long"))


def test_estimate_and_advice(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id", "id % 10 as k").repartitionByRange(5, "id").write.parquet(path)
    df = spark.read.parquet(path)
    got = introspect.estimate(df, {"id": {"gte": 900}})
    assert got["rows"] == 1000 and 0 < got["candidateFiles"] < got["files"]
    by = {a["column"]: a["advice"] for a in introspect.advise(df, ["id", "k"])}
    assert by == {"id": "fine", "k": "sort or partition by it"}
    assert introspect.analyze(df, {"k": 3})["rows"] == 100


def test_progress_and_cancel(spark):
    import threading
    import time

    import pytest
    from pyspark.sql import functions as F

    from tabulon.plans.introspect import with_progress

    slow = spark.range(0, 8, 1, 8).select(F.pandas_udf(lambda x: (time.sleep(0.4), x)[1], "long")("id").alias("x"))
    seen = []
    assert with_progress(spark, lambda: slow.count() or slow.agg(F.sum("x")).first()[0], seen.append) is not None and seen[-1]["done"] <= seen[-1]["tasks"]
    stop = threading.Event()
    stop.set()
    endless = spark.range(0, 64, 1, 64).select(F.pandas_udf(lambda x: (time.sleep(3), x)[1], "long")("id").alias("x"))
    began = time.time()
    with pytest.raises(Exception, match="(?i)cancel"):
        with_progress(spark, lambda: endless.agg(F.sum("x")).first(), lambda _: None, stop)
    assert time.time() - began < 40


def test_batches_stream_in_order(spark):
    from tabulon.operators import rows
    from tabulon.operators.query import from_

    df = spark.range(1000).withColumnRenamed("id", "_row_id").selectExpr("_row_id", "999 - _row_id as v").repartition(5)
    got = [v for b in rows.batches(df.orderBy("_row_id"), None, ["v"]) for v in b.column(0).to_pylist()]
    assert got == list(range(999, -1, -1))
    assert [r["v"] for r in from_(df).order_by("v")] == list(range(1000))
    placed = from_(df).order_by("v").select(lambda r: {"i": r.i, "v": r.v}, index="i").frame()
    assert sorted(map(tuple, placed.collect())) == [(i, i) for i in range(1000)]
