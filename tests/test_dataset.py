import datetime as dt

import pytest

from tabulon.functions.values import ValidationError
from tabulon.operators import access, changes
from tabulon.operators.orders import ROW_ID
from tabulon.sources.dataset import Dataset, GroupWriter
from tabulon.streaming.ingest import append_stream, upsert_stream


def rows(df, *names):
    return [tuple(r) for r in df.orderBy(ROW_ID).select(*names).collect()]


@pytest.fixture
def data(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 10.0), (2, "b", None), (2, "b2", 5.0), (None, "n", 1.0)], "id long, name string, v double").coalesce(1)
    return Dataset.create(spark, str(tmp_path / "d"), {"t": df})


def test_update_replaces_in_place_and_appends(data):
    got = data.update("t", insert=[{"id": 9, "name": "new"}], upsert=[{"id": 2, "name": "x"}, {"id": 2, "name": "last"}, {"id": None, "name": "m"}, {"id": 5, "name": "y"}], key_columns=["id"], delete={"name": "b"}, set_={"v": "7.5"}, where={"id": 1})
    assert rows(data.table("t"), "id", "name", "v") == [(1, "a", 7.5), (2, "last", None), (None, "m", None), (9, "new", None), (5, "y", None)]
    assert got["rowCount"] == 5 and got["inserted"] == 2
    with pytest.raises(ValidationError):
        data.update("t", insert=[{"nope": 1}])
    with pytest.raises(ValidationError):
        data.update("t", set_={"v": 1})


def test_append_delete_versions_and_compact(data, spark):
    old = Dataset(spark, data.path)
    got = data.append("t", insert=[{"id": 7, "name": "z"}], upsert=[{"id": 1, "name": "A"}], key_columns=["id"], delete={"v": {"lt": 6}})
    assert got == {"inserted": 1, "updated": 1, "deleted": 2, "rowCount": 3}
    assert rows(data.table("t"), "id", "name") == [(2, "b"), (1, "A"), (7, "z")]
    assert old.changed() and old.table("t").count() == 4 and old.refresh().table("t").count() == 3
    data.compact("t")
    assert rows(data.table("t"), ROW_ID, "id") == [(0, 2), (1, 1), (2, 7)]
    assert data.verify() == [] and data.storage()["unused"] > 0
    data.vacuum()
    assert data.storage()["unused"] == 0


def test_transaction_clashes_and_single_commit(data):
    before = data.version
    data.begin().add("t", insert=[{"id": 50, "name": "p"}]).add("t", delete={"id": 1}).commit()
    assert data.version == before + 1 and data.table("t").count() == 4
    t = data.begin().add("t", insert=[{"id": 60, "name": "q"}])
    with pytest.raises(ValidationError):
        t.add("t", delete={"id": 60})
    with pytest.raises(ValidationError):
        t.add("t", upsert=[{"id": 60}], key_columns=["id"])
    t.rollback()
    assert data.table("t").count() == 4


def test_sorted_table_keeps_its_order(spark, tmp_path):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (None, "n"), (2, "b")], "id long, name string")
    d = Dataset.create(spark, str(tmp_path / "s"), {"t": df}, {"t": {"sortedBy": ["id"]}})
    assert [r[0] for r in rows(d.table("t"), "id")] == [None, 1, 2, 3]
    d.append("t", insert=[{"id": 4}])
    with pytest.raises(ValidationError):
        d.append("t", insert=[{"id": 0}])
    d.update("t", insert=[{"id": 0}])
    assert [r[0] for r in rows(d.table("t"), "id")] == [None, 0, 1, 2, 3, 4]


def test_group_writer_isolates_the_bad_call(data):
    w = GroupWriter(data, "t", max_rows=100)
    for r in ([{"id": 70}], [{"bad": 1}], [{"id": 71}]):
        w.insert(r)
    w.flush()
    assert len(w.failed) == 1 and data.table("t").count() == 6


def test_second_writer_is_refused(data, spark):
    other = Dataset(spark, data.path)
    data.append("t", insert=[{"id": 8}])
    with pytest.raises(ValidationError):
        other.append("t", insert=[{"id": 9}])


def test_links_tables_and_metadata(spark, tmp_path):
    a = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "id long, b long")
    b = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    link = {"name": "ab", "from": {"table": "a", "columns": ["b"]}, "to": {"table": "b", "columns": ["id"]}}
    d = Dataset.create(spark, str(tmp_path / "l"), {"a": a, "b": b}, links=[link])
    [report] = d.check_links()
    assert (report["rows"], report["empty"], report["missing"], report["examples"], report["duplicateTargets"]) == (3, 1, 1, [{"b": 9}], 1)
    with pytest.raises(ValidationError):
        d.remove_table("b")
    d.rename_table("b", "c")
    d.merge_metadata({"x": 1})
    assert d.inspect()["links"][0]["to"]["table"] == "c" and d.manifest["metadata"] == {"x": 1}


def test_streams_apply_each_batch_once(spark, tmp_path, data):
    source = str(tmp_path / "in")
    spark.createDataFrame([(100, "s", 1.0), (1, "up", 2.0)], "id long, name string, v double").write.parquet(source)
    stream = spark.readStream.schema("id long, name string, v double").parquet(source)
    append_stream(stream, data.path, "t", str(tmp_path / "c1")).awaitTermination()
    assert data.refresh().table("t").count() == 6
    upsert_stream(stream, data.path, "t", ["id"], str(tmp_path / "c2")).awaitTermination()
    assert data.refresh().manifest["metadata"]["stream:t"] == 0


def test_changes_conflicts_and_submissions(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "y")], "id long, name string, part string")
    after = spark.createDataFrame([(1, "A", "x"), (3, "c", "y"), (4, "d", "y")], "id long, name string, part string")
    made = changes.diff(base, after, ["id"])
    assert sorted((r.op, r.id) for r in made.collect()) == [("delete", 2), ("insert", 4), ("update", 1)]
    done, judged = changes.apply_changes(base, made, ["id"])
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, after.collect())) and judged.where("conflict is not null").count() == 0
    moved = spark.createDataFrame([(1, "z", "x"), (4, "q", "y")], "id long, name string, part string")
    _, judged = changes.apply_changes(moved, made, ["id"])
    assert {r.id: r.conflict for r in judged.collect()} == {1: "changed", 2: "missing", 4: "exists"}
    refused = changes.classify(base, made, ["id"], access.Grant(edit=("part",)))
    assert {r.id: r.conflict for r in refused.collect()}[1] == "refused"
    sent = spark.createDataFrame([(1, "", None), (2, "B", "x"), (9, "n", None)], "id long, name string, part string")
    got = changes.merge_submission(base, sent, ["id"], "part", "x")
    assert sorted(map(tuple, got.collect())) == [(1, "a", "x"), (2, "B", "x"), (3, "c", "y"), (9, "n", "x")]


def test_grants_and_masks(spark):
    df = spark.createDataFrame([(1, "x", "12345678", "joe@example.org"), (2, None, "12", None), (3, "y", "ABcd-12", "a@b")], "id long, part string, card string, mail string")
    policy = access.Policy("part", {"private": ("mail",)}, (access.Mask("card", "last", 4),))
    got = access.view(df, policy, access.Grant(rows=("x", ""), columns=())).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "x", "••••5678"), (2, None, "••••")]
    assert access.view(df, policy, access.Grant(unmasked=("card",))).where("id = 1").first().card == "12345678"
    shown = access.view(df, access.Policy(masks=(access.Mask("card", "keepFormat"), access.Mask("mail", "email", rows={"id": {"lt": 3}}))), access.Grant()).orderBy("id").collect()
    assert [(r.card, r.mail) for r in shown] == [("00000000", "j••••@example.org"), ("00", None), ("XXxx-00", "a@b")]
    with pytest.raises(PermissionError):
        access.view(df, policy, access.Grant(expires=dt.datetime(2020, 1, 1)))


def test_row_ids_of_many_wide_rows(spark):
    """Adaptive execution cuts wide and narrow rows differently; ids must not depend on that."""
    from pyspark.sql import functions as F

    from tabulon.operators.orders import with_row_ids

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        df = spark.range(0, 1_000_000, 1, 16).select(F.xxhash64("id").alias("k"), "id", *(F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(i))), 512).alias(f"w{i}") for i in range(2)))
        got = with_row_ids(df, "k", "id").select("k", ROW_ID)
        n, distinct, least, most = got.agg(F.count(F.lit(1)), F.count_distinct(ROW_ID), F.min(ROW_ID), F.max(ROW_ID)).first()
        assert (n, distinct, least, most) == (1_000_000, 1_000_000, 0, 999_999)
        after = got.select((F.col(ROW_ID) - 1).alias(ROW_ID), F.col("k").alias("next"))
        assert got.join(after, ROW_ID).where("next < k").isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_two_streams_into_one_table(spark, tmp_path, data):
    for i in (1, 2):
        source = str(tmp_path / f"in{i}")
        spark.createDataFrame([(100 + i, "s", 1.0)], "id long, name string, v double").write.parquet(source)
        stream = spark.readStream.schema("id long, name string, v double").parquet(source)
        for _ in range(2):  # the second start of the same stream adds nothing
            append_stream(stream, data.path, "t", str(tmp_path / f"k{i}")).awaitTermination()
    assert sorted(r.id for r in data.refresh().table("t").collect() if r.id and r.id > 100) == [101, 102]


def test_transaction_with_overlapping_deletes(spark, tmp_path):
    d = Dataset.create(spark, str(tmp_path / "o"), {"t": spark.range(10).withColumnRenamed("id", "k")})
    got = d.begin().add("t", delete={"k": {"lt": 5}}).add("t", delete={"k": {"lt": 7}}).add("t", upsert=[{"k": 8}], key_columns=["k"]).commit()["t"]
    assert got == {"inserted": 0, "updated": 1, "deleted": 7, "rowCount": 3}
    assert d.verify() == [] and sorted(r.k for r in d.table("t").collect()) == [7, 8, 9]


def test_random_calls_against_plain_python(spark, tmp_path):
    import random

    rng = random.Random(4)
    d = Dataset.create(spark, str(tmp_path / "r"), {"t": spark.createDataFrame([(i % 7, i) for i in range(20)], "k long, v long").coalesce(1)})
    plain = [(i % 7, i) for i in range(20)]
    for step in range(8):
        k, low = rng.randrange(9), rng.randrange(30)
        match rng.choice(["append", "update", "transaction", "compact"]):
            case "append":
                d.append("t", insert=[{"k": k, "v": 100 + step}], delete={"v": {"lt": low % 10}})
                plain = [r for r in plain if r[1] >= low % 10] + [(k, 100 + step)]
            case "update":
                d.update("t", upsert=[{"k": k, "v": 200 + step}], key_columns=["k"])
                first = next((i for i, r in enumerate(plain) if r[0] == k), None)
                rest = [r for i, r in enumerate(plain) if r[0] != k or i == first]
                plain = [(k, 200 + step) if r[0] == k else r for r in rest] if first is not None else [*plain, (k, 200 + step)]
            case "transaction":
                d.begin().add("t", delete={"k": k}).add("t", upsert=[{"k": (k + 1) % 9, "v": 300 + step}], key_columns=["k"]).commit()
                plain = [r for r in plain if r[0] not in (k, (k + 1) % 9)] + [((k + 1) % 9, 300 + step)]
            case _:
                d.compact("t")
        assert rows(d.table("t"), "k", "v") == plain, step
    assert d.verify() == []


def test_several_tables_in_one_version_lock_and_checksums(spark, tmp_path):
    d = Dataset.create(spark, str(tmp_path / "m"), {"a": spark.range(3), "b": spark.range(4)})
    version = d.version
    got = d.update_tables({"a": {"insert": [{"id": 9}]}, "b": {"delete": {"id": 0}}})
    assert d.version == version + 1 and got["a"]["rowCount"] == 4 and got["b"]["deleted"] == 1
    d.files.write("writer.lock", '{"owner": "another", "since": 4102444800}')
    with pytest.raises(ValidationError, match="locked by another"):
        d.append("a", insert=[{"id": 10}])
    d.files.write("writer.lock", '{"owner": "another", "since": 0}', True)
    d = d.refresh()
    d.append("a", insert=[{"id": 10}])
    with d.lock():
        d.append("a", insert=[{"id": 11}])
        d.append("b", insert=[{"id": 12}])
    assert not d.files.exists("writer.lock") and d.verify() == []
    wrong = d.manifest["tables"]["a"]["segments"][0]["path"]
    spark.range(4).selectExpr("id + 1 as id", "id as _row_id").write.mode("overwrite").parquet(f"{d.path}/{wrong}")
    assert len(d.verify()) == 1


@pytest.mark.parametrize("keys,good,bad", [(["-id"], 1, 9), ([{"column": "name", "natural": True}], 10, 1), (["id"], 9, 0)])
def test_appends_keep_declared_orders_of_any_kind(spark, tmp_path, keys, good, bad):
    df = spark.createDataFrame([(i, f"a{i}") for i in (2, 5, 3)], "id long, name string")
    d = Dataset.create(spark, str(tmp_path / "s"), {"t": df}, {"t": {"sortedBy": keys}})
    with pytest.raises(ValidationError):
        d.append("t", insert=[{"id": bad, "name": f"a{bad}"}])
    d.append("t", insert=[{"id": good, "name": f"a{good}"}])
    assert rows(d.table("t"), "id")[-1] == (good,)


def test_group_writer_of_many_threads_and_a_delay(data):
    import threading
    import time

    w = GroupWriter(data, "t", max_rows=1000, max_delay=0.5)
    threads = [threading.Thread(target=w.insert, args=([{"id": 500 + i}],)) for i in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    for _ in range(150):
        if data.refresh().table("t").where("id >= 500").count() == 12:
            break
        time.sleep(0.2)
    w.close()
    assert not w.failed and data.refresh().table("t").where("id >= 500").count() == 12
