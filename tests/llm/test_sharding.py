from collections import Counter, defaultdict

import numpy as np
import pytest

from tabulon.llm import sharding


@pytest.mark.parametrize("rows,bucket_bytes", [(0, 100), (5, 100), (803, 700)])
def test_every_row_once_and_even_shards(spark, rows, bucket_bytes):
    data = [(None if i % 3 == 0 else i % 50, None if i % 7 == 0 else "text " * (i % 9), i, "s") for i in range(rows)]
    df = spark.createDataFrame(data, "doc_id long, text string, extra int, shard string")
    got = sharding.shuffle(df, 16, 5, bucket_bytes).collect()
    assert Counter((r.doc_id, r.text, r.extra) for r in got) == Counter(x[:3] for x in data)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    sizes = [len(slots[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    if rows > 100:
        at = {r.extra: (r.shard, r.slot) for r in got}
        order = sorted(at, key=at.get)
        assert abs(np.corrcoef(order, range(rows))[0, 1]) < 0.15


def test_fisher_yates_is_a_uniform_permutation():
    seen = Counter(tuple(sharding.fisher_yates(4, s)) for s in range(4800))
    assert len(seen) == 24 and min(seen.values()) > 140 and max(seen.values()) < 270


def test_reruns_agree_and_files_hold_the_shards(spark, tmp_path):
    df = spark.range(300).selectExpr("id as doc_id", "repeat('x', cast(id % 40 as int)) as text")
    first, again = (sorted(sharding.shuffle(df, 4, 1, 900).collect()) for _ in range(2))
    assert first == again
    path = sharding.write_shards(df, str(tmp_path / "out"), shards=4, seed=1, bucket_bytes=900)
    back = spark.read.parquet(path).select("doc_id", "text", "shard", "slot").collect()
    assert sorted(tuple(r) for r in back) == [tuple(r) for r in first]


def test_clashing_columns_are_kept_and_cuts_do_not_matter(spark):
    data = [(i % 90, f"t{i % 90}", i % 90, i % 7, 5) for i in range(90)]
    df = spark.createDataFrame(data, "doc_id long, text string, begin int, scatter int, bucket int")
    first, again = (sorted(sharding.shuffle(df.repartition(n), 4, 1, 300).collect()) for n in (1, 7))
    assert first == again and first[0].asDict().keys() == {"doc_id", "text", "begin", "scatter", "bucket", "shard", "slot"}
    assert all((r.begin, r.bucket) == (r.doc_id, 5) for r in first)


def test_repeated_rows_spread(spark):
    df = spark.createDataFrame([(1, "same text")] * 900 + [(i, f"own {i}") for i in range(2, 300)], "doc_id long, text string")
    got = sharding.shuffle(df, 4, 1, 2000).collect()
    assert len(got) == 1198
    for s in range(4):
        part = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in part) == list(range(len(part)))
        assert 0.6 < sum(r.doc_id == 1 for r in part) / len(part) < 0.9


def test_against_a_plain_two_pass_shuffle(spark):
    """The same scatter and swaps in plain Python over the whole table."""
    from pyspark.sql import functions as F

    rows = [(i, "x" * (i % 30)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64(F.lit(9), "doc_id", "text").alias("h")).collect()}
    total = sum(len(t) + sharding.ROW_BYTES for _, t in rows)
    buckets = -(-total // 1000)
    order = []
    for b in range(buckets):
        held = sorted((h, d) for d, h in hashes.items() if h % buckets == b)
        order += [held[i][1] for i in sharding.fisher_yates(len(held), 9 + b)]
    shard = [p * 5 // 400 for p in range(400)]
    want = {d: (shard[p], p - shard.index(shard[p])) for p, d in enumerate(order)}
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle(df.repartition(3), 5, 9, 1000).collect()} == want
