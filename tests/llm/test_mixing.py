import random

import pytest
from pyspark.sql import functions as F

from tabulon.llm import mixing


def water_fill(sizes, weights, total):
    """Targets by sharing the excess again and again."""
    target, live, left = {}, dict(weights), total
    while live:
        level = left / sum(live.values())
        over = [s for s in live if live[s] * level > 2 * sizes[s]]
        if not over:
            return target | {s: w * level for s, w in live.items()}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            del live[s]
    return target


@pytest.mark.parametrize("cells,sources", [(4, 7), (mixing.CELLS, 5)])
def test_targets_and_sample(spark, monkeypatch, cells, sources):
    monkeypatch.setattr(mixing, "CELLS", cells)
    rng = random.Random(cells)
    rows = []
    for i in range(600):
        s = rng.choice([None] + [f"s{j}" for j in range(sources)]) if i % 3 else "s0"
        rows.append((i, None if i % 50 == 0 else "w " * rng.randint(0, 40), s, 1.5))
    rows += [(None, "a b c", "s1", 0.0), (5, rows[5][1], rows[5][2], 0.0), (5, rows[5][1], rows[5][2], 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size double").repartition(3)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    want = water_fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 40, s
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in again) == sorted((r.doc_id or -1, r.taken) for r in got)


def test_odds_favour_rows_and_edges(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w w w w").alias("text"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"), F.when(F.col("id") % 2 == 0, 9.0).otherwise(1.0).alias("weight"))
    got = mixing.mix(df, weights=(1, 3), share=1.0, odds=F.col("weight")).toPandas()
    a = got[got.source == "a"]
    assert abs(a.taken.sum() - 4000) <= 4
    assert a[a.doc_id % 2 == 0].copies.sum() > 2 * a[a.doc_id % 2 == 1].copies.sum()
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    nothing = mixing.mix(spark.createDataFrame([(1, None, None), (2, " ", "x")], "doc_id long, text string, source string")).collect()
    assert [r.taken for r in nothing] == [0, 0] and [r.target for r in nothing] == [0, 0]


def test_many_repeated_rows_come_near_the_target(spark):
    text = "w " * 8
    rows = [(1, text, "a")] * 1000 + [(2, text, "b")] * 1000 + [(10 + i, text, "c") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(df).toPandas()
    for source, part in got.groupby("source"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 8, source
        assert (part.taken <= 2 * part["size"]).all()
    again = mixing.mix(df.repartition(3)).toPandas()
    by = ["doc_id", "taken"]
    assert (got[by].sort_values(by).to_numpy() == again[by].sort_values(by).to_numpy()).all()
    copies = mixing.with_copies(df).select("row.doc_id", "copies").toPandas()
    want = got[got.copies > 0]
    assert (copies.sort_values(["doc_id", "copies"]).to_numpy() == want[["doc_id", "copies"]].sort_values(["doc_id", "copies"]).to_numpy()).all()
