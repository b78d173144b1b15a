import hashlib
import random
import re

import numpy as np
import pytest

from tabulon.llm import substring


def brute(rows, window=20):
    """Every window of every document against all earlier ones; rows equal in id and text count once."""
    order = sorted({(d is not None, d or 0, d, t or "") for d, t in rows})
    assert len({x[:3] for x in order}) == len(order), "ties of the id need the operator's own tie break"
    seen, found = set(), {}
    for _, _, d, t in order:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        drop = [False] * len(words)
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                drop[i : i + window] = [True] * window
            seen.add(w)
        kept = [w for w, x in zip(words, drop, strict=True) if not x]
        found[d, t or ""] = (d, len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return sorted((found[d, t or ""] for d, t in rows), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "A", "a"]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [words(rng.randint(15, 90)) for _ in range(8)]
    texts = [None, "", "one two", "x " * 70, "x " * 26, "a b " * 40, " ".join(words(20))]
    for _ in range(90):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts += rng.choice([words(rng.randint(1, 40)), p, p[a:], p[: a + 20]])
        texts.append(rng.choice([" ", "\n", " \t"]).join(parts))
        if rng.random() < 0.3:
            texts.append(texts[rng.randrange(len(texts))])
        if rng.random() < 0.3:
            near = (texts[rng.randrange(len(texts))] or "").split()
            if near:
                near[rng.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    return rows + [(None, " ".join(passages[0])), rows[20], rows[20]]


@pytest.mark.parametrize("seed,hot", [(1, substring.HOT), (2, 3)])
def test_against_brute_force(spark, seed, hot):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, 7, "x") for d, t in rows], "doc_id long, text string, start int, anchor string").repartition(5)
    got = sorted((tuple(r) for r in substring.remove_repeats(df, hot=hot).collect()), key=str)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 0


def test_factors_point_at_equal_words(spark):
    rows = [r for r in corpus(3) if r[0] is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = {d: (t or "").split() for d, t in rows}
    found = substring.factors(df, substring.prepare(df)).collect()
    assert found
    for f in found:
        size = f.n + 19
        assert words[f.doc][f.start : f.start + size] == words[f.ref][f.ref_start : f.ref_start + size]
        assert (f.ref, f.ref_start) < (f.doc, f.start)


def test_empty_table(spark):
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_windows_that_differ_in_low_bits_only_are_not_equal(monkeypatch):
    import pyarrow as pa

    grams = substring._grams
    monkeypatch.setattr(substring, "_grams", lambda h, k: grams(h, k) & np.uint64(0xFFFFFFFF) if k == substring.WINDOW else grams(h, k))
    own = lambda i, side: " ".join(f"w{i}{side}{j}" for j in range(30))
    texts = pa.array([f"{own(i, 'a')} one passage of sixteen words that all of these documents share with each other and with none {own(i, 'b')}" for i in range(40)])
    runs = substring.Runs(texts, substring.WINDOW, substring.GRAM)
    anchors = np.unique(runs.anchor)
    assert len(anchors) < len(runs.anchor)
    wanted = pa.array([[{"anchor": int(a), "salts": 1} for a in anchors.view(np.int64)]] * len(texts), pa.list_(pa.struct([("anchor", pa.int64()), ("salts", pa.int64())])))
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, texts, wanted], names=["doc", "tie", "text", "wanted"])
    rows = pa.Table.from_batches(substring._blocks(substring.WINDOW, substring.GRAM)(iter([batch])))
    rows = rows.sort_by([(c, "ascending") for c in ("anchor", "salt", "doc", "tie", "start")])
    assert sum(b.num_rows for b in substring._parse(iter(rows.to_batches()))) == 0


def test_factors_against_a_plain_greedy_parse(spark):
    rows = [r for r in corpus(5) if r[0] is not None]
    rows = sorted(dict(rows).items())
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((f.doc, f.start, f.n, f.ref, f.ref_start) for f in substring.factors(df, substring.prepare(df)).collect())
    first, want = {}, []
    for d, t in rows:
        words, factor = (t or "").split(), None
        for i in range(len(words) - 19):
            place = first.setdefault(tuple(words[i : i + 20]), (d, i))
            if place == (d, i):
                factor = None
            elif factor and place == (factor[3], factor[4] + factor[2]):
                factor[2] += 1
            else:
                factor = [d, i, 1, *place]
                want.append(factor)
    assert got == sorted(map(tuple, want)) and max(f[2] for f in got) > 30


def test_many_documents_around_one_phrase_lose_nothing(spark):
    """40,000 documents share eight words and nothing else, so no window of twenty is found twice."""
    rng = np.random.default_rng(2)
    words = rng.integers(0, 10**9, (40_000, 28))
    phrase = "one common phrase that very many texts share"
    rows = [(i, " ".join(f"{x:x}" for x in w[:14].tolist()) + f" {phrase} " + " ".join(f"{x:x}" for x in w[14:].tolist())) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = substring.remove_repeats(df)
    assert got.where("n_removed > 0").count() == 0 and got.count() == 40_000
    assert {r.n_words for r in got.select("n_words").distinct().collect()} == {36}
