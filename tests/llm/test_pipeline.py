import importlib.util
import os
import random

from tabulon.llm import simhash

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def pipeline():
    spec = importlib.util.spec_from_file_location("corpus_pipeline", os.path.join(ROOT, "corpus_pipeline.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def near_corpus():
    rng = random.Random(6)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts = []
    for i in range(60):
        base = words(rng.choice([60, 200, 500]))
        texts.append(" ".join(base))
        for _ in range(i % 4):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    return texts


def test_near_duplicates_recall_against_brute_force(spark):
    texts = near_corpus()
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], COLUMNS).repartition(3)
    for bucket in (simhash.BUCKET, 2):
        rows = simhash.similar_documents(df, bucket=bucket).select("row.doc_id", "group").collect()
        group = {r.doc_id: r.group for r in rows}
        sets = [shingles(t) for t in texts]
        near = lone = 0
        for i in range(len(texts)):
            for j in range(i):
                s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
                if s >= 0.8:
                    near += 1
                    lone += group[i] != group[j]
                elif s == 0:
                    assert group[i] != group[j]
        assert near > 50 and lone <= 0.05 * near


def test_near_duplicates_in_a_family_of_similar_texts(spark):
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared, texts = words(162), []
    for _ in range(150):
        own = words(38)
        copy = list(own)
        copy[10], copy[25] = words(2)
        texts += [" ".join(shared + own), " ".join(shared + copy)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], COLUMNS).repartition(3)
    sets = [shingles(t) for t in texts]
    like = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert all(like(2 * i, 2 * i + 1) > 0.85 and 0.6 < like(2 * i, (2 * i + 2) % 300) < 0.75 for i in range(150))
    for bucket in (simhash.BUCKET, 50):
        group = {r.doc_id: r.group for r in simhash.similar_documents(df, bucket=bucket).select("row.doc_id", "group").collect()}
        assert sum(group[2 * i] == group[2 * i + 1] for i in range(150)) >= 0.95 * 150
        assert len({group[2 * i] for i in range(150)}) == 150


def test_keep_one_of_repeated_null_and_empty_rows(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(5, long, "en", "a", 1), (2, long.upper(), "en", "b", 1), (2, long.upper(), "en", "b", 1), (None, long, None, None, None), (7, None, "en", "a", 1), (8, "", "en", "a", 1), (9, "other words", "en", "a", 1)]
    got = simhash.keep_one(spark.createDataFrame(rows, COLUMNS)).collect()
    assert sorted(r.doc_id for r in got) == [2, 7, 9]
    assert simhash.keep_one(spark.createDataFrame([], COLUMNS)).collect() == []


def test_stages_hand_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        return
    module = pipeline()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    kept = []
    for i, (_, stage) in enumerate(module.STAGES):
        docs = stage(spark, docs, sf)
        if i < len(module.STAGES) - 1:
            assert docs.columns == names
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append({r.doc_id for r in docs.collect()})
    assert all(b <= a for a, b in zip(kept, kept[1:], strict=False)) and kept[-1]


def test_recall_of_planted_pairs_at_two_sizes(spark):
    """Pairs at a similarity just over 0.8 among texts that share nothing else."""
    rng = random.Random(12)
    for n in (500, 3000):
        texts = []
        for _ in range(n):
            base = [f"w{rng.randrange(50_000)}" for _ in range(60)]
            copy = list(base)
            copy[rng.randrange(10, 50)] = "changed"
            texts += [" ".join(base), " ".join(copy)]
        a, b = shingles(texts[0]), shingles(texts[1])
        assert 0.8 <= len(a & b) / len(a | b) < 0.85
        df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], COLUMNS).repartition(4)
        group = {r.doc_id: r.group for r in simhash.similar_documents(df).select("row.doc_id", "group").collect()}
        assert sum(group[2 * i] == group[2 * i + 1] for i in range(n)) >= 0.96 * n
        assert len({group[2 * i] for i in range(n)}) == n


def test_near_dedup_broadcasts_no_rows_of_the_buckets(spark):
    """A row for each mask and document must not be gathered on the driver, at whatever threshold for broadcasts."""
    rng = random.Random(14)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts + texts[:20])], COLUMNS).repartition(3)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    assert len(simhash.keep_one(df).collect()) == 400
    most = 0
    runs = store.executionsList(int(before), 1000)
    for i in range(runs.size()):
        run = runs.apply(i).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for j in range(nodes.size()):
            if nodes.apply(j).name().startswith("BroadcastExchange"):
                metrics = nodes.apply(j).metrics()
                for k in range(metrics.size()):
                    if metrics.apply(k).name() == "number of output rows" and values.contains(metrics.apply(k).accumulatorId()):
                        most = max(most, int(values.apply(metrics.apply(k).accumulatorId()).replace(",", "")))
    assert runs.size() > 3 and most <= 420
