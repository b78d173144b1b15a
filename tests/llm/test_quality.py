import random
import re
from collections import Counter

import numpy as np

from tabulon.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(hit)


def texts():
    rng = random.Random(4)
    w = [f"word{i}" for i in range(300)] + ["été", "😀x"]
    out = [None, "", " \n\t", "a b c a b c", "x " * 200, "A\n\nA\n A\nb\n", "é\x85ü z a", "# * $% &|<>"]
    for i in range(220):
        n = rng.randint(40, 300)
        part = [rng.choice(w) for _ in range(n)]
        if i % 6 == 0:
            part = [p + rng.choice(["###", "$$$", "&&&"]) for p in part]
        out.append(rng.choice([" ", "\n"]).join(part))
    return out


def test_statistics_against_brute_force_and_verdicts(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, 3, True) for i, t in enumerate(rows)] + [(9, rows[9], 3, True), (None, rows[9], 3, True)], "doc_id long, text string, n_words int, kept boolean")
    labels = spark.createDataFrame([(i, int((i - 8) % 6 != 0), 0) for i in range(8, len(rows))] + [(None, 1, 1), (3, None, 1)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        text = rows[9 if r.doc_id is None else r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    judged = [(r.doc_id, r.kept) for r in got if r.doc_id is not None and r.doc_id >= 8 and not r.base_failed]
    assert np.mean([k == ((i - 8) % 6 != 0) for i, k in judged]) > 0.95


def test_without_labels_and_without_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string"), labels).collect() == []
    got = quality.judge(spark.createDataFrame([(1, " ".join(map(str, range(60)))), (2, "a")], "doc_id long, text string"), labels).collect()
    assert sorted((r.doc_id, r.kept) for r in got) == [(1, True), (2, False)]


def test_paths_are_shorter_for_outliers():
    rng = np.random.default_rng(1)
    rows = np.vstack([rng.normal(0, 1, (400, 3)), [[9, 9, 9]]])
    score = quality.Forest(rows).score(rows)
    assert score.argmax() == 400 and score[400] > 0.6


def test_fit_does_not_depend_on_the_order_of_repeated_ids(spark):
    rng = random.Random(5)
    line = lambda i: " ".join(rng.choice(["Abc", "de", "x1!", "#", f"w{rng.randrange(99)}"]) for _ in range(60 + i % 40))
    rows = [(1, line(i)) for i in range(300)] + [(i, line(i)) for i in range(2, 12)]
    labels = spark.createDataFrame([(i, int(i != 7)) for i in range(1, 12)], "doc_id long, quality int")
    cuts = []
    for order in (rows, rows[::-1]):
        model = quality.fit(spark.createDataFrame(order, "doc_id long, text string").coalesce(1), labels, 11)
        assert model is not None
        cuts.append(model[1])
    assert cuts[0] == cuts[1]


def test_scores_against_plain_paths():
    """Each row walked down each tree by itself, and the mean path turned into a score."""
    rng = np.random.default_rng(3)
    rows = np.round(rng.normal(0, 1, (300, 4)), 1)
    forest = quality.Forest(rows, trees=20, subsample=64)

    def path(tree, row):
        column, cut, left, right, length = (x.tolist() for x in tree)
        at = 0
        while column[at] >= 0:
            at = left[at] if row[column[at]] <= cut[at] else right[at]
        return length[at]

    def expected(n):
        return 0 if n <= 1 else 1 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    want = [2 ** (-np.mean([path(t, r) for t in forest.trees]) / expected(64)) for r in rows]
    assert np.allclose(forest.score(rows), want)
    # every leaf's length is its depth and what rows that are still together there would take
    for column, _, left, right, length in forest.trees:
        def walk(at, depth, column=column, left=left, right=right, length=length):
            if column[at] < 0:
                assert length[at] >= depth
                return
            walk(left[at], depth + 1)
            walk(right[at], depth + 1)

        walk(0, 0)


def test_verdicts_on_unseen_documents(spark):
    """Enough labels that the threshold comes from rows the forests have not seen; rates on new documents are as on known ones."""
    rng = random.Random(8)
    w = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(2400):
        part = [rng.choice(w) for _ in range(rng.randint(60, 160))]
        if i % 6 == 0:
            part = [p + rng.choice(["###", "$$$", "&&&"]) if rng.random() < 0.7 else p for p in part]
        rows.append((i, " ".join(part)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = [(i, int(i % 6 != 0)) for i in range(2400) if i % 5]
    assert len(known) > quality.PARTS * quality.SUBSAMPLE
    got = quality.judge(docs, spark.createDataFrame(known, "doc_id long, quality int")).collect()
    kept = lambda new, good: np.mean([r.kept for r in got if (r.doc_id % 5 == 0) == new and (r.doc_id % 6 != 0) == good])
    assert abs(kept(True, True) - kept(False, True)) < 0.05 and abs(kept(True, False) - kept(False, False)) < 0.05
    assert kept(True, True) > 0.8 and kept(True, False) < 0.1


def test_fit_takes_every_label(spark, monkeypatch):
    """22,000 labelled rows: the draws reach all of them, and the threshold is that of a plain search over the scores of all."""
    n = 22_000
    docs = spark.range(n).selectExpr("id doc_id", "concat('w', id, if(id % 7 = 0, '## ', ' '), array_join(transform(sequence(1, 60 + id % 40), i -> concat('x', (i * (id % 96 + 1)) % 97)), ' ')) text")
    labels = spark.range(n).selectExpr("id doc_id", "cast(id % 7 <> 0 as int) quality")
    seen = {}
    threshold = quality._threshold

    def spy(found, forest, others):
        seen["rows"], seen["forests"] = found.toPandas(), (forest, others)
        return threshold(found, forest, others)

    monkeypatch.setattr(quality, "_threshold", spy)
    model = quality.fit(docs, labels)
    rows, (forest, others) = seen["rows"], seen["forests"]
    assert len(rows) == n and rows.n.sum() == n and rows.good.sum() + rows.bad.sum() == n
    x, score = quality.features({s: rows[s].to_numpy() for s in quality.STATS}), np.zeros(n)
    for p in range(quality.PARTS):
        at = (rows.part == p).to_numpy()
        score[at] = others[p].score(x[at])
    cuts, good = np.unique(score), rows.good.to_numpy() == 1
    above = lambda some: 1 - np.searchsorted(np.sort(some), cuts, side="right") / len(some)
    gain = above(score[~good]) - quality.COST * above(score[good])
    assert abs(gain[np.searchsorted(cuts, model[1])] - gain.max()) < 1e-9 and model[1] in cuts
    assert quality.draws(n).max() > 0.99 * n


def test_labels_that_an_id_has_more_than_once_count_as_often(spark):
    """Without a square of the repeats: an id's labels and rows are counted before they are joined."""
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text)] * 50 + [(2, text + " more")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 40 + [(1, 0)] * 3 + [(2, 0), (None, 1), (2, None)], "doc_id long, quality int")
    rows = quality._labelled(quality.with_statistics(docs), labels).collect()
    assert sorted((r.doc_id, r.n, r.good, r.bad) for r in rows) == [(1, 50, 40, 3), (2, 1, 0, 1)]
    assert quality.fit(docs, labels) is not None and quality.judge(docs, labels).count() == 51


def test_bad_labels_beyond_the_first_20000_by_hash_count(spark):
    """A fit on the 20,000 labels least by this hash would know none of the bad ones, and reject nothing."""
    n = 22_000
    order = spark.range(n).selectExpr("id doc_id", "cast(row_number() over (order by xxhash64(cast(id as string), 7), id) <= 20000 as int) quality")
    text = "concat('w', doc_id, if(quality = 0, ' ## %%', ' '), array_join(transform(sequence(1, 60 + doc_id % 40), i -> concat(if(quality = 0 and i % 2 = 0, '#$', 'x'), (i * (doc_id % 96 + 1)) % 97)), ' ')) text"
    got = quality.judge(order.selectExpr("doc_id", text), order).join(order, "doc_id").groupBy("quality").avg("anomaly").collect()
    model = quality.fit(order.selectExpr("doc_id", text), order)
    assert model is not None and {r.quality: r[1] for r in got}[0] > {r.quality: r[1] for r in got}[1]
