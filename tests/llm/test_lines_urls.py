import random
import re
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from tabulon.llm import linededup, urlfilter


def brute_lines(docs, gram=2, window=3, long=25):
    """docs: (id, text) with distinct ids. The same rules, in plain loops over lines as strings' hashes."""
    import hashlib

    h = lambda x: int(hashlib.md5(x.strip(" \t\n\x0b\x0c\r").encode()).hexdigest()[:15], 16)
    seqs = {}
    for d, t in docs:
        lines = [] if t is None else t.split("\n")
        seqs[d] = [(i, h(x), len(re.findall(r"[^\x20\x09-\x0D]+", x))) for i, x in enumerate(lines)]
        seqs[d] = [x for x in seqs[d] if x[2]]
    marks = []
    for d, s in seqs.items():
        grams = [tuple(x[1] for x in s[i : i + gram]) for i in range(len(s) - gram + 1)]
        value = []
        for g in grams:
            v = 0
            for x in g:
                v = (v >> 1) ^ x
            value.append(v)
        picked = {min(range(i, min(i + window, len(value))), key=lambda j: (value[j], j)) for i in range(max(1, len(value) - window + 1))} if value else set()
        marks += [(grams[i], d, i) for i in picked] + [((x[1],), d, i) for i, x in enumerate(s) if x[2] >= long]
    first = {}
    for key, d, p in sorted(marks, key=lambda m: m[1:]):
        first.setdefault(key, (d, p))
    gone = {d: set() for d in seqs}
    for key, d, p in marks:
        d0, q = first[key]
        if (d, p) == (d0, q):
            continue
        a, b = [x[1] for x in seqs[d]], [x[1] for x in seqs[d0]]
        lo, hi = 0, 0
        while p - lo > 0 and q - lo > 0 and a[p - lo - 1] == b[q - lo - 1]:
            lo += 1
        while p + hi < len(a) and q + hi < len(b) and a[p + hi] == b[q + hi]:
            hi += 1
        gone[d] |= {seqs[d][j][0] for j in range(p - lo, p + hi)}
    return {d: (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]), len(gone[d])) for d, t in docs}


def test_lines_against_brute_force(spark):
    rng = random.Random(8)
    pool = [f"line {i} " + "w " * rng.choice([1, 3, 30]) for i in range(60)]
    docs = [(0, None), (1, ""), (2, "\n \n"), (3, "a\na\na\na\na\na"), (4, "a\na\na")]
    for i in range(5, 90):
        lines = [rng.choice(pool + ["", f"own {i}", f"other {i} {rng.random()}"]) for _ in range(rng.randint(0, 12))]
        at = rng.randrange(50)
        lines[2:2] = pool[at : at + rng.randint(0, 8)]
        docs.append((i, "\n".join(lines)))
    df = spark.createDataFrame([(d, t, 3, "x") for d, t in docs], "doc_id long, text string, n_lines int, line string").repartition(4)
    got = {r.doc_id: r for r in linededup.dedup_lines(df).collect()}
    want = brute_lines(docs)
    assert sum(n for _, n in want.values()) > 50
    assert {d: (r.text, r.n_removed) for d, r in got.items()} == want
    assert got[9].line == "x" and got[0].n_lines == 0


def test_lines_repeated_rows_null_ids_and_empty(spark):
    text = "\n".join(f"l {i}" for i in range(6))
    rows = [(None, text), (1, text), (1, text), (2, text + "\nmore")]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("1", 6), ("1", 6), ("2", 6), ("None", 0)]
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


URLS = ["http://A.Example.org/es/x?q=1", "https://example.org/en/123#top", "http://x.com/fr/", "http://x.com/de/1", "http://notexample.org/es/", "http://org/a", "http://org", "ftp://com/fr", None, "no url", "http://h.net?x=/de/", "http://a//b://c"]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in urlfilter.judge(df, none).collect()}
    for i, u in enumerate(URLS):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fit)[1:] if fit else (None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *want), u


def test_mined_rules_against_brute_force(spark):
    rng = random.Random(3)
    pages, labels = [], []
    for i in range(300):
        spam = rng.random() < 0.3
        host = rng.choice(["win", "bets"] if spam and rng.random() < 0.8 else ["news", "blog", "win"])
        pages.append((i, f"http://{host}.site.net/{rng.choice('ab')}/{rng.randrange(99)}?{rng.choice(['ref', 'page'])}=1"))
        labels.append((i, int(not spam), 0))
    df = spark.createDataFrame(pages, "page_id long, url string")
    options = {"min_support": 0.02, "min_confidence": 0.6}
    rules = {tuple(r.tokens): (r.support, r.confidence) for r in urlfilter.mine(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), **options).collect()}
    tokens = {r.page_id: r.t for r in df.select("page_id", urlfilter.tokens_of(F.col("url")).alias("t")).collect()}
    every, bad = Counter(), Counter()
    for i, q, _ in labels:
        for n in range(1, len(tokens[i]) + 1):
            for c in combinations(tokens[i], n):
                every[c] += 1
                bad[c] += q == 0
    sure = {c: bad[c] / every[c] for c in every if bad[c] >= 0.02 * 300 and bad[c] / every[c] >= 0.6}
    want = {c for c, x in sure.items() if not any(sure.get(c[:i] + c[i + 1 :], -1) >= x for i in range(len(c)))}
    assert set(rules) == want and want
    judged = {r.page_id: r.verdict for r in urlfilter.judge(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), **options).collect()}
    assert judged == {i: "block" if any(set(c) <= set(tokens[i]) for c in want) else "allow" for i, _ in pages}


def test_late_tokens_of_long_urls_are_mined(spark):
    deep = "/".join("abcdefghijklmn")
    pages = [(i, f"http://site{'xyz'[i % 3]}.net/{deep}/{'spam' if i % 4 == 0 else 'zine'}?ref=1&{'win=1&zip=2' if i % 4 == 0 else 'who=1'}") for i in range(120)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    options = {"min_support": 0.02, "min_confidence": 0.6}
    rules = {tuple(r.tokens): (r.support, r.confidence) for r in urlfilter.mine(df, labels, **options).collect()}
    assert rules == {(t,): (0.25, 1.0) for t in ("p:spam", "q:win", "q:zip")}
    judged = {r.page_id: r.verdict for r in urlfilter.judge(df, labels, **options).collect()}
    assert judged == {i: "allow" if i % 4 else "block" for i in range(120)}
