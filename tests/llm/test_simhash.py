import random
import re

import numpy as np
import pytest
import xxhash

from tabulon.llm import simhash


def brute_print(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=2):
    comp = list(range(len(prints)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                comp[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def near_texts(n, seed):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gamma", "Été", "x", "ßq", "y z"] + [f"w{i}" for i in range(300)]
    out = [None, "", " \t\n", "one", "One two", "one two three"]
    while len(out) < n:
        base = [rng.choice(words) for _ in range(rng.randint(1, 60) if rng.random() < 0.5 else 400)]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append("\n".join(copy))
    return out[:n]


def test_against_brute_force(spark):
    texts = near_texts(250, 1) + ["same words here now"] * 30
    df = spark.createDataFrame([(i, t, 5, "m") for i, t in enumerate(texts)], "doc_id long, text string, fp int, mask string")
    rows = sorted(simhash.near_duplicates(df).collect())
    prints = [brute_print(t) for t in texts]
    assert [r.fp % 2**64 for r in rows] == prints
    assert [r.component_id for r in rows] == brute_components(prints)


@pytest.mark.parametrize("node", [4, 16, 2048])
def test_refined_nodes_lose_no_link(spark, node):
    rng = random.Random(node)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for center in list(fps)[:6]:
        marginal = rng.sample(range(64), 20)
        for _ in range(120):
            fps.add(center ^ sum(1 << b for b in marginal if rng.random() < 0.15))
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    root = {r.node: r.root for r in simhash.connected(simhash.near_pairs(df, 2, node), "t").collect()}
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    mine, want = [root.get(s, s) for s in signed], brute_components(fps)
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def test_tree_search_finds_all_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 50, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 50).astype(np.uint64)) for _ in range(8)]))
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    found = {(i, j) for a, b in simhash.links(fps, 2) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 2}
    assert found == want


def test_empty_table_and_null_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = simhash.near_duplicates(spark.createDataFrame([(None, "a b"), (None, None), (3, "a b")], "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in rows), key=str) == sorted([(3, 3), (None, 3), (None, None)], key=str)


def test_wide_tree_against_all_pairs():
    rng = np.random.default_rng(4)
    for n, radius in ((1, 5), (2, 128), (9, 40), (300, 29), (900, 6)):
        centre = rng.integers(0, 2**63, (2, 7), dtype=np.uint64)
        f = centre[:, rng.integers(0, 7, n)]
        for _ in range(12):
            f = f ^ (np.uint64(1) << rng.integers(0, 64, (2, n)).astype(np.uint64)) * rng.integers(0, 2, (2, n)).astype(np.uint64)
        root = rng.integers(0, 5, n)
        root[: n // 2] = 3
        got = {(min(i, j), max(i, j)) for a, b in simhash.wide_links(f, root, radius) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        far = np.bitwise_count(f[:, :, None] ^ f[:, None, :]).sum(0, dtype=np.int64)
        want = {(i, j) for i in range(n) for j in range(i + 1, n) if far[i, j] <= radius and root[i] != root[j]}
        assert got == want


def test_one_large_node_at_the_default_size(spark):
    """Over a thousand fingerprints that share all upper bits go through the tree and lose no link."""
    rng = random.Random(3)
    fps = sorted({0xABCD << 48 | sum(1 << b for b in range(20) if rng.random() < 0.5) for _ in range(1600)})
    assert len(fps) > 1000
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    root = {r.node: r.root for r in simhash.connected(simhash.near_pairs(df, 2), "t").collect()}
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    mine, want = [root.get(s, s) for s in signed], brute_components(fps)
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))
