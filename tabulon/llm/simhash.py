"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints within ``radius`` bits differ in at most ``radius`` of ``radius + 1`` disjoint blocks, so they agree on
one. The upper nodes of the index are those agreements: a mask and the bits that all members share under it. A node
with more than ``NODE`` members is refined: its free bits fall into ``radius + 1`` blocks again, and members go to the
children that share one block more. As fingerprints are distinct, a node with few free bits is small by itself, so
refining ends without a cap and without losing a link. Below an upper node, members are sorted by Gray rank and
neighbours are factored into a tree whose nodes hold the bits that all below them share; a search adds up differences
on the way down and drops whole groups once they exceed the radius.

A node yields a star for each of its local components, never its pairs; components are then joined across nodes.

Nulls: a null text has no words. Documents without words have fingerprint 0 and link like any other. A null doc_id
never becomes a component's id unless it has no other. Repeated rows are returned as often as they occur. Very long
texts are hashed in slices. An empty table gives no row. Input columns of any other name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import binaries, bounded, connected, persist

SEED = 42
#: Members from which an upper node is refined.
NODE = 2048
#: Shingles hashed at once.
SLICE = 1 << 16
#: Query and node pairs that a search holds at once.
FRONTIER = 1 << 20
#: Children of a tree node.
FANOUT = 8


def fingerprint(text: bytes, shingle: int) -> int:
    """Majority bits of the shingles' hashes, as an unsigned integer; 0 without words."""
    words = text.lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    elif shingle == 3:
        parts = [b"%b %b %b" % x for x in zip(words, words[1:], words[2:], strict=False)]
    else:
        parts = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(parts), SLICE):
        part = parts[i : i + SLICE]
        hashes = np.array([digest(x, SEED) for x in part], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(parts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, fp long)``; fp holds the unsigned fingerprint's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            fps = np.array([fingerprint(x, shingle) for x in binaries(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Position of each 64-bit word in the reflected Gray code."""
    out = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def _levels(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bottom-up, for each level the bits that a node's members share (mask) and their values (pattern)."""
    ones, zeros = fps, ~fps
    out = [(ones | zeros, ones)]
    while len(ones) > 1:
        cuts = np.arange(0, len(ones), FANOUT)
        ones, zeros = np.bitwise_and.reduceat(ones, cuts), np.bitwise_and.reduceat(zeros, cuts)
        out.append((ones | zeros, ones))
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each member's component, by hooking to the least neighbour and halving paths."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(jump := root[root], root):
            root = jump
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    return root


def links(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (query < member) within ``radius`` among distinct fingerprints sorted by Gray rank."""
    levels = _levels(fps)
    top = len(levels) - 1
    step = max(1, FRONTIER // (FANOUT * FANOUT * 8))
    for begin in range(0, len(fps), step):
        query = np.arange(begin, min(begin + step, len(fps)))
        node, far, seen = np.zeros(len(query), np.int64), np.zeros(len(query), np.int64), np.zeros(len(query), np.uint64)
        for level in range(top, -1, -1):
            mask, pattern = levels[level]
            if level < top:
                child = node[:, None] * FANOUT + np.arange(FANOUT)
                keep = (child < len(mask)) & ((child + 1) * FANOUT**level > query[:, None])  # a pair is found from its first member
                at = np.nonzero(keep)
                query, node, far, seen = query[at[0]], child[at], far[at[0]], seen[at[0]]
            new = mask[node] & ~seen
            far = far + np.bitwise_count((fps[query] ^ pattern[node]) & new)
            keep = far <= radius
            query, node, far, seen = query[keep], node[keep], far[keep], (seen | new)[keep]
        keep = node > query
        yield query[keep], node[keep]


def _stars(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of two or more among distinct fingerprints."""
    fps = fps[np.argsort(gray_rank(fps))]
    a, b = (np.concatenate(x) for x in zip(*links(fps, radius), strict=True))
    root = _roots(len(fps), a, b)
    member = np.nonzero(root != np.arange(len(fps)))[0]
    return fps[member], fps[root[member]]


def _search(radius: int):
    """Streams rows sorted by upper node; nodes of two are compared at once for the whole batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp = np.empty(0, np.int64), np.empty(0, np.uint64)

        def found(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            start = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0] if len(key) else np.empty(0, np.int64)
            size = np.diff(np.r_[start, len(key)])
            two = start[size == 2]
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            a, b = [fp[near]], [fp[near + 1]]
            for i, n in zip(start[size > 2], size[size > 2], strict=True):
                x, y = _stars(fp[i : i + n], radius)
                a.append(x)
                b.append(y)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate([held_key, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([held_fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            cut = np.searchsorted(key, key[-1])
            yield found(key[:cut], fp[:cut])
            held_key, held_fp = key[cut:], fp[cut:]
        yield found(held_key, held_fp)

    return run


def _blocks(mask: int, parts: int) -> list[int]:
    """The free bits of ``mask`` in ``parts`` runs of near equal length, each as a mask."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * i // parts for i in range(parts + 1)]
    return [sum(1 << i for i in free[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_pairs(distinct: DataFrame, radius: int, node: int = NODE) -> DataFrame:
    """``distinct(fp long)``, all different, to star edges ``(a, b)`` that join just what links within ``radius`` join."""
    spark, edges, masks = distinct.sparkSession, None, [0]
    rows = distinct.select("fp")
    while True:
        children = [(m, m | b) for m in masks for b in _blocks(m, radius + 1)]
        masks = sorted({c for _, c in children})
        if edges is None:
            rows = rows.select("fp", F.explode(F.array(*(F.lit(_signed(c)).cast("long") for c in masks))).alias("mask"))
        else:  # one row for each mask of this depth: a table bounded by the radius and the 64 bits, whatever the input
            tree = spark.createDataFrame([(_signed(m), _signed(c)) for m, c in children], "mask long, child long")
            rows = rows.join(F.broadcast(tree), "mask").select("fp", F.col("child").alias("mask"))
        rows = rows.withColumn("key", F.xxhash64("mask", F.col("mask").bitwiseAND(F.col("fp"))))
        if min(64 - m.bit_count() for m in masks) <= node.bit_length() - 1:  # 2 ** free bits members at most
            last, large = rows, None
        else:
            large = rows.groupBy("key").count().where(F.col("count") > node).select("key", F.lit(True).alias("large"))
            marked = persist(rows.join(large, "key", "left"), "nodes")
            last, rows = marked.where("large is null").drop("large"), marked.where("large").select("fp", "mask")
        turn = last.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(_search(radius), "a long, b long")
        edges = turn if edges is None else edges.unionAll(turn)
        if large is None or rows.isEmpty():
            return edges


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, fp long, component_id)``."""
    prints = persist(fingerprints(docs, shingle), "fingerprints")
    distinct = persist(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected(near_pairs(distinct, radius), "near")
    members = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(members.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


# -- near duplicates by similarity ------------------------------------------------------------------------------------

#: Members from which a bucket is parted among tasks.
BUCKET = 4096
#: Members up to which a bucket's pairs are all candidates at once.
EXACT = 4
#: Bits of the wider fingerprint.
WIDE = 128
#: Words of the sketch that candidates of the second search must agree on too, before their texts are compared.
SKETCH = 16


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted; none without words."""
    words = text.lower().split()
    parts = {b" ".join(words)} if 0 < len(words) < shingle else set(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    return np.unique(np.array([xxhash.xxh64_intdigest(x, SEED) for x in parts], np.uint64))


def wide_fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """Two words of majority bits, the second from the remixed hashes."""
    out = []
    for word in (hashes, (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(word), SLICE):
            ones += np.unpackbits(word[i : i + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(ones * 2 > len(word), bitorder="little").view("<i8")[0]))
    return out[0], out[1]


def sketch(hashes: np.ndarray) -> np.ndarray:
    """``SKETCH`` more words of majority bits, from multiples of the hashes."""
    out = np.zeros(SKETCH, np.uint64)
    for w in range(SKETCH):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(hashes), SLICE):
            word = hashes[i : i + SLICE] * np.uint64(0xC2B2AE3D27D4EB4F + 2 * w)
            word = (word ^ (word >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            ones += np.unpackbits((word ^ (word >> np.uint64(32))).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[w] = np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0]
    return out


def sketch_radius(similarity: float) -> int:
    """Differing sketch bits that texts of that similarity exceed about once in a thousand times."""
    same, bits = 1 - np.arccos(2 * similarity / (1 + similarity)) / np.pi, 64 * SKETCH
    return int(bits * (1 - same) + 3 * np.sqrt(bits * same * (1 - same)))


def tables(n: int, similarity: float, recall: float) -> tuple[list[tuple[int, int]], int]:
    """Masks over both words, and the radius: as many tables of about log2(n) bits as the recall at that similarity takes."""
    same = 1 - np.arccos(2 * similarity / (1 + similarity)) / np.pi  # bits that such texts share
    bits = max(8, int(np.ceil(np.log2(max(n, 2)))))
    count = int(np.ceil(np.log(1 - recall) / np.log1p(-(same**bits))))
    rng, masks = np.random.default_rng(SEED), []
    for _ in range(count):
        chosen = rng.choice(WIDE, bits, replace=False).tolist()
        masks.append(tuple(_signed(sum(1 << b - 64 * w for b in chosen if b // 64 == w)) for w in (0, 1)))
    return masks, int(WIDE * (1 - same) + 2.5 * np.sqrt(WIDE * same * (1 - same)))


_PAIRS = "key long, a long, b long, f1 long, f2 long"


def _leaders(radius: int, hand_on: bool):
    """Rows sorted by key and part: a member joins the first leader within the radius, or becomes one.

    Copies of one text lie around it and not around each other, so each leader's followers join their medoid too: the
    one nearest to the majority of their bits. Under part -1 every member leads and joins all, so all pairs are
    compared. Members of other parts are handed on for the second search (b is a). Leaders of parts stay open (b is
    null) and go on to be compared with those of the bucket's other parts.
    """

    def medoids(f: np.ndarray, ids: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, int]]:
        order = np.argsort(of, kind="stable")
        cuts = np.nonzero(np.diff(of[order]))[0] + 1
        for group in np.split(order, cuts):
            if len(group) < 3:
                continue
            bits = np.unpackbits(np.ascontiguousarray(f[:, group].T).view(np.uint8).reshape(len(group), -1), axis=1)
            middle = (bits.sum(0, dtype=np.int64) * 2 > len(group)).astype(np.uint8)
            best = ids[group[np.argmin((bits != middle).sum(1))]]
            yield from ((int(x), int(best)) for x in ids[group] if x != best)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lead, n = None, np.empty((2, 64), np.uint64), 0
        ids: list[int] = []
        held: list[tuple[int, np.ndarray, int]] = []  # member, its bits, its leader's number

        def closed() -> list[tuple]:
            if now is None or now[1] < 0 or len(held) < 3:
                return []
            f, a = np.stack([x[1] for x in held], axis=1), np.array([x[0] for x in held], np.int64)
            return [(now[0], x, y, None, None) for x, y in medoids(f, a, np.array([x[2] for x in held]))]

        for batch in batches:
            out: list[tuple] = []
            f = np.stack([np.asarray(batch.column(c), dtype=np.int64).view(np.uint64) for c in ("f1", "f2")])
            for i, (key, part, a) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "part", "a")), strict=True)):
                if (key, part) != now:
                    out += closed()
                    now, n, ids, held = (key, part), 0, [], []
                if hand_on and part >= 0:
                    out.append((key, a, a, *f[:, i].view(np.int64).tolist()))
                near = np.nonzero(np.bitwise_count(lead[:, :n] ^ f[:, i : i + 1]).sum(0) <= radius)[0] if n else ()
                if part >= 0:
                    held.append((a, f[:, i].copy(), int(near[0]) if len(near) else n))
                if len(near):
                    out += [(key, a, ids[j], None, None) for j in near[: None if part < 0 else 1].tolist()]
                    if part >= 0:
                        continue
                if n == lead.shape[1]:
                    lead = np.concatenate([lead, np.empty_like(lead)], axis=1)
                lead[:, n] = f[:, i]
                n += 1
                ids.append(a)
                if part > 0:
                    out.append((key, a, None, *f[:, i].view(np.int64).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 5)], names=["key", "a", "b", "f1", "f2"])
        last = closed()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*last, strict=True) if last else [()] * 5)], names=["key", "a", "b", "f1", "f2"])

    return run


def wide_links(f: np.ndarray, root: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of columns of ``f`` (two words each) within ``radius`` whose roots differ, by a Gray-order tree.

    Columns are sorted by the Gray rank of all 128 bits and factored into a tree of shared bits; a search adds up
    differences on the way down and drops a node once they exceed the radius, or if all below it have the query's root.
    """
    turned = np.where(np.bitwise_count(f[0]) & 1, ~np.uint64(0), np.uint64(0))
    order = np.lexsort((gray_rank(f[1]) ^ turned, gray_rank(f[0])))
    f, root = f[:, order], root[order]
    ones, zeros, low, high = f, ~f, root, root
    levels = [(ones | zeros, ones, low, high)]
    while ones.shape[1] > 1:
        cuts = np.arange(0, ones.shape[1], FANOUT)
        ones, zeros = np.bitwise_and.reduceat(ones, cuts, axis=1), np.bitwise_and.reduceat(zeros, cuts, axis=1)
        low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
        levels.append((ones | zeros, ones, low, high))
    n, top = f.shape[1], len(levels) - 1
    step = max(1, FRONTIER // n)
    for begin in range(0, n, step):
        query = np.arange(begin, min(begin + step, n))
        node, far, seen = np.zeros(len(query), np.int64), np.zeros(len(query), np.int64), np.zeros((2, len(query)), np.uint64)
        for level in range(top, -1, -1):
            mask, pattern, low, high = levels[level]
            if level < top:
                child = node[:, None] * FANOUT + np.arange(FANOUT)
                at = np.nonzero((child < mask.shape[1]) & ((child + 1) * FANOUT**level > query[:, None]))  # a pair is found from its first member
                query, node, far, seen = query[at[0]], child[at], far[at[0]], seen[:, at[0]]
            new = mask[:, node] & ~seen
            far = far + np.bitwise_count((f[:, query] ^ pattern[:, node]) & new).sum(0, dtype=np.int64)
            keep = (far <= radius) & ((low[node] != high[node]) | (low[node] != root[query]))
            query, node, far, seen = query[keep], node[keep], far[keep], (seen | new)[:, keep]
        keep = node > query
        yield order[query[keep]], order[node[keep]]


def _across(radius: int, sketched: int):
    """Rows sorted by key: all pairs of a bucket within the radius whose groups differ and whose sketches are as near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: np.ndarray, more: np.ndarray) -> Iterator[pa.RecordBatch]:
            start = np.nonzero(np.r_[True, rows[0, 1:] != rows[0, :-1]])[0] if rows.shape[1] else np.empty(0, np.int64)
            for begin, end in zip(start.tolist(), [*start[1:].tolist(), rows.shape[1]], strict=False):
                _, group, a, *f = rows[:, begin:end]
                for x, y in wide_links(np.stack(f).view(np.uint64), group, radius):
                    for i in range(0, len(x), FRONTIER // SKETCH):
                        p, q = x[i : i + FRONTIER // SKETCH], y[i : i + FRONTIER // SKETCH]
                        near = np.bitwise_count(more[begin + p] ^ more[begin + q]).sum(1, dtype=np.int64) <= sketched
                        if near.any():
                            yield pa.RecordBatch.from_arrays([pa.array(a[p[near]]), pa.array(a[q[near]])], names=["a", "b"])

        held, extra = np.empty((5, 0), np.int64), np.empty((0, SKETCH), np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            held = np.concatenate([held, np.stack([np.asarray(c, dtype=np.int64) for c in batch.columns[:5]])], axis=1)
            extra = np.concatenate([extra, np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64).reshape(-1, SKETCH)])
            cut = int(np.searchsorted(held[0], held[0, -1]))
            yield from found(held[:, :cut], extra[:cut])
            held, extra = held[:, cut:], extra[cut:]
        yield from found(held, extra)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as the struct ``row``, its doc_id as ``doc``, its text, and ``tie``, a key of id and text."""
    doc, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.struct("*").alias("row"), doc.alias("doc"), text.alias("text"), F.xxhash64(doc, doc.isNull(), text).alias("tie"))


def similar_keys(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, recall: float = 0.97, bucket: int = BUCKET) -> DataFrame:
    """Keys of linked rows of ``docs``: ``(node, root)``, root the least key of the texts that node is linked with.

    Candidates agree on the bits of one of several masks, the upper nodes, and lie within the radius there; a link is
    a candidate pair whose sets of shingles have the similarity (intersection over union). Equal fingerprints link.
    Buckets of over ``EXACT`` members are searched twice: by leaders, which joins copies by stars, then by a Gray-order
    tree for all pairs that the links so far don't join and whose longer sketches are near: families of texts that
    resemble each other at less than the similarity would else give the square of their size.
    """
    texts = _keyed(docs).select("tie", "text")

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            hashes = [shingle_hashes(x, shingle) for x in binaries(batch.column(1))]
            fps = [wide_fingerprint(x) for x in hashes]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[w] for x in fps], pa.int64()) for w in (0, 1)), pa.array([sketch(x).tobytes() for x in hashes], pa.binary())], names=["tie", "f1", "f2", "sketch"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_hashes(x, shingle).view(np.int64) for x in binaries(batch.column(1))], pa.list_(pa.int64()))], names=["tie", "set"])

    found = persist(texts.mapInArrow(prints, "tie long, f1 long, f2 long, sketch binary"), "wide")
    distinct = persist(found.groupBy("f1", "f2").agg(F.min("tie").alias("a"), F.min_by("sketch", "tie").alias("sketch")), "distinct")
    masks, radius = tables(distinct.count(), similarity, recall)
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("f1").bitwiseAND(F.lit(m1)), F.col("f2").bitwiseAND(F.lit(m2))) for i, (m1, m2) in enumerate(masks)))
    rows = distinct.select("a", "f1", "f2", F.explode(keys).alias("key"))
    count = persist(rows.groupBy("key").count().where(F.col("count") > 1), "buckets")
    small = F.col("count") <= min(EXACT, bucket)
    parts = F.when(small, -1).otherwise(F.ceil(F.col("count") / bucket)).cast("int")
    # by a merge at every size, as all joins here of what grows with the input: the planner takes the exploded rows for
    # as small as ``distinct``, and would gather one for each mask and document on the driver to broadcast them
    rows = rows.join(count.select("key", parts.alias("parts")).hint("merge"), "key")
    rows = rows.withColumn("part", F.when(F.col("parts") > 1, 1 + F.pmod(F.xxhash64("a"), F.col("parts"))).otherwise(F.least("parts", F.lit(0))).cast("int"))
    chosen = ["key", "part", "a", "f1", "f2"]
    first = persist(rows.repartition("key", "part").sortWithinPartitions("key", "part", F.xxhash64("key", "a")).select(*chosen).mapInArrow(_leaders(radius, True), _PAIRS), "leaders")
    left = first.where("b is null").select("key", F.lit(0).alias("part"), "a", "f1", "f2")
    again = left.repartition("key").sortWithinPartitions("key", F.xxhash64("key", "a")).select(*chosen).mapInArrow(_leaders(radius, False), _PAIRS)

    def alike(found: DataFrame) -> DataFrame:
        pairs = persist(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        wanted = pairs.select(F.col("a").alias("tie")).unionAll(pairs.select(F.col("b").alias("tie"))).distinct()
        known = persist(texts.join(wanted.hint("merge"), "tie").dropDuplicates(["tie"]).mapInArrow(sets, "tie long, set array<long>"), "sets")
        both = pairs.join(known.select(F.col("tie").alias("a"), F.col("set").alias("x")).hint("merge"), "a").join(known.select(F.col("tie").alias("b"), F.col("set").alias("y")).hint("merge"), "b")
        shared = F.size(F.array_intersect("x", "y"))
        return both.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b")

    links = alike(first.where("b <> a").select("a", "b").unionAll(again.select("a", "b")))
    equal = found.drop("sketch").join(distinct.drop("sketch").hint("merge"), ["f1", "f2"]).where("tie <> a").select("a", F.col("tie").alias("b"))
    roots = connected(links.unionAll(equal), "similar")
    members = first.where("b = a").select("key", "a", "f1", "f2")
    if not members.isEmpty():
        known = distinct.select("a", "sketch").join(roots.withColumnRenamed("node", "a").hint("merge"), "a", "left").select("a", F.coalesce("root", "a").alias("root"), "sketch")
        rows = members.join(known.hint("merge"), "a").select("key", "root", "a", "f1", "f2", "sketch")
        more = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_across(radius, sketch_radius(similarity)), "a long, b long")
        roots = connected(alike(more).unionAll(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), "similar")
    return roots


def _groups(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows``, which have ``tie``, with the ``group`` they are in."""
    return rows.join(roots.select(F.col("node").alias("tie"), "root").hint("merge"), "tie", "left").withColumn("group", F.coalesce("root", "tie")).drop("root")


def similar_documents(docs: DataFrame, **options) -> DataFrame:
    """Each row of ``docs`` as the struct ``row``, ``doc``, ``tie``, a key of id and text, and ``group``, the least key of the texts it is linked with."""
    return _groups(_keyed(docs).select("row", "doc", "tie"), similar_keys(docs, **options))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of near duplicates: that of the least doc_id (null last), then of the least key; rows that repeat count as one.

    Groups choose among keys, so texts are shuffled once, by key, where repeated rows have been reduced before.
    """
    keyed = _keyed(docs)
    best = _groups(keyed.select("doc", "tie"), similar_keys(docs, **options)).groupBy("group").agg(F.min(F.struct(F.col("doc").isNull().alias("n"), "doc", "tie")).alias("best"))
    one = keyed.withColumn("place", F.monotonically_increasing_id()).groupBy("tie").agg(F.min_by("row", "place").alias("row"))
    return one.join(best.select("best.tie").hint("merge"), "tie", "left_semi").select("row.*")
