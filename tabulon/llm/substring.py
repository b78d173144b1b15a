"""Duplicate passages by relative Lempel-Ziv parsing.

The reference is the corpus itself, cut into blocks: in each window of ``WINDOW`` words the shingle of ``GRAM`` words
with the least hash is its anchor, and the words around one anchor, up to ``WINDOW - GRAM + 1`` windows, are a block.
Equal windows have equal anchors, so an anchor that occurs once proves that its windows are new; the index therefore
keeps the blocks of repeated anchors only, dealt by anchor. Each document's blocks are looked up there, window by window,
at the window's earliest place. The document is then factored from left to right: a factor begins at the first window
with an earlier place and goes on, over the ends of blocks, as far as the next window's earliest place is the next one
of the same earlier document; between factors are literal words. Factors of ``WINDOW`` words or more are duplicate
spans. Every window was looked up by itself, so those across the boundary of two factors are checked too, and the spans
cover just the words of windows that also start earlier.

Anchors with over ``HOT`` occurrences don't meet in one task: documents are salted so that about ``HOT`` meet, each
such group is looked up by itself, and only the first place of each window in a group goes on to a second look-up by
window. A factor then may point at an earlier place other than the earliest.

A window's identity is 64 bits of its anchor and 64 of the window: among n different windows under one anchor the
chance that any two are taken for equal is about n * n / 2 ** 65, that is 0.03 for a billion of them.

Order: smaller doc_id first, null before all, ties by a hash of the text, then by place in the text. Rows equal in
doc_id and text are one document listed twice and get the same result. A null or empty text has no words; texts under
``WINDOW`` words have no window and are kept whole. Texts of any length are parsed whole. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import binaries, bounded, persist, split_words

WINDOW = 20
GRAM = 8
#: Occurrences of an anchor that meet in one task, about.
HOT = 2_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * _M1) ^ ((b ^ (b >> np.uint64(29))) * _M2)
    h ^= h >> np.uint64(32)
    h *= _M1
    return h ^ (h >> np.uint64(29))


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, put together from runs of powers of two."""
    size, power, out, done = len(h) - k + 1, h, None, 0
    for bit in range(k.bit_length()):
        if k >> bit & 1:
            part = power[done : done + size]
            out, done = (part if out is None else _mix(out, part)), done + (1 << bit)
        if k >> bit + 1:
            step = 1 << bit
            power = _mix(power[:-step], power[step:]) if len(power) > step else power[:0]
    return out


def _least(a: np.ndarray, w: int) -> np.ndarray:
    step = 1
    while step * 2 <= w:
        a = np.minimum(a[:-step], a[step:])
        step *= 2
    return np.minimum(a[: len(a) - (w - step)], a[w - step :]) if w > step else a


class Runs:
    """The windows of a batch of texts, in runs that share an anchor: doc, start, length, anchor, and each window's tag."""

    def __init__(self, column: pa.Array, window: int, gram: int) -> None:
        codes, words, self.offsets = split_words(column)
        none = np.empty(0, np.int64)
        self.doc = self.start = self.size = none
        self.anchor, self.tags, self.repeats = none.view(np.uint64), none.view(np.uint64), none.astype(bool)
        if len(codes) < window:
            return
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()], np.uint64)[codes]
        whole, spread = _grams(hashes, window), window - gram + 1
        least = _least(_grams(hashes, gram), spread)
        counts = np.diff(self.offsets)
        end = np.repeat(self.offsets[1:], counts)
        at = np.nonzero(np.arange(len(whole)) + window <= end[: len(whole)])[0]
        if not len(at):
            return
        least, whole = least[at], whole[at]
        new = np.r_[True, (np.diff(at) != 1) | (least[1:] != least[:-1])]
        first = np.nonzero(new)[0]
        offset = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
        first = np.nonzero(offset % spread == 0)[0]
        doc = np.searchsorted(self.offsets, at, side="right") - 1
        again = np.zeros(len(at), bool)
        for s in range(1, spread):
            again[s:] |= whole[s:] == whole[:-s]
        self.doc, self.start = doc[first], at[first] - self.offsets[doc[first]]
        self.size = np.diff(np.r_[first, len(at)])
        self.anchor, self.tags = least[first], whole
        self.first, self.repeats = first, np.logical_or.reduceat(again, first)


def _keys(docs: DataFrame) -> DataFrame:
    """doc (its doc_id, null as the least long), tie (a hash of id and text) and text; neither key is ever null."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc, F.lit(-(2**63)).cast("long")).alias("doc"), F.xxhash64(doc, doc.isNull(), text).alias("tie"), text.alias("text"), doc.alias("doc_id"))


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def _anchors(window: int, gram: int):
    """doc, tie, text, doc_id to doc, tie, doc_id, n_words, hash of all words, and the anchors of all runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 2):
            runs = Runs(batch.column(2), window, gram)
            times = 1 + runs.repeats.astype(np.int64)
            doc, anchor = np.repeat(runs.doc, times), np.repeat(runs.anchor, times)
            cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            sha = [hashlib.sha256(b" ".join(x.split())).hexdigest() for x in binaries(batch.column(2))]
            columns = [batch.column(0), batch.column(1), batch.column(3), pa.array(np.diff(runs.offsets)), pa.array(sha), _lists(anchor.view(np.int64), cuts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "tie", "doc_id", "n_words", "sha", "anchors"])

    return run


def _blocks(window: int, gram: int):
    """doc, tie, text, repeated anchors with their numbers of salts to the runs of those anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 2):
            runs = Runs(batch.column(2), window, gram)
            wanted = batch.column(3).flatten()
            anchors, at = np.unique(np.asarray(wanted.field(0), dtype=np.int64).view(np.uint64), return_index=True)
            salts = np.asarray(wanted.field(1), dtype=np.int64)[at]
            keep = np.nonzero(np.isin(runs.anchor, anchors))[0]
            size, anchor = runs.size[keep], runs.anchor[keep]
            cuts = np.r_[0, np.cumsum(size)]
            inside = np.repeat(runs.first[keep] - cuts[:-1], size) + np.arange(cuts[-1]) if len(keep) else np.empty(0, np.int64)
            doc, tie = (np.asarray(batch.column(i))[runs.doc[keep]] for i in (0, 1))
            parts = salts[np.searchsorted(anchors, anchor)] if len(keep) else np.empty(0, np.int64)
            salt = np.where(parts > 1, 1 + (tie & 0x7FFFFFFF) % np.maximum(parts, 1), 0)
            columns = [pa.array(anchor.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(doc), pa.array(tie), pa.array(runs.start[keep].astype(np.int32)), _lists(runs.tags[inside].view(np.int64), cuts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "salt", "doc", "tie", "start", "tags"])

    return run


_RUNS = "anchor long, salt int, doc long, tie long, start int, tags array<long>"
_FACTORS = "key long, tag long, doc long, tie long, start int, n int, ref long, ref_start int"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]


def _rows(out: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _FACTORS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 8, _KINDS, strict=True)], names=names)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by anchor, salt and place, to matches: n windows from ``start`` that also begin at ``ref_start`` of ``ref``.

    Under a salt, a window's first place is still open: it goes on with n = 0, keyed by anchor and tag.
    """
    now, seen, before = None, {}, None
    for batch in batches:
        out: list[tuple] = []
        for anchor, salt, doc, tie, start, tags in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (anchor, salt) != now:
                now, seen, before = (anchor, salt), {}, None
            if (doc, tie, start) == before:
                continue
            before, n = (doc, tie, start), 0
            ref = ref_start = None
            for i, tag in enumerate(tags, start):
                place = seen.get(tag)
                if place is None:
                    seen[tag] = (doc, i)
                    if salt:
                        out.append((anchor, tag, doc, tie, i, 0, None, None))
                if n and (place is None or place != (ref, ref_start + n)):
                    out.append((tie, 0, doc, tie, i - n, n, ref, ref_start))
                    n = 0
                if place is not None:
                    if not n:
                        ref, ref_start = place
                    n += 1
            if n:
                out.append((tie, 0, doc, tie, start + len(tags) - n, n, ref, ref_start))
        yield _rows(out)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches pass; of open windows, sorted by anchor, tag and place, all but the first become matches."""
    now = first = None
    for batch in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key, tag, doc, tie, start, n, _, _ = row
            if n:
                out.append(row)
            elif (key, tag) != now:
                now, first = (key, tag), (doc, start)
            else:
                out.append((key, tag, doc, tie, start, 1, *first))
        yield _rows(out)


def greedy(matches: list[dict]) -> list[tuple[int, int, int, int]]:
    """The factors of one document, from left to right: (start, n, ref, ref_start) of n windows each.

    ``matches`` are its windows with an earlier place, in runs within blocks; a factor takes all that go on from it.
    """
    out: list[list[int]] = []
    for m in sorted(matches, key=lambda m: m["start"]):
        if out and m["start"] == out[-1][0] + out[-1][1] and m["ref"] == out[-1][2] and m["ref_start"] == out[-1][3] + out[-1][1]:
            out[-1][1] += m["n"]
        else:
            out.append([m["start"], m["n"], m["ref"], m["ref_start"]])
    return [tuple(f) for f in out]


def _factored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, tie and its matches, to its factors."""
    for batch in batches:
        rows = [(doc, tie, *f) for doc, tie, matches in zip(*(c.to_pylist() for c in batch.columns), strict=True) for f in greedy(matches)]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], names=["doc", "tie", "start", "n", "ref", "ref_start"])


def _cut(window: int):
    """doc, tie, text and the matches found in it, to the words removed and a hash of those kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 2):
            removed, shas = [], []
            for text, matches in zip(binaries(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                words = text.split()
                drop = bytearray(len(words))
                for start, n, _, _ in greedy(matches):
                    drop[start : start + n + window - 1] = b"\1" * (n + window - 1)
                kept = [w for w, gone in zip(words, drop, strict=True) if not gone]
                removed.append(len(words) - len(kept))
                shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(shas)], names=["doc", "tie", "n_removed", "kept"])

    return run


def prepare(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Documents with their anchors, written to the shared folder."""
    return persist(_keys(docs).mapInArrow(_anchors(window, gram), "doc long, tie long, doc_id long, n_words long, sha string, anchors array<long>"), "anchors")


def _texts(docs: DataFrame) -> DataFrame:
    # dealt once: both reads of the texts share this exchange
    return _keys(docs).select("doc", "tie", "text").repartition("doc", "tie")


def matches(docs: DataFrame, prepared: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """For each document with any, its windows with an earlier place: doc, tie, and ``matches(start, n, ref, ref_start)`` in runs."""
    counts = prepared.select(F.explode("anchors").alias("anchor")).groupBy("anchor").count().where("count > 1")
    salts = F.ceil(F.col("count") / hot).cast("int")
    mine = prepared.select("doc", "tie", F.explode(F.array_distinct("anchors")).alias("anchor")).join(counts.select("anchor", salts.alias("salts")), "anchor")
    mine = mine.groupBy("doc", "tie").agg(F.collect_list(F.struct("anchor", "salts")).alias("wanted"))
    runs = _texts(docs).join(mine, ["doc", "tie"]).select("doc", "tie", "text", "wanted").mapInArrow(_blocks(window, gram), _RUNS)
    parsed = runs.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "doc", "tie", "start").mapInArrow(_parse, _FACTORS)
    settled = parsed.repartition("key", "tag").sortWithinPartitions("key", "tag", "doc", "tie", "start").mapInArrow(_settle, _FACTORS)
    return settled.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "n", "ref", "ref_start")).alias("matches"))


def factors(docs: DataFrame, prepared: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Factors of all documents: doc, tie, start, n, ref, ref_start; ``n + window - 1`` words from ``start`` on."""
    return matches(docs, prepared, window, gram, hot).mapInArrow(_factored, "doc long, tie long, start int, n int, ref long, ref_start int")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_words, n_removed, kept_sha256)``."""
    prepared = prepare(docs, window, gram)
    cut = _texts(docs).join(matches(docs, prepared, window, gram, hot), ["doc", "tie"]).select("doc", "tie", "text", "matches").mapInArrow(_cut(window), "doc long, tie long, n_removed long, kept string")
    cut = cut.dropDuplicates(["doc", "tie"])
    found = prepared.drop("anchors").join(cut, ["doc", "tie"], "left")
    return found.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256"))
