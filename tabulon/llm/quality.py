"""Quality rules with an isolation forest over their statistics.

Each text gives a row of rule statistics. Documents that fail a base rule are rejected outright. For the others the
statistics go through a forest of random splits: the shorter the mean path that isolates a row, the more anomalous
the document. The forest draws from all labelled rows, that is all documents with a labelled id that pass the base rules:
each tree grows on ``SUBSAMPLE`` of them, as the method has it, drawn without replacement. The threshold comes from
the scores of all labelled rows, each by a forest that has not seen its id, which draws from the other ``PARTS - 1``
parts of the ids by a hash: the score with the best balance of rows labelled bad above it and, at ``COST``, rows
labelled good. A document counts once for each label of its id. Where a tree's rows would be most of such a part, at
under ``PARTS * SUBSAMPLE`` labelled rows, the forest's own scores serve. The driver gets the drawn rows, at most
``(PARTS + 1) * TREES * SUBSAMPLE``, and sums by cells, whatever the number of labels.

Nulls and empty texts have no words and fail the base rule. Repeated rows are judged alike, each by itself. Very long
texts are read whole. Without labelled rows of both kinds only the base rule decides. An empty table gives no row.
Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import binaries, bounded, persist, split_words

TREES, SUBSAMPLE, SEED = 100, 256, 7
#: Parts of the labelled ids, each scored by a forest of the others to find the threshold.
PARTS = 5
#: What rejecting a row labelled good costs, against the gain of rejecting one labelled bad; as shares of either.
COST = 2.0
#: Cells of labelled rows in each part, by a hash, and of scores: so many sums go to the driver, rows are put in order within a cell only.
CELLS = 1024
SYMBOLS = "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_bangs", "n_distinct"]
_SCHEMA = ", ".join(f"{s} long" for s in STATS)


def _sums(per_word: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(per_word[codes])]
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text the words that lie in a window of three words found twice or more in it."""
    import pandas as pd

    n = len(codes)
    if n < 3:
        return np.zeros(len(offsets) - 1, np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = doc[:-2] == doc[2:]
    c = codes.astype(np.uint64)
    m1, m2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    key = ((c[:-2] * m1 ^ c[1:-1]) * m2 ^ c[2:]) * m1 ^ doc[:-2].astype(np.uint64)
    key = (key ^ (key >> np.uint64(31))) * m2
    twice = np.zeros(n, bool)
    at = np.nonzero(inside)[0]
    twice[at] = pd.Series(key[at]).duplicated(keep=False).to_numpy()
    covered = twice.copy()
    covered[1:] |= twice[:-1]
    covered[2:] |= twice[:-2]
    total = np.r_[0, np.cumsum(covered)]
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(column: pa.Array) -> list[np.ndarray]:
    """The columns of STATS for a batch of texts."""
    codes, words, offsets = split_words(column)
    get = lambda counts: np.asarray(counts, dtype=np.int64)
    symbols = sum((get(pc.count_substring(words, s)) for s in SYMBOLS), np.zeros(len(words), np.int64))
    lines, again = [], []
    for text in binaries(column):
        full = [x for x in text.split(b"\n") if x.strip()]
        lines.append(len(full))
        again.append(len(full) - len(set(full)))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    pairs = np.unique(doc * max(1, len(words)) + codes) // max(1, len(words))
    per = lambda counts: _sums(get(counts), codes, offsets)
    return [
        np.diff(offsets), per(pc.utf8_length(words)), per(symbols), np.array(again, np.int64), _repeated(codes, offsets), np.array(lines, np.int64),
        per(pc.count_substring_regex(words, r"\p{Lu}")), per(pc.count_substring_regex(words, "[0-9]")), per(pc.count_substring(words, "!")), np.bincount(pairs, minlength=len(offsets) - 1),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, STATS...)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in statistics(batch.column(1)))], names=["doc_id", *STATS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, {_SCHEMA}")


def base_failed(n_words, n_repeat_words):
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Length-free ratios; one row for each document."""
    s = {k: v.astype(float) for k, v in stats.items()}
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    return np.stack([s["n_symbols"] / words, s["n_upper"] / chars, s["n_bangs"] / words, s["n_repeat_words"] / words, 1 - s["n_distinct"] / words], axis=1)


def _expected(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def draws(n: int, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> np.ndarray:
    """For each tree the places of its rows among ``n``."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.choice(n, min(subsample, n), replace=False) for _ in range(trees)])


class Forest:
    """Random splits over subsamples; ``score`` nears 1 for rows that few splits isolate. ``drawn`` has the places of each tree's rows, if they are drawn elsewhere."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED, drawn: np.ndarray | None = None) -> None:
        drawn = draws(len(rows), trees, subsample, seed) if drawn is None else drawn
        rng, self.size = np.random.default_rng(seed), drawn.shape[1]
        self.depth = int(np.ceil(np.log2(max(self.size, 2))))
        self.trees = [self._tree(rows[places], rng) for places in drawn]

    def _tree(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        nodes: list[list[float]] = []  # column (-1: leaf), cut, left, right, path length

        def grow(part: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0, at, at, depth + _expected(len(part))])
            spread = np.nonzero(np.ptp(part, axis=0) > 0)[0] if len(part) > 1 and depth < self.depth else []
            if len(spread):
                column = int(rng.choice(spread))
                cut = rng.uniform(part[:, column].min(), part[:, column].max())
                below = part[:, column] <= cut
                nodes[at][:4] = [column, cut, grow(part[below], depth + 1), grow(part[~below], depth + 1)]
            return at

        grow(rows, 0)
        table = np.array(nodes)
        return table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4]

    def score(self, rows: np.ndarray) -> np.ndarray:
        total, each = np.zeros(len(rows)), np.arange(len(rows))
        for column, cut, left, right, path in self.trees:
            at = np.zeros(len(rows), int)
            for _ in range(self.depth):
                below = rows[each, column[at]] <= cut[at]
                at = np.where(below, left[at], right[at])  # a leaf leads to itself
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(_expected(self.size), 1e-9))


Model = tuple[Forest, float]


def _labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Different rows of ``stats`` that have labels and pass the base rules: ``n``, how often, and ``good`` and ``bad``, labels of the id."""
    one = F.col("quality") == 1
    by = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count_if(one).alias("good"), F.count_if(~one).alias("bad"))
    rows = stats.where(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).groupBy("doc_id", *STATS).agg(F.count(F.lit(1)).alias("n"))
    place = F.xxhash64("doc_id", *STATS, F.lit(SEED))
    part = (F.crc32(F.concat(F.lit(f"{SEED}|"), F.col("doc_id").cast("string")).cast("binary")) % PARTS).cast("int")
    # by a merge at every size: labels grow with the input
    return rows.join(by.hint("merge"), "doc_id").select("*", place.alias("place"), part.alias("part"), F.pmod(place, F.lit(CELLS)).cast("int").alias("cell"))


def _features(batch: pa.RecordBatch) -> np.ndarray:
    return features({name: np.asarray(batch.column(name)) for name in STATS})


def _forests(found: DataFrame, subsample: int) -> tuple[Forest, dict[int, Forest]] | None:
    """The forest of all rows of ``found``, and by part that of the rows in other parts; rows are numbered by part, cell and hash."""
    sums = found.groupBy("part", "cell").agg(*(F.sum(c).alias(a) for a, c in (("n", "n"), ("good", F.col("n") * F.col("good")), ("bad", F.col("n") * F.col("bad"))))).toArrow()
    part, cell, n, good, bad = (np.asarray(sums.column(c)) for c in ("part", "cell", "n", "good", "bad"))
    if not good.sum() or not bad.sum():
        return None
    size = np.zeros(PARTS * CELLS, np.int64)
    size[part.astype(np.int64) * CELLS + cell] = n
    start, rows, total = np.cumsum(size) - size, size.reshape(PARTS, CELLS).sum(1), int(n.sum())
    drawn = {-1: draws(total, subsample=subsample)}
    if total >= PARTS * subsample:
        for p in np.nonzero((rows > 0) & (rows < total))[0].tolist():
            places = draws(total - int(rows[p]), subsample=subsample)
            drawn[p] = np.where(places < start[p * CELLS], places, places + rows[p])
    wanted = np.unique(np.concatenate([x.ravel() for x in drawn.values()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            end = start[np.asarray(batch.column("part"), dtype=np.int64) * CELLS + np.asarray(batch.column("cell"))] + np.asarray(batch.column("upto"))
            begin = end - np.asarray(batch.column("n"))
            hit = np.searchsorted(wanted, end) > np.searchsorted(wanted, begin)
            yield pa.RecordBatch.from_arrays([pa.array(begin[hit]), *map(pa.array, _features(batch)[hit].T)], names=["begin", *(f"x{i}" for i in range(5))])

    order = Window.partitionBy("part", "cell").orderBy("place", "doc_id", *STATS)
    got = found.withColumn("upto", F.sum("n").over(order)).mapInArrow(run, "begin long, " + ", ".join(f"x{i} double" for i in range(5))).toArrow().sort_by("begin")
    begin, x = np.asarray(got.column("begin")), np.stack([np.asarray(got.column(f"x{i}")) for i in range(5)], axis=1)
    grown = {p: Forest(x, drawn=np.searchsorted(begin, places, side="right") - 1) for p, places in drawn.items()}
    return grown.pop(-1), grown


def _threshold(found: DataFrame, forest: Forest, others: dict[int, Forest]) -> float:
    """The score that parts the labels best, of all scores of ``found``; the least of equally good ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, part, score = _features(batch), np.asarray(batch.column("part")), np.zeros(batch.num_rows)
            for p in np.unique(part).tolist():
                score[part == p] = others.get(p, forest).score(x[part == p])
            n = np.asarray(batch.column("n"))
            yield pa.RecordBatch.from_arrays([pa.array(score), pa.array(n * np.asarray(batch.column("good"))), pa.array(n * np.asarray(batch.column("bad")))], names=["score", "good", "bad"])

    kinds = ("good", "bad")
    each = found.mapInArrow(run, "score double, good long, bad long").groupBy("score").agg(*(F.sum(c).alias(c) for c in kinds))
    each = persist(each.withColumn("cell", F.floor(F.col("score") * CELLS).cast("int")), "scores")
    sums = sorted((r.cell, r.good, r.bad) for r in each.groupBy("cell").agg(*(F.sum(c).alias(c) for c in kinds)).collect())
    ends = np.cumsum([r[1:] for r in sums], axis=0)
    below = [(r[0], int(g) - r[1], int(b) - r[2]) for r, (g, b) in zip(sums, ends, strict=True)]
    before = F.broadcast(found.sparkSession.createDataFrame(below, "cell int, good_below long, bad_below long"))  # broadcast: CELLS rows and one at most
    order = Window.partitionBy("cell").orderBy("score")
    above = {c: 1 - (F.col(f"{c}_below") + F.col(f"{c}_upto")) / int(most) for c, most in zip(kinds, ends[-1], strict=True)}
    cuts = each.select("cell", "score", *(F.sum(c).over(order).alias(f"{c}_upto") for c in kinds)).join(before, "cell")
    return cuts.select("score", (above["bad"] - COST * above["good"]).alias("gain")).orderBy(F.desc("gain"), "score").first().score


def _fit(stats: DataFrame, labels: DataFrame, subsample: int = SUBSAMPLE) -> Model | None:
    found = persist(_labelled(stats, labels), "labelled")
    grown = _forests(found, subsample)
    return grown and (grown[0], _threshold(found, *grown))


def fit(docs: DataFrame, labels: DataFrame, subsample: int = SUBSAMPLE) -> Model | None:
    """Forest and threshold from all labelled rows, trees of ``subsample`` rows each; None without labels of both kinds."""
    return _fit(with_statistics(docs), labels, subsample)


def verdicts(stats: list[np.ndarray], model: Model | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the STATS of some documents what fails the base rules, the anomaly scores and what is kept."""
    columns = dict(zip(STATS, stats, strict=True))
    failed = base_failed(columns["n_words"], columns["n_repeat_words"])
    score = model[0].score(features(columns)) if model else np.zeros(len(failed))
    return failed, score, ~failed & ((score <= model[1]) if model else True)


def judge(docs: DataFrame, labels: DataFrame, subsample: int = SUBSAMPLE) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, STATS..., base_failed, anomaly, kept)``; texts are read once, statistics are written and judged."""
    found = persist(with_statistics(docs), "statistics")
    model = _fit(found, labels, subsample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = verdicts([np.asarray(batch.column(s)) for s in STATS], model)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, rest)], names=["doc_id", *STATS, "base_failed", "anomaly", "kept"])

    return found.mapInArrow(run, f"doc_id long, {_SCHEMA}, base_failed boolean, anomaly double, kept boolean")


def kept(docs: DataFrame, labels: DataFrame, subsample: int = SUBSAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, whose verdict is to keep them, in two passes without a shuffle of texts."""
    model = fit(docs, labels, subsample)
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            good = verdicts(statistics(batch.column(1)), model)[-1]
            yield batch.select(["row"]).filter(pa.array(good))

    return rows.mapInArrow(run, rows.select("row").schema).select("row.*")
