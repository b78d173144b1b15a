"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.sources.scratch import persist, shared_dir  # noqa: F401

#: ASCII white space; everything between is a word.
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def binaries(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bounded(batches: Iterable[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds about ``most`` bytes of the text column, or a single row."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        piece = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.nonzero(np.diff(piece))[0] + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


#: A node of a graph with over one in ``SHARE`` of all edges is a hub; so there are ``SHARE`` of them at most.
SHARE = 2000
#: Edges up to which hubs need no care: any task can hold them all.
FEW = 10_000


def _with_least(edges: DataFrame, name: str, few: bool) -> DataFrame:
    """``edges(u, v)`` with ``m``, the least of u and its neighbours; hubs are broadcast, so that their edges stay where they are."""
    if few:
        return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "u")
    least = persist(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), name)
    most = max(1, (least.agg(F.sum("n")).first()[0] or 0) // SHARE)
    hubs = F.broadcast(least.where(F.col("n") > most).select("u", F.col("m").alias("h")))  # broadcast: SHARE rows at most
    marked = edges.join(hubs, "u", "left")
    others = marked.where("h is null").drop("h").join(least.where(F.col("n") <= most).select("u", "m"), "u")
    return marked.where("h is not null").withColumnRenamed("h", "m").unionByName(others)


def connected(edges: DataFrame, name: str) -> DataFrame:
    """Components of undirected ``edges(a long, b long)``: a row ``(node, root)`` for each node, root its component's least node.

    Alternating large-star and small-star steps until nothing changes. Each step groups with partial sums and joins
    by node, hubs apart, and is written to the shared folder. Empty edges give an empty result; null ends are not nodes.
    """
    one = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = persist(one, name), None
    few = now.count() <= FEW  # the steps never add edges
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _with_least(both, f"{name}-least", few).where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = large if few else persist(large, f"{name}-large")
        small = _with_least(large.select(F.col("a").alias("u"), F.col("b").alias("v")), f"{name}-least", few).where("u > v")
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b"))
        now = persist(small.distinct(), name)
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def split_words(column: pa.Array):
    """Words of a batch of texts: codes into ``dictionary``, the distinct words, and where each text begins (one more at the end)."""
    import numpy as np
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
    flat, offsets = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if not full.all():
        offsets = np.r_[0, np.cumsum(full)][offsets]
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return np.asarray(coded.indices, dtype=np.int64), coded.dictionary, offsets
