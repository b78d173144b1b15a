"""Mixing sources to target weights by Pareto order sampling.

Each source has a weight and shares a budget of words; targets stop at ``MOST`` times the source's size and the excess
is shared again by weight. The rate of a source is its target over its size: each document gets the whole copies of
the rate for certain, and the rest is the inclusion probability of one copy more. Those copies are an order sample:
with u uniform and odds u / (1 - u), documents are ranked by their random odds over their inclusion odds (times
``odds``, if a column of relative odds is given, for unequal probabilities within a source), and are taken in that
order until the words that are left are used up; the document at the edge is taken if at least half of it fits.

Rows equal in source, id and text have one u and one rank; they are first summed up to one with a count, so that any
number of them is one place in the order, of which as many are taken as fit. The edge is found by radix: sums for each
source and one of ``CELLS`` cells of the rank, then for the edge's cell alone its sub-cells, then the few ranks of the
last cell in order. Sums are partial before each shuffle, so no task sees all rows of a source. u comes from a hash of
seed, id and text, so reruns agree however the input is cut.

Nulls: a null source is a source of its own, ordered last; a null text has size 0 and is never more than 0 words;
a null doc_id hashes as an empty one. Of rows equal in id and text any is as good as the other. Sources of size 0 have
target 0. An empty table gives no row. Other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import n_words, persist

WEIGHTS = (5, 2, 1)
SHARE, MOST, SEED = 1.5, 2.0, "mix-1"
#: Cells of the rank on each of the two levels of the radix.
CELLS = 4096
#: Sources up to which the table with a row for each is broadcast.
BROADCAST_SOURCES = 10_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes(source, source_size)``, a row for each source, with its ``target``.

    Sources fill up in the order of cap over weight. Before source i those already full have their caps, and the rest
    would get ``level`` a weight; the first source whose cap is not below that ends the filling.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    everything = F.sum("source_size").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("level", (everything * share - full) / rest)
    level = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    goal = F.coalesce(F.least("cap", F.col("weight") * level), F.col("cap"))
    return rows.select("source", "source_size", goal.alias("target"))


def uniform(seed: str, doc_id: Column, text: Column) -> Column:
    """52 bits of a hash as a number between 0 and 1, neither included."""
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit("")))))
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, odds: Column | None = None) -> DataFrame:
    """``docs(doc_id, text, source)`` to ``(doc_id, tie, source, size, source_size, target, copies, taken)``; tie is a hash of id, text and source.

    ``odds``: a positive column of ``docs`` that multiplies a document's inclusion odds within its source.
    """
    return _mixed(docs, weights, share, most, seed, odds, False).select("doc_id", "tie", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def with_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, odds: Column | None = None) -> DataFrame:
    """Each row of ``docs`` as the struct ``row``, and ``copies``, how often the mix takes it; rows that it doesn't take are left out.

    The cut of each source is found on sizes alone; then each row tells its own copies, so texts are never shuffled.
    """
    return _mixed(docs, weights, share, most, seed, odds, True).where("copies > 0").select("row", "copies")


def _mixed(docs: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: str, odds: Column | None, whole_rows: bool) -> DataFrame:
    text, doc = F.col("text").cast("string"), F.col("doc_id").cast("long")
    measured = docs.select(
        F.struct("*").alias("row"), doc.alias("doc_id"), F.xxhash64(doc, doc.isNull(), text, "source").alias("tie"), F.col("source").cast("string").alias("source"), n_words(text).alias("size"),
        uniform(seed, doc, text).alias("u"), (F.lit(1.0) if odds is None else odds.cast("double")).alias("odds"),
    )
    slim = persist(measured.drop("row"), "sizes")
    goals = persist(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most).withColumn("n", F.monotonically_increasing_id()), "targets")
    small = goals.count() <= BROADCAST_SOURCES

    def with_source(rows: DataFrame, table: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(table) if small else table, "n", "left")

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)

    def ranked_in(rows: DataFrame) -> DataFrame:
        rows = rows.join(F.broadcast(goals) if small else goals, rows.source.eqNullSafe(goals.source)).drop(goals.source)
        rows = rows.withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("left", F.col("rate") - F.floor("rate"))
        rank = (F.col("u") / (1 - F.col("u"))) / (F.col("left") / (1 - F.col("left")) * F.col("odds"))
        rows = rows.withColumn("rank", F.when(F.col("left") > 0, rank))
        cell = F.floor(F.col("rank") / (1 + F.col("rank")) * CELLS * CELLS)
        return rows.withColumn("cell", F.floor(cell / CELLS)).withColumn("sub", cell % CELLS)

    keyed = ranked_in(slim)
    wanted = goals.select("n", (F.col("target") - F.floor(rate) * F.col("source_size")).alias("wanted"))

    def edge(rows: DataFrame, by: str, want: DataFrame) -> DataFrame:
        """For each source the cell in which the wanted words run out, and those still wanted when it begins."""
        sums = rows.groupBy("n", by).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("n").orderBy(by))
        found = with_source(sums, want).withColumn("upto", upto).where("upto > wanted")
        return found.groupBy("n").agg(F.min(by).alias("edge"), F.min_by(F.col("wanted") - F.col("upto") + F.col("words"), by).alias("wanted"))

    ranked = keyed.where("rank is not null")
    same = ["n", "rank", "doc_id", "tie", "cell", "sub"]
    active = ranked.groupBy(*same).agg(F.min("size").alias("each"), F.count(F.lit(1)).alias("times"), F.sum("size").alias("size"))
    first = persist(edge(active, "cell", wanted), "edge")
    inner = with_source(active, first).where("cell = edge").drop("edge", "wanted")
    second = persist(edge(inner, "sub", first.select("n", "wanted")), "edge")
    last = with_source(inner, second).where("sub = edge")
    before = F.coalesce(F.sum("size").over(Window.partitionBy("n").orderBy("rank", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # of equal rows those are taken of which at least half fits, in one place of the order after the other
    fit = F.greatest(F.lit(0), F.least("times", F.floor((F.col("wanted") - F.col("before")) / F.col("each") + 0.5)))
    last = last.withColumn("before", before).withColumn("fit", F.when(F.col("each") > 0, fit).when(F.col("before") <= F.col("wanted"), F.col("times")).otherwise(0))
    edges = first.select("n", F.col("edge").alias("edge1")).join(second.select("n", F.col("edge").alias("edge2")), "n", "left")
    place = F.struct("rank", "doc_id", "tie")
    # where the order is cut: the last place of which some row is taken, and how many rows of it
    cut = last.where("fit > 0").groupBy("n").agg(F.max(F.struct("rank", "doc_id", "tie", "fit", "times")).alias("cut"))
    table = persist(edges.join(cut, "n", "left"), "limits")
    out = with_source(ranked_in(measured) if whole_rows else keyed, table)
    limit = F.struct(F.col("cut.rank").alias("rank"), F.col("cut.doc_id").alias("doc_id"), F.col("cut.tie").alias("tie"))
    code = (
        F.when(F.col("rank").isNull(), 0)
        .when(F.col("edge1").isNull() | (F.col("cell") < F.col("edge1")), 1)
        .when(F.col("cell") > F.col("edge1"), 0)
        .when(F.col("edge2").isNull() | (F.col("sub") < F.col("edge2")), 1)
        .when(F.col("sub") > F.col("edge2"), 0)
        .when(F.col("cut").isNull() | (place > limit), 0)
        .when((place < limit) | (F.col("cut.fit") == F.col("cut.times")), 1)
    )
    out = out.withColumn("extra", code)
    copies = (F.col("whole") + F.col("extra")).cast("int")
    names = [*(["row"] if whole_rows else []), "doc_id", "tie", "source", "size", "source_size", "target"]
    if table.where("cut.fit < cut.times").isEmpty():
        return out.select(*names, copies.alias("copies"))
    # the rows of the place at the cut itself, if only some of them are taken: numbered by their place in the input, block by block
    split = persist(out.where("extra is null").select(*names, "whole", "n", F.col("cut.fit").alias("fit")).withColumn("at", F.monotonically_increasing_id()), "split")
    blocks = split.groupBy("n", F.shiftright("at", 13).alias("block")).agg(F.count(F.lit(1)).alias("rows"))
    ahead = F.sum("rows").over(Window.partitionBy("n").orderBy("block")) - F.col("rows")
    number = F.row_number().over(Window.partitionBy("n", "block").orderBy("at"))
    settled = split.withColumn("block", F.shiftright("at", 13)).join(persist(blocks.select("n", "block", ahead.alias("ahead")), "blocks"), ["n", "block"])
    settled = settled.withColumn("extra", (F.col("ahead") + number <= F.col("fit")).cast("int"))
    return out.where("extra is not null").select(*names, copies.alias("copies")).unionByName(settled.select(*names, copies.alias("copies")))
