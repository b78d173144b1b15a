"""Line dedup by winnowing over line hashes, with DataFrame functions only.

A document is the sequence of its lines that have a word, each by a hash of the line without outer white space. Runs
of ``GRAM`` lines are grams; of each ``WINDOW`` neighbouring grams the least (the first of equals) is a fingerprint,
so any run of ``WINDOW + GRAM - 1`` lines that two places share holds a fingerprint at both. A line of ``LONG`` words
or more is a fingerprint by itself. Each fingerprint is joined to its earliest place; from there the match is extended
both ways while lines are equal, and the later of the two runs is deleted. The earliest copy of a line always stays.

Order: smaller doc_id first, null before all, ties by a hash of the text, then by place. Rows equal in doc_id and text
are one document listed twice and get the same result. A null text stays null; an empty text or one of blank lines
only stays as it is; blank lines are never deleted. Texts of any length are read whole. All input columns are kept,
but for those named like the outputs ``n_lines`` and ``n_removed``, which are replaced. An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import n_words, persist

GRAM, WINDOW = 2, 3
#: Words from which a line is a fingerprint by itself.
LONG = 25
#: A key, or an earliest document, with over one in ``SHARE`` of all rows is hot; so there are ``SHARE`` of them at most.
SHARE = 2000
#: Lines that an extension compares at first, and then; only what is still equal is compared to the end.
STEPS = (16, 512)
_BLANKS = " \t\n\x0b\x0c\r"


def line_hash(line: Column) -> Column:
    """60 bits of a hash of the line without outer white space."""
    return F.conv(F.substring(F.md5(F.btrim(line, F.lit(_BLANKS))), 1, 15), 16, 10).cast("long")


def _keyed(docs: DataFrame) -> DataFrame:
    text, doc = F.col("text").cast("string"), F.col("doc_id").cast("long")
    return docs.select(F.struct("*").alias("row"), text.alias("text"), F.coalesce(doc, F.lit(-(2**63)).cast("long")).alias("doc"), F.xxhash64(doc, doc.isNull(), F.coalesce(text, F.lit(""))).alias("tie"))


def fingerprints(lines: DataFrame, gram: int = GRAM, window: int = WINDOW, long: int = LONG) -> DataFrame:
    """``lines(doc, tie, hashes, words)`` to a row for each fingerprint: its key and place."""
    n = F.size("hashes") - (gram - 1)
    grams = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.slice("hashes", i, gram))).otherwise(F.array().cast("array<array<bigint>>"))
    rows = lines.withColumn("grams", grams).withColumn("value", F.transform("grams", lambda g: F.aggregate(g, F.lit(0).cast("long"), lambda a, x: F.shiftright(a, 1).bitwiseXOR(x))))
    least = lambda i: F.slice("value", i, window)
    starts = F.sequence(F.lit(1), F.greatest(F.size("value") - (window - 1), F.lit(1)))
    picked = F.array_distinct(F.transform(starts, lambda i: (i + F.array_position(least(i), F.array_min(least(i))) - 1).cast("int")))
    chosen = F.when(F.size("value") > 0, F.transform(picked, lambda i: F.struct(F.get("grams", i - 1).alias("key"), (i - 1).alias("pos")))).otherwise(F.array().cast("array<struct<key:array<bigint>,pos:int>>"))
    alone = F.filter(F.transform("words", lambda w, i: F.when(w >= long, F.struct(F.slice("hashes", i + 1, 1).alias("key"), i.alias("pos")))), lambda x: x.isNotNull())
    return rows.select("doc", "tie", F.inline(F.concat(chosen, alone)))


def _equal(a: Column, b: Column) -> Column:
    """How many items two arrays agree on from the start."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(at > 0, at - 1).otherwise(F.size(a)).cast("int")


def _run(a: Column, b: Column, i: Column, j: Column, back: bool) -> Column:
    """How many items ``a`` and ``b`` agree on, from the places i and j (from 0) on, or before them going back.

    Short runs look at a few items only, so many hits in a long document cost little each.
    """

    def part(most: Column) -> tuple[Column, Column]:
        if back:
            return tuple(F.reverse(F.slice(x, at - most + 1, most)) for x, at in ((a, i), (b, j)))
        return tuple(F.slice(x, at + 1, most) for x, at in ((a, i), (b, j)))

    there = F.least(i, j) if back else F.least(F.size(a) - i, F.size(b) - j)
    found = _equal(*part(there))
    for step in reversed(STEPS):
        near = _equal(*part(F.least(there, F.lit(step))))
        found = F.when((near < step) | (there <= step), near).otherwise(found)
    return found


def _first_places(marks: DataFrame) -> DataFrame:
    """``marks(key, at)`` that lie after their key's earliest place, with that place as ``first``.

    Hot keys are too few to matter in size and are broadcast, so that their marks stay where they are; the marks of
    the others meet their key in a shuffle.
    """
    first = persist(marks.groupBy("key").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "first")
    most = max(1, (first.agg(F.sum("n")).first()[0] or 0) // SHARE)
    hot = F.broadcast(first.where(F.col("n") > most).select("key", F.col("first").alias("known")))  # broadcast: SHARE rows at most
    marked = marks.join(hot, "key", "left")
    cold = marked.where("known is null").drop("known").join(first.where(F.col("n") <= most).select("key", "first"), "key")
    return marked.where("known is not null").withColumnRenamed("known", "first").unionByName(cold).where("at > first")


def repeated_lines(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, long: int = LONG) -> DataFrame:
    """For each document with repeats: ``doc``, ``tie``, and ``dropped``, the numbers of its lines to delete."""
    each = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), line_hash(x).alias("hash"), n_words(x).cast("int").alias("words")))
    lines = _keyed(docs).where("text is not null").select("doc", "tie", F.filter(each, lambda x: x["words"] > 0).alias("lines"))
    lines = lines.select("doc", "tie", F.col("lines.line").alias("line"), F.col("lines.hash").alias("hashes"), F.col("lines.words").alias("words"))
    lines = persist(lines.dropDuplicates(["doc", "tie"]), "lines")
    marks = persist(fingerprints(lines, gram, window, long).select("key", F.struct("doc", "tie", "pos").alias("at")), "marks")
    hits = _first_places(marks).groupBy(F.col("at.doc").alias("doc"), F.col("at.tie").alias("tie"), F.col("first.doc").alias("doc0"), F.col("first.tie").alias("tie0"))
    hits = hits.agg(F.array_sort(F.collect_set(F.struct(F.col("at.pos").alias("p"), F.col("first.pos").alias("q")))).alias("hits"))
    # a hit that goes on from the one before it, or the one before that, is in the same run
    follows = lambda x, y: (F.get("hits", y)["p"] == x["p"] - 1) & (F.get("hits", y)["q"] == x["q"] - 1)
    hits = persist(hits.withColumn("hits", F.filter("hits", lambda x, i: ~F.coalesce(follows(x, i - 1), F.lit(False)) & ~F.coalesce(follows(x, i - 2), F.lit(False)))), "hits")
    # an earliest document that very many have hits in comes once for each salt
    uses = persist(hits.groupBy("doc0", "tie0").agg(F.count(F.lit(1)).alias("n")), "uses")
    most = max(1, (uses.agg(F.sum("n")).first()[0] or 0) // SHARE)
    salts = uses.select("doc0", "tie0", F.ceil(F.col("n") / most).cast("int").alias("salts"))
    hot = F.broadcast(salts.where("salts > 1"))  # broadcast: SHARE rows at most
    pairs = hits.join(hot, ["doc0", "tie0"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc", "tie"), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
    earliest = lines.select(F.col("doc").alias("doc0"), F.col("tie").alias("tie0"), F.col("hashes").alias("b")).join(salts, ["doc0", "tie0"])
    earliest = earliest.select("doc0", "tie0", "b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    pairs = pairs.join(earliest, ["doc0", "tie0", "salt"]).join(lines.select("doc", "tie", "line", F.col("hashes").alias("a")), ["doc", "tie"])
    a, b = F.col("a"), F.col("b")
    places = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["p"] - _run(a, b, x["p"], x["q"], True), x["p"] + _run(a, b, x["p"], x["q"], False) - 1))))
    gone = pairs.select("doc", "tie", F.explode(F.transform(places, lambda i: F.get("line", i))).alias("gone"))
    return gone.groupBy("doc", "tie").agg(F.collect_set("gone").alias("dropped"))


def dedup_lines(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, long: int = LONG) -> DataFrame:
    """``docs`` with ``text`` without its repeated runs, and ``n_lines`` and ``n_removed``; a null text has 0 lines."""
    rows = _keyed(docs).join(repeated_lines(docs, gram, window, long), ["doc", "tie"], "left")
    parts = F.split("text", "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "dropped"), lambda i: F.get(parts, i))
    size = F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long")
    text = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    removed = F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long")
    kept_columns = [text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    return rows.select(*kept_columns, size.alias("n_lines"), removed.alias("n_removed"))
