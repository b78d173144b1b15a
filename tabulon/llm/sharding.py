"""Two-pass external shuffle into shards of equal row counts.

First pass: rows are scattered uniformly over buckets by a seeded hash of id and text and written to the shared folder,
so that the same seed gives the same shuffle however the input is cut. Rows that repeat in id and text would all meet
in one bucket; only for those the place in the input takes part in the hash. Buckets are sized to fit a task's memory. Second pass: a task reads one bucket after the other,
puts it into a canonical order, Fisher-Yates shuffles it with the bucket's own seed, and numbers its rows from the
bucket's place in the whole. The shuffled order is cut into runs of equal length: shard ``p * shards // rows``.

Law ``rows``: shard sizes differ by one at most. Rows that repeat spread like all others. Both passes see the written scatter, so a lost executor changes
nothing. Nulls in any column are carried; an empty or null text is as good as another; texts of any length are single
rows. Input columns are kept, but for those named like the outputs ``shard`` and ``slot``, which are replaced. An empty
table gives no row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import persist, shared_dir, utf8_size

SHARDS = 16
SEED = 20_241
#: Bytes of text in a bucket, about: what a task holds at once.
BUCKET_BYTES = 8 << 20
#: Buckets that a task reads one after the other, about.
TASK_BUCKETS = 2
#: Bytes that a row is reckoned with besides its text.
ROW_BYTES = 64
#: Buckets summed up in one task; the sums of such groups are summed in another.
GROUP = 4096
#: Rows handed back at once.
BATCH = 2000


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform permutation of range(n): from the end, each place swaps with a random place up to it."""
    rng, order = np.random.default_rng(seed), np.arange(n)
    swap = (rng.random(n) * (np.arange(n) + 1)).astype(np.int64)
    for i in range(n - 1, 0, -1):
        j = swap[i]
        order[i], order[j] = order[j], order[i]
    return order


def _shuffled(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            bucket, begin = table.column("bucket")[0].as_py(), table.column("begin")[0].as_py()
            order = fisher_yates(len(table), seed + bucket)
            for i in range(0, len(order), BATCH):
                part = table.take(pa.array(order[i : i + BATCH])).combine_chunks()
                place = pa.array(begin + np.arange(i, i + len(part)))
                part = part.set_column(part.schema.get_field_index("begin"), pa.field("begin", pa.int64()), place)
                yield from part.to_batches()

        for batch in batches:
            buckets = np.asarray(batch.column("bucket"))
            cuts = [0, *(np.nonzero(np.diff(buckets))[0] + 1).tolist(), len(buckets)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and held[0].column("bucket")[0].as_py() != buckets[a]:
                    yield from out()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from out()

    return run


def shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with ``doc_id`` and ``text``, all columns, and ``shard int`` and ``slot long``."""
    bytes_, = docs.agg(F.sum(utf8_size(F.col("text")) + ROW_BYTES)).first()
    buckets = max(1, -(-(bytes_ or 0) // bucket_bytes))
    hashed = docs.select(F.struct("*").alias("row"), F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("hash"))
    # written first, so that its true size decides whether it is broadcast
    repeated = persist(hashed.groupBy("hash").count().where("count > 1").select("hash", F.lit(True).alias("repeats")), "repeated")
    scatter = F.when(F.col("repeats"), F.xxhash64("hash", F.monotonically_increasing_id())).otherwise(F.col("hash"))
    rows = hashed.join(repeated, "hash", "left").select("row", scatter.alias("scatter"))
    rows = persist(rows.withColumn("bucket", F.pmod("scatter", F.lit(buckets))), "scatter")

    counts = rows.groupBy("bucket").count().withColumn("grp", F.floor(F.col("bucket") / GROUP))
    groups = counts.groupBy("grp").agg(F.sum("count").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("count").over(Window.partitionBy("grp").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = persist(counts.join(groups.select("grp", before.alias("before")), "grp").select("bucket", (F.col("before") + inside).cast("long").alias("begin")), "begins")
    total = rows.count()

    # a task gets about TASK_BUCKETS buckets, however many there are
    dealt = rows.repartition(-(-buckets // TASK_BUCKETS), "bucket").join(begins, "bucket").sortWithinPartitions("bucket", "scatter")
    mixed = dealt.mapInArrow(_shuffled(seed), dealt.schema)
    # whole numbers throughout: shard s begins at the place ceil(s * total / shards)
    shard = f"((begin * {shards}L) div {max(total, 1)}L)"
    slot = f"begin - (({shard} * {total}L + {shards - 1}L) div {shards}L)"
    mixed = mixed.select("row", F.expr(shard).cast("int").alias("shard"), F.expr(slot).cast("long").alias("slot"))
    return mixed.select(*(F.col(f"row.`{c}`") for c in docs.columns if c not in ("shard", "slot")), "shard", "slot")


def write_shards(docs: DataFrame, path: str | None = None, **options) -> str:
    """Write the shuffled shards as one Parquet folder for each, every file in the order of its slots; returns the path, a new one by default."""
    path = path or f"{shared_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    shuffle(docs, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path
