"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A piece goes to the open window that it fills best; when none
fits, a new window opens while there is room, else the fullest is topped up with the head of the piece and emitted.
What is still open at a partition's end is merged: leftovers of ``FAN`` partitions meet in one task, round by round,
until one task holds the last ones. A task never holds more than ``open_windows * FAN`` windows beside its batch.

Nulls: a null text is an empty one, a null doc_id is kept. An empty text has the closing id only. Repeated rows are
packed as often as they occur. Very long texts fill whole windows of their own. An empty table gives no row.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import bounded, persist

#: Partitions whose leftovers meet in one task.
FAN = 64
CAPACITY = 1024
OPEN_WINDOWS = 32
#: Distinct chunks of text whose ids a task keeps.
CACHE = 400_000
PIECES = "part long, win long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in re.findall(r"(\w+) (?:long|binary)", PIECES)])
#: White space at which cutting a text could change its ids.
_ODD = re.compile(r"\A\s|\s\s|\s\Z")


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    The pre-tokenizer never joins what stands before a single blank to what stands after it, so a text without runs
    of white space is encoded blank by blank and the ids of frequent chunks are kept. The byte-pair merges come from
    the rank file of the same vocabulary, which gives the ids of ``byte_bpe_50k.json`` several times faster.
    ``added``: tokens and their ids that a text is cut at first, as the tokenizer does with its added tokens; without
    them such strings are ordinary text.
    """

    def __init__(self, ranks_path: str, pattern: str, added: dict[str, int] | None = None) -> None:
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encode = tiktoken.Encoding("pack", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._known: dict[str, bytes] = {}
        self._added = {t: i.to_bytes(4, "little") for t, i in (added or {}).items()}
        longest = sorted(self._added, key=len, reverse=True)  # of two that begin alike the longer one
        self._cuts = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None

    def _ids(self, text: str) -> bytes:
        ids = self._encode(text)
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def __call__(self, text: str) -> bytes:
        if self._cuts is None or not any(t in text for t in self._added):
            return self._plain(text)
        parts = self._cuts.split(text)
        return b"".join(self._added[x] if i % 2 else self._plain(x) for i, x in enumerate(parts) if x)

    def _plain(self, text: str) -> bytes:
        if _ODD.search(text):
            return self._ids(text)
        first, *rest = text.split(" ")
        known, out = self._known, [self._ids(first)]
        for part in rest:
            ids = known.get(part)
            if ids is None:
                ids = self._ids(" " + part)
                if len(known) < CACHE:
                    known[part] = ids
            out.append(ids)
        return b"".join(out)


class Windows:
    """The open windows of one task, and the emitted pieces as columns."""

    def __init__(self, capacity: int, most: int, prefix: int, part: int) -> None:
        self.capacity, self.most, self.prefix, self.part, self.made = capacity, most, prefix, part, 0
        self.open: dict[int, list] = {}  # window: its pieces
        self.gaps: list[tuple[int, int]] = []  # (gap, window), sorted
        self.out: list[tuple] = []

    def _new(self) -> int:
        self.made += 1
        return self.made - 1

    def _close(self, win: int, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) >> 2
            self.out.append((self.part, win, doc, start, n, zlib.crc32(ids), total, self.prefix + win, at, None))
            at += n

    def add(self, doc: int | None, start: int, ids: bytes, total: int) -> None:
        cap = self.capacity * 4
        whole = len(ids) - len(ids) % cap
        for i in range(0, whole, cap):
            self._close(self._new(), [(doc, start + i // 4, ids[i : i + cap], total)])
        ids, start = ids[whole:], start + whole // 4
        while ids:
            n = len(ids) >> 2
            at = bisect.bisect_left(self.gaps, (n, -1))
            if at < len(self.gaps):
                gap, win = self.gaps.pop(at)
            elif len(self.open) < self.most:
                gap, win = self.capacity, self._new()
                self.open[win] = []
            else:
                gap, win = self.gaps.pop(0)
            self.open[win].append((doc, start, ids[: gap * 4], total))
            ids, start = ids[gap * 4 :], start + min(gap, n)
            if n >= gap:
                self._close(win, self.open.pop(win))
            else:
                bisect.insort(self.gaps, (gap - n, win))

    def leave(self, last: bool) -> None:
        """Put out what is open: as leftovers, or for good after topping up the fuller windows from the emptier ones."""
        if last:
            left = sorted(self.open.items(), key=lambda x: (-sum(len(p[2]) for p in x[1]), x[0]))
            self.open, self.gaps, self.most = {}, [], 1
            for _, pieces in left:
                for piece in pieces:
                    self.add(*piece)
            for win, pieces in self.open.items():
                self._close(win, pieces)
        else:
            for win, pieces in self.open.items():
                self.out += [(self.part, win, doc, start, len(ids) >> 2, None, total, None, None, ids) for doc, start, ids, total in pieces]
        self.open, self.gaps = {}, []

    def taken(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(_ARROW), _ARROW.types, strict=True)], schema=_ARROW)


def _prefix(level: int, part: int) -> int:
    return level << 58 | part << 30


def pack(docs: DataFrame, tokenizer_file, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS, end_id: int = 0, added: dict[str, int] | None = None) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer_file``: (rank file, pre-tokenizer pattern). ``added``: tokens with ids of their own, as text. The first pass is written to the shared folder, so
    tokenizing happens once; later rounds touch leftovers only.
    """
    ranks, pattern = tokenizer_file
    end = end_id.to_bytes(4, "little")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = Encoder(ranks, pattern, added), TaskContext.get().partitionId()
        windows = Windows(capacity, open_windows, _prefix(0, part), part)
        for batch in bounded(batches, 1):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + end if text else end
                windows.add(doc, 0, ids, len(ids) >> 2)
                if len(windows.out) > 20_000:
                    yield windows.taken()
            yield windows.taken()
        windows.leave(False)
        yield windows.taken()

    def merge(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = None
            for batch in batches:
                for grp, doc, start, total, ids in zip(*(batch.column(n).to_pylist() for n in ("grp", "doc_id", "start", "doc_tokens", "ids")), strict=True):
                    if windows is None or windows.part != grp:
                        if windows is not None:
                            windows.leave(last)
                            yield windows.taken()
                        windows = Windows(capacity, open_windows, _prefix(level, grp), grp)
                    windows.add(doc, start, ids, total)
                if windows is not None:
                    yield windows.taken()
            if windows is not None:
                windows.leave(last)
                yield windows.taken()

        return run

    done = persist(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(first, PIECES), "pack")
    result, left, level = done.where("ids is null"), done.where("ids is not null"), 0
    parts = (left.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        level, parts = level + 1, -(-parts // FAN)
        turn = left.withColumn("grp", F.floor(F.col("part") / FAN)).repartition(parts, "grp").sortWithinPartitions("grp", "part", "win", "doc_id", "start")
        done = persist(turn.mapInArrow(merge(level, parts == 1), PIECES), "pack")
        result = result.unionAll(done.where("ids is null"))
        if parts == 1:
            return result.drop("part", "win", "ids")
        left = done.where("ids is not null")
