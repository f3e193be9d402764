"""Packing into as few sequences as possible by matching large items.

A piece of more than a third of a sequence is large: no sequence holds three, so large pieces meet in a matching. From
the longest down, each takes the longest large piece that still fits beside it. What fits beside a long piece fits
beside every shorter one too, so this greedy matching leaves as few sequences with a single large piece as any
matching. The smaller pieces then go, longest first, each to the sequence whose gap it fits best, and a new sequence is
begun only where it fits no gap.

Pieces are known by their lengths, and lengths are few: at most as many as a sequence has tokens. Counts by length come
to the driver, whatever the number of pieces, and both steps work on counts: sequences with equal gaps are a range of
numbers, which a step takes, fills or splits as a whole. A length touches a range once, so the plan's size depends on the
sequence's length alone. Pieces take their places by their rank among those of their length (see `packing.ranked`).

Defined results: a null or empty text is the end id alone. Documents longer than a sequence are cut at multiples of it.
Repeated rows are packed each; of pieces that tie in doc_id and start any may take either place. An empty table gives an
empty result. Pieces of no length or longer than a sequence get none (null). `pack` keeps all columns; those named
sequence_id and offset are replaced.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import table, tokenizer_path, unused, written
from .packing import pieces_of, ranked

#: Tokens in a sequence, the id that ends a document.
CAPACITY, END_ID = 2048, 0

#: Ranks of a length up to this number have places.
MOST_RANKS = 1 << 48

Place = tuple[int, int, int, int, int]


class Bins:
    """Sequences by their gaps, each gap with its ranges (first sequence, how many), and the places given so far.

    A place is (length, first rank, how many of the length in each sequence, first sequence, offset there).
    """

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.of: dict[int, list[tuple[int, int]]] = {}
        self.gaps: list[int] = []
        self.places: list[Place] = []
        self.used: dict[int, int] = {}

    def add(self, gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in self.of:
                self.of[gap] = []
                insort(self.gaps, gap)
            self.of[gap].append((first, n))

    def take(self, gap: int) -> tuple[int, int]:
        """A range of sequences with this gap."""
        found = self.of[gap].pop()
        if not self.of[gap]:
            del self.of[gap]
            del self.gaps[bisect_left(self.gaps, gap)]
        return found

    def new(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def put(self, length: int, each: int, n: int, first: int, offset: int) -> None:
        """`each` pieces of a length into each of `n` sequences from `first` on."""
        rank = self.used.get(length, 0)
        self.used[length] = rank + each * n
        self.places.append((length, rank, each, first, offset))


def match_large(counts: dict[int, int], bins: Bins) -> None:
    """Sequences for the lengths over a third: two pieces each where one fits beside another, else one."""
    left = {k: n for k, n in counts.items() if n and 3 * k > bins.capacity}
    lengths = sorted(left)
    while lengths:
        longest = lengths[-1]
        at = bisect_left(lengths, bins.capacity - longest + 1) - 1
        if at >= 0 and lengths[at] == longest and left[longest] < 2:
            at -= 1  # the only one of its length can't stand beside itself
        if at < 0:
            n = left[longest]
            first = bins.new(n)
            bins.put(longest, 1, n, first, 0)
            bins.add(bins.capacity - longest, first, n)
            taken = {longest: n}
        else:
            other = lengths[at]
            if other == longest:
                n = left[longest] // 2
                first = bins.new(n)
                bins.put(longest, 2, n, first, 0)
                taken = {longest: 2 * n}
            else:
                n = min(left[longest], left[other])
                first = bins.new(n)
                bins.put(longest, 1, n, first, 0)
                bins.put(other, 1, n, first, longest)
                taken = {longest: n, other: n}
            bins.add(bins.capacity - longest - other, first, n)
        for k, n in taken.items():
            left[k] -= n
            if not left[k]:
                lengths.remove(k)


def fit_small(counts: dict[int, int], bins: Bins) -> None:
    """Best fit, longest first: a sequence that a piece fits best is the best one for the next piece too, until it is full."""
    for length in sorted((k for k, n in counts.items() if n and 0 < 3 * k <= bins.capacity), reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(bins.gaps, length)
            if at < len(bins.gaps):
                gap = bins.gaps[at]
                first, n = bins.take(gap)
            else:
                gap = bins.capacity
                n = -(-left // (gap // length))
                first = bins.new(n)
            each = gap // length
            full, offset = min(n, left // each), bins.capacity - gap
            if full:
                bins.put(length, each, full, first, offset)
                bins.add(gap - each * length, first, full)
                left -= each * full
            if left and full < n:  # the last of them, in one sequence
                bins.put(length, left, 1, first + full, offset)
                bins.add(gap - left * length, first + full, 1)
                full, left = full + 1, 0
            bins.add(gap, first + full, n - full)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Place], int]:
    """The places of all pieces, known by how many there are of each length, and the number of sequences."""
    bins = Bins(capacity)
    match_large({k: n for k, n in counts.items() if k <= capacity}, bins)
    fit_small(counts, bins)
    return bins.places, bins.sequences


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """`pieces` (with `length`) with sequence_id and offset. It is read three times: it should be a written table.

    `order` says which piece takes which place; its columns should tell pieces apart.
    """
    pieces = pieces.drop("sequence_id", "offset")
    fits = F.col("length").between(1, capacity)
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().where(fits).collect()}  # `capacity` rows at most
    places, _ = plan(counts, capacity)
    held = np.array(sorted(places), np.int64).reshape(-1, 5)
    starts = held[:, 0] * MOST_RANKS + held[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            own, rank = batch.select(names), batch.column("_rank").fill_null(0).to_numpy(zero_copy_only=False)
            told = (length > 0) & (length <= capacity)
            at = np.searchsorted(starts, np.where(told, length * MOST_RANKS + rank, 0), "right") - 1
            place = held[np.where(told, at, 0)] if len(held) else np.zeros((len(length), 5), np.int64)
            _, first, each, sequence, offset = place.T
            in_place, each = rank - first, np.maximum(each, 1)
            for made in (sequence + in_place // each, offset + in_place % each * length):
                own = own.append_column("_", pa.array(made, pa.int64(), mask=~told))
            yield pa.RecordBatch.from_arrays(own.columns, [*names, "sequence_id", "offset"])

    names = pieces.columns
    schema = StructType([*pieces.schema.fields]).add("sequence_id", LongType()).add("offset", LongType())
    return ranked(pieces, sum(counts.values()), list(order)).mapInArrow(run, schema)


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of `docs`: doc_id, piece, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = pieces_of(docs, path, capacity, end_id).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    number = unused(pieces, "number")[0]
    pieces = pieces.withColumns({"piece": (F.col("start") / capacity).cast("int"), number: F.monotonically_increasing_id()})
    return pack(written(pieces, "pieces"), capacity, ("doc_id", "start", number)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), tokenizer_path())
