"""Packing token pieces into windows by minimum bin slack.

Pieces are known by their lengths, and lengths are few: at most as many as the window has tokens. So the whole problem
is a table of counts by length, which comes to the driver whatever the number of pieces. Of the lengths left, the
longest opens a window; a bitset subset-sum over the others (bit s: some multiset of them adds up to s) tells how full the
window can become, and backtracking through the bitsets gives the counts of the fullest. This window is repeated as often
as its lengths last, so each step uses up a length and the plan has a few thousand windows at most, each with a number
of repetitions. Pieces then take their places by their rank among the pieces of their length.

Ranks are made in two steps, within hashed blocks and by the blocks' counts, so a length that a third of all pieces have
meets in no single task, nor do repeated rows, as each piece has a number of its own.

Defined results: a null or empty text is the end id alone. Documents longer than the window are cut at multiples of it.
Repeated rows are packed each. An empty table gives an empty result. Pieces of no length or longer than the window get
no sequence (null). `pack` keeps all columns; those named sequence_id and offset are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, tokenizer_path, written
from .tokens import encoder, small

#: Tokens in a window, the id that ends a document, pieces in a block of ranks.
WINDOW, END_ID, BLOCK_ROWS = 4096, 2, 4096


def pieces_of(
    docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Each document's ids and the end id in pieces of at most `window`: doc_id, start, length, doc_tokens, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        end = own.pack([end_id])
        for batch in small(batches):
            docs, starts, lengths, totals, ids = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = own.encode(text.as_py()) + end
                n = len(found) // 4
                for start in range(0, n, window):
                    ids.append(found[4 * start : 4 * (start + window)])
                    docs.append(doc)
                    starts.append(start)
                    lengths.append(len(ids[-1]) // 4)
                    totals.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in ((docs, pa.int64()), (starts, pa.int64()), (lengths, pa.int64()), (totals, pa.int64()), (ids, pa.binary()))],
                ["doc_id", "start", "length", "doc_tokens", "ids"],
            )

    return docs.select(F.col(doc_id).cast("bigint"), F.col(text)).mapInArrow(
        run, "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary"
    )


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, at most `counts` of each, whose sum is largest within `room`; longer lengths are tried first."""
    reach, mask = 1, (1 << room + 1) - 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, some = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            some = min(some, left)  # 1, 2, 4, ... copies at a time give every number of copies
            steps.append((length, some, reach))
            reach |= reach << length * some & mask
            left, some = left - some, 2 * some
        if reach >> room & 1:
            break
    full, out = reach.bit_length() - 1, {}
    for length, some, before in reversed(steps):
        if not before >> full & 1:
            full -= length * some
            out[length] = out.get(length, 0) + some
    return out


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Windows as (how many of each length, repetitions), until no piece is left."""
    left = {k: n for k, n in counts.items() if n > 0 and 0 < k <= window}
    out = []
    while left:
        longest = max(left)
        rest = {k: n - (k == longest) for k, n in left.items() if n > (k == longest)}
        made = fullest(rest, window - longest)
        made[longest] = made.get(longest, 0) + 1
        times = min(left[k] // n for k, n in made.items())
        out.append((made, times))
        for k, n in made.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def places(planned: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """By length and range of ranks: (length, first rank, rank after the last, number in a window, first sequence, offset)."""
    out, used, sequence = [], {}, 0
    for made, times in planned:
        offset = 0
        for length in sorted(made, reverse=True):
            first = used.get(length, 0)
            used[length] = first + made[length] * times
            out.append((length, first, used[length], made[length], sequence, offset))
            offset += length * made[length]
        sequence += times
    return out


def ranked(pieces: DataFrame, total: int, order: list[str]) -> DataFrame:
    """`pieces` with `_rank` among the pieces of the same length, from 0; without a length it is null."""
    blocks = total // BLOCK_ROWS + 1
    own = pieces.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.groupBy("length", "_block").count().withColumn("_base", F.coalesce(F.sum("count").over(before), F.lit(0)))
    within = Window.partitionBy("length", "_block").orderBy(*order)
    out = own.withColumn("_in_block", F.row_number().over(within) - 1).join(starts.drop("count"), ["length", "_block"], "left")
    return out.withColumn("_rank", F.col("_base") + F.col("_in_block")).drop("_block", "_base", "_in_block")


def pack(pieces: DataFrame, window: int = WINDOW, order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """`pieces` (with `length`) with sequence_id and offset. It is read three times: it should be a written table.

    `order` says which piece takes which place; its columns should tell pieces apart.
    """
    pieces = pieces.drop("sequence_id", "offset")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().where(F.col("length").between(1, window)).collect()}
    told = places(plan(counts, window))  # some ten thousand rows at most, as lengths are at most `window`
    spark = pieces.sparkSession
    if not told:
        return pieces.withColumns({"sequence_id": F.lit(None).cast("bigint"), "offset": F.lit(None).cast("bigint")})
    rows = spark.createDataFrame(told, "length bigint, first bigint, last bigint, each bigint, sequence bigint, at bigint")
    by_length = rows.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "last", "each", "sequence", "at"))).alias("_places"))
    out = ranked(pieces, sum(counts.values()), list(order)).join(F.broadcast(by_length), "length", "left")
    fits = F.filter("_places", lambda p: (p["first"] <= F.col("_rank")) & (F.col("_rank") < p["last"]))
    out = out.withColumn("_place", F.get(fits, F.lit(0)))
    in_place = F.col("_rank") - F.col("_place.first")
    return out.withColumns(
        {
            "sequence_id": F.col("_place.sequence") + F.floor(in_place / F.col("_place.each")),
            "offset": F.col("_place.at") + F.pmod(in_place, F.col("_place.each")) * F.col("length"),
        }
    ).drop("_places", "_place", "_rank")


def packed(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of `docs`: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = pieces_of(docs, path, window, end_id).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    numbered = written(pieces.withColumn("number", F.monotonically_increasing_id()), "pieces")
    return pack(numbered, window, ("doc_id", "start", "number")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def sequences(pieces: DataFrame, pad_id: int, window: int = WINDOW) -> DataFrame:
    """Packed pieces with `ids` as token sequences: sequence_id, tokens, ids padded to the window unless full to a power of two."""

    def fill(of_one: pa.Table) -> pa.Table:
        rows = sorted(of_one.select(["offset", "ids", "sequence_id"]).to_pylist(), key=lambda r: r["offset"])
        ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in rows])
        n = len(ids)
        padded = ids if n & (n - 1) == 0 else np.concatenate([ids, np.full(window - n, pad_id, "<u4")])
        return pa.table({"sequence_id": pa.array([rows[0]["sequence_id"]], pa.int64()), "tokens": pa.array([n], pa.int64()), "ids": pa.array([padded.astype("<u4").tobytes()], pa.binary())})

    return pieces.where("sequence_id IS NOT NULL").groupBy("sequence_id").applyInArrow(fill, "sequence_id bigint, tokens bigint, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), tokenizer_path())
