"""Token ids in compact binary files: canonical Huffman codes of limited length from global counts.

Ids are counted over all documents; package-merge gives the best code lengths within `MOST_BITS`, and canonical codes
follow from the lengths alone. Files hold documents in ascending order of doc_id (nulls first, ties by content), each
file a range of them: a header, the documents' ids and token counts, a bit offset for each block of `BLOCK_TOKENS`
tokens, then the codes. Blocks decode independently of each other through one table of 2 ** MOST_BITS entries, many
blocks in step at a time.

Each file has a name that no other attempt of its task has, and the table of files names those that count, so a task that
runs again needs no renaming, which some stores refuse. `write` returns that table. The folder must be on a store that pyarrow reaches (local or shared disk, HDFS, S3, GCS).

Defined results: a null or empty text is the end id alone; repeated rows are documents of their own; an empty table
gives no file and an empty result. Ids that never occur have no code. Other columns are not looked at.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, table, tokenizer_path, written
from .tokens import encoder, small

#: Longest code, tokens in a block, tokens in a file at most (a document stays in one file), tokens coded together.
MOST_BITS, BLOCK_TOKENS, FILE_TOKENS, TOGETHER = 20, 512, 8_000_000, 256 * 1024

#: The id that the query puts after each document.
END_ID = 1

MAGIC, HEADER = b"GWHUF01\0", struct.Struct("<8sQQQIIQ")


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Bits of each id's code by package-merge; 0 for ids without occurrence."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << most:
        raise ValueError(f"{n} ids need codes of more than {most} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    levels, merged = [], leaves
    is_leaf = np.ones(n, bool)
    for _ in range(most):
        levels.append(is_leaf)
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        order = np.argsort(both, kind="stable")
        merged, is_leaf = both[order], order < n
    taken = 2 * n - 2
    for is_leaf in reversed(levels):
        of_leaves = int(is_leaf[:taken].sum())
        lengths[used[:of_leaves]] += 1
        taken = 2 * (taken - of_leaves)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    for bits in range(1, int(lengths.max(initial=0)) + 1):
        ids = np.flatnonzero(lengths == bits)
        code <<= bits - last
        codes[ids] = code + np.arange(len(ids), dtype=np.uint64)
        code, last = code + len(ids), bits
    return codes


def decoding_table(lengths: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """For each `most` bits: the id of the code that they begin with, times 32, plus its length."""
    out = np.zeros(1 << most, np.uint32)
    codes = canonical(lengths)
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    spans = np.left_shift(1, most - lengths[ids].astype(np.int64))
    filled = np.repeat((ids.astype(np.uint32) << np.uint32(5)) | lengths[ids], spans)
    out[: len(filled)] = filled  # canonical codes cover the table from 0 on, in this order
    assert not len(ids) or int(codes[ids[0]]) == 0
    return out


def encode(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of `ids` in big-endian 64-bit words, and the bit at which each id begins."""
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    at = ends - bits
    word, shift = at >> 6, 64 - (at & 63) - bits
    code = codes[ids]
    over = shift < 0
    first = np.where(over, code >> np.where(over, -shift, 0).astype(np.uint64), code << np.where(over, 0, shift).astype(np.uint64))
    out = np.zeros(int(ends[-1] + 63 >> 6) if len(ids) else 0, np.uint64)
    if len(ids):
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[starts]] = np.bitwise_or.reduceat(first, starts)
        split = np.flatnonzero(over)
        out[word[split] + 1] |= code[split] << (64 + shift[split]).astype(np.uint64)
    return out.astype(">u8").tobytes(), at


def decode(payload: bytes, offsets: np.ndarray, sizes: np.ndarray, decoding: np.ndarray, most: int = MOST_BITS, lanes: int = 2048) -> Iterator[np.ndarray]:
    """The ids of blocks that begin at bit `offsets` and hold `sizes` ids, some blocks at a time."""
    words = np.concatenate([np.frombuffer(payload, ">u8").astype(np.uint64), np.zeros(2, np.uint64)])
    for low in range(0, len(offsets), lanes):
        at, own = offsets[low : low + lanes].astype(np.int64), sizes[low : low + lanes]
        out = np.zeros((len(at), int(own.max(initial=0))), np.uint32)
        for j in range(out.shape[1]):
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            seen = (words[word] << shift) | ((words[word + 1] >> np.uint64(1)) >> (np.uint64(63) - shift))
            entry = decoding[(seen >> np.uint64(64 - most)).astype(np.int64)]
            out[:, j] = entry >> np.uint32(5)
            at = np.minimum(at + (entry & np.uint32(31)), 64 * (len(words) - 2))
        yield out[np.arange(out.shape[1]) < own[:, None]]


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def put(path: str, parts: list[bytes]) -> int:
    store, name = place(path)
    with store.open_output_stream(name) as out:
        for x in parts:
            out.write(x)
    return sum(map(len, parts))


class Writer:
    """One task's files."""

    def __init__(self, folder: str, task: int, lengths: np.ndarray):
        self.folder, self.task, self.lengths, self.codes = folder, task, lengths, canonical(lengths)
        self.files = 0
        self.clear()

    def clear(self) -> None:
        self.docs: list[int | None] = []
        self.sizes: list[int] = []
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = self.bits = 0
        self.payload: list[bytes] = []
        self.offsets: list[np.ndarray] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.sizes.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_tokens += len(ids)
        if self.n_held >= TOGETHER:
            self.code(self.n_held // BLOCK_TOKENS * BLOCK_TOKENS)

    def code(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint16)
        for low in range(0, n, TOGETHER):
            payload, at = encode(ids[low : min(low + TOGETHER, n)], self.codes, self.lengths)
            self.offsets.append(at[::BLOCK_TOKENS] + self.bits)
            self.payload.append(payload)
            self.bits += 8 * len(payload)
        self.held, self.n_held = [ids[n:].copy()], len(ids) - n

    def close(self) -> tuple[str, int, int, int] | None:
        if not self.docs:
            return None
        self.code(self.n_held)
        name = f"{self.task:08d}-{self.files:06d}-{uuid.uuid4().hex}.huf"  # in order of the documents
        offsets = np.concatenate([np.zeros(0, np.int64), *self.offsets])
        docs = np.array([0 if x is None else x for x in self.docs], "<i8").tobytes() + np.array([x is None for x in self.docs], "u1").tobytes()
        index = zlib.compress(docs + np.array(self.sizes, "<u4").tobytes() + offsets.astype("<u8").tobytes(), 1)
        head = HEADER.pack(MAGIC, len(self.docs), self.n_tokens, len(offsets), BLOCK_TOKENS, MOST_BITS, len(index))
        size = put(f"{self.folder}/{name}", [head, index, *self.payload])
        out = (name, len(self.docs), self.n_tokens, size)
        self.files += 1
        self.clear()
        return out


def read_file(path: str, decoding: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
    """Each document of a file with its ids, in order."""
    store, name = place(path)
    with store.open_input_stream(name) as stream:
        data = stream.read()
    magic, n_docs, n_tokens, n_blocks, block, most, n_index = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError(f"{path} is not such a file")
    index = zlib.decompress(data[HEADER.size : HEADER.size + n_index])
    docs, nulls = np.frombuffer(index, "<i8", n_docs), np.frombuffer(index, "u1", n_docs, 8 * n_docs)
    sizes, offsets = np.frombuffer(index, "<u4", n_docs, 9 * n_docs), np.frombuffer(index, "<u8", n_blocks, 13 * n_docs)
    of_block = np.full(n_blocks, block)
    if n_blocks:
        of_block[-1] = n_tokens - block * (n_blocks - 1)
    blocks, rest = decode(memoryview(data)[HEADER.size + n_index :], offsets, of_block, decoding, most), np.zeros(0, np.uint32)
    for doc, null, n in zip(docs.tolist(), nulls.tolist(), sizes.tolist(), strict=True):
        if len(rest) < n:
            parts, have = [rest], len(rest)
            while have < n:
                parts.append(next(blocks))
                have += len(parts[-1])
            rest = np.concatenate(parts)
        yield (None if null else doc), rest[:n]
        rest = rest[n:]


def token_table(docs: DataFrame, path: str, end_id: int | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids as little-endian bytes, of 16 bits if the vocabulary allows, as a written table.

    Ids are counted as they are made: each task ends with a row without ids that has the counts of its ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        size = max(own.tokenizer.get_vocab_size(), (end_id or 0) + 1)
        width = 2 if size <= 1 << 16 else 4
        end = own.pack([end_id]) if end_id is not None else b""
        total = np.zeros(size, np.int64)
        names = ["doc_id", "ids", "width", "counts"]
        for batch in small(batches):
            ids = [np.frombuffer(own.encode(x.as_py()) + end, "<u4").astype(f"<u{width}") for x in batch.column(1)]
            total += np.bincount(np.concatenate(ids), minlength=size)
            n = len(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([width] * n, pa.int32()), pa.nulls(n, pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([width], pa.int32()), pa.array([total.tobytes()], pa.binary())], names)

    rows = docs.select(F.col(doc_id).cast("bigint"), F.col(text))
    return written(rows.mapInArrow(run, "doc_id bigint, ids binary, width int, counts binary"), "ids")


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents: the tasks' counts, summed by id; as long as the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for counts in batch.column(0):
                n = np.frombuffer(counts.as_py(), np.int64)
                total = total + n if len(total) else n
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])

    rows = tokens.where("counts IS NOT NULL").select("counts").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def write(tokens: DataFrame, folder: str) -> tuple[DataFrame, np.ndarray]:
    """Files of `tokens` (a token_table) in `folder`; gives the written table of files (file, documents, tokens, bytes, start) and the code lengths."""
    counts = id_counts(tokens)
    lengths = code_lengths(counts)
    store, name = place(folder)
    store.create_dir(name)
    put(f"{folder}/codebook.bin", [zlib.compress(lengths.tobytes())])
    parts = int(counts.sum()) // FILE_TOKENS + 1
    # Repeated rows are told apart by a number, so they are many ranges too.
    order = ("doc_id", "_tie", "_row")
    numbered = tokens.where("ids IS NOT NULL").drop("counts").withColumns({"_tie": F.xxhash64("ids"), "_row": F.monotonically_increasing_id()})
    ordered = numbered.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, done = Writer(folder, TaskContext.get().partitionId(), lengths), []
        for batch in batches:
            for doc, ids, width in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                own.add(doc, np.frombuffer(ids.as_buffer(), f"<u{width}"))
                if own.n_tokens >= FILE_TOKENS:
                    done.append(own.close())
        done += [x for x in [own.close()] if x]
        columns = list(zip(*done, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(columns[0]), pa.string()), *(pa.array(list(c), pa.int64()) for c in columns[1:])],
            ["file", "documents", "tokens", "bytes"],
        )

    files = written(ordered.drop("_tie", "_row").mapInArrow(run, "file string, documents bigint, tokens bigint, bytes bigint"), "files")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file of some million tokens
    return files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))), lengths


#: What `read` gives by itself.
PLAIN = ("ids binary", lambda ids: (ids.astype("<u4").tobytes(),))


def read(files: DataFrame, folder: str, view: tuple = PLAIN) -> DataFrame:
    """Each document of the files: doc_id, start, n_tokens and what `view`, a schema and a function, makes of its ids."""
    names = ["doc_id", "start", "n_tokens", *(x.split()[0] for x in view[0].split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, name = place(f"{folder}/codebook.bin")
        with store.open_input_stream(name) as stream:
            decoding = decoding_table(np.frombuffer(zlib.decompress(stream.read()), np.uint8))
        for batch in batches:
            for file, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list[tuple] = []
                for doc, ids in read_file(f"{folder}/{file}", decoding):
                    rows.append((doc, start, len(ids), *view[1](ids)))
                    start += len(ids)
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], names)

    # Each file to a task of its own, or nearly so; the executors read them from the shared folder.
    spread = files.select("file", "start").repartition(max(1, files.count()))
    return spread.mapInArrow(run, f"doc_id bigint, start bigint, n_tokens bigint, {view[0]}")


CHECKSUM = ("ids_crc32 bigint", lambda ids: (zlib.crc32(ids.astype("<u4").tobytes()),))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "huffman")
    files, _ = write(token_table(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID), folder)
    return read(files, folder, CHECKSUM)
