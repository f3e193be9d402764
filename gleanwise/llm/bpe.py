"""BPE encoding and decoding by tree concatenation.

A text of more than HALF_CHARS characters is halved, wherever that is, until its pieces are short. The pieces are encoded
for themselves and joined pairwise up the tree: a join encodes some words from either side of the seam again, twice as many
each time, until the first and the last of them have the ids that they had. Pieces are encoded word by word, as white space
parts a text into words whose ids are independent of each other; a worker keeps a bounded table of words.

What white space does not part is a word, however long. A long word is normalised once, as a whole, and cut into pre-tokens by the tokenizer's own
splitter. A long pre-token is halved until its parts are short; the parts are encoded in parallel, those before the last as
text that goes on, then joined pairwise up the tree. A join re-encodes some tokens from either side of the seam, twice as
many each time, until the window's first token is the left side's and its last token the right side's. BPE encodings are
settled by neighbouring tokens: a sequence is the encoding of its text if each pair of neighbours is the encoding of the
pair's text. All pairs lie within the left side, the window or the right side, so agreement at both ends proves the result.

Long texts become parts, slices of whole words or chunks of a long pre-token. Parts are rows of their own, dealt out to
all executors, and so are encoded in parallel; only one document's ids meet in a task. Every long text and every long word
goes through its tree.

Defined results: null and empty texts have no ids and decode to the empty text. Strings of special tokens in a text give
their ids, as in the library. Rows with equal ids or texts are encoded each. Columns of the input with the names of the
results are replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import table, tokenizer_path
from .tokens import CUT, SPACE_RUN, Encoder, small, words_of

#: Texts longer than this are cut into parts of about this length; longer words are encoded by their pre-tokens, and
#: pre-tokens of more symbols than LONG_SYMBOLS are halved.
LEAF_CHARS, LONG_WORD, LONG_SYMBOLS = 32_768, 1024, 512

#: Texts longer than this are halved, wherever that is, until they are not.
HALF_CHARS = 4096

#: Ids of a pre-token's part, with the number of symbols of each.
Ids = list[tuple[int, int]]


class Half(NamedTuple):
    """A piece of a text: its words, the ids of each, and whether it begins and ends within a word."""

    words: list[str]
    ids: list[bytes]
    open_left: bool
    open_right: bool


#: Kinds of a text's parts: words; symbols of whole pre-tokens, with spaces between; a chunk of a pre-token, its last one;
#: the id of a special token.
WORDS, TOKENS, CHUNK, END, SPECIAL = "words", "tokens", "chunk", "end", "special"


class TreeEncoder:
    def __init__(self, path: str, leaf: int = LEAF_CHARS, long_word: int = LONG_WORD, long_symbols: int = LONG_SYMBOLS, half_chars: int = HALF_CHARS):
        from tokenizers.models import BPE

        self.base = Encoder(path)
        self.half_chars, self.joins = half_chars, 0
        self.leaf, self.long_word, self.long_symbols = leaf, long_word, long_symbols
        self.tokenizer = self.base.tokenizer
        told = json.loads(self.tokenizer.to_str())
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.specials = re.compile("|".join(map(re.escape, self.special)))
        model = told["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ends, self.goes_on = self.tokenizer.model, BPE(vocab=model["vocab"], merges=merges)
        self.base.long_word, self.base.long_ids = long_word, self.long_ids
        self.names = {i: w.encode() for w, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}

    # Texts with white space.
    def text_ids(self, text: str) -> bytes:
        """Ids of a text: it is prepared as a whole, and if it is long, encoded in halves that are joined."""
        if len(text) <= self.half_chars:
            return self.base.encode(text)
        return b"".join(self.tree(self.base.prepared(text)).ids)

    def tree(self, text: str) -> Half:
        """A text's halves, each encoded for itself, joined."""
        if len(text) > self.half_chars:
            middle = len(text) // 2
            return self.join(self.tree(text[:middle]), self.tree(text[middle:]))
        words = words_of(text)
        return Half(words, self.base.encode_words(words), not SPACE_RUN.match(text), not SPACE_RUN.match(text, len(text) - 1))

    def join(self, left: Half, right: Half) -> Half:
        """Both sides, with some words on either side of the seam encoded again, twice as many each time, until the
        window's first and last words have the ids that the sides gave them. The seam is within the window's middle word
        only, so what both sides agree on is settled. White space at the seam leaves nothing to encode again."""
        self.joins += 1
        words, ids = left.words + right.words, left.ids + right.ids
        if left.open_right and right.open_left:
            k, n, m = 2, len(left.words), len(right.words)
            while True:
                low, high = max(0, n - k), min(m, k)
                window = [*left.words[low:-1], left.words[-1] + right.words[0], *right.words[1:high]]
                found = self.base.encode_words(window)
                if (low == 0 or found[0] == left.ids[low]) and (high == m or found[-1] == right.ids[high - 1]):
                    break
                k *= 2
            words, ids = left.words[:low] + window + right.words[high:], left.ids[:low] + found + right.ids[high:]
        return Half(words, ids, left.open_left, right.open_right)

    # Sections between special tokens.
    def sections(self, text: str) -> list[str | int]:
        """The text cut at the strings of special tokens, which are given as their ids."""
        out: list[str | int] = []
        at = 0
        for found in self.specials.finditer(text):
            out += [text[at : found.start()]] * (found.start() > at) + [self.special[found[0]]]
            at = found.end()
        return [*out, text[at:]] if at < len(text) else out

    # Long words.
    def pre_tokens(self, word: str) -> list[str]:
        """The symbols of each pre-token of a word; it is normalised here, once and as a whole."""
        return [symbols for symbols, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(word))]

    def long_ids(self, word: str) -> bytes:
        """Ids of a word of any length."""
        out = b""
        for section in self.sections(word):
            if isinstance(section, int):
                out += self.base.pack([section])
            else:
                out += b"".join(self.base.pack([i for i, _ in self.symbol_tree(x, True)]) for x in self.pre_tokens(section))
        return out

    def symbol_tree(self, symbols: str, end: bool) -> Ids:
        """Ids of a pre-token with the number of symbols of each; `end`: its last symbol ends the word."""
        if len(symbols) <= self.long_symbols:
            return self.symbol_ids(symbols, end)
        half = len(symbols) // 2
        return self.symbol_join(self.symbol_tree(symbols[:half], False), self.symbol_tree(symbols[half:], end), symbols, end)

    def symbol_ids(self, symbols: str, end: bool) -> Ids:
        found = [(t.id, len(t.value)) for t in (self.ends if end else self.goes_on).tokenize(symbols)]
        if end:  # the last token's name also holds the mark of a word's end
            found[-1] = (found[-1][0], found[-1][1] - len(self.ends.end_of_word_suffix))
        return found

    def symbol_join(self, left: Ids, right: Ids, symbols: str, end: bool) -> Ids:
        seam, k = sum(n for _, n in left), 2
        while True:
            low, high = max(0, len(left) - k), min(len(right), k)
            start, stop = seam - sum(n for _, n in left[low:]), seam + sum(n for _, n in right[:high])
            window = self.symbol_ids(symbols[start:stop], end and high == len(right))
            if (low == 0 or window[0] == left[low]) and (high == len(right) or window[-1] == right[high - 1]):
                return left[:low] + window + right[high:]
            k *= 2

    # Texts.
    def parts(self, text: str) -> Iterator[tuple[str, str]]:
        """(kind, text) of a whole text's parts of about `leaf` characters, in order; they may be encoded apart."""
        for section in self.sections(text):
            if isinstance(section, int):
                yield SPECIAL, str(section)
                continue
            at = 0
            while at < len(section):
                cut = CUT.search(section, min(at + self.leaf, len(section)))
                piece = section[at : cut.end() if cut else len(section)]
                at += len(piece)
                if len(piece) <= 2 * self.leaf:
                    yield WORDS, piece
                else:
                    yield from self.long_parts(piece)

    def long_parts(self, piece: str) -> Iterator[tuple[str, str]]:
        """The parts of some words with one that has no place to cut at: its pre-tokens, the long ones in chunks."""
        for long, some in groupby(words_of(piece), key=lambda w: len(w) > self.leaf):
            if not long:
                yield WORDS, " ".join(some)
                continue
            for word in some:
                held, size = [], 0
                for symbols in self.pre_tokens(word):
                    if len(symbols) <= self.leaf:
                        held.append(symbols)
                        size += len(symbols)
                    if held and (size >= self.leaf or len(symbols) > self.leaf):
                        yield TOKENS, " ".join(held)
                        held, size = [], 0
                    if len(symbols) > self.leaf:
                        *first, last = halves(symbols, self.leaf)
                        yield from ((CHUNK, x) for x in first)
                        yield END, last
                if held:
                    yield TOKENS, " ".join(held)

    def part_ids(self, kind: str, text: str) -> Ids:
        """A part's ids; those of a pre-token's symbols with their numbers."""
        if kind == SPECIAL:
            return [(int(text), 0)]
        if kind == WORDS:
            return [(i, 0) for i in np.frombuffer(self.text_ids(text), "<u4").tolist()]
        if kind == TOKENS:
            return [x for symbols in text.split(" ") for x in self.symbol_tree(symbols, True)]
        return self.symbol_tree(text, kind == END)

    def joined(self, chunks: list[tuple[str, Ids]]) -> Ids:
        """The ids of a pre-token from those of its chunks, joined pairwise, level by level."""
        while len(chunks) > 1:
            chunks = [self.two(*chunks[i : i + 2], i + 2 >= len(chunks)) if i + 1 < len(chunks) else chunks[i] for i in range(0, len(chunks), 2)]
        return chunks[0][1]

    def two(self, left: tuple[str, Ids], right: tuple[str, Ids], end: bool) -> tuple[str, Ids]:
        return left[0] + right[0], self.symbol_join(left[1], right[1], left[0] + right[0], end)

    def whole(self, parts: Iterator[tuple[str, str, Ids]]) -> bytes:
        """The ids of a text from its parts (kind, text, ids) in order."""
        out, chunks = [], []
        for kind, text, ids in parts:
            if kind in (CHUNK, END):
                chunks.append((text, ids))
            if kind == END:
                ids, chunks = self.joined(chunks), []
            if kind != CHUNK:
                out.append(np.array([i for i, _ in ids], "<u4").tobytes())
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, all in this process, however long."""
        return self.whole((kind, x, self.part_ids(kind, x)) for kind, x in self.parts(text or ""))

    def decode(self, ids: np.ndarray) -> bytes:
        """The decoded text in UTF-8: the vocabulary has no decoder, so its strings are joined by spaces."""
        return b" ".join(map(self.names.__getitem__, ids.tolist()))


def halves(symbols: str, most: int) -> list[str]:
    """The symbols halved until no part is longer than `most`."""
    if len(symbols) <= most:
        return [symbols]
    half = len(symbols) // 2
    return halves(symbols[:half], most) + halves(symbols[half:], most)


@lru_cache(maxsize=2)
def tree_encoder(path: str, leaf: int) -> TreeEncoder:
    return TreeEncoder(path, leaf)


#: What `encoded` gives by itself: the ids and the decoded text.
PLAIN = ("ids binary, decoded binary", lambda ids, decoded: (ids, decoded))


def encoded(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", leaf: int = LEAF_CHARS, view: tuple = PLAIN
) -> DataFrame:
    """One row for each row of `docs`: doc_id, ids (little-endian unsigned 32-bit), decoded (UTF-8).

    `view`, a schema and a function of ids and decoded text, gives other columns in their stead, made where they are.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema, make = f"doc_id bigint, {view[0]}", view[1]
    out_schema = to_arrow_schema(StructType.fromDDL(schema))

    def seen(own: TreeEncoder, docs: list, ids: list[bytes]) -> pa.RecordBatch:
        made = zip(*(make(x, own.decode(np.frombuffer(x, "<u4"))) for x in ids), strict=True) if ids else [()] * (len(out_schema) - 1)
        return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip([docs, *made], out_schema, strict=True)], schema=out_schema)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tree_encoder(path, leaf)
        for batch in small(batches):
            yield seen(own, batch.column(0).to_pylist(), [own.text_ids(x.as_py()) for x in batch.column(1)])

    columns = ["row", "doc_id", "part", "kind", "text"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tree_encoder(path, leaf)
        for batch in batches:
            for i in range(batch.num_rows):
                row, doc, text = (c[i].as_py() for c in batch.columns)
                held: list[tuple] = []
                for at, part in enumerate(own.parts(text)):
                    held.append((row, doc, at, *part))
                    if len(held) == 64:
                        yield of_rows(held)
                        held = []
                if held:
                    yield of_rows(held)

    def of_rows(held: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], columns)

    def part_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts with their ids in place of their text; chunks keep it, as a join may need it, with the symbols of each id."""
        own = tree_encoder(path, leaf)
        for batch in small(batches, 8):
            ids, sizes, texts = [], [], []
            for kind, text in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                found, chunk = own.part_ids(kind, text), kind in (CHUNK, END)
                ids.append(np.array([i for i, _ in found], "<u4").tobytes())
                sizes.append(np.array([n for _, n in found], "<u4").tobytes() if chunk else b"")
                texts.append(text if chunk else "")
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(texts, pa.string()), pa.array(ids, pa.binary()), pa.array(sizes, pa.binary())], [*columns, "ids", "sizes"])

    def joined(of_one: pa.Table) -> pa.Table:
        own = tree_encoder(path, leaf)
        rows = of_one.sort_by("part")

        def told() -> Iterator[tuple[str, str, Ids]]:
            for kind, text, ids, sizes in zip(*(rows.column(c).to_pylist() for c in ("kind", "text", "ids", "sizes")), strict=True):
                numbers = np.frombuffer(ids, "<u4").tolist()
                yield kind, text, list(zip(numbers, np.frombuffer(sizes, "<u4").tolist() or [0] * len(numbers), strict=True))

        return pa.Table.from_batches([seen(own, [rows.column("doc_id")[0].as_py()], [own.whole(told())])])

    short = rows.where(F.length("text") <= leaf).mapInArrow(whole, schema)
    parts = rows.withColumn("row", F.monotonically_increasing_id()).where(F.length("text") > leaf).select("row", "doc_id", "text")
    parts = parts.mapInArrow(cut, "row bigint, doc_id bigint, part int, kind string, text string")
    parts = parts.repartition("row", "part").mapInArrow(part_ids, "row bigint, doc_id bigint, part int, kind string, text string, ids binary, sizes binary")
    return short.unionByName(parts.groupBy("row").applyInArrow(joined, schema))


def _digests(ids: bytes, decoded: bytes) -> tuple[int, str, str]:
    numbers = np.frombuffer(ids, "<u4")
    told = hashlib.sha256(" ".join(map(str, numbers.tolist())).encode()).hexdigest()
    return len(numbers), told, hashlib.sha256(decoded).hexdigest()


#: Token count, SHA-256 of the decimal ids joined by spaces, SHA-256 of the decoded text.
DIGESTS = ("n_tokens bigint, ids_sha256 string, decoded_sha256 string", _digests)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), tokenizer_path(), view=DIGESTS)
