"""Edit-aware token counts: a stored segment tree of pre-tokens for each document, re-encoded only where edits touch it.

A document is cut into segments of about `SEGMENT` characters, after white space or, in text without any, between
pre-tokens that nothing can join; a run of letters alone is one pre-token, however long, and one segment. Segments are the
leaves of a segment tree whose nodes hold sums of characters and tokens.

A `Store` keeps both in a folder. The trees are a table with a row for each document: characters and tokens of its segments,
and where their texts are, pages of some segments each in files that each task writes one of. A batch of edits joins the
trees of the documents that it names, finds the segments it touches by character sums, reads only the pages of these and
of neighbours they could join, and encodes only what an edit replaces, with as much of the neighbours as its ends can join
(boundary context). New sums go up the tree. Changed segments and changed trees are written beside the older ones, and the
tree goes on naming what is left of an older page; the newest tree of a document counts. Nothing else is read, encoded or
moved.

Edits of a batch are applied in their order, each in the coordinates of the text that the ones before it left.

Defined results: a null text counts as empty; null or empty edits change nothing; a null edit in the list is skipped;
ranges are clipped to the text, an end before its start counts as the start, a null replacement as empty. Repeated rows
are documents of their own, and an edit names a row by its number in the store; of a number named twice, both lists are
applied, in any order. Columns other than doc_id and text are not looked at. Files are written under names of their own,
so a task that runs again leaves the ones that count alone. The folder must be on a store that pyarrow reaches.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .binary_ids import place
from .common import fresh_path, table, tokenizer_path
from .tokens import CUT, SAFE, WHITE, Encoder, encoder, small

#: Characters in a segment and segments in a page, about; characters of edited documents that a task of a batch has, about.
SEGMENT, PAGE, TASK_CHARS = 256, 32, 16_000_000

EDITS = "array<struct<start:bigint,stop:bigint,replacement:string>>"
TREE = (
    "row bigint, doc_id bigint, files array<string>, pages array<struct<file:int,at:bigint,bytes:int,size:int,skip:int,segments:int>>, "
    "chars array<int>, tokens array<int>, n_chars bigint, n_tokens bigint, n_chars_encoded bigint, n_chars_read bigint"
)

PAGE_FIELDS = ("file", "at", "bytes", "size", "skip", "segments")

_WHITE = re.compile(f"[{WHITE}]")
_SAFE = re.compile(SAFE)


def parted(text: str) -> list[str]:
    """The segments of a text."""
    out, at = [], 0
    while at < len(text):
        cut = CUT.search(text, min(at + SEGMENT, len(text)))
        end = cut.end() if cut else len(text)
        out.append(text[at:end])
        at = end
    return out


def may_part(left: str, right: str) -> bool:
    """Whether nothing can join across the seam of two texts."""
    return not left or not right or bool(_WHITE.match(left[-1]) or _WHITE.match(right[0]) or _SAFE.match(left[-1] + right[0], 1))


class CountedText:
    """A text as a segment tree of token counts. Segments' texts come by the page, when they are asked for."""

    def __init__(self, own: Encoder, chars: list[int], tokens: list[int], pages: list[tuple[int, int]], load: Callable[[int], str]):
        """`pages` says how many segments a page has and how many of its characters are skipped before them; `load` gives a page's text."""
        self.own, self.load, self.encoded, self.read = own, load, 0, 0
        self.loaded: dict[int, str] = {}
        self.page: list[int] = []
        self.skip: list[int] = []
        for p, (n, skip) in enumerate(pages):
            for _ in range(n):
                self.page.append(p)
                self.skip.append(skip)
                skip += chars[len(self.page) - 1]
        self.texts: list[str | None] = [None if n else "" for n in chars]
        self.fresh = [False] * len(chars)
        self.grow(chars, tokens)

    @classmethod
    def of(cls, text: str, own: Encoder) -> CountedText:
        """The tree of a whole text."""
        segments = parted(text) or [""]
        out = cls(own, [len(s) for s in segments], [len(own.encode(s)) // 4 for s in segments], [(len(segments), 0)], lambda p: "")
        out.texts, out.fresh, out.encoded = segments, [True] * len(segments), len(text)
        return out

    @classmethod
    def stored(cls, own: Encoder, chars: list[int], tokens: list[int], files: list[str], pages: list[dict], reader: Reader) -> CountedText:
        """A tree as it was stored."""
        load = lambda p: reader.page(files[pages[p]["file"]], pages[p]["at"], pages[p]["bytes"], pages[p]["size"])
        return cls(own, chars, tokens, [(p["segments"], p["skip"]) for p in pages], load)

    def grow(self, chars: list[int], tokens: list[int]) -> None:
        """Leaves in slots `width`, `width` + 1, ...; node i has the children 2i and 2i + 1."""
        self.n = len(chars)
        self.width = 1 << (self.n - 1).bit_length()
        pad = [0] * (self.width - self.n)
        self.chars = [0] * self.width + chars + pad
        self.tokens = [0] * self.width + tokens + pad
        for i in range(self.width - 1, 0, -1):
            self.lift(i)

    def lift(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def leaves(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the segments."""
        return self.chars[self.width : self.width + self.n], self.tokens[self.width : self.width + self.n]

    def text(self) -> str:
        return "".join(map(self.segment, range(self.n)))

    def segment(self, k: int) -> str:
        if self.texts[k] is None:
            page = self.page[k]
            if page not in self.loaded:
                self.loaded[page] = self.load(page)
                self.read += len(self.loaded[page])
            self.texts[k] = self.loaded[page][self.skip[k] : self.skip[k] + self.chars[self.width + k]]
        return self.texts[k]

    def find(self, at: int) -> tuple[int, int]:
        """The segment with the character `at`, and its place there; the end is in the last segment with characters."""
        at = min(at, max(self.length - 1, 0))
        i = 1
        while i < self.width:
            i *= 2
            if at >= self.chars[i]:
                at -= self.chars[i]
                i += 1
        return min(i - self.width, self.n - 1), at

    def beside(self, k: int, step: int) -> int | None:
        """The next segment with characters to one side."""
        k += step
        while 0 <= k < self.n and not self.chars[self.width + k]:
            k += step
        return k if 0 <= k < self.n else None

    def put(self, k: int, segment: str) -> None:
        self.texts[k], self.fresh[k] = segment, True
        self.encoded += len(segment)
        i = self.width + k
        self.chars[i], self.tokens[i] = len(segment), len(self.own.encode(segment)) // 4
        while i > 1:
            i //= 2
            self.lift(i)

    def edit(self, start: int, end: int, replacement: str) -> None:
        start = max(0, min(start, self.length))
        end = max(start, min(end, self.length))
        if start == end and not replacement:
            return
        (first, a), (last, b) = self.find(start), self.find(max(start, end - 1))
        if start == self.length and self.length:
            a += 1
        head = self.segment(first)[:a]
        tail = self.segment(last)[b + 1 :] if end > start else self.segment(first)[a:]
        new = head + replacement + tail
        # Boundary context: neighbours that the new text, or each other if there is none, could join with.
        before, after = self.beside(first, -1), self.beside(last, 1)
        if not new and before is not None and after is not None and not may_part(self.segment(before), self.segment(after)):
            first, new = before, self.segment(before)
        while (k := self.beside(last, 1)) is not None and not may_part(new, self.segment(k)):
            last, new = k, new + self.segment(k)
        while (k := self.beside(first, -1)) is not None and not may_part(self.segment(k), new):
            first, new = k, self.segment(k) + new
        pieces = parted(new)
        slots = last - first + 1
        if len(pieces) > 4 * slots:  # a long replacement: the tree gets leaves of its own for it
            self.insert(first, last, pieces)
            return
        share = -(-len(pieces) // slots) if pieces else 1
        for k in range(slots):
            self.put(first + k, "".join(pieces[k * share : (k + 1) * share]))

    def insert(self, first: int, last: int, pieces: list[str]) -> None:
        """Pieces in place of some segments."""
        chars, tokens = self.leaves()
        none = [0] * len(pieces)
        self.texts[first : last + 1] = pieces
        self.page[first : last + 1] = self.skip[first : last + 1] = none
        self.fresh[first : last + 1] = [True] * len(pieces)
        self.grow([*chars[:first], *none, *chars[last + 1 :]], [*tokens[:first], *none, *tokens[last + 1 :]])
        for k, piece in enumerate(pieces):
            self.put(first + k, piece)


class Pages:
    """A task's own file of pages, made when the first one comes."""

    def __init__(self, folder: str):
        self.path, self.out, self.at, self.codec = f"{folder}/{uuid.uuid4().hex}.pages", None, 0, pa.Codec("zstd", compression_level=3)

    def write(self, text: str) -> tuple[int, int, int]:
        """Where the page is, its bytes there, its bytes as text."""
        if self.out is None:
            store, name = place(self.path)
            self.out = store.open_output_stream(name)
        data = text.encode("utf-8", "surrogatepass")
        packed = self.codec.compress(data, asbytes=True) if data else b""
        self.out.write(packed)
        self.at += len(packed)
        return self.at - len(packed), len(packed), len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


class Reader:
    """Pages of some files; the files last used stay open, and the page last read at hand."""

    def __init__(self):
        self.open: dict[str, pa.NativeFile] = {}
        self.codec = pa.Codec("zstd")
        self.last: tuple = (None, "")

    def page(self, path: str, at: int, n: int, size: int) -> str:
        if not n or self.last[0] == (path, at):
            return self.last[1] if n else ""
        if path not in self.open:
            if len(self.open) >= 16:
                self.open.pop(next(iter(self.open))).close()
            store, name = place(path)
            self.open[path] = store.open_input_file(name)
        packed = self.open[path].read_at(n, at)
        self.last = (path, at), self.codec.decompress(packed, size, asbytes=True).decode("utf-8", "surrogatepass")
        return self.last[1]


def tree_row(row: int, doc: int | None, tree: CountedText, files: list[str], pages: list[dict], out: Pages) -> tuple:
    """The tree as it is stored: segments without characters go, changed ones are written, the others stay where they are."""
    every = list(zip(*tree.leaves(), strict=True))
    kept = [k for k, (n, _) in enumerate(every) if n] or [0]
    told: list[tuple] = []
    at = 0
    while at < len(kept):
        k, end = kept[at], at + 1
        if tree.fresh[k]:
            while end < len(kept) and tree.fresh[kept[end]] and end - at < PAGE:
                end += 1
            told.append((len(files), *out.write("".join(map(tree.segment, kept[at:end]))), 0, end - at))
        else:
            while end < len(kept) and not tree.fresh[kept[end]] and tree.page[kept[end]] == tree.page[k] and tree.skip[kept[end]] == tree.skip[kept[end - 1]] + every[kept[end - 1]][0]:
                end += 1
            old = pages[tree.page[k]]
            told.append((old["file"], old["at"], old["bytes"], old["size"], tree.skip[k], end - at))
        at = end
    used = [*files, out.path] if any(p[0] == len(files) for p in told) else files
    return row, doc, used, told, [every[k][0] for k in kept], [every[k][1] for k in kept], tree.length, tree.total, tree.encoded, tree.read


def tree_table(held: list[tuple]) -> pa.RecordBatch:
    page = pa.struct([("file", pa.int32()), ("at", pa.int64()), ("bytes", pa.int32()), ("size", pa.int32()), ("skip", pa.int32()), ("segments", pa.int32())])
    names = [f.split(" ")[0] for f in re.sub(r"<[^ ]*>", "", TREE).split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(page), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.int64()] * 4]
    columns = list(zip(*held, strict=True))
    columns[3] = [[dict(zip(PAGE_FIELDS, p, strict=True)) for p in pages] for pages in columns[3]]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)


class Store:
    """Documents as stored segment trees in a folder: a table of trees for the documents as they came and one for each batch."""

    def __init__(self, spark: SparkSession, folder: str, path: str, batches: int):
        self.spark, self.folder, self.path, self.batches = spark, folder, path, batches

    @classmethod
    def create(cls, docs: DataFrame, folder: str, path: str, doc_id: str = "doc_id", text: str = "text") -> Store:
        """Stores documents; each whole text is encoded, this once."""
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        at = f"{folder}/pages"
        store, name = place(at)
        store.create_dir(name)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, out = encoder(path), Pages(at)
            for batch in small(batches):
                yield tree_table([tree_row(row, doc, CountedText.of(text.as_py(), own), [], [], out) for row, doc, text in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2), strict=True)])
            out.close()

        rows.mapInArrow(run, TREE).write.parquet(f"{folder}/trees-0")
        return cls(docs.sparkSession, folder, path, 0)

    def changes(self, batch: int) -> DataFrame:
        """The trees that a batch wrote, with what it encoded and read; batch 0 has all documents."""
        return self.spark.read.parquet(f"{self.folder}/trees-{batch}")

    def trees(self) -> DataFrame:
        """The newest tree of each document."""
        out = self.changes(0)
        for k in range(1, self.batches + 1):
            newer = self.changes(k)
            out = out.join(newer.select("row"), "row", "left_anti").unionByName(newer)
        return out

    def documents(self) -> DataFrame:
        """row, doc_id, n_chars, n_tokens of each document."""
        return self.trees().select("row", "doc_id", "n_chars", "n_tokens")

    def apply(self, edits: DataFrame) -> DataFrame:
        """Applies a batch, rows of row and edits (an array of start, stop and replacement in code points); gives its changes."""
        edits, trees = edits.select("row", F.col("edits").cast(EDITS).alias("edits")), self.trees()
        size = trees.agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")).first()
        parts = int((size["chars"] or 0) * min(1.0, edits.count() / max(1, size["n"])) // TASK_CHARS) + 1
        # Both sides are dealt to as many tasks as the named documents ask for, and joined as they are.
        given = edits.repartition(parts, "row").groupBy("row").agg(F.flatten(F.collect_list("edits")).alias("edits"))
        joined = trees.select("row", "doc_id", "files", "pages", "chars", "tokens").repartition(parts, "row").join(given, "row")
        path, at = self.path, f"{self.folder}/pages"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, out, reader = encoder(path), Pages(at), Reader()
            for batch in small(batches):
                held = []
                for row, doc, files, pages, chars, tokens, changes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    tree = CountedText.stored(own, chars, tokens, files, pages, reader)
                    for e in changes or []:
                        if e is not None:
                            start = e["start"] or 0
                            tree.edit(start, e["stop"] if e["stop"] is not None else start, e["replacement"] or "")
                    held.append(tree_row(row, doc, tree, files, pages, out))
                if held:
                    yield tree_table(held)
            out.close()

        joined.mapInArrow(run, TREE).write.parquet(f"{self.folder}/trees-{self.batches + 1}")
        self.batches += 1
        return self.changes(self.batches)

    def texts(self) -> DataFrame:
        """row, doc_id and the text of each document, put together from its pages."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = Reader()
            for batch in small(batches, 16):
                whole = [CountedText.stored(None, chars, chars, files, pages, reader).text() for files, pages, chars in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(whole, pa.string())], ["row", "doc_id", "text"])

        return self.trees().select("row", "doc_id", "files", "pages", "chars").mapInArrow(run, "row bigint, doc_id bigint, text string")


def sample_edits(n_chars: Column, doc_id: Column) -> Column:
    """The query's edits of each document: a cut of 40 characters at a third, a sentence put in at a half, a word joined at two thirds."""
    third = F.floor(n_chars / 3)
    change = lambda start, stop, new: F.struct(start.alias("start"), stop.alias("stop"), new.alias("replacement"))
    return F.array(
        change(third, third + 40, F.lit("")),
        change(F.floor(n_chars / 2), F.floor(n_chars / 2), F.concat(F.lit(" Revised in document "), F.coalesce(doc_id.cast("string"), F.lit("?")), F.lit(". "))),
        change(2 * third, 2 * third + 1, F.lit("x")),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored, then a batch of edits to each: its tokens before and after, and what the batch encoded."""
    store = Store.create(table(spark, sf_dir, "documents"), fresh_path(spark, "edits"), tokenizer_path())
    before = store.documents()
    after = store.apply(before.select("row", sample_edits(F.col("n_chars"), F.col("doc_id")).alias("edits")))
    told = after.select("row", F.col("n_tokens").alias("n_tokens_edited"), F.col("n_chars").alias("n_chars_edited"), "n_chars_encoded")
    return before.join(told, "row").select("doc_id", "n_tokens", "n_tokens_edited", "n_chars_edited", "n_chars_encoded")
