"""Phrase collocation mining by generalised suffix automata.

Each task gathers the words of its texts into shards, one language each, with small numbers for words and a gap between
pieces. Over a shard stands a suffix automaton of bounded depth: its nodes are the distinct word strings of up to four
words, each with the number of its ends (endpos count), its prefix (the string without its last word) and its suffix
link (the string without its first word). The nodes of a depth come from those of the depth before by one sort of
(prefix, last word) pairs, so an automaton is built of arrays, without a Python object for each node; strings with equal
ends are one state (`states`), known by its longest string.

Counts are reduced globally in two rounds. A phrase that stands `least` times has pairs that all do. So the first round
sums the pairs' endpos counts by 64-bit hashes and leaves a filter of fixed size, a bit for each hash that reaches
`least`; pairs that meet a bit by chance cost rows, not results. In the second round each shard's pieces are cut where a
pair is not in the filter, and all nodes of the automaton over what is left are summed by their words. What reaches
`least` there is exact.

A phrase lies in a longer one if prefixes and suffix links lead from that to it. A phrase between the two is as frequent
as the longer one at least, so if any longer phrase subsumes another, one that is longer by a single word does: only the
prefix and the suffix link of each phrase are joined.

A shard's words and numbers are a file in the shared folder that its tasks read by pyarrow; Spark's rows have its name
alone, so neither Parquet's nor Arrow's buffers in the JVM hold shards of some megabytes, several to a batch.

Hot keys: shards are dealt out as they are read, whatever their language; frequent words and phrases are counted in each
shard before the shuffle; joins deal both sides anew (`spread_join`). A task holds the words of one shard for each
language that it meets, SHARD_WORDS in all.

Defined results: a null text is empty, a null lang is `und`. A-Z are lower-cased, other letters stay. Pieces end at
`[.,;:!?\\x0A-\\x0D]`, words at spaces and tabs. Repeated rows count each. A language without phrases has no rows. An empty
table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import spread_join
from ..sources.shared import place
from .common import fresh_path, table, written

#: Production parameters: words in a phrase, least frequency, share of a phrase's frequency at which a longer one
#: subsumes it (in hundredths), phrases of a language in the result.
MOST_WORDS, LEAST_COUNT, SUBSUMED, TOP = 4, 30, 80, 2000

#: Words that a task gathers before it closes its largest shard, and bits of the filter of frequent pairs (16 MB).
SHARD_WORDS, FILTER_BITS = 1_500_000, 1 << 27

#: Shards of a task, about, and tasks that shards are dealt to, at most.
PER_TASK, MOST_TASKS = 4, 4096

#: Bits of the filter that are set together, as one row.
BLOCK_BITS = 1 << 16

#: Parts of a language that are ranked apart.
BLOCKS = 64

#: Bytes that end a piece (fixed values) become one that UTF-8 doesn't have.
_GAP = b"\xff"
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _GAP * 10)


class Shard:
    """Words of one language by number, in order; 0 is a gap between pieces. Word n of the vocabulary has number n + 1."""

    def __init__(self):
        self.number: dict[bytes, int] = {_GAP: 0}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str) -> None:
        number = self.number
        words = (text.encode().lower().translate(_ENDS).replace(_GAP, b" \xff ")).split()  # bytes: only A-Z and ASCII white space
        own = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
        self.parts += [own, np.zeros(1, np.int32)]
        self.size += len(words) + 1

    def closed(self) -> tuple[bytes, bytes, int]:
        """The vocabulary, one word a line, the numbers, and how many words."""
        ids = np.concatenate(self.parts)
        ids = ids[(ids > 0) | (np.append(0, ids[:-1]) > 0)]  # one gap is enough
        return b"\n".join(w for w in self.number if w != _GAP), ids.astype("<i4").tobytes(), int((ids > 0).sum())


def shards(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = SHARD_WORDS) -> DataFrame:
    """lang, file and n_words of each shard; a file has words (bytes, one a line) and ids (little-endian 32-bit numbers, 0 between pieces)."""
    folder = fresh_path(docs.sparkSession, "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, Shard] = {}
        held = 0

        def close(name: str) -> pa.RecordBatch:
            words, ids, n = own.pop(name).closed()
            file = f"{folder}/{uuid.uuid4().hex}.arrow"
            store, path = place(file)
            store.create_dir(path.rsplit("/", 1)[0], recursive=True)
            held = pa.RecordBatch.from_arrays([pa.array([words], pa.binary()), pa.array([ids], pa.binary())], ["words", "ids"])
            with store.open_output_stream(path) as out, pa.ipc.new_file(out, held.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
                f.write_batch(held)
            return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([file], pa.string()), pa.array([n], pa.int64())], ["lang", "file", "n_words"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = own.setdefault(name, Shard())
                before = shard.size
                shard.add(text.as_py())
                held += shard.size - before
                while held > most and own:
                    largest = max(own, key=lambda x: own[x].size)
                    held -= own[largest].size
                    yield close(largest)
        for name in [*own]:
            yield close(name)

    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")), F.col(text)).where(F.length(F.col(text)) > 0)
    return rows.mapInArrow(run, "lang string, file string, n_words bigint")


class Automaton:
    """The suffix automaton of pieces, up to `depth` words: by depth, the node at each place (0: none) and the nodes' arrays.

    Of node x of depth d: count[d][x] its ends, first[d][x] a place where it begins, prefix[d][x] and link[d][x] nodes of
    depth d - 1. Node 0 of each depth is none.
    """

    def __init__(self, ids: np.ndarray, depth: int):
        ids = ids if len(ids) else np.zeros(1, np.int32)
        self.ids, self.depth = ids, depth
        size = int(ids.max(initial=0)) + 1
        first = np.zeros(size, np.int64)
        first[ids[::-1]] = np.arange(len(ids) - 1, -1, -1)
        count = np.bincount(ids, minlength=size)
        count[0] = 0
        self.at, self.count, self.first = [None, ids], [None, count], [None, first]
        self.prefix, self.link = [None, None], [None, None]
        for d in range(2, depth + 1):
            self.deepen(d, size)

    def deepen(self, d: int, size: int) -> None:
        before, last = self.at[d - 1], self.ids
        n = max(0, len(last) - d + 1)
        where = np.flatnonzero((before[:n] > 0) & (last[d - 1 : d - 1 + n] > 0)).astype(np.int32)
        keys = before[where].astype(np.int64)
        keys *= size
        keys += last[where + d - 1]
        order = np.argsort(keys, kind="stable").astype(np.int32)  # places and nodes are 32-bit numbers, and what is done is let go
        keys = keys[order]
        new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
        del keys
        edges = np.flatnonzero(new)
        count = np.diff(np.append(edges, len(order)))
        first = np.append(0, where[order[edges]])
        nodes = np.zeros(len(last), np.int32)
        nodes[where[order]] = np.cumsum(new, dtype=np.int32)
        del where, order, new, edges
        prefix, link = before[first], before[np.minimum(first + 1, len(last) - 1)]
        prefix[0] = link[0] = 0
        self.at.append(nodes)
        self.count.append(np.append(0, count))
        self.first.append(first)
        self.prefix.append(prefix)
        self.link.append(link)

    def states(self) -> list[np.ndarray]:
        """By depth, for each node, how many words longer the longest string with the same ends is."""
        longer = [None, *(np.zeros(len(c), np.int64) for c in self.count[1:])]
        for d in range(self.depth, 1, -1):
            same = self.count[d] == self.count[d - 1][self.link[d]]
            same[0] = False
            longer[d - 1][self.link[d][same]] = longer[d][same] + 1
        return longer

    def strings(self, d: int, words: pa.Array) -> pa.Array:
        """The words of each node of a depth (from node 1 on), joined by spaces. `words` has word n at place n."""
        import pyarrow.compute as pc

        first = self.first[d][1:]
        parts = [words.take(pa.array(self.ids[first + k])) for k in range(d)]
        return parts[0] if d == 1 else pc.binary_join_element_wise(*parts, " ")


def pair_ends(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The automaton's nodes of two words, as first * size + second, and their ends: no places, prefixes or links, in less memory."""
    where = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0)).astype(np.int32)
    keys = ids[where].astype(np.int64)
    keys *= size
    keys += ids[where + 1]
    del where
    keys.sort()
    edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[edges], np.diff(np.append(edges, len(keys)))


def mixed(a: np.ndarray) -> np.ndarray:
    """64-bit numbers, well mixed."""
    a = (a ^ (a >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    a = (a ^ (a >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return a ^ (a >> np.uint64(33))


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word within its language; number 0 is no word."""
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in [b"", *words]), np.uint64, len(words) + 1)


def pair_hashes(hashes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(hashes[left] * np.uint64(0x9E3779B97F4A7C15) + hashes[right])


def opened(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """lang, words and ids of each shard of a batch, one at a time."""
    for lang, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        store, path = place(file)
        with store.open_input_file(path) as f:
            held = pa.ipc.open_file(f).get_batch(0)
        words = held.column(0)[0].as_py()
        yield lang, words.split(b"\n") if words else [], np.frombuffer(held.column(1)[0].as_buffer(), "<i4")


def dealt(shards: DataFrame) -> DataFrame:
    """lang and file; a table of names is small, so its rows are dealt to tasks by number, a few to each."""
    return shards.select("lang", "file").repartition(max(1, min(shards.count() // PER_TASK + 1, MOST_TASKS)), "file")


def frequent_pairs(shards: DataFrame, least: int = LEAST_COUNT, bits: int = FILTER_BITS) -> np.ndarray:
    """A filter of `bits` bits, as bytes, that has the hash of every pair of words that stands `least` times."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, words, ids in opened(batch):
                hashes, size = word_hashes(lang, words), len(words) + 1
                nodes, ends = pair_ends(ids, size)
                for k in range(0, len(nodes), 1 << 16):
                    own = nodes[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(pair_hashes(hashes, own // size, own % size).view(np.int64)), pa.array(ends[k : k + (1 << 16)])], ["h", "n"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}  # bits // BLOCK_BITS at most
        for batch in batches:
            at = batch.column(0).to_numpy()
            for block in np.unique(at // BLOCK_BITS).tolist():
                held = own.setdefault(block, np.zeros(BLOCK_BITS, bool))
                held[at[at // BLOCK_BITS == block] % BLOCK_BITS] = True
        for block, held in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(held).tobytes()], pa.binary())], ["block", "bits"])

    counted = dealt(shards).mapInArrow(pairs, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    at = counted.where(F.col("n") >= least).select(F.pmod("h", F.lit(bits)).alias("at"))
    # A block's bits are dealt to one task: at most BLOCK_BITS of them differ.
    of_block = at.distinct().repartition((F.col("at") / BLOCK_BITS).cast("bigint"))
    out = np.zeros((bits // BLOCK_BITS, BLOCK_BITS // 8), np.uint8)
    for r in of_block.mapInArrow(blocks, "block bigint, bits binary").toLocalIterator():  # `bits` bits in all
        out[r["block"]] |= np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def cut_at_rare(ids: np.ndarray, hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The pieces cut between words that are no pair of the filter, without words that are left alone."""
    left, right = ids[:-1], ids[1:]
    ok = (left > 0) & (right > 0)
    at = pair_hashes(hashes, left[ok], right[ok]).view(np.int64) % np.int64(8 * len(known))
    ok[ok] = known[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1
    before, after = np.append(False, ok), np.append(ok, False)
    # A word stays if it is in a pair; a gap comes before each word whose pair with the word before is rare.
    stays = before | after
    places = np.flatnonzero(stays)
    out = np.zeros(2 * len(places) + 1, ids.dtype)
    out[1::2] = ids[places]
    gap = np.ones(len(out), bool)
    gap[1::2] = True
    gap[0:-1:2] = ~before[places]
    return out[gap]


def phrase_counts(shards: DataFrame, known: np.ndarray, least: int = LEAST_COUNT, depth: int = MOST_WORDS) -> DataFrame:
    """lang, phrase (of up to `depth` words), size, prefix, link and f of all that stand `least` times."""
    held = shards.sparkSession.sparkContext.broadcast(known)  # of a fixed size
    names = ["lang", "phrase", "size", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, words, ids in opened(batch):
                text = pa.array([b"", *words], pa.binary()).cast(pa.string())
                alone = np.bincount(ids, minlength=len(words) + 1)[1:]
                hashes = word_hashes(lang, words)
                del words
                nodes = Automaton(cut_at_rare(ids, hashes, held.value), depth)
                nodes.at = nodes.prefix = nodes.link = None  # only ends and words are asked for
                for d in range(1, depth + 1):  # one depth's strings at a time
                    strings, n = (text[1:], alone) if d == 1 else (nodes.strings(d, text), nodes.count[d][1:])
                    for k in range(0, len(n), 1 << 15):
                        own = strings[k : k + (1 << 15)]
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), own, pa.array([d] * len(own), pa.int32()), pa.array(n[k : k + (1 << 15)], pa.int64())], names)

    rows = dealt(shards).mapInArrow(run, "lang string, phrase string, size int, n bigint")
    counted = rows.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    return counted.withColumns({"prefix": F.regexp_extract("phrase", "(?s)^(.*) [^ ]*$", 1), "link": F.regexp_extract("phrase", "(?s)^[^ ]* (.*)$", 1)})


def scored(counted: DataFrame, depth: int = MOST_WORDS) -> DataFrame:
    """Phrases of two words or more with a, l, r and score of their lowest-scoring cut. `counted` should be a written table."""
    words = F.split("phrase", " ")
    joined = lambda first, n: F.array_join(F.slice(words, first, n), " ")
    cuts = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    rows = counted.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), cuts)
    rows = rows.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    # A part of a phrase is as frequent as the phrase at least, so it is in the table.
    of = lambda name, f: counted.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    rows = spread_join(spread_join(rows, of("left", "l"), ["lang", "left"]), of("right", "r"), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    rows = rows.withColumn("score", floored(F.lit(2_000_000).cast("decimal(7,0)") * wide("a"), wide("l") + wide("r")))
    return rows.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def floored(a: Column, b: Column) -> Column:
    """The whole part of a / b for decimals of no less than 0."""
    return F.call_function("div", a, b)


def subsumed(counted: DataFrame, share: int = SUBSUMED) -> DataFrame:
    """lang and phrase of those that lie in a longer phrase with `share` hundredths of their frequency or more."""
    long = counted.where("size > 2")
    up = long.select("lang", F.explode(F.array("prefix", "link")).alias("phrase"), "f")
    most = up.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    both = spread_join(counted.where("size > 1"), most, ["lang", "phrase"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    return both.where(100 * wide("longer") >= share * wide("f")).select("lang", "phrase")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST_COUNT, depth: int = MOST_WORDS, share: int = SUBSUMED, top: int = TOP
) -> DataFrame:
    """Each language's `top` phrases: lang, rank, phrase, a, l, r, n, score."""
    own = written(shards(docs, text, lang), "shards")
    counted = written(phrase_counts(own, frequent_pairs(own, least), least, depth), "phrases")
    left = spread_join(scored(counted, depth), subsumed(counted, share), ["lang", "phrase"], "left_anti")
    order = (F.desc("score"), F.desc("a"), "phrase")
    ranked = lambda df, *of: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", *of).orderBy(*order))).where(F.col("rank") <= top)
    # A language's best are among the best of its blocks, so the last ranking takes BLOCKS * top rows at most.
    best = ranked(ranked(left.withColumn("block", F.pmod(F.xxhash64("phrase"), F.lit(BLOCKS))), "block").drop("block", "rank"))
    total = own.groupBy("lang").agg(F.sum("n_words").alias("n"))
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents WHERE text IS NOT NULL
),
split AS (SELECT row, lang, string_split_regex(t, '[.,;:!?\x0A-\x0D]') AS parts FROM texts),
pieces AS (SELECT row, lang, unnest(range(len(parts))) AS piece, unnest(parts) AS part FROM split),
listed AS (SELECT lang, list_filter(string_split_regex(part, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::bigint AS n FROM listed GROUP BY lang),
grams AS (SELECT lang, size, w[k:k + size - 1] AS words FROM listed, range(1, 5) AS s(size), unnest(range(1, len(w) - size + 2)) AS p(k)),
counted AS (SELECT lang, size, words, count(*) AS f FROM grams GROUP BY lang, size, words HAVING count(*) >= 30),
cuts AS (SELECT lang, words, f AS a, unnest(range(1, size)) AS k FROM counted WHERE size > 1),
rated AS (
  SELECT c.lang, c.words, a, k, l.f AS l, r.f AS r, (2000000::hugeint * a // (l.f::hugeint + r.f))::bigint AS score
  FROM cuts c JOIN counted l ON l.lang = c.lang AND l.words = c.words[1:k] JOIN counted r ON r.lang = c.lang AND r.words = c.words[k + 1:]
),
lowest AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
inner_parts AS (
  SELECT DISTINCT c.lang, c.words[i:j] AS words, f FROM counted c, range(1, 4) AS x(i), range(2, 5) AS y(j)
  WHERE j > i AND j <= size AND j - i + 1 < size
),
dropped AS (SELECT p.lang, p.words FROM inner_parts p JOIN counted c ON c.lang = p.lang AND c.words = p.words GROUP BY ALL HAVING bool_or(100 * p.f::hugeint >= 80 * c.f::hugeint))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM (SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, score FROM lowest ANTI JOIN dropped USING (lang, words)) JOIN totals USING (lang)
QUALIFY rank <= 2000
"""
