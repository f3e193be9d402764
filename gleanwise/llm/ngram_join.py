"""N-gram Jaccard join by MinHash banding.

A document is the set of its five-word shingles, as 64-bit hashes. Documents with the same set are one class and go on
as one row, under a number. Each class gets MinHash values in bands; numbers of bands and rows follow from the target
recall. Classes are shuffled on band hashes; only classes that share a bucket are candidates, and buckets with the same
members are one place. A pair that shares several places belongs to the smallest of them, so each is looked at once.

A place's members are dealt to blocks, and a task takes two of them (a tile): of the pairs that belong to the place, those
go on whose sketches, a byte of each MinHash value, agree far enough: five standard deviations below the least similarity
lose less than one pair in a million, and passages that many documents share do not pass. What goes on are the classes of
these pairs, again dealt to blocks, in which neighbours by sketch lie together; only for them whole sets are made, and the
pairs are verified on these by matrix products. Each class gets the number of documents that it is linked with and one
link towards its group. No pair of classes becomes a row. Links then give the groups.

Memory: a task holds two blocks of TILE_CLASSES sketches, or two of at most BLOCK_CLASSES sets or about BLOCK_SHINGLES
shingles (a longer document is a block of its own). Work grows with the pairs in buckets; a group of near copies has
quadratically many, as their links are counted.

Defined results: words are runs without white space, as written; a text of fewer than five words has one shingle, all
its words; a text without words is linked with nothing and is its own group. A group's id is its smallest doc_id, where
null comes last. Repeated rows are documents of their own, linked with each other. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components, spread_join
from .common import one_row_each, row_key, table, written
from .tokens import small

#: Words in a shingle, least similarity, chance to find a pair at that similarity, MinHash values at most.
WORDS, LEAST, RECALL, MOST_VALUES = 5, 0.8, 0.999, 192

#: Classes in a block whose sketches are compared; bounds of a block whose sets are; ids that are broadcast at most (8 bytes each).
TILE_CLASSES, BLOCK_CLASSES, BLOCK_SHINGLES, BROADCAST_IDS = 512, 128, 500_000, 2_000_000

#: Bytes that are hashed together, up to the end of a word.
PIECE = 1 << 20

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES[_IS_SPACE] = 0
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_POWERS = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
_MULTIPLY = _RANDOM.integers(0, 1 << 31, MOST_VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RANDOM.integers(0, 1 << 32, MOST_VALUES, dtype=np.uint32)


def bands_for(least: float = LEAST, recall: float = RECALL, most: int = MOST_VALUES) -> tuple[int, int]:
    """(bands, rows): the most rows in a band for which enough bands to reach `recall` fit into `most` values."""
    best = (most, 1)
    for rows in range(1, 17):
        chance = least**rows
        bands = 1 if chance >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-chance))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values spread evenly (in place)."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor, and of its inverse, for `n` places at least."""
    global _POWERS
    if n > len(_POWERS[0]):
        inverse = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
        _POWERS = tuple(np.cumprod(np.full(max(n, 1 << 16), x)) for x in (_FACTOR, inverse))
    return _POWERS


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes other than white space: a polynomial of its bytes, wherever it stands."""
    space = _IS_SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data))
    values = _BYTES[data]
    values *= up[: len(data)]
    return mixed(np.add.reduceat(values, starts) * down[starts])


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted 64-bit hashes of the text's shingles."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    found, at = [], 0
    while at < len(data):  # pieces of whole words
        end = min(at + PIECE, len(data))
        while end < len(data) and not _IS_SPACE[data[end]]:
            step = _IS_SPACE[data[end : end + PIECE]]
            end += int(step.argmax()) if step.any() else len(step)
        found.append(word_hashes(data[at:end]))
        at = end
    hashes = found[0] if len(found) == 1 else np.concatenate([np.zeros(0, np.uint64), *found])
    if not len(hashes):
        return hashes
    size = min(words, len(hashes))
    n = len(hashes) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = out * _FACTOR + hashes[i : i + n]
    out = np.sort(mixed(out))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def minima(shingles: np.ndarray, k: int) -> np.ndarray:
    """The set's first `k` MinHash values."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(k, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        x = _MULTIPLY[:k, None] * low[None, i : i + 2048]
        x += _ADD[:k, None]
        np.minimum(least, x.min(axis=1), out=least)
    return least


def band_hashes(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash for each band of MinHash values."""
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for column in least.astype(np.uint64).reshape(bands, rows).T:
        out = mixed(out * _FACTOR + column)
    return out.view(np.int64)


def least_sketch(least: float, values: int) -> float:
    """The share of equal values below which a pair is not verified: five standard deviations under `least`."""
    return least - 5 * math.sqrt(least * (1 - least) / values)


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """node (digest of the set; null without words), shingles, bands, sketch (a byte of each MinHash value); the columns of `docs` but `text` as they are."""
    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "node binary, shingles bigint, bands array<bigint>, sketch binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            nodes, sizes, hashes, sketches = [], [], [], []
            for text in batch.column(0):
                own = shingle_set(text.as_py(), words)
                least = minima(own, bands * rows)
                nodes.append(set_digest(own) if len(own) else None)
                sizes.append(len(own))
                hashes.append(band_hashes(least, bands, rows) if len(own) else np.zeros(0, np.int64))
                sketches.append(least.astype(np.uint8).tobytes() if len(own) else None)
            made = [pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], [*(f.name for f in kept), "node", "shingles", "bands", "sketch"])

    return docs.select("text", *(f.name for f in kept)).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """node and its set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            own = [shingle_set(x.as_py(), words) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([set_digest(x) for x in own], pa.binary()), pa.array([x.tobytes() for x in own], pa.binary())], ["node", "set"])

    return docs.mapInArrow(run, "node binary, set binary")


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share; shingles of one set alone are left out before the products."""
    n, values = len(sets), np.concatenate(sets)
    order = np.argsort(values, kind="stable")  # merges the sets, which are sorted
    values, owner = values[order], np.repeat(np.arange(n), [len(x) for x in sets])[order]
    column = np.cumsum(np.concatenate([[False], values[1:] != values[:-1]]))
    several = np.bincount(column) > 1
    shared = several[column]
    owner, column = owner[shared], (np.cumsum(several) - 1)[column[shared]]
    out = np.zeros((n, n), np.float64)
    columns = int(column[-1]) + 1 if len(column) else 0
    step = max(256, min(columns, 4_000_000 // n))
    for low in range(0, columns, step):
        a, b = np.searchsorted(column, [low, low + step])
        x = np.zeros((n, step), np.float32)
        x[owner[a:b], column[a:b] - low] = 1
        out += x @ x.T
    return out


def own_pairs(places: list[list[int]], place: int, *sides: list[bool] | None) -> np.ndarray:
    """Which pairs belong to `place`: those that share no smaller one of their places, and are of different sides wherever there are two."""
    n = len(places)
    out = ~np.eye(n, dtype=bool)
    for of in sides:
        if of is not None:
            side = np.array(of, bool)
            out &= side[:, None] != side[None, :]
    members: dict[int, list[int]] = {}
    for i, of in enumerate(places):
        for p in of:
            if p < place:
                members.setdefault(p, []).append(i)
    for of in members.values():
        if len(of) > 1:
            out[np.ix_(of, of)] = False
    return out


def alike(sketches: np.ndarray, wanted: np.ndarray, least: float) -> np.ndarray:
    """Those of the wanted pairs whose sketches agree in a share of at least `least`."""
    out = np.zeros_like(wanted)
    for i in np.flatnonzero(wanted.any(axis=1)).tolist():
        at = np.flatnonzero(wanted[i])
        out[i, at] = (sketches[at] == sketches[i]).mean(axis=1) >= least
    return out


def first_of_group(links: np.ndarray) -> np.ndarray:
    """For each row of a symmetric table of links, the first row of its group."""
    root = np.arange(len(links))
    while True:
        near = np.where(links, root[None, :], len(links)).min(axis=1)
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def dealt(root: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """Blocks of bounded size for rows in order of their groups."""
    out, block, classes, load = np.zeros(len(root), np.int64), 0, 0, 0
    for i in np.argsort(root, kind="stable").tolist():
        if classes and (classes >= BLOCK_CLASSES or load + shingles[i] > BLOCK_SHINGLES):
            block, classes, load = block + 1, 0, 0
        out[i] = block
        classes, load = classes + 1, load + int(shingles[i])
    return out


def rows_by(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows that agree in their first `keys` columns, as they come."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    for key, found in groupby(rows(), key=lambda r: r[:keys]):
        yield key, list(found)


_TILE = ["place", "low", "high"]
_SUB = [*_TILE, "first", "second"]


def candidates(rows: DataFrame, least: float) -> DataFrame:
    """The classes that have a candidate pair, once for each pair of blocks to verify it in: place, low, high, first, second, right, later, id.

    `rows` has the members of each tile: place, low, high, block, id, shingles, places, sketch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for key, found in rows_by(batches, 3):
            place, low, high = key
            wanted = own_pairs([r[6] for r in found], place, None if low == high else [r[3] == high for r in found])
            near = alike(np.frombuffer(b"".join(r[7] for r in found), np.uint8).reshape(len(found), -1), wanted, least)
            some = np.flatnonzero(near.any(axis=1))
            if not len(some):
                continue
            near = near[np.ix_(some, some)]
            block = dealt(first_of_group(near), np.array([found[i][5] for i in some]))
            x, y = np.nonzero(near)
            a, b = block[x], block[y]
            for first, second in sorted(set(zip(a[a <= b].tolist(), b[a <= b].tolist(), strict=True))):
                of = np.unique(x[((a == first) & (b == second)) | ((a == second) & (b == first))])
                held += [(*key, first, second, found[some[i]][3] == high, bool(block[i] != first), found[some[i]][4]) for i in of.tolist()]
            if len(held) > 10_000:
                yield table_of(held)
                held = []
        if held:
            yield table_of(held)

    def table_of(held: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], [*_SUB, "right", "later", "id"])

    tiles = rows.repartition(*_TILE).sortWithinPartitions(*_TILE).select(*_TILE, "block", "id", "shingles", "places", "sketch")
    return tiles.mapInArrow(run, "place bigint, low int, high int, first int, second int, right boolean, later boolean, id bigint")


def verified(sets: list[np.ndarray], wanted: np.ndarray, weights: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For each set: the weight of the sets that it is linked with by wanted pairs, and the first set of its group."""
    sizes = np.array([len(x) for x in sets], np.float64)
    both = common(sets)
    links = wanted & (both >= least * (sizes[:, None] + sizes[None, :] - both) - 1e-9)
    return links @ weights, first_of_group(links)


def checked(rows: DataFrame, least: float) -> DataFrame:
    """id, links, root for each class of each pair of blocks: place, low, high, first, second, right, later, id, size, places, set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, own in rows_by(batches, 5):
            place, low, high, first, second = key
            _, right, later, ids, sizes, places, sets = zip(*((r[:5], *r[5:]) for r in own), strict=True)
            wanted = own_pairs(list(places), place, None if low == high else right, None if first == second else later)
            links, root = verified([np.frombuffer(x, np.uint64) for x in sets], wanted, np.array(sizes, np.float64), least)
            ids = np.array(ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links.astype(np.int64)), pa.array(ids[root])], ["id", "links", "root"])

    blocks = rows.repartition(*_SUB).sortWithinPartitions(*_SUB).select(*_SUB, "right", "later", "id", "size", "places", "set")
    return blocks.mapInArrow(run, "id bigint, links bigint, root bigint")


def grouped(docs: DataFrame, words: int, least: float, recall: float, doc_id: str, text: str, keyed: bool = False) -> tuple[DataFrame, DataFrame]:
    """doc_id and node for each row of `docs`; node, class_id and n_links for each node.

    If `keyed`, rows have their key, and nodes `best` (the first of their group's rows by doc_id, null last, then key) and `rows` of their group.
    """
    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    told_rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), row_key(F.col(doc_id), F.col(text)).alias("key")) if keyed else narrow
    bands, rows = bands_for(least, recall)
    signed = written(signatures(told_rows, words, bands, rows), "signatures")
    best = [F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best")] if keyed else []
    classes = signed.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("size"), F.max("shingles").alias("shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), *best
    )
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    # Buckets of two classes or more. Those with the same members are one place.
    member = classes.select("id", F.explode("bands").alias("bucket"))
    marks = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    buckets = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("low"), F.max("id").alias("high"), *marks).where("members > 1")
    buckets = buckets.select("bucket", F.struct(F.xxhash64("members", "low", "high", "x1", "x2").alias("place"), "members").alias("at"))
    near = spread_join(member, buckets, "bucket").groupBy("id").agg(F.collect_set("at").alias("at"))
    near = near.withColumn("places", F.col("at.place")).join(classes.select("id", "node", "first_id", "size", "shingles", "sketch"), "id")
    near = written(near, "near")

    # The members of a place, in tiles of two blocks.
    tiles = near.select("id", "shingles", "places", "sketch", F.explode("at").alias("at")).select("*", "at.place", F.ceil(F.col("at.members") / TILE_CLASSES).cast("int").alias("blocks"))
    tiles = tiles.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    some = written(candidates(tiles, least_sketch(least, bands * rows)), "candidates")

    # Whole sets, only for classes with a candidate pair.
    wanted = some.select("id").distinct().join(near.select("id", "node", "first_id", "size", "places"), "id")
    ids = wanted.select(F.col("first_id").alias("doc_id")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = narrow.join(ids, narrow["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select("text")
    sets = shingle_sets(texts, words).dropDuplicates(["node"]).join(wanted.select("id", "node", "size", "places"), "node").drop("node")
    found = written(checked(some.join(sets, "id"), least), "links")

    groups = components(found.where("id <> root"), "id", "root").select(F.col("node").alias("id"), F.col("component").alias("group"))
    last = F.lit((1 << 63) - 1)
    more = ["best"] if keyed else []
    told = classes.select("id", "node", "first_id", "size", *more).join(groups, "id", "left").withColumn("group", F.coalesce("group", "id"))
    of_group = [F.min("best").alias("best"), F.sum("size").alias("rows")] if keyed else []
    smallest = told.groupBy("group").agg(F.min(F.coalesce("first_id", last)).alias("class_id"), *of_group)
    told = spread_join(told.drop(*more), smallest, "group").join(found.groupBy("id").agg(F.sum("links").alias("links")), "id", "left")
    more = ["best", "rows"] if keyed else []
    told = told.select("node", F.when(F.col("class_id") != last, F.col("class_id")).alias("class_id"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), *more)
    return signed.select("doc_id", "node", *(["key"] if keyed else [])), told


def joined(docs: DataFrame, words: int = WORDS, least: float = LEAST, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, class_id (smallest doc_id of its group), n_links (other documents at least `least` alike)."""
    signed, told = grouped(docs, words, least, recall, doc_id, text)
    return spread_join(signed, told, "node", "left").select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of each group, the one with the smallest doc_id (null comes last); all columns stay as they are.

    Rows are told apart by doc_id and text, not by doc_id alone; of rows that tie in both, one stays. Texts without words are groups of their own and stay.
    """
    signed, told = grouped(docs, WORDS, LEAST, RECALL, doc_id, text, keyed=True)
    several = told.where("rows > 1").select("node", "best")
    rows = spread_join(signed.where("node IS NOT NULL"), several, "node").select("key", (F.col("key") == F.col("best.key")).alias("kept"))
    return one_row_each(docs, written(rows, "groups"), doc_id, text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, then the groups: for tables of some thousand documents.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
linked AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
groups AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
counted AS (SELECT a AS doc_id, count(*) AS n_links FROM edges GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links FROM groups LEFT JOIN counted USING (doc_id)
"""
