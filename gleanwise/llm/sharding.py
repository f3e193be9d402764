"""Sharding by a k-d tree over the documents' metadata.

All rows begin as one node that is to become `shards` leaves. Level by level, each node is split along its widest
dimension (widths are shares of the dimension's global range) at the weighted median that gives either side bytes in
proportion to its leaves; nodes of one leaf are done. Medians are distributed: one pass over the rows sums bytes by (node,
bin) for all nodes of a level, some ten thousand bins over each node's own range, and finds each node's cut between bins
and its children's ranges. Only if the bin that the cut falls into holds several rows and more than EVEN of the node's
bytes, a further pass looks into that bin. One row for each node and side comes to the driver; nodes are at most as many
as shards.

Coordinates are integers: the place on the dimension, then a hash of doc_id, size and text, then a hash of the row's
number, so equal metadata and even repeated rows can be split anywhere. Numbers take their places on a logarithmic scale
between the dimension's ends, strings by their rank among all distinct values, which are sorted by ranges. The tree is
applied as one expression of nested comparisons, without a join and without writing rows again.

The law is `bytes`: shard sizes are near equal; each split errs by half a bin: one document, or EVEN of its bytes. Slots
are made by the counts of hashed blocks within the shard, so a shard is never sorted in one task.

Defined results: a null text has no bytes but counts 16; null metadata lie at the low end. Rows equal in doc_id and text
may come to different shards. An empty table gives an empty result; with fewer rows than shards some shards stay empty.
Copies of a text have no group here, as the law asks for equal bytes. Columns with the names of the results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import spread_join
from .common import table, written

#: Shards and bytes that each row counts besides its text; the query's dimensions.
SHARDS, ROW_BYTES, DIMENSIONS = 40, 16, ("n_chars", "source", "lang")

#: Bits of a coordinate from the place, the content's hash and the row's; bins in a pass; the share of a node's bytes that
#: a split may miss; rows in a block of slots.
PLACE_BITS, CONTENT_BITS, ROW_BITS, BINS, EVEN, BLOCK_ROWS = 16, 28, 16, 1 << 15, 1 / 2000, 4096


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def text_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")))


def numbers(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("bigint") for v in values))


def scaled(x: Column) -> Column:
    """A number on a logarithmic scale, the same on both sides of zero."""
    return F.signum(x) * F.log2(F.abs(x) + 1)


def string_ranks(rows: DataFrame, name: str) -> DataFrame:
    """value and its rank among the distinct values of a string column, from 1; a range of values is sorted in a task."""
    values = rows.where(F.col(name).isNotNull()).select(F.col(name).alias("value")).distinct()
    ranged = written(values.repartitionByRange("value").withColumn("part", F.spark_partition_id()), "values")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    base = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("value"))
    return ranged.withColumn("at", within).join(base, "part").select("value", (F.col("base") + F.col("at")).alias("rank"))


@dataclass
class Tree:
    """Splits: for each node of each level its dimension, its threshold and its left child; the right one is the next."""

    levels: list[tuple[list[int], list[int], list[int]]] = field(default_factory=list)

    def node(self, keys: list[Column], level: int = 0, i: int = 0) -> Column:
        """A row's node of the last level: nested comparisons, each split once. A node that is done has no comparison."""
        if level == len(self.levels):
            return F.lit(i)
        dim, cut, left = (x[i] for x in self.levels[level])
        if dim < 0:
            return self.node(keys, level + 1, left)
        return F.when(keys[dim] >= F.lit(cut).cast("bigint"), self.node(keys, level + 1, left + 1)).otherwise(self.node(keys, level + 1, left))


@dataclass
class Split:
    """A node that is being split along `dim`: the range that holds its cut, the bytes before it, the bytes that are to go left."""

    dim: int
    low: int
    high: int
    goal: float
    total: int
    before: int = 0
    left: int = 0
    cut: int | None = None
    narrowed: bool = False
    sides: dict[bool, list[tuple[int, int]]] = field(default_factory=dict)

    @property
    def width(self) -> int:
        return (self.high - self.low) // BINS + 1


def one_pass(at: DataFrame, keys: list[Column], splits: dict[int, Split], n_nodes: int) -> None:
    """Narrows each open node's split to a bin, and sets its cut if that is enough."""
    still = {i: s for i, s in splits.items() if s.cut is None}
    of = lambda value, none=0: F.get(numbers([value(still[i]) if i in still else none for i in range(n_nodes)]), F.col("node"))
    rows = at.withColumn("dim", of(lambda s: s.dim, -1).cast("int")).where("dim >= 0")
    rows = rows.withColumns({"key": F.get(F.array(*keys), F.col("dim")), "low": of(lambda s: s.low), "high": of(lambda s: s.high), "width": of(lambda s: s.width, 1)})
    rows = rows.where("key BETWEEN low AND high").withColumn("bin", F.expr("(key - low) div width"))
    ends = [f(k).alias(f"{n}{i}") for i, k in enumerate(keys) for n, f in (("a", F.min), ("b", F.max))]
    bins = rows.groupBy("node", "bin").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), *ends)
    upto = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most BINS + 1 rows
    bins = bins.withColumn("upto", F.sum("bytes").over(upto))
    # A bin goes left if most of it lies before the goal.
    bins = bins.withColumn("goal", of(lambda s: int(s.goal) - s.before)).withColumn("left", 2 * F.col("upto") - F.col("bytes") <= 2 * F.col("goal"))
    middle = (F.col("upto") > F.col("goal")) & (F.col("upto") - F.col("bytes") < F.col("goal"))
    sides = [f(f"{n}{i}").alias(f"{n}{i}") for i in range(len(keys)) for n, f in (("a", F.min), ("b", F.max))]
    told = bins.groupBy("node", "left").agg(F.max("bin").alias("last"), F.sum("bytes").alias("bytes"), F.max(F.when(middle, F.struct("bytes", "rows", "bin", "upto"))).alias("middle"), *sides)
    found: dict[int, dict[bool, object]] = {}
    for r in told.collect():
        found.setdefault(r["node"], {})[r["left"]] = r
    for i, s in still.items():
        by_side = found.get(i, {})
        middle = next((r["middle"] for r in by_side.values() if r["middle"] is not None), None)
        if middle is None or middle["rows"] == 1 or s.width == 1 or middle["bytes"] <= EVEN * s.total:
            s.cut = s.low + (by_side[True]["last"] + 1) * s.width if True in by_side else s.low
            s.left = s.before + (by_side[True]["bytes"] if True in by_side else 0)
            if not s.narrowed:
                s.sides = {side: [(r[f"a{d}"], r[f"b{d}"]) for d in range(len(keys))] for side, r in by_side.items()}
            continue
        start = s.low + middle["bin"] * s.width
        s.before += middle["upto"] - middle["bytes"]
        s.low, s.high, s.narrowed = start, min(s.high, start + s.width - 1), True


def grow(rows: DataFrame, dims: int, shards: int) -> Tree:
    """The tree for a written table with the coordinates k0, k1, ... and `size`."""
    tree, keys = Tree(), [F.col(f"k{i}") for i in range(dims)]
    first = rows.agg(F.sum("size").alias("bytes"), *(f(k).alias(f"{n}{i}") for i, k in enumerate(keys) for n, f in (("a", F.min), ("b", F.max)))).first()
    whole = [(first[f"a{i}"] or 0, first[f"b{i}"] or 0) for i in range(dims)]
    nodes = [(shards, first["bytes"] or 0, whole)]  # leaves, bytes, ranges
    place = lambda x: x >> (CONTENT_BITS + ROW_BITS)
    while any(n > 1 for n, _, _ in nodes):
        at = rows.select("size", *keys, tree.node(keys).alias("node"))
        splits = {}
        for i, (n, total, ranges) in enumerate(nodes):
            if n > 1:
                share = [(place(b) - place(a)) / max(1, place(whole[d][1]) - place(whole[d][0])) for d, (a, b) in enumerate(ranges)]
                dim = max(range(dims), key=lambda d: (share[d], -d))
                splits[i] = Split(dim, *ranges[dim], total * (n // 2) / n, total)
        while any(s.cut is None for s in splits.values()):
            one_pass(at, keys, splits, len(nodes))
        level: tuple[list[int], list[int], list[int]] = ([], [], [])
        after = []
        for i, (n, total, ranges) in enumerate(nodes):
            s = splits.get(i)
            for values, x in zip(level, (s.dim if s else -1, s.cut if s else 0, len(after)), strict=True):
                values.append(x)
            if s is None:
                after.append((n, total, ranges))
                continue
            for side, m, size in ((True, n // 2, s.left), (False, n - n // 2, total - s.left)):
                # The ranges of a side are as seen; after a second look into a bin, those of the node up to the cut.
                a, b = ranges[s.dim]
                cut = [((a, s.cut - 1) if side else (s.cut, b)) if d == s.dim else r for d, r in enumerate(ranges)]
                after.append((m, size, s.sides.get(side, cut)))
        tree.levels.append(level)
        nodes = after
    return tree


def slotted(rows: DataFrame, total: int, shards: int, order: list[str]) -> DataFrame:
    """`rows` with `slot`, gapless from 0 within the shard."""
    own = rows.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(total // (shards * BLOCK_ROWS) + 1)))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.groupBy("shard", "_block").count().withColumn("_base", F.coalesce(F.sum("count").over(before), F.lit(0)))
    within = Window.partitionBy("shard", "_block").orderBy(*order)
    out = own.withColumn("_in_block", F.row_number().over(within) - 1).join(starts.drop("count"), ["shard", "_block"])
    return out.withColumn("slot", (F.col("_base") + F.col("_in_block")).cast("long")).drop("_block", "_base", "_in_block")


@dataclass
class Space:
    """The dimensions: for numbers their ends, for strings the table of their ranks and its size."""

    ends: list[tuple[float, float]]
    ranks: list[DataFrame | None]

    def keyed(self, rows: DataFrame) -> DataFrame:
        """`rows` (doc_id, size, text_crc32, m0, m1, ...) with number, tie and the coordinates k0, k1, ... in place of m0, m1, ..."""
        for i, told in enumerate(self.ranks):
            if told is not None:
                told = told.select(F.col("value").alias(f"m{i}"), F.col("rank").cast("double").alias("rank"))
                rows = spread_join(rows, told, f"m{i}", "left").drop(f"m{i}").withColumnRenamed("rank", f"m{i}")
        content = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(1 << CONTENT_BITS))
        out = rows.withColumn("number", F.monotonically_increasing_id())
        out = out.withColumn("tie", content * (1 << ROW_BITS) + F.pmod(F.xxhash64("number"), F.lit(1 << ROW_BITS)))
        most = (1 << PLACE_BITS) - 2
        for i, (low, high) in enumerate(self.ends):
            few = self.ranks[i] is not None and high - low <= most  # then ranks are places as they are
            share = F.col(f"m{i}") - low if few else (F.col(f"m{i}") - low) / (high - low) * most if high > low else F.col(f"m{i}") * 0
            place = F.coalesce(F.floor(share).cast("bigint") + 1, F.lit(0))
            out = out.withColumn(f"k{i}", place * (1 << CONTENT_BITS + ROW_BITS) + F.col("tie"))
        return out.drop(*(f"m{i}" for i in range(len(self.ends))))


def narrowed(docs: DataFrame, dimensions: tuple[str, ...], doc_id: str, text: str, *more: Column) -> tuple[DataFrame, list[bool]]:
    """doc_id, size, text_crc32 and the dimensions m0 (the size), m1, ... that `docs` has; and which are strings."""
    kinds = dict(docs.dtypes)
    names = [d for d in dimensions if d in kinds]
    strings = [False, *(kinds[d] == "string" for d in names)]
    size = text_bytes(F.col(text))
    metadata = [scaled(size.cast("double")), *(F.col(d) if kinds[d] == "string" else scaled(F.col(d).cast("double")) for d in names)]
    return docs.select(*more, F.col(doc_id).alias("doc_id"), size.alias("size"), text_crc(F.col(text)).alias("text_crc32"), *(m.alias(f"m{i}") for i, m in enumerate(metadata))), strings


def space_of(narrow: DataFrame, strings: list[bool]) -> Space:
    ranks = [written(string_ranks(narrow, f"m{i}"), "ranks") if s else None for i, s in enumerate(strings)]
    told = narrow.agg(F.count(F.lit(1)), *(f(f"m{i}").alias(f"{n}{i}") for i, s in enumerate(strings) if not s for n, f in (("a", F.min), ("b", F.max)))).first()
    ends = [(told[f"a{i}"] or 0.0, told[f"b{i}"] or 0.0) if r is None else (1, r.count()) for i, r in enumerate(ranks)]
    return Space(ends, ranks)


def plan(docs: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS, doc_id: str = "doc_id", text: str = "text") -> tuple[Space, Tree, DataFrame]:
    """The space and the tree for `docs`, and its rows: doc_id, size, text_crc32, number, tie, shard."""
    narrow, strings = narrowed(docs, dimensions, doc_id, text)
    narrow = written(narrow, "sizes")
    space = space_of(narrow, strings)
    rows = written(space.keyed(narrow), "coordinates")
    tree = grow(rows, len(strings), shards)
    return space, tree, rows.withColumn("shard", tree.node([F.col(f"k{i}") for i in range(len(strings))]))


def assigned(docs: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    _, _, rows = plan(docs, shards, dimensions, doc_id, text)
    out = slotted(rows.select("doc_id", "size", "text_crc32", "number", "tie", "shard"), rows.count(), shards, ["tie", "number"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS, doc_id: str = "doc_id", text: str = "text") -> Tree:
    """`docs` as Parquet in a folder for each shard (shard=0, ...). The tree is applied to each row where it is.

    Rows that are equal in doc_id, size and checksum get new numbers, so which of them goes where may differ from `assigned`.
    """
    space, tree, _ = plan(docs, shards, dimensions, doc_id, text)
    rows, strings = narrowed(docs, dimensions, doc_id, text, F.struct("*").alias("row"))
    rows = space.keyed(rows).withColumn("shard", tree.node([F.col(f"k{i}") for i in range(len(strings))]))
    rows.select("row.*", "shard").write.partitionBy("shard").parquet(path)
    return tree


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(table(spark, sf_dir, "documents"))
