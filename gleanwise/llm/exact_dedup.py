"""Exact dedup by content-defined chunk recipes.

The white space of a text is normalised, and its UTF-8 bytes are cut where their own content says so: after at least
`CHUNK_LEAST` bytes, at the first place whose last `CHUNK_WINDOW` bytes are each in a hashed table of its own, or after `CHUNK_MOST`. Bytes know no script, so texts of any language, with spaces or without, are cut
by content, about 64 bytes after the least size. A chunk is known by a short
hash; where one short hash stands for several SHA-256 digests, an ordinal tells these chunks apart, so an identifier
stands for one content. A document is the ordered list of its chunks' identifiers, its recipe; documents with equal
recipes are equal. Texts never go through a shuffle: only digests and recipes do, some ten bytes for each kB of text.

Hot groups: copies are counted before the shuffle (map-side), and the join of documents with their groups is a plain
equi-join of narrow rows, whose skewed partitions AQE splits.

Defined results: a null text counts as empty; equal doc_ids are rows of their own; a group's doc_id is its smallest (a
null doc_id is smaller than none: it is kept only if the group has no other); rows that tie in doc_id and text all have
the same `kept`. Other columns of the input are not looked at; `drop_copies` gives all columns back as they are.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, one_row_each, row_key, table, written

#: Chunk sizes in bytes, and how many bytes decide on an end: of 2 ** CHUNK_WINDOW places in plain letters about one is an end.
CHUNK_LEAST, CHUNK_MOST, CHUNK_WINDOW = 512, 8192, 6


def byte_table(k: int) -> str:
    """The bytes that table `k` takes, as a character class: of each two neighbours one, by their hash, so that small
    alphabets have ends too; and all bytes that lead a character, which say little but the script."""
    takes = [b >= 0xC0 or hashlib.blake2b(bytes([k, b >> 1])).digest()[0] & 1 == b & 1 for b in range(256)]
    return "[" + "".join(f"\\x{b:02x}" for b in range(256) if takes[b]) + "]"


#: Where a chunk may end.
CHUNK_END = "(?<=" + "".join(byte_table(k) for k in range(CHUNK_WINDOW)) + ")"


def normal_text(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ")


def content_chunks(text: Column) -> Column:
    """The text's UTF-8 bytes in content-defined pieces, each as a string with a character for each byte."""
    cut = rf"(?s).{{{CHUNK_LEAST},{CHUNK_MOST}}}?{CHUNK_END}|.{{1,{CHUNK_MOST}}}"
    return F.regexp_extract_all(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), F.lit(cut), F.lit(0))


def joined_chunks(chunks: Column) -> Column:
    """The text of some pieces in a row."""
    return F.decode(F.encode(F.array_join(chunks, ""), "ISO-8859-1"), "UTF-8")


def chunk_digests(chunks: Column) -> Column:
    return F.transform(chunks, lambda c: F.struct(F.xxhash64(c).alias("h"), F.unhex(F.sha2(c, 256)).alias("d")))


def with_digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with text_sha256 of the normalised text and the digests of its chunks, instead of the text."""
    out = docs.withColumn("_normal", normal_text(F.col(text)))
    return out.withColumns(
        {"text_sha256": F.sha2(F.col("_normal"), 256), "_chunks": chunk_digests(content_chunks(F.col("_normal")))}
    ).drop("_normal", text)


def recipes(digested: DataFrame) -> DataFrame:
    """`digested` with `recipe`, the ordered list of chunk identifiers (short hash, ordinal among its digests)."""
    chunks = digested.select(F.explode("_chunks").alias("c")).select("c.h", "c.d")
    first = chunks.groupBy("h").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    clash = written(first.where("low <> high").select("h"), "clash")
    if clash.isEmpty():  # each short hash stands for one digest
        ordinal = lambda c: F.lit(0)
        out = digested
    else:
        told = chunks.distinct().join(clash, "h").groupBy("h").agg(F.sort_array(F.collect_set("d")).alias("ds"))
        told = told.select("h", F.posexplode("ds").alias("ordinal", "d")).where("ordinal > 0")
        own = digested.select("_row", F.explode("_chunks").alias("c")).select("_row", "c.*").distinct().join(told, ["h", "d"])
        own = own.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("h", "d"), "ordinal"))).alias("_told"))
        ordinal = lambda c: F.coalesce(F.element_at("_told", c), F.lit(0))
        out = digested.join(own, "_row", "left")
    identifier = lambda c: F.struct(c["h"].alias("h"), ordinal(c).alias("ordinal"))
    return out.withColumn("recipe", F.transform("_chunks", identifier)).drop("_chunks", "_told", "_row")


def decided(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row for each row of `docs`: doc_id, key (its row_key), keep_id, group_size, kept, text_sha256."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), row_key(F.col(doc_id), F.col(text)).alias("key"))
    digested = written(with_digests(narrow).withColumn("_row", F.monotonically_increasing_id()), "dedup")
    rows = recipes(digested).withColumn("_of", F.xxhash64("recipe"))
    groups = rows.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # The join also has the recipe's hash as a key: both sides are then dealt anew, so AQE can split a large group's rows.
    return rows.join(groups.withColumn("_of", F.xxhash64("recipe")), ["_of", "recipe"]).select(
        "doc_id", "key", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def groups_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256."""
    return decided(docs, doc_id, text).drop("key")


def chunk_store(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each distinct chunk once: sha256, chunk, in how many places it stands. With the recipes it gives all texts."""
    chunks = docs.select(F.explode(content_chunks(normal_text(F.col(text)))).alias("chunk"))
    counted = chunks.groupBy(F.sha2("chunk", 256).alias("sha256"))
    return counted.agg(F.first("chunk").alias("chunk"), F.count(F.lit(1)).alias("places"))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the rows whose text a smaller doc_id has; of rows that tie in doc_id and text, one stays.

    Rows of the smallest doc_id may differ in white space: the one with the smallest key stays. Texts are normalised and
    cut once; the second reading only takes each row's key.
    """
    rows = written(decided(docs, doc_id, text).select("text_sha256", "key", "kept", "group_size"), "copies")
    several = rows.where("group_size > 1")  # other rows stay without a word
    best = several.where("kept").groupBy("text_sha256").agg(F.min("key").alias("best"))
    dealt = several.withColumn("_of", F.xxhash64("text_sha256")).join(best.withColumn("_of", F.xxhash64("text_sha256")), ["_of", "text_sha256"])
    told = written(dealt.select("key", (F.col("kept") & (F.col("key") == F.col("best"))).alias("kept")), "decided")
    return one_row_each(docs, told, doc_id, text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups_of(table(spark, sf_dir, "documents"))


SQL = r"""
WITH normal AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), grouped AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM normal GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM normal JOIN grouped USING (t)
"""
