"""What the operators of this folder share: the shared folder, written tables, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import fresh_path, shared_dir, written

__all__ = ["SPACE", "VOCABULARY", "as_rows", "fresh_path", "let", "one_row_each", "row_key", "shared_dir", "table", "tokenizer_path", "unused", "written"]

#: White space between words, as a character class without brackets (fixed value).
SPACE = r"\x20\x09-\x0D"

#: Keys of dropped rows are broadcast up to this number (16 bytes each); beyond it they are joined by a shuffle.
BROADCAST_KEYS = 1_000_000

#: The public tokenizer that the queries name.
VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once for each row, however often `body` uses it."""
    return F.transform(F.array(value), body)[0]


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be none of the columns of `df`."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def as_rows(docs: DataFrame, text: str) -> DataFrame:
    """`row`, all columns of `docs` in a struct, and `text`: names of further columns can't clash with those of `docs`."""
    return docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))


def row_key(doc_id: Column, text: Column) -> Column:
    """A row's 128-bit key: rows with equal doc_id (null too) and text share it."""
    number = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.unhex(F.md5(F.concat(number, F.lit("\n"), F.coalesce(text, F.lit("")))))


def one_row_each(docs: DataFrame, told: DataFrame, doc_id: str, text: str) -> DataFrame:
    """`docs` without the rows whose `key` (a row_key) is told not `kept`, and with one row of those that share a kept key.

    `told` should be a written table. Rows whose key is not told stay. All columns stay as they are.
    """
    key, other = unused(docs, "key", "other")
    dropped = told.where("NOT kept").select(F.col("key").alias(other)).distinct()
    tied = told.where("kept").groupBy(F.col("key").alias(other)).count().where("count > 1").select(other)
    if dropped.count() <= BROADCAST_KEYS:
        dropped = F.broadcast(dropped)
    keyed = docs.withColumn(key, row_key(F.col(doc_id), F.col(text)))
    left = keyed.join(dropped, F.col(key) == F.col(other), "left_anti")
    if not tied.isEmpty():
        same = F.col(key) == F.col(other)
        once = left.join(tied, same, "left_semi").dropDuplicates([key])
        left = left.join(tied, same, "left_anti").unionByName(once)
    return left.drop(key)
