"""Observation tables on disk: fixed schemas, day partitions, additive columns, the spend ledger as JSON lines.

A table is Parquet in folders by day; a scan of the last hours reads those days only, and the exact bound goes down to
the files. Columns that older files lack read as null, so a table grows columns without being rewritten.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.state import LEDGER

#: Columns of each table; ts is in epoch seconds. A null category is general.
SCHEMAS = {
    "probes": "ts bigint, engine string, query string, verdict string, results int, relevant int, latency_ms int, reason string, first_title string, urls array<string>, hit int, category string",
    "reads": "ts bigint, url string, path string, expected string, status string, via string, http_status int, chars int, latency_ms int, hit int, reason string, stub_check string",
    "pool": "ts bigint, engines array<string>, reason string, computed int, category string",
}

DAY_S = 86_400


def shaped(rows: DataFrame, kind: str) -> DataFrame:
    """`rows` with the columns of the table: those it lacks are null, others go."""
    have = set(rows.columns)
    schema = StructType.fromDDL(SCHEMAS[kind])
    return rows.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def append(rows: DataFrame, path: str, kind: str) -> None:
    """Adds rows; within a day they are sorted by time, so files have narrow ranges of ts."""
    out = shaped(rows, kind).withColumn("day", F.floor(F.col("ts") / DAY_S).cast("int"))
    out.repartition("day").sortWithinPartitions("day", "ts").write.mode("append").partitionBy("day").parquet(path)


def scan(spark: SparkSession, path: str, kind: str, since: int | None = None, category: str | None = None) -> DataFrame:
    """The table's rows from `since` on, of one category (rows without one are general)."""
    schema = StructType.fromDDL(SCHEMAS[kind] + ", day int")
    rows = spark.read.schema(schema).parquet(path)
    if since is not None:
        rows = rows.where((F.col("day") >= since // DAY_S) & (F.col("ts") >= since))
    if category is not None:
        rows = rows.where(F.coalesce("category", F.lit("general")) == category)
    return rows.drop("day")


def append_ledger(calls: DataFrame, path: str) -> bool:
    """Adds calls as JSON lines; whether they were written. A ledger that can't be written loses its lines, not the calls."""
    schema = StructType.fromDDL(LEDGER)
    have = set(calls.columns)
    lines = calls.select(*((F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
    try:
        lines.write.mode("append").json(path)
    except (PySparkException, Py4JJavaError) as e:
        warnings.warn(f"the ledger at {path} was not written: {str(e).splitlines()[0]}", stacklevel=2)
        return False
    return True


def ledger_lines(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's lines as text, broken ones too: the input of `operators.state.ledger`."""
    return spark.read.text(path)


class RecordedAnswers(DataSource):
    """Recorded metasearch answers, a JSON body in each file, as rows: `spark.read.format("recorded_answers").load(folder)`.

    Entries without an http link are dropped, fields are tidied and cut, three engines at most are named.
    """

    @classmethod
    def name(cls) -> str:
        return "recorded_answers"

    def schema(self) -> str:
        return "file string, rank int, url string, title string, snippet string, engines array<string>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _AnswerReader(self.options)


class _AnswerReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        files = store.get_file_info(fs.FileSelector(name))
        return [InputPartition(f.path) for f in sorted(files, key=lambda f: f.path) if f.base_name.endswith(".json")]

    def read(self, partition: InputPartition) -> Iterator[tuple[Any, ...]]:
        import json

        from pyarrow import fs

        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        with store.open_input_stream(partition.value) as stream:
            body = json.loads(stream.read().decode("utf-8", "replace") or "{}")
        tidy = lambda x, n: " ".join(str(x or "").split())[:n]
        links = [x for x in body.get("results") or [] if str(x.get("url") or "").startswith(("http://", "https://"))]
        for rank, x in enumerate(links):
            yield partition.value, rank, x["url"], tidy(x.get("title"), 300), tidy(x.get("content"), 300), [str(e) for e in (x.get("engines") or [])[:3]]
