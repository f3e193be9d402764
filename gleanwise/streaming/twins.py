"""Streaming twins of observation queries: probes arrive as files, results are tables.

Each twin runs until the files at hand are read (availableNow) and gives what the batch query gives; started with a
trigger of its own, the same plan goes on. State is bounded: windows close by watermark, and an engine's trust state is
its last ten judged probes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import IntegerType, StructType

from ..operators import history
from ..sources import views
from ..sources.shared import drop_path, fresh_path

TRUST_LAST = 10

#: Seconds that event times are moved on by. A stream's first watermark is 1970, and what is no later is dropped as late,
#: so seconds from 0, or up to 68 years before it, would be. Nanoseconds of pandas end in 2262.
EARLY = 1 << 31


def timed(rows: DataFrame, late: str) -> DataFrame:
    """`rows` with `at`, the event time of ts (seconds, 0 and less too), and a watermark on it."""
    return rows.withColumn("at", F.timestamp_seconds(F.col("ts") + F.lit(EARLY))).withWatermark("at", late)


def probe_stream(spark: SparkSession, folder: str, files: int = 1000) -> DataFrame:
    """The probes of `views.probes` as they arrive in the folder's events."""
    return views.probes_of(event_stream(spark, folder, files))


def event_stream(spark: SparkSession, folder: str, files: int = 1000) -> DataFrame:
    """The folder's events as a file stream, up to `files` files in a batch. The name is a pattern, as a source that is one file has no base folder."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/event[s].parquet")


def drained(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """All that the stream gives for the files at hand, as a table in the shared folder."""
    spark = stream.sparkSession
    out, log = fresh_path(spark, "stream"), fresh_path(spark, "stream-log")
    writer = stream.writeStream.option("checkpointLocation", log).trigger(availableNow=True).outputMode(mode)
    if each is None:
        writer = writer.format("parquet").option("path", out)
    else:
        writer = writer.foreachBatch(each)
    writer.start().awaitTermination()
    return spark.read.parquet(out) if each is None else spark.createDataFrame([], stream.schema)


def appended(spark: SparkSession, folder: str) -> DataFrame:
    """The probe sink: probes appended batch by batch."""
    return drained(probe_stream(spark, folder).select("id", "ts", "engine", "verdict"))


def _last_of_batches(stream: DataFrame, key: str) -> DataFrame:
    """The last state of an update stream: each batch is merged into the table that the batch before left.

    A version is written anew if its batch comes again, from the version before it, and the one before that is dropped,
    so what is kept does not grow with the number of batches.
    """
    spark, out = stream.sparkSession, fresh_path(stream.sparkSession, "updates")
    schema = StructType([*stream.schema.fields]).add("version", IntegerType())

    def keep(batch: DataFrame, number: int) -> None:
        if number:
            before = spark.read.schema(schema).parquet(out).where(F.col("version") == number - 1).drop("version")
            batch = batch.unionByName(before.join(batch.select(key), key, "left_anti"))
        batch.write.mode("overwrite").parquet(f"{out}/version={number}")
        if number > 1:
            drop_path(spark, f"{out}/version={number - 2}")

    drained(stream, "update", keep)
    versions = spark.read.schema(schema).parquet(out)
    return versions.where(F.col("version") == (versions.agg(F.max("version")).first()[0] or 0)).drop("version")


@contextmanager
def state_in_rocks(spark: SparkSession) -> Iterator[None]:
    """Typed state (lists, values, timers) is kept by this store only."""
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, store)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def health(spark: SparkSession, folder: str, files: int = 1000) -> DataFrame:
    """engine, probes, ok, hits over all probes so far, kept up to date batch by batch."""
    told = probe_stream(spark, folder, files).groupBy("engine").agg(
        F.count(F.lit(1)).alias("probes"), F.count_if(F.col("verdict") == "ok").alias("ok"), F.count_if(F.col("hit") == 1).alias("hits")
    )
    return _last_of_batches(told, "engine")


class LastJudged(StatefulProcessor):
    """An engine's last judged probes as a list in state, and its trust after each batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "ts bigint, id bigint, hit bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = list(self.last.get()) if self.last.exists() else []
        for batch in rows:
            held = sorted(held + list(zip(batch["ts"].tolist(), batch["id"].tolist(), batch["hit"].tolist(), strict=True)))[-TRUST_LAST:]
        self.last.put(held)
        n, good = len(held), int(sum(r[2] for r in held))
        label = "substitutes" if good < n else "clean" if n >= 3 else "candidate"
        yield pd.DataFrame({"engine": [key[0]], "judged": [n], "hits": [good], "trust": [label]})

    def close(self) -> None:
        pass


def trust(spark: SparkSession, folder: str, confirmed: tuple[str, ...], files: int = 1000) -> DataFrame:
    """engine, judged, hits, trust over the last ten judged probes of confirmed references, whatever order files arrive in."""
    judged = probe_stream(spark, folder, files).where(F.col("query").isin(*confirmed) & F.expr("hit IS NOT NULL AND results > 0 AND relevant > 0"))
    rows = judged.select("engine", "ts", "id", "hit").groupBy("engine")
    told = rows.transformWithStateInPandas(LastJudged(), "engine string, judged bigint, hits bigint, trust string", "Update", "None")
    with state_in_rocks(spark):
        return _last_of_batches(told, "engine")


class Cached(StatefulProcessor):
    """When a page was stored: a hit is younger than `ttl`, a miss stores anew. A timer forgets the page once no row that
    may still come can hit it."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.stored = handle, handle.getValueState("stored", "ts bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        at = self.stored.get()[0] if self.stored.exists() else None
        before, told = at, pd.concat(list(rows)).sort_values(["ts", "id"])
        hits = []
        for ts in told["ts"].tolist():
            hits.append(at is not None and ts - at < self.ttl)
            at = at if hits[-1] else ts
        if at != before:
            self.stored.update((at,))
            self.handle.registerTimer((EARLY + at + self.ttl) * 1000)
        yield pd.DataFrame({"page": key[0], "id": told["id"], "hit": hits})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.stored.exists() and (EARLY + self.stored.get()[0] + self.ttl) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.stored.clear()
        return iter(())

    def close(self) -> None:
        pass


def cache(requests: DataFrame, ttl: int, late: str = "1 hour") -> DataFrame:
    """page, id, hit of each request (page, id, ts in seconds) of a stream, kept for `ttl` seconds of event time.

    A batch's requests are taken in order of time; later batches may be `late`, and what comes later still is dropped.
    """
    told = timed(requests.select("page", "id", "ts"), late).groupBy("page").transformWithStateInPandas(Cached(ttl), "page string, id bigint, hit boolean", "Append", "EventTime")
    with state_in_rocks(requests.sparkSession):
        return drained(told)


def tumbling(spark: SparkSession, folder: str, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Probes and mean value by event-time window, closed by watermark. The last windows stay open until later probes come."""
    events = event_stream(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))
    told = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return drained(told.select(F.col("window.start").alias("start"), "event_type", "n"))


def sessions(spark: SparkSession, folder: str, gap: str = "30 minutes", late: str = "1 hour", files: int = 1000) -> DataFrame:
    """engine, start, seconds, n of each session of probes no further apart than `gap`, when the watermark has passed its end."""
    told = timed(probe_stream(spark, folder, files), late).groupBy("engine", F.session_window("at", gap).alias("w"))
    told = told.agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    return drained(told.select("engine", "start", (F.col("end") - F.col("start")).alias("seconds"), "n"))


class Panes:
    """Sliding windows over a stream by panes: each batch leaves its partial counts by pane (a slide's length of time).

    A batch is a folder of its own, written anew if it comes again. The watermark of a batch is the latest time of all
    batches before it less `late`; rows older than that go to a table of late rows and are counted nowhere else. A
    window is the sum of its panes, so a row is counted once and not once for each window over it.
    """

    def __init__(self, spark: SparkSession, slide: int, late: int):
        self.spark, self.slide, self.late = spark, slide, late
        self.folder = {name: fresh_path(spark, name) for name in ("panes", "late")}
        self.batches = "engine string, pane bigint, probes bigint, ok bigint, hits bigint, latest bigint, batch int"

    def panes(self) -> DataFrame:
        return self.spark.read.schema(self.batches).parquet(self.folder["panes"])

    def late_rows(self) -> DataFrame:
        return self.spark.read.parquet(self.folder["late"])

    def keep(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch."""
        latest = self.panes().where(F.col("batch") < number).agg(F.max("latest")).first()[0] if number else None
        on_time = F.lit(True) if latest is None else F.col("ts") >= latest - self.late
        own = batch.where(on_time).groupBy("engine", F.floor(F.col("ts") / self.slide).alias("pane")).agg(
            F.count(F.lit(1)).alias("probes"), F.count_if(F.col("verdict") == "ok").alias("ok"), F.count_if(F.col("hit") == 1).alias("hits"), F.max("ts").alias("latest")
        )
        own.write.mode("overwrite").parquet(f"{self.folder['panes']}/batch={number}")
        batch.where(~on_time).write.mode("overwrite").parquet(f"{self.folder['late']}/batch={number}")

    def windows(self, panes: int) -> DataFrame:
        """engine, slide (its number: the window ends there, after that many slides), probes, ok, hits over `panes` slides."""
        merged = self.panes().groupBy("engine", "pane").agg(*(F.sum(c).alias(c) for c in ("probes", "ok", "hits")))
        over = merged.withColumn("slide", F.explode(F.sequence(F.col("pane") + 1, F.col("pane") + panes)))
        return over.groupBy("engine", "slide").agg(*(F.sum(c).alias(c) for c in ("probes", "ok", "hits")))


def sliding(spark: SparkSession, folder: str, width: int = 86_400, slide: int = 1800, late: int = 7200, files: int = 1000) -> tuple[DataFrame, Panes]:
    """Health over the last `width` seconds at each slide, and the panes with the late rows."""
    panes = Panes(spark, slide, late)
    drained(probe_stream(spark, folder, files), "append", panes.keep)
    return panes.windows(width // slide), panes


def pools(spark: SparkSession, folder: str, slide: int, panes: int, least: int, files: int = 1000) -> DataFrame:
    """The pool from snapshot to snapshot, as batches of probes come: each batch adds its counts, and the snapshots that the
    watermark has passed (no probe comes that is older than the latest one) are folded onto the pools before.

    All pools that were kept: category, snapshot, engines, reason.
    """
    counts, kept = fresh_path(spark, "probes"), fresh_path(spark, "pools")
    seen = "id bigint, ts bigint, engine string, category string, hit int, results int, batch int"

    def each(batch: DataFrame, number: int) -> None:
        batch.select("id", "ts", "engine", "category", "hit", "results").write.mode("overwrite").parquet(f"{counts}/batch={number}")
        before = history.read_pools(spark, kept).where(F.col("batch") < number).agg(F.max("snapshot")).first()[0]
        probes = spark.read.schema(seen).parquet(counts).where(F.col("batch") <= number)
        done = F.floor(F.lit(probes.agg(F.max("ts")).first()[0] or 0) / slide)
        first = F.lit(-1 if before is None else before)
        recent = probes.where(F.col("ts") >= (first + 1 - panes) * slide)
        rated = history.snapshots(recent, slide, panes, least).where((F.col("snapshot") > first) & (F.col("snapshot") <= done))
        history.keep_pools(rated, number, kept)

    drained(probe_stream(spark, folder, files), "append", each)
    return history.read_pools(spark, kept).drop("batch")
