"""Streams give what batches give, whatever files the probes arrive in."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleanwise.operators import observe
from gleanwise.sources import views
from gleanwise.streaming import twins

CONFIRMED = ("view", "click", "purchase")


@pytest.fixture(scope="module")
def arrived(spark, folder, tmp_path_factory):
    """The events in four files, not in order of time."""
    path = str(tmp_path_factory.mktemp("stream"))
    events = spark.read.parquet(f"{folder}/events.parquet")
    events.repartition(4, F.col("event_id") % 4).write.parquet(f"{path}/events.parquet")
    return path


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_sink(spark, arrived):
    assert rows(twins.appended(spark, arrived)) == rows(views.probes(spark, arrived).select("id", "ts", "engine", "verdict"))


@pytest.mark.parametrize("files", [1, 1000])
def test_health(spark, arrived, files):
    assert rows(twins.health(spark, arrived, files)) == rows(observe.health(views.probes(spark, arrived)).select("engine", "probes", "ok", "hits"))


@pytest.mark.parametrize("files", [1, 1000])
def test_trust(spark, arrived, files):
    confirmed = spark.createDataFrame([(q,) for q in CONFIRMED], "query string")
    batch = observe.trust(views.probes(spark, arrived), confirmed).select("engine", "judged", "hits", "trust")
    assert rows(twins.trust(spark, arrived, CONFIRMED, files)) == rows(batch)


def test_windows_close_by_watermark(spark, folder, arrived):
    got = twins.tumbling(spark, arrived, width="1 day", late="2 hours")
    days = spark.read.parquet(f"{folder}/events.parquet").groupBy(F.col("ts").cast("date").alias("d"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    both = got.select(F.col("start").cast("date").alias("d"), "event_type", F.col("n").alias("m")).join(days, ["d", "event_type"])
    assert got.count() == both.count() > 0 and both.where("n <> m").count() == 0
