"""Pace and cooldown against the loop over all requests in time order."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanwise.operators import admission


def loop(rows, interval, pauses):
    """rows: (key, ts, id, outcome); the ids of admitted requests."""
    asked, cooling, out = {}, {}, set()
    for key, ts, i, outcome in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
        if cooling.get(key, ts) > ts or (key in asked and ts - asked[key] < interval):
            continue
        asked[key] = ts
        if pauses.get(outcome):
            cooling[key] = ts + pauses[outcome]
        out.add(i)
    return out


SCHEMA = "key string, ts int, id int, outcome string"


@pytest.mark.parametrize("fan", [1024, 2])
def test_cooldown_is_the_loop(spark, monkeypatch, fan):
    """Also with many levels of composition, and with keys that never pause."""
    monkeypatch.setattr(admission, "FAN", fan)
    r = random.Random(8)
    pauses = {"refused": 12, "empty": 5}
    rows = [(r.choice("abc"), r.randint(-300, 3000), i, r.choice(["ok", "ok", "refused", "empty", None])) for i in range(900)]
    rows += [("busy", i // 2, 1000 + i, r.choice(["ok", "refused", "empty"])) for i in range(4000)] + [(None, 1, 9000, "ok"), (None, 2, 9001, "ok"), ("z", None, 9002, "ok")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for interval in (0, 1, 7) if fan > 2 else (3,):
        out = admission.admitted(df, "key", interval, pauses).collect()
        assert len(out) == len(rows) and {x["id"] for x in out if x["admitted"]} == loop(rows, interval, pauses)


def test_pacing(spark):
    df = spark.createDataFrame([("a", t, i, None) for i, t in enumerate([0, 5, 9, 11, 20, 21])], SCHEMA)
    assert {r["id"] for r in admission.admitted(df, "key", 10).where("admitted").collect()} == {0, 3, 5}
    assert {r["id"] for r in admission.cache_replay(df, "key", 10).where("hit").collect()} == {1, 2, 4}
    assert admission.admitted(df.where("false"), "key", 10).count() == 0


def test_transfer_functions_compose():
    r = np.random.default_rng(4)
    for _ in range(200):
        n, most = int(r.integers(1, 60)), int(r.integers(1, 9))
        ts = np.sort(r.integers(0, 80, n))
        wait = r.integers(0, most + 1, n)
        at, end = admission.transfer(ts, wait, most)
        for state in range(most + 1):
            want = state
            for t, w in zip(ts.tolist(), wait.tolist()):
                if t >= want:
                    want = t + w
            assert admission.through(state, at.tolist(), end.tolist()) == want


def test_a_busy_key_is_many_tasks(spark):
    """A key without a pause: its rows are dealt by slices, none of which is more than SLICE pauses long."""
    busy = spark.range(20_000).select(F.lit("k").alias("key"), F.col("id").alias("ts"), "id")
    rows = busy.select(F.struct("key").alias("of"), F.floor(F.col("ts") / (10 * admission.SLICE)).alias("slice"), "ts", F.lit(10).cast("bigint").alias("wait"), F.col("id").alias("tie"))
    made = admission.functions_of(rows, 10 * admission.SLICE, 10, "string").collect()
    assert len(made) == -(-2000 // admission.SLICE) and max(len(r["at"]) for r in made) <= 12
    assert admission.admitted(busy, "key", 10).where("admitted").count() == 2000


def cached(rows, ttl, capacity):
    """rows: (pool, key, ts, id); the ids of hits, by one loop for each pool."""
    caches, out = {}, set()
    for pool, key, ts, i in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[3])):
        own = caches.setdefault(pool, {})
        if key in own and ts - own[key] > ttl:
            del own[key]
        if key in own:
            out.add(i)
        else:
            if len(own) >= capacity:
                del own[min(own, key=own.get)]
            own[key] = ts
    return out


@pytest.mark.parametrize("capacity", [1, 3, 1000])
def test_cache_is_the_loop(spark, capacity):
    r = random.Random(capacity)
    rows = [(r.choice(["p", "q", None]), r.choice("abcdef"), r.randint(0, 2000), i) for i in range(1500)]
    rows += [("busy", f"k{r.randint(0, 5)}", i // 3, 2000 + i) for i in range(1500)] + [("busy", None, None, 9000), ("busy", None, 5, 9001), ("busy", None, 6, 9002)]
    df = spark.createDataFrame(rows, "pool string, key string, ts int, id int").repartition(3)
    out = admission.cache_evict(df, "pool", "key", 9, capacity).collect()
    assert len(out) == len(rows) and {x["id"] for x in out if x["hit"]} == cached(rows, 9, capacity)


def swept(requests, answers, n, interval, pauses, least):
    free, out = {}, []
    for request, ts, query in sorted(requests, key=lambda r: (r[1], r[0])):
        links, asked = [], 0
        for _, pos, engine, urls, outcome in sorted(a for a in answers if a[0] == query):
            if (len(links) >= n) if least is None else (asked >= least):
                out.append((request, pos, "not_reached", None, 0))
            elif free.get(engine, ts) > ts:
                out.append((request, pos, "skipped", None, 0))
            else:
                room = max(1, n - len(links)) if least is None else n
                new = [u for u in dict.fromkeys(urls[:room]) if u not in links]
                links += new
                asked += 1
                free[engine] = ts + max(interval, pauses.get(outcome, 0))
                out.append((request, pos, "asked", room, len(new)))
    return sorted(out)


@pytest.mark.parametrize("least", [None, 2])
def test_sweep_with_skips_is_the_loop(spark, least):
    r = random.Random(3)
    queries = [f"q{k}" for k in range(6)]
    answers = [(q, pos, f"e{pos}", [f"u{r.randint(0, 15)}" for _ in range(r.randint(0, 6))], r.choice(["ok", "ok", "refused", "empty"])) for q in queries for pos in range(5) if r.random() < 0.9]
    requests = [(i, r.randint(0, 400), r.choice(queries)) for i in range(250)]
    pauses = {"refused": 20, "empty": 4}
    a = spark.createDataFrame(answers, "query string, pos int, engine string, urls array<string>, outcome string")
    out = admission.paced_sweep(spark.createDataFrame(requests, "request int, ts int, query string"), a, 5, 3, pauses, least).collect()
    assert sorted((x["request"], x["pos"], x["state"], x["wanted"], x["new_links"]) for x in out) == swept(requests, answers, 5, 3, pauses, least)
    assert len({x["state"] for x in out}) == 3


def test_a_sweep_broadcasts_no_table_of_visits(spark):
    """Visits are small as files and many as rows: none of their joins may bring them to the driver."""
    a = spark.createDataFrame([("q", pos, f"e{pos}", ["u1", "u2"], "ok") for pos in range(5)], "query string, pos int, engine string, urls array<string>, outcome string")
    requests = spark.range(40_000).select(F.col("id").alias("request"), (F.col("id") % 20_000).alias("ts"), F.lit("q").alias("query"))
    most = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(most, "3m")
    try:
        assert admission.paced_sweep(requests, a, 3, 2, {}, 1).count() == 200_000
    finally:
        spark.conf.unset(most)


def test_requests_of_a_second_meet_as_one(spark, monkeypatch):
    """However many searches come, a task of a sweep has no more of an engine's requests than its slice has seconds."""
    met, functions_of = [], admission.functions_of
    monkeypatch.setattr(admission, "functions_of", lambda rows, *more: met.append(rows.count()) or functions_of(rows, *more))
    a = spark.createDataFrame([("q", pos, f"e{pos}", ["u1", "u2"], "ok") for pos in range(3)], "query string, pos int, engine string, urls array<string>, outcome string")
    requests = spark.range(3000).select(F.col("id").alias("request"), (F.col("id") % 20).alias("ts"), F.lit("q").alias("query"))
    out = admission.paced_sweep(requests, a, 2, 5, {})
    assert out.where("state = 'asked'").count() == 3 * 4 and out.count() == 9000
    assert max(met) == 3 * 20
