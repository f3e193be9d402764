"""Pools over time, schedules, and their streaming twins, against plain loops."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_admission import cached, swept

from gleanwise.operators import history
from gleanwise.operators.admission import cache_replay
from gleanwise.plans import QUERIES, states
from gleanwise.sources import views as V
from gleanwise.streaming import twins

ZONE = 0.10


def probes_of(n, good):
    return [(k < good) for k in range(n)]


def test_three_phases_of_a_pool(spark):
    """A first pool; a gain within the dead zone changes nothing; a clear one displaces, and the reason names whom; what was
    taken out by a bad run comes back when it is forgotten."""
    rows = []
    for snapshot, changes in enumerate([{}, {"e8": (200, 160)}, {"e8": (200, 160), "e7": (400, 84)}, {"e0": (500, 90)}, {}]):
        counts = {f"e{i}": (100, 98 - 3 * i) for i in range(9)} | changes
        rows += [("general", snapshot, e, hit, 5) for e, (n, good) in counts.items() for hit in probes_of(n, good)]
    probes = spark.createDataFrame([(c, s * 10 + 1, e, int(h), r) for c, s, e, h, r in rows], "category string, ts bigint, engine string, hit int, results int")
    got = {r["snapshot"]: r for r in history.pool_history(history.snapshots(probes, 10, 1, 20)).collect()}
    assert got[1]["engines"] == [f"e{i}" for i in range(8)] and got[1]["reason"].startswith("first: e0 0.98")
    assert "e8" not in got[2]["engines"] and got[2]["reason"] == ""
    assert "e8" in got[3]["engines"] and got[3]["reason"] == "e8 0.80 displaced e7 0.21 (by share) by 0.59"
    assert "e0" not in got[4]["engines"] and "displaced e0" in got[4]["reason"]
    assert "e0" in got[5]["engines"]


def loop_of_pools(rows, slide, panes, least):
    """rows: (category, ts, engine, hit, results)."""
    out, pools = [], {}
    last = max(r[1] for r in rows) // slide + panes
    for snapshot in range(1, last + 1):
        of = defaultdict(list)
        for c, ts, e, hit, results in rows:
            if (snapshot - panes) * slide <= ts < snapshot * slide:
                of[c or "general", e].append((hit or 0, results or 0))
        for category in sorted({c for c, _ in of}):
            told = {e: x for (c, e), x in of.items() if c == category and len(x) >= least}
            if not told:
                continue
            share = {e: sum(h for h, _ in x) / len(x) for e, x in told.items()}
            wanted = sorted(told, key=lambda e: (-share[e], -sum(r for _, r in told[e]) / len(told[e]), e))[:8]
            now = pools.get(category)
            if now is None:
                pool, kind = wanted, "first"
            else:
                pool, kind = list(now), ""
                for engine in wanted:
                    stale = [e for e in pool if e not in wanted]
                    if engine in now or not stale:
                        continue
                    worst = min(stale, key=lambda e: share.get(e, -1.0))
                    if share[engine] - share.get(worst, -1.0) >= ZONE:
                        pool[pool.index(worst)] = engine
                        kind = "swap"
                pool = sorted(pool, key=lambda e: -share.get(e, 0.0))
                kind = kind if kind or pool == now else "order"
            pools[category] = pool
            out.append((category, snapshot, ",".join(pool), kind))
    return sorted(out)


def kinds(rows):
    kind = lambda r: "first" if r.startswith("first") else "swap" if "displaced" in r else r
    return sorted((r["category"], r["snapshot"], r["engines"], kind(r["reason"])) for r in rows)


@pytest.fixture(scope="module")
def probed(spark, folder):
    rows = V.probes(spark, folder).select("category", "ts", "engine", "hit", "results").collect()
    return loop_of_pools([tuple(r) for r in rows], states._SLIDE, states._PANES, states._LEAST)


def test_pool_history_is_the_loop(spark, folder, probed):
    assert kinds(QUERIES["pool_history"](spark, folder).collect()) == probed
    rated = history.snapshots(V.probes(spark, folder), states._SLIDE, states._PANES, states._LEAST)
    assert kinds(history.pool_history(rated, chunk=7).withColumn("engines", F.array_join("engines", ",")).collect()) == probed
    assert history.pool_history(rated.where("false")).count() == 0


def test_pools_of_a_stream(spark, folder, probed):
    """A stream keeps the pools of all snapshots that have ended; a batch that comes again leaves the same."""
    latest = V.probes(spark, folder).agg(F.max("ts")).first()[0] // states._SLIDE
    got = QUERIES["stream_pools"](spark, folder)
    assert kinds(got.collect()) == [x for x in probed if x[1] <= latest]


def test_a_batch_again(spark, tmp_path):
    rated = spark.createDataFrame([("g", s, f"e{k}", 0.5 - k / 10 + s / 100, k + 1, True, "") for s in (1, 2) for k in range(3)], "category string, snapshot bigint, engine string, share double, place int, wanted boolean, why_not string")
    path = f"{tmp_path}/pools"
    for number, snapshot in ((0, 1), (1, 2), (1, 2), (0, 1)):
        history.keep_pools(rated.where(F.col("snapshot") == snapshot), number, path)
    rows = history.read_pools(spark, path).orderBy("snapshot").collect()
    assert [(r["snapshot"], r["engines"], r["reason"][:5]) for r in rows] == [(1, ["e0", "e1", "e2"], "first"), (2, ["e0", "e1", "e2"], "")]


def test_schedule_is_the_loop(spark):
    r = random.Random(2)
    ticks = [(i, r.randint(0, 3000)) for i in range(700)]
    rare = {"x": None, "b": 100, "c": 0, "d": 5000}
    engines, last, i, want = [f"e{k}" for k in range(5)], {k: v for k, v in rare.items()}, 0, []
    for tick, ts in sorted(ticks, key=lambda t: (t[1], t[0])):
        due = next((name for name in sorted(rare) if last[name] is None or ts - last[name] >= 300), None)
        want.append((tick, ts, due or engines[i % 5], due is not None, i // 5 % 3))
        if due:
            last[due] = ts
        else:
            i += 1
    df = spark.createDataFrame(ticks, "id int, ts bigint")
    got = history.schedule(df, engines, rare, 3, 300, block=500).collect()
    assert sorted((x["id"], x["ts"], x["engine"], x["jumped"], x["reference"]) for x in got) == sorted(want)
    assert history.schedule(df, engines, {}, 3).where("jumped").count() == 0


def test_cache_evict(spark, folder):
    rows = [(r["engine"], r["k"] % 40, r["ts"], r["id"]) for r in V.probes(spark, folder).collect()]
    got = QUERIES["cache_evict"](spark, folder).collect()
    assert len(got) == len(rows) and {r["id"] for r in got if r["hit"]} == cached(rows, 6 * 3600, 8)


def test_sweep_paced(spark, folder):
    requests, answers = states._searches(spark, folder)
    requests = [tuple(r) for r in requests.collect()]
    answers = [(r["query"], r["pos"], r["engine"], r["urls"], r["outcome"]) for r in answers.collect()]
    want = swept([r for r in requests if r[2] in {a[0] for a in answers}], answers, states.N_LINKS, 900, states._PAUSES, None)
    got = QUERIES["sweep_paced"](spark, folder).collect()
    assert sorted((x["request"], x["pos"], x["state"], x["wanted"], x["new_links"]) for x in got) == want


@pytest.fixture(scope="module")
def arrived(spark, folder, tmp_path_factory):
    """The events in six files, the later ones with earlier events too."""
    path = str(tmp_path_factory.mktemp("stream"))
    events = spark.read.parquet(f"{folder}/events.parquet")
    events.repartition(6, F.col("event_id") % 11).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("files", [1, 2, 1000])
def test_sliding_windows_and_late_rows(spark, arrived, files):
    """What was on time is in all its windows; what was late is in the table of late rows; nothing is lost."""
    told, panes = twins.sliding(spark, arrived, late=5 * 86_400, files=files)
    probes = V.probes(spark, arrived).collect()
    late = {r["id"] for r in panes.late_rows().collect()}
    assert bool(late) == (files < 1000)
    want = Counter()
    for r in probes:
        if r["id"] not in late:
            for slide in range(r["ts"] // 1800 + 1, r["ts"] // 1800 + 49):
                want[r["engine"], slide, "probes"] += 1
                want[r["engine"], slide, "ok"] += r["verdict"] == "ok"
                want[r["engine"], slide, "hits"] += r["hit"] == 1
    got = {(r["engine"], r["slide"], c): r[c] for r in told.collect() for c in ("probes", "ok", "hits")}
    assert {k: n for k, n in got.items() if n} == {k: n for k, n in want.items() if n}


def test_sessions_merge_over_batches(spark, folder, tmp_path):
    """Files in order of time, but for half a day's disorder that the watermark allows: one batch or many give the same sessions."""
    days = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") + F.pmod(F.xxhash64("event_id"), F.lit(43_200))
    events = spark.read.parquet(f"{folder}/events.parquet").withColumn("file", F.floor(days / (6 * 86_400)))
    for k in range(7):
        events.where(F.col("file") == k).drop("file").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    one = sorted(map(str, twins.sessions(spark, str(tmp_path), gap="3 hours", late="1 day").collect()))
    assert len(one) > 100 and one == sorted(map(str, twins.sessions(spark, str(tmp_path), gap="3 hours", late="1 day", files=1).collect()))


def test_cache_of_a_stream(spark, folder, tmp_path):
    """Files in order of time, each a batch of its own: state and timers give what one batch gives."""
    events = spark.read.parquet(f"{folder}/events.parquet").withColumn("file", F.floor(F.dayofmonth("ts") / 5))
    for k in range(7):
        events.where(F.col("file") == k).drop("file").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    page = lambda df: df.select(F.concat_ws("/", "engine", (F.col("k") % 3).cast("string")).alias("page"), "id", "ts")
    at, want = {}, set()
    for r in sorted(page(V.probes(spark, str(tmp_path))).collect(), key=lambda r: (r["ts"], r["id"])):
        if r["page"] in at and r["ts"] - at[r["page"]] < 40_000:
            want.add(r["id"])
        else:
            at[r["page"]] = r["ts"]
    for files in (1, 1000):
        got = twins.cache(page(twins.probe_stream(spark, str(tmp_path), files)), 40_000).collect()
        assert len(got) == events.count() and {r["id"] for r in got if r["hit"]} == want


def test_cache_of_a_stream_from_its_first_second(spark, folder, tmp_path):
    """Requests of second 0 and before it are no later than a stream's first watermark, and count as others."""
    first = F.expr("TIMESTAMP_NTZ'2023-12-31 23:59:50.5' + make_dt_interval(0, 0, 0, event_id % 20)")
    spark.read.parquet(f"{folder}/events.parquet").limit(200).withColumn("ts", first).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    requests = lambda df: df.select(F.concat_ws("/", "engine", (F.col("k") % 3).cast("string")).alias("page"), "id", "ts")
    want = cache_replay(requests(V.probes(spark, str(tmp_path))), "page", 5)
    got = twins.cache(requests(twins.probe_stream(spark, str(tmp_path))), 5)
    assert got.count() == 200 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rare_engines_walk_one_tick_a_second(spark, monkeypatch):
    """Many ticks in a second are one row for a rare engine's walk, with the schedule of all ticks."""
    seen, walk = [], history.admitted
    monkeypatch.setattr(history, "admitted", lambda asked, *a, **k: (seen.append(asked.count()), walk(asked, *a, **k))[1])
    ticks = spark.range(2000).select("id", F.floor(F.col("id") / 50).alias("ts"))
    got = {r["id"] for r in history.schedule(ticks, ["a", "b"], {"r": None, "s": -3}, 2, every=7).where("jumped").collect()}
    assert max(seen) <= 41
    left, want = list(range(2000)), set()
    for free in (0, 4):
        for i in list(left):
            if i // 50 >= free:
                free = i // 50 + 7
                want.add(i)
                left.remove(i)
    assert got == want
