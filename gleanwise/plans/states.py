"""Queries with a memory, streaming twins, and extensions that the original service has no counterpart of (ext_*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import admission as A
from ..operators import history as H
from ..operators import observe as O
from ..operators import state as S
from ..sources import views as V
from ..streaming import twins
from .catalogue import query
from .observations import _CONFIRMED, _TRUST
from .views_sql import PROBES

# Admitted requests in SQL: from each key's first, jump to the next that is late enough.
_JUMPS = """
r AS (SELECT *, row_number() OVER (PARTITION BY engine ORDER BY ts, id) AS n, {wait} AS wait FROM probes),
jumps AS (SELECT engine, n, ts, wait FROM r WHERE n = 1 UNION ALL SELECT engine, x.n, x.ts, x.wait FROM jumps j, LATERAL (SELECT n, ts, wait FROM r WHERE r.engine = j.engine AND r.ts >= j.ts + j.wait AND r.n > j.n ORDER BY n LIMIT 1) x)"""

#: Links that a search wants.
N_LINKS = 25

#: The views' probes are an hour apart, not a second: pauses are as much longer.
_PAUSES = {k: 240 * v for k, v in A.PAUSES.items()}


@query(f"WITH RECURSIVE {PROBES}, {_JUMPS.format(wait=3600)} SELECT engine, id, EXISTS (SELECT 1 FROM jumps j WHERE j.engine = r.engine AND j.n = r.n) AS admitted FROM r")
def pacing_admit(spark: SparkSession, d: str) -> DataFrame:
    return A.admitted(V.probes(spark, d), "engine", 3600)


@query(f"""WITH RECURSIVE {PROBES}, {_JUMPS.format(wait="CASE WHEN verdict IN ('refused', 'irrelevant') THEN 28800 WHEN verdict = 'empty' THEN 1200 ELSE 900 END")}
SELECT engine, id, verdict, EXISTS (SELECT 1 FROM jumps j WHERE j.engine = r.engine AND j.n = r.n) AS admitted FROM r""")
def cooldown_admit(spark: SparkSession, d: str) -> DataFrame:
    """Pace and cooldown: a refusal or a substitution blocks an engine for long, an empty answer briefly."""
    probes = V.probes(spark, d)
    told = A.admitted(probes, "engine", 900, _PAUSES, "verdict")
    return told.join(probes.select("id", "verdict"), "id").select("engine", "id", "verdict", "admitted")


@query(f"WITH RECURSIVE {PROBES}, {_JUMPS.format(wait=7200)} SELECT engine, id, NOT EXISTS (SELECT 1 FROM jumps j WHERE j.engine = r.engine AND j.n = r.n) AS hit FROM r")
def cache_replay(spark: SparkSession, d: str) -> DataFrame:
    return A.cache_replay(V.probes(spark, d), "engine", 7200)


@query()
def cache_evict(spark: SparkSession, d: str) -> DataFrame:
    """A cache for each engine that holds eight pages for six hours; the oldest store leaves."""
    requests = V.probes(spark, d).withColumn("page", F.col("k") % 40)
    return A.cache_evict(requests, "engine", "page", 6 * 3600, 8)


def _searches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Searches, one for each event, and what each engine answers to each question."""
    answers = V.responses(spark, d).groupBy("query", "pos", "engine").agg(F.sort_array(F.collect_list(F.struct("rank", "url")))["url"].alias("urls"))
    outcome = F.when(F.col("pos") == 2, "refused").when((F.col("pos") == 5) & F.col("query").contains("HIGH"), "irrelevant").when((F.col("pos") == 7) | (F.size("urls") == 0), "empty").otherwise("ok")
    urls = F.when(outcome == "ok", F.col("urls")).otherwise(F.array().cast("array<string>"))
    questions = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    requests = V.probes(spark, d).select(F.col("id").alias("request"), "ts", F.get(questions, F.pmod(F.col("k"), F.lit(5))).alias("query"))
    return requests, answers.select("query", "pos", "engine", urls.alias("urls"), outcome.alias("outcome"))


@query()
def sweep_paced(spark: SparkSession, d: str) -> DataFrame:
    """Searches that skip engines which may not be asked now."""
    requests, answers = _searches(spark, d)
    return A.paced_sweep(requests, answers, N_LINKS, 900, _PAUSES)


_SLIDE, _PANES, _LEAST = 43_200, 10, 5


@query()
def pool_history(spark: SparkSession, d: str) -> DataFrame:
    """The pools of both categories at half-day steps, over five days each."""
    rated = H.snapshots(V.probes(spark, d), _SLIDE, _PANES, _LEAST)
    return H.pool_history(rated).withColumn("engines", F.array_join("engines", ","))


_RARE_JUMPS = """
{name}_r AS (SELECT id, ts, row_number() OVER (ORDER BY ts, id) AS n FROM {left}),
{name}_j AS (SELECT n, ts FROM {name}_r WHERE n = (SELECT min(n) FROM {name}_r WHERE ts >= {since}) UNION ALL SELECT x.n, x.ts FROM {name}_j j, LATERAL (SELECT n, ts FROM {name}_r r WHERE r.ts >= j.ts + 86400 ORDER BY n LIMIT 1) x),
{name}_t AS (SELECT id FROM {name}_r JOIN {name}_j USING (n)),
{name}_left AS (SELECT id, ts FROM {left} ANTI JOIN {name}_t USING (id))"""


@query(f"""WITH RECURSIVE {PROBES}, {_RARE_JUMPS.format(name="r1", left="probes", since=0)}, {_RARE_JUMPS.format(name="r2", left="r1_left", since=5 * 86400 + 86400)},
told AS (SELECT id, ts, CASE WHEN id IN (FROM r1_t) THEN 'rare1' WHEN id IN (FROM r2_t) THEN 'rare2' END AS rare FROM probes),
placed AS (SELECT *, coalesce(sum(CASE WHEN rare IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS i FROM told)
SELECT id, ts, coalesce(rare, 'e' || i % 7) AS engine, rare IS NOT NULL AS jumped, i // 7 % 4 AS reference FROM placed""")
def rare_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Each probe's time is a tick; two rare engines, one of them probed on the fifth day."""
    return H.schedule(V.probes(spark, d).select("id", "ts"), [f"e{k}" for k in range(7)], {"rare1": None, "rare2": 5 * 86400}, 4)


@query()
def pool_recompute(spark: SparkSession, d: str) -> DataFrame:
    """The pools of both categories, recomputed from what was asked before: general has a pool with two stale engines, images none."""
    probes = O.in_window(V.probes(spark, d), V.NOW_S, V.WINDOW_S).withColumn("category", F.coalesce("category", F.lit("general")))
    out = None
    for category in ("general", "images"):
        rated = O.rating(probes.where(F.col("category") == category), 5)
        alone = rated.select("engine", F.col("engine").alias("family"))
        placed = O.breakdown(rated, alone).join(rated.select("engine", "share"), "engine").select(F.lit(category).alias("category"), "engine", "share", "place", "in_pool")
        out = placed if out is None else out.unionByName(placed)
    current = spark.sql("SELECT 'general' AS category, array('e11', 'e10', 'e3', 'e2', 'e1', 'e5', 'e6', 'e7') AS engines")
    return S.recomputed(out, current)


_LEDGER = "SELECT event_id AS n, event_type AS model, user_id AS tin, CAST(floor(value) AS BIGINT) AS tout FROM events"


@query(f"""WITH l AS ({_LEDGER}), g AS (SELECT CASE WHEN n % 19 > 0 THEN model END AS model, CASE WHEN n % 19 > 0 THEN tin ELSE 0 END AS tin, CASE WHEN n % 19 > 0 THEN tout ELSE 0 END AS tout, CASE WHEN n % 19 > 0 AND n % 3 = 0 AND model <> 'view' THEN n % 10 END AS cached FROM l)
SELECT model, count(*) AS calls, CAST(sum(tin) AS BIGINT) AS tokens_in, CAST(sum(tout) AS BIGINT) AS tokens_out, CAST(coalesce(sum(cached), 0) AS BIGINT) AS cached, count(cached) > 0 AS cached_reported, (sum(tin) * 2.0::DOUBLE + sum(tout) * 8.0::DOUBLE) / 1000 AS cost FROM g GROUP BY model""")
def ledger_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Spend by model from JSON lines, one in nineteen of them broken."""
    n = F.col("event_id")
    cached = F.when((n % 3 == 0) & (F.col("event_type") != "view"), n % 10)
    record = F.struct(n.alias("ts"), F.lit("p").alias("provider"), F.col("event_type").alias("model"), F.col("user_id").alias("in"), F.floor("value").alias("out"), cached.alias("cached"))
    line = F.when(n % 19 > 0, F.to_json(record)).otherwise('{"ts": 1, "model": "cut o')
    return S.ledger(V.read(spark, d, "events").select(line.alias("value")), 2.0, 8.0)


@query("SELECT user_id AS account, count(*) AS calls, CAST(sum(floor(value)) AS BIGINT) AS tokens, bool_and(event_id % 97 <> 0) AS ledger_written FROM events GROUP BY 1")
def usage_account(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    calls = V.read(spark, d, "events").select(F.col("user_id").alias("account"), F.floor("value").alias("tokens"), F.when(n % 194 > 0, n % 97 != 0).alias("written"))
    return S.usage(calls, "account")


@query(f"WITH {PROBES} SELECT id, ts, engine, verdict FROM probes")
def stream_probes(spark: SparkSession, d: str) -> DataFrame:
    return twins.appended(spark, d)


@query(f"WITH {PROBES} SELECT engine, count(*) AS probes, CAST(count_if(verdict = 'ok') AS BIGINT) AS ok, CAST(count_if(hit = 1) AS BIGINT) AS hits FROM probes GROUP BY engine")
def stream_health(spark: SparkSession, d: str) -> DataFrame:
    return twins.health(spark, d)


@query(f"WITH {PROBES}, {_TRUST} SELECT engine, judged, hits, trust FROM trust")
def stream_trust(spark: SparkSession, d: str) -> DataFrame:
    return twins.trust(spark, d, _CONFIRMED)


_PAGES = PROBES + ", pages0 AS (SELECT * REPLACE (engine || '/' || k % 40 AS engine) FROM probes)"


@query(f"WITH RECURSIVE {_PAGES}, {_JUMPS.format(wait=7200).replace('FROM probes', 'FROM pages0')} SELECT engine AS page, id, NOT EXISTS (SELECT 1 FROM jumps j WHERE j.engine = r.engine AND j.n = r.n) AS hit FROM r")
def stream_cache(spark: SparkSession, d: str) -> DataFrame:
    """A cache of pages on a stream: values with a time to live, forgotten by timers."""
    requests = twins.probe_stream(spark, d).select(F.concat_ws("/", "engine", (F.col("k") % 40).cast("string")).alias("page"), "id", "ts")
    return twins.cache(requests, 7200)


@query(f"""WITH {PROBES}, p AS (SELECT engine, ts // 1800 AS pane, count(*) AS probes, count(*) FILTER (verdict = 'ok') AS ok, count(*) FILTER (hit = 1) AS hits FROM probes GROUP BY ALL)
SELECT engine, pane + i AS slide, CAST(sum(probes) AS BIGINT) AS probes, CAST(sum(ok) AS BIGINT) AS ok, CAST(sum(hits) AS BIGINT) AS hits FROM p, range(1, 49) r(i) GROUP BY ALL""")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Health over the last day at each half hour, by panes."""
    return twins.sliding(spark, d)[0]


@query(f"""WITH {PROBES}, s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY engine ORDER BY ts, id) <= 1800 THEN 0 ELSE 1 END AS new FROM probes),
n AS (SELECT *, sum(new) OVER (PARTITION BY engine ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS session FROM s)
SELECT engine, min(ts) AS start, max(ts) - min(ts) AS seconds, count(*) AS n FROM n GROUP BY engine, session HAVING max(ts) + 1800 <= (SELECT max(ts) FROM probes) - 3600""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that the watermark, an hour behind the latest probe, has passed."""
    return twins.sessions(spark, d)


@query("""SELECT b * 21600 AS start, event_type, count(*) AS n FROM (SELECT (epoch_us(ts) - 1704067200000000) // 21600000000 AS b, event_type FROM events)
WHERE (b + 1) * 21600 <= (SELECT (max(epoch_us(ts)) - 1704067200000000) // 1000 / 1000.0 - 3600 FROM events) GROUP BY ALL""")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Events by windows of six hours that the watermark has passed."""
    told = twins.tumbling(spark, d)
    return told.select((F.unix_timestamp("start") - 1704067200).alias("start"), "event_type", "n")


@query()
def stream_pools(spark: SparkSession, d: str) -> DataFrame:
    """The pools of pool_history, kept by a stream."""
    return twins.pools(spark, d, _SLIDE, _PANES, _LEAST).withColumn("engines", F.array_join("engines", ","))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("SELECT (epoch_us(ts) - 1704067200000000) // 21600000000 AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL")
def ext_tumbling(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return V.read(spark, d, "events").groupBy(F.floor(seconds / 21600).alias("bucket"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PROBES}, s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY engine ORDER BY ts, id) <= 1800 THEN 0 ELSE 1 END AS new FROM probes),
n AS (SELECT *, sum(new) OVER (PARTITION BY engine ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS session FROM s)
SELECT engine, CAST(session AS BIGINT) AS session, count(*) AS n, max(ts) - min(ts) AS seconds FROM n GROUP BY ALL""")
def ext_session(spark: SparkSession, d: str) -> DataFrame:
    rows = H.sessions(V.probes(spark, d).select("engine", "ts", "id"), "engine", 1800)
    return rows.groupBy("engine", "session").agg(F.count(F.lit(1)).alias("n"), (F.max("ts") - F.min("ts")).alias("seconds"))
