"""Queries over observation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import observe as O
from ..sources import views as V
from ..sources.views import NOW_S, WINDOW_S
from .catalogue import query
from .views_sql import ENGINE_URLS, PROBES, READS

_IN = f"ts >= {NOW_S - WINDOW_S}"
_CONFIRMED = ("view", "click", "purchase")


def _window(spark: SparkSession, d: str, category: str | None = None) -> DataFrame:
    return O.in_window(V.probes(spark, d), NOW_S, WINDOW_S, category)


def _confirmed(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{q}')" for q in _CONFIRMED) + " AS t(query)")


@query(f"WITH {PROBES} SELECT id, ts, engine, verdict FROM probes WHERE {_IN} AND coalesce(category, 'general') = 'general'")
def scan_window(spark: SparkSession, d: str) -> DataFrame:
    return _window(spark, d, "general").select("id", "ts", "engine", "verdict")


_RATED = f"""
rated AS (
  SELECT engine, count(*) AS probes, CAST(sum(coalesce(hit, 0)) AS BIGINT) AS hits, sum(coalesce(hit, 0)) / count(*) AS share, sum(results) / count(*) AS links_avg
  FROM probes WHERE {_IN} AND coalesce(category, 'general') = 'general' GROUP BY engine HAVING count(*) >= 20
)"""


@query(f"WITH {PROBES}, {_RATED} SELECT * FROM rated ORDER BY share DESC, links_avg DESC, engine")
def rating(spark: SparkSession, d: str) -> DataFrame:
    return O.rating(_window(spark, d, "general")).orderBy(*O.by_rating())


_HEALTH = f"""
health AS (
  SELECT engine, count(*) AS probes, count_if(verdict = 'ok') AS ok, count_if(verdict = 'refused') AS refused, count_if(verdict = 'empty') AS empty,
         count_if(verdict = 'irrelevant') AS irrelevant, count_if(verdict = 'miss') AS miss, count_if(results > 0 AND relevant > 0) AS on_topic,
         count_if(hit = 1) AS hits, CAST(sum(latency) // count(latency) AS BIGINT) AS latency_avg, max(ts) AS last_ts
  FROM probes WHERE {_IN} GROUP BY engine
)"""


@query(f"WITH {PROBES}, {_HEALTH} SELECT * REPLACE (CAST(ok AS BIGINT) AS ok, CAST(refused AS BIGINT) AS refused, CAST(empty AS BIGINT) AS empty, CAST(irrelevant AS BIGINT) AS irrelevant, CAST(miss AS BIGINT) AS miss, CAST(on_topic AS BIGINT) AS on_topic, CAST(hits AS BIGINT) AS hits) FROM health")
def engine_health(spark: SparkSession, d: str) -> DataFrame:
    return O.health(_window(spark, d))


_TRUST = """
judged AS (
  SELECT engine, ts, hit, row_number() OVER (PARTITION BY engine ORDER BY ts DESC, id DESC) AS k
  FROM probes WHERE query IN ('view', 'click', 'purchase') AND hit IS NOT NULL AND results > 0 AND relevant > 0
), trust AS (
  SELECT engine, count(*) AS judged, CAST(sum(hit) AS BIGINT) AS hits, max(ts) - min(ts) AS span_s,
         CASE WHEN sum(hit) < count(*) THEN 'substitutes' WHEN count(*) >= 3 THEN 'clean' ELSE 'candidate' END AS trust
  FROM judged WHERE k <= 10 GROUP BY engine
)"""


@query(f"WITH {PROBES}, {_TRUST} SELECT * FROM trust")
def trust_last_n(spark: SparkSession, d: str) -> DataFrame:
    return O.trust(V.probes(spark, d), _confirmed(spark))


@query(f"""WITH {PROBES}, cold AS (SELECT *, engine || '/' || query || '/' || id % 40 AS path FROM probes),
never AS (SELECT path AS engine FROM cold GROUP BY path HAVING sum(CASE WHEN results > 0 AND relevant > 0 THEN 1 ELSE 0 END) = 0)
SELECT engine FROM never""")
def trust_unavailable(spark: SparkSession, d: str) -> DataFrame:
    """All probes; an engine's ways to ask stand for engines here, so that some never answered."""
    cold = V.probes(spark, d).withColumn("engine", F.concat_ws("/", "engine", "query", (F.col("id") % 40).cast("string")))
    return O.unavailable(cold)


@query(f"WITH {READS} SELECT url, path, id, ts, status FROM reads QUALIFY row_number() OVER (PARTITION BY url, path ORDER BY ts DESC, id DESC) = 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return O.latest(V.reads(spark, d), ["url", "path"]).select("url", "path", "id", "ts", "status")


@query(f"WITH {READS} SELECT url, path, id, ts, status FROM reads r WHERE ts = (SELECT max(ts) FROM reads m WHERE m.url = r.url AND m.path = r.path)")
def latest_per_key_join(spark: SparkSession, d: str) -> DataFrame:
    return O.latest_by_join(V.reads(spark, d), ["url", "path"]).select("url", "path", "id", "ts", "status")


_STATE = f"""
state AS (
  SELECT url, path, count(*) AS probes, CAST(sum(hit) AS BIGINT) AS hits, max(ts) AS last_ts, CAST(sum(latency) // count(*) AS BIGINT) AS latency_avg,
         arg_max(expected, ts * 1000000 + id) AS expected
  FROM reads WHERE {_IN} GROUP BY ALL
)"""


@query(f"""WITH {READS}, {_STATE}, last AS (SELECT url, path, arg_max(status, ts * 1000000 + id) AS last_status FROM reads GROUP BY ALL)
SELECT state.*, coalesce(last_status, '') AS last_status FROM state LEFT JOIN last USING (url, path)""")
def reading_state(spark: SparkSession, d: str) -> DataFrame:
    return O.reading_state(V.reads(spark, d), NOW_S, WINDOW_S)


@query(f"WITH {READS}, {_STATE} SELECT path, CAST(sum(probes) AS BIGINT) AS probes, CAST(sum(hits) AS BIGINT) AS hits, CASE WHEN sum(hits) > 0 THEN 'alive' ELSE 'unconfirmed' END AS state FROM state GROUP BY path")
def path_alive(spark: SparkSession, d: str) -> DataFrame:
    return O.path_alive(O.reading_state(V.reads(spark, d), NOW_S, WINDOW_S))


@query(f"WITH {PROBES} SELECT DISTINCT coalesce(category, 'general') AS category FROM probes")
def distinct_categories(spark: SparkSession, d: str) -> DataFrame:
    return V.probes(spark, d).select(F.coalesce("category", F.lit("general")).alias("category")).distinct()


_PAIRS = """
urls AS (SELECT DISTINCT engine, query, url FROM engine_urls),
own AS (SELECT engine, query, count(*) AS n FROM urls GROUP BY ALL),
common AS (SELECT a.engine AS a, b.engine AS b, query, count(*) AS c FROM urls a JOIN urls b USING (query, url) WHERE a.engine <> b.engine GROUP BY ALL),
pairs AS (
  SELECT x.engine AS a, y.engine AS b, count(*) AS queries, CAST(sum(coalesce(c, 0) * 1000000 // x.n) AS BIGINT) AS sum_ppm
  FROM own x JOIN own y ON x.query = y.query AND x.engine <> y.engine LEFT JOIN common ON a = x.engine AND b = y.engine AND common.query = x.query
  WHERE x.n >= 5 GROUP BY ALL HAVING count(*) >= 3
)"""

#: The overlap of a family in these data, where no pair reaches the production value at the larger sizes.
_OVERLAP = 0.5

_FAMILIES = f"""
sizes AS (SELECT engine FROM urls GROUP BY engine HAVING count(*) >= 5 * count(DISTINCT query)),
close AS (SELECT a, b FROM pairs WHERE sum_ppm >= {_OVERLAP} * 1000000 * queries AND a IN (FROM sizes) AND b IN (FROM sizes)),
edges AS (SELECT a, b FROM close UNION SELECT b, a FROM close),
reach AS (SELECT engine AS a, engine AS b FROM (SELECT DISTINCT engine FROM urls) UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
families AS (SELECT a AS engine, min(b) AS family FROM reach GROUP BY a)"""


@query(f"WITH {ENGINE_URLS} SELECT engine, query, count(DISTINCT url) AS links FROM engine_urls GROUP BY ALL")
def engine_query_urls(spark: SparkSession, d: str) -> DataFrame:
    return O.query_urls(V.engine_urls(spark, d)).groupBy("engine", "query").agg(F.count(F.lit(1)).alias("links"))


@query(f"WITH {ENGINE_URLS}, {_PAIRS} SELECT a, b, queries, sum_ppm FROM pairs")
def containment_pairs(spark: SparkSession, d: str) -> DataFrame:
    return O.containment(O.query_urls(V.engine_urls(spark, d)))


@query(f"WITH RECURSIVE {ENGINE_URLS}, {_PAIRS}, {_FAMILIES} SELECT engine, family FROM families")
def engine_families(spark: SparkSession, d: str) -> DataFrame:
    return O.families(O.query_urls(V.engine_urls(spark, d)), _OVERLAP)


_SHARED = """
witness AS (SELECT query, url, count(DISTINCT engine) AS w FROM engine_urls GROUP BY ALL),
shared AS (SELECT engine, count(*) AS links, count_if(w >= 2) AS shared FROM (SELECT DISTINCT engine, query, url FROM engine_urls) JOIN witness USING (query, url) GROUP BY engine)"""


@query(f"WITH {ENGINE_URLS}, {_SHARED} SELECT engine, links, CAST(shared AS BIGINT) AS shared FROM shared")
def url_overlap(spark: SparkSession, d: str) -> DataFrame:
    return O.overlap(O.query_urls(V.engine_urls(spark, d)))


@query(f"""WITH {ENGINE_URLS} SELECT engine, count(*) AS links, CAST(sum(CASE WHEN w >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS shared_rows
FROM engine_urls JOIN (SELECT query, url, count(*) AS w FROM engine_urls GROUP BY ALL) USING (query, url) GROUP BY engine""")
def overlap_rowcount(spark: SparkSession, d: str) -> DataFrame:
    """The as-coded variant, which counts an engine's own repeated finds as witnesses."""
    urls = V.engine_urls(spark, d)
    w = urls.groupBy("query", "url").agg(F.count(F.lit(1)).alias("w"))
    return urls.join(w, ["query", "url"]).groupBy("engine").agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("w") >= 2).alias("shared_rows"))


_POOL = """
walk AS (
  SELECT rated.*, coalesce(family, engine) AS family, row_number() OVER (ORDER BY share DESC, links_avg DESC, engine) AS place,
         row_number() OVER (PARTITION BY coalesce(family, engine) ORDER BY share DESC, links_avg DESC, engine) AS fr
  FROM rated LEFT JOIN families USING (engine)
), entered AS (
  SELECT *, coalesce(sum(CASE WHEN fr <= 2 THEN 1 ELSE 0 END) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM walk
), pool AS (
  SELECT engine, family, probes, hits, CAST(place AS INTEGER) AS place, fr <= 2 AND before < 8 AS in_pool,
         CASE WHEN before >= 8 THEN 'by share' WHEN fr > 2 THEN 'family cap' ELSE '' END AS why_not
  FROM entered
)"""


def _pool(spark: SparkSession, d: str) -> DataFrame:
    family = O.families(O.query_urls(V.engine_urls(spark, d)), _OVERLAP)
    return O.breakdown(O.rating(_window(spark, d, "general")), family)


@query(f"WITH RECURSIVE {PROBES}, {_RATED}, {ENGINE_URLS}, {_PAIRS}, {_FAMILIES}, {_POOL} SELECT * FROM pool")
def pool_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return _pool(spark, d)


@query(f"""WITH RECURSIVE {PROBES}, {_RATED}, {ENGINE_URLS}, {_PAIRS}, {_FAMILIES}, {_POOL}, {_HEALTH}, {_TRUST}, {_SHARED}
SELECT health.engine, health.probes, CAST(ok AS BIGINT) AS ok, CAST(health.hits AS BIGINT) AS hits, coalesce(links, 0) AS links, CAST(coalesce(shared.shared, 0) AS BIGINT) AS shared, coalesce(trust, 'not_checked') AS trust,
       coalesce(in_pool, false) AS in_pool, coalesce(why_not, 'not rated') AS why_not
FROM health LEFT JOIN shared USING (engine) LEFT JOIN trust USING (engine) LEFT JOIN pool USING (engine)""")
def engine_health_full(spark: SparkSession, d: str) -> DataFrame:
    out = O.health(_window(spark, d)).select("engine", "probes", "ok", "hits")
    out = out.join(O.overlap(O.query_urls(V.engine_urls(spark, d))), "engine", "left")
    out = out.join(O.trust(V.probes(spark, d), _confirmed(spark)).select("engine", "trust"), "engine", "left")
    out = out.join(_pool(spark, d).select("engine", "in_pool", "why_not"), "engine", "left")
    return out.na.fill({"links": 0, "shared": 0, "trust": "not_checked", "in_pool": False, "why_not": "not rated"})


@query(f"""WITH {PROBES}, history AS (
  SELECT ts, id, category, engine || ',' || query AS engines FROM probes WHERE k % 10 = 0
), seeds(category, seed) AS (VALUES ('general', 'a,b'), ('images', 'c,d'), ('videos', 'e,f'))
SELECT s.category, coalesce((SELECT engines FROM history h WHERE coalesce(h.category, 'general') = s.category ORDER BY ts DESC, id DESC LIMIT 1), seed) AS engines,
       CASE WHEN EXISTS (SELECT 1 FROM history h WHERE coalesce(h.category, 'general') = s.category) THEN 'observation' ELSE 'seed' END AS source
FROM seeds s""")
def pool_latest(spark: SparkSession, d: str) -> DataFrame:
    history = V.probes(spark, d).where("k % 10 = 0").select("ts", "id", "category", F.concat_ws(",", "engine", "query").alias("engines"))
    seeds = spark.sql("SELECT * FROM VALUES ('general', 'a,b'), ('images', 'c,d'), ('videos', 'e,f') AS t(category, seed)")
    return O.latest_pool(history, seeds)


_DUE_AT = 5 * 86400


@query(f"""WITH {PROBES}, engines AS (SELECT DISTINCT engine FROM probes UNION SELECT 'e_new'),
early AS (SELECT engine, max(ts) AS last_ts FROM probes WHERE ts < {_DUE_AT} AND k < 3 GROUP BY engine)
SELECT engine, {_DUE_AT} - last_ts AS idle_s FROM engines LEFT JOIN early USING (engine) WHERE last_ts IS NULL OR {_DUE_AT} - last_ts >= 86400""")
def due_engines(spark: SparkSession, d: str) -> DataFrame:
    p = V.probes(spark, d)
    engines = p.select("engine").union(spark.sql("SELECT 'e_new'")).distinct()
    return O.due(p.where((F.col("ts") < _DUE_AT) & (F.col("k") < 3)), engines, _DUE_AT)


@query(f"""WITH {PROBES}, engines AS (SELECT engine, row_number() OVER (ORDER BY engine) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT engine FROM probes))
SELECT tick, engine, CAST(tick // n % 4 AS BIGINT) AS reference FROM range(100) r(tick) JOIN engines ON i = tick % n""")
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    return O.round_robin(V.probes(spark, d).select("engine").distinct(), 4, 100)


@query(f"""WITH {PROBES}, firsts AS (SELECT 'c' || (id % 9 * k % 71) AS client, min(ts * 1000000 + id) AS f, count(*) AS calls FROM probes GROUP BY 1)
SELECT CASE WHEN place <= 50 THEN client ELSE 'other' END AS client, CAST(sum(calls) AS BIGINT) AS calls
FROM (SELECT *, row_number() OVER (ORDER BY f) AS place FROM firsts) GROUP BY 1""")
def bounded_counters(spark: SparkSession, d: str) -> DataFrame:
    calls = V.probes(spark, d).select("id", "ts", F.concat(F.lit("c"), (F.col("id") % 9 * F.col("k") % 71).cast("string")).alias("client"))
    return O.bounded_keys(calls, "client", 50)


@query(f"""WITH {PROBES} SELECT count(*) AS calls, CAST(count_if(k % 2 = 0) AS BIGINT) AS searches, CAST(count_if(k % 2 = 0 AND relevant >= 2) AS BIGINT) AS corroborated,
count_if(k % 2 = 0 AND relevant >= 2) / nullif(count_if(k % 2 = 0), 0) AS share, max(ts) AS last_call FROM probes""")
def call_stats(spark: SparkSession, d: str) -> DataFrame:
    p = V.probes(spark, d)
    search = F.col("k") % 2 == 0
    out = p.agg(F.count(F.lit(1)).alias("calls"), F.count_if(search).alias("searches"), F.count_if(search & (F.col("relevant") >= 2)).alias("corroborated"), F.max("ts").alias("last_call"))
    return out.withColumn("share", F.try_divide("corroborated", "searches"))




@query(f"""WITH {PROBES} SELECT id, CASE WHEN k = 99 THEN 'error' WHEN query = 'error' AND results = 0 THEN 'refused' WHEN results = 0 THEN 'empty'
  WHEN relevant = 0 THEN 'irrelevant' WHEN coalesce(hit, 0) = 0 THEN 'miss' ELSE 'ok' END AS verdict FROM probes""")
def probe_verdict(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.verdicts import probe_verdict as verdict

    c = F.col
    return V.probes(spark, d).select("id", verdict(c("k") == 99, c("query") == "error", c("results"), c("relevant") > 0, c("hit") == 1).alias("verdict"))


@query(f"""WITH {PROBES} SELECT id, CASE WHEN k = 99 THEN 'error' WHEN query = 'error' AND results = 0 THEN 'refused' WHEN results = 0 THEN 'empty'
  WHEN coalesce(hit, 0) = 0 THEN 'miss' ELSE 'ok' END AS verdict FROM probes WHERE category = 'images'""")
def probe_verdict_images(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.verdicts import probe_verdict as verdict

    c = F.col
    images = V.probes(spark, d).where("category = 'images'")
    return images.select("id", verdict(c("k") == 99, c("query") == "error", c("results"), F.lit(True), c("hit") == 1).alias("verdict"))


@query(f"""WITH {READS} SELECT id, (status = expected AND (chars % 700 <> 0 OR chars % 300 = 0) AND chars >= 1000) AS hit FROM reads""")
def read_probe_hit(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.verdicts import read_hit

    c = F.col
    marker = F.when(c("chars") % 300 != 0, c("chars") % 700 != 0)  # no marker asked for: null
    return V.reads(spark, d).select("id", read_hit(c("status"), c("expected"), marker, F.array(c("chars") >= 1000)).alias("hit"))


@query(f"""WITH {PROBES}, refs(query, expect) AS (VALUES ('view', ['view.org', 'v.com']), ('click', ['click.org']), ('purchase', ['buy.com', 'purchase.org']))
SELECT id, CASE k % 4 WHEN 0 THEN query || '.org' WHEN 1 THEN 'www.' || query || '.org' WHEN 2 THEN 'not' || query || '.org' ELSE 'x.v.com' END AS domain,
  coalesce(list_bool_or([CASE k % 4 WHEN 0 THEN query || '.org' WHEN 1 THEN 'www.' || query || '.org' WHEN 2 THEN 'not' || query || '.org' ELSE 'x.v.com' END = e
   OR ends_with(CASE k % 4 WHEN 0 THEN query || '.org' WHEN 1 THEN 'www.' || query || '.org' WHEN 2 THEN 'not' || query || '.org' ELSE 'x.v.com' END, '.' || e) for e in expect]), false) AS hit
FROM probes JOIN refs USING (query)""")
def reference_hit(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.urls import domain_matches

    refs = spark.sql("SELECT * FROM VALUES ('view', array('view.org', 'v.com')), ('click', array('click.org')), ('purchase', array('buy.com', 'purchase.org')) AS t(query, expect)")
    k = F.col("k") % 4
    found = F.when(k == 0, F.concat("query", F.lit(".org"))).when(k == 1, F.concat(F.lit("www."), "query", F.lit(".org"))).when(k == 2, F.concat(F.lit("not"), "query", F.lit(".org"))).otherwise("x.v.com")
    rows = V.probes(spark, d).join(refs, "query").withColumn("domain", found)
    return rows.select("id", "domain", domain_matches(F.col("domain"), F.col("expect")).alias("hit"))
