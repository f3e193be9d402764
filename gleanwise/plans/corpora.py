"""Queries over documents as the pages of a corpus, one question for each source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import corpus as C
from ..sources import views as V
from .catalogue import query
from .views_sql import SOURCES

#: Markers of the questions: words of the corpus.
_MARKERS = ("the", "and", "enau")


def _markers(n: int = 3) -> Column:
    return F.array(*map(F.lit, _MARKERS[:n]))


@query("SELECT doc_id AS id, strpos(lower(text), 'the') > 0 AND strpos(lower(text), 'and') > 0 AND abs(strpos(lower(text), 'the') - strpos(lower(text), 'and')) <= 50 AS together FROM documents")
def markers_together(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "documents").select(F.col("doc_id").alias("id"), T.markers_together(F.col("text"), _markers(2), 50).alias("together"))


@query("""WITH a AS (SELECT item_id AS id, unnest(range(1, length(text) + 1)) AS i, text FROM benchmark), p AS (SELECT id, i FROM a WHERE substr(text, i, 2) = 'th'), q AS (SELECT id, i FROM a WHERE substr(text, i, 3) = 'and')
SELECT item_id AS id, EXISTS (SELECT 1 FROM p JOIN q USING (id) WHERE p.id = item_id AND abs(p.i - q.i) <= 6) AS near FROM benchmark""")
def near_each_other(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "benchmark").select(F.col("item_id").alias("id"), T.near_each_other(F.col("text"), F.lit("th"), F.lit("and"), 6).alias("near"))


def _dated(spark: SparkSession, d: str) -> DataFrame:
    """Pages with dates in words and in ISO form, near and far from the marker."""
    n = F.col("id")
    far = F.repeat(F.lit("x "), 200)
    head = F.concat(F.lit("Kimi: "), (n % 2 + 20).cast("string"), F.lit(" апреля 2026. "), far, F.lit(" 2026-01-0"), (n % 3 + 1).cast("string"), F.lit(" ."))
    iso = F.concat(F.lit("О kimi 2026-05-1"), (n % 2).cast("string"), F.lit(" и 7 Мая 2025 года, 3 марта 1999; "))
    text = F.when(n % 3 == 0, head).when(n % 3 == 1, iso).otherwise("5 июня 2020, no marker")
    return V.sources(spark, d).withColumn("text", text).withColumn("chars", F.length("text").cast("bigint"))


_DATES = """
dated AS (
  SELECT question, id, url, unnest(CASE id % 3 WHEN 0 THEN ['2026-04-' || (id % 2 + 20)] WHEN 1 THEN ['2026-05-1' || (id % 2), '2025-05-07', '1999-03-03'] ELSE [] END) AS value FROM sources
)"""


@query(f"WITH {SOURCES}, {_DATES} SELECT id, coalesce((SELECT string_agg(value, ',' ORDER BY value) FROM dated WHERE dated.id = sources.id), '') AS dates FROM sources")
def dates_near_markers(spark: SparkSession, d: str) -> DataFrame:
    return _dated(spark, d).select("id", F.array_join(T.dates_near(F.col("text"), F.array(F.lit("Kimi"))), ",").alias("dates"))


@query(f"""WITH {SOURCES}, {_DATES}, v AS (SELECT question, value, count(DISTINCT url) AS sources FROM dated GROUP BY ALL HAVING count(DISTINCT url) >= 2)
SELECT question, value, sources FROM v QUALIFY count(*) OVER (PARTITION BY question) >= 2 AND row_number() OVER (PARTITION BY question ORDER BY sources DESC, value) <= 4""")
def date_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return C.date_conflicts(_dated(spark, d), F.array(F.lit("Kimi")))


@query("SELECT p_partkey AS id, 'Tesla,K2.' || p_size || ',' || CASE WHEN p_partkey % 2 = 0 THEN 'Сберба' ELSE 'Москва' END AS markers FROM part")
def markers_from_question(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 2 == 0, "Сбербанк").otherwise("Москва")
    question = F.concat(F.lit("What did Tesla say of K2."), F.col("p_size").cast("string"), F.lit(" and the "), name, F.lit("?"))
    return V.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(T.markers_from_question(question), ",").alias("markers"))


@query()
def marker_window(spark: SparkSession, d: str) -> DataFrame:
    rows = V.sources(spark, d).select("id", C.marker_window(F.col("text"), _markers()).alias("window"))
    return rows.select("id", F.length("window").cast("bigint").alias("chars"), F.md5("window").alias("digest"))


#: Pages of one language stand for one subject here; the threshold tells languages apart.
_SIMILAR = 0.35
_VOCABULARY = r"""
vocabulary AS (SELECT DISTINCT question, id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_\-]{4,}')) AS word FROM sources),
words AS (SELECT * FROM vocabulary WHERE word NOT IN ('enau')),
sizes AS (SELECT question, id, count(*) AS n FROM words GROUP BY ALL),
alike AS (
  SELECT question, a.id AS a, b.id AS b, count(*) AS common, least(any_value(x.n), any_value(y.n)) AS smaller
  FROM words a JOIN words b USING (question, word) JOIN sizes x ON x.question = a.question AND x.id = a.id JOIN sizes y ON y.question = b.question AND y.id = b.id WHERE a.id < b.id GROUP BY ALL
)"""


@query(f"WITH {SOURCES}, {_VOCABULARY} SELECT question, a, b, common, smaller FROM alike")
def vocab_similarity(spark: SparkSession, d: str) -> DataFrame:
    return C.similar_pages(V.sources(spark, d), _markers())


_GROUPS = f"""
near AS (SELECT a, b FROM alike WHERE common >= {_SIMILAR} * smaller),
edges AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach AS (SELECT a, a AS b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
members AS (SELECT question, id, g FROM (SELECT a AS id, min(b) AS g FROM reach GROUP BY a) JOIN sources USING (id)),
kept AS (SELECT question, g, count(*) AS n FROM members GROUP BY ALL HAVING count(*) >= 2),
groups AS (SELECT question, id, g AS "group" FROM members JOIN kept USING (question, g) WHERE question IN (SELECT question FROM kept GROUP BY question HAVING count(*) >= 2))"""


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return C.namesake_groups(V.sources(spark, d), _markers(), _SIMILAR)


@query(f'WITH RECURSIVE {SOURCES}, {_VOCABULARY}, {_GROUPS} SELECT question, id, "group" FROM groups')
def namesake_groups(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d)


@query(f"""WITH RECURSIVE {SOURCES}, {_VOCABULARY}, {_GROUPS}, top AS (SELECT question, "group", n FROM (SELECT question, "group", count(*) AS n FROM groups GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY question ORDER BY n DESC, "group") <= 3),
has AS (SELECT question, "group", m, count_if(contains(lower(text), m)) * 2 > any_value(n) AS own FROM groups JOIN top USING (question, "group") JOIN sources USING (question, id), (VALUES ('the'), ('une'), ('der')) v(m) GROUP BY ALL),
sets AS (SELECT question, "group", string_agg(m, ',' ORDER BY m) FILTER (own) AS s FROM has GROUP BY ALL)
SELECT question, count(s) >= 2 AND count(DISTINCT s) >= 2 AS structure FROM sets GROUP BY question""")
def question_structure(spark: SparkSession, d: str) -> DataFrame:
    pages = V.sources(spark, d)
    markers = pages.select("question").distinct().select("question", F.explode(F.array(F.lit("the"), F.lit("une"), F.lit("der"))).alias("marker"))
    return C.question_structure(_groups(spark, d), pages, markers)


def _judged(spark: SparkSession, d: str) -> DataFrame:
    rows = V.sources(spark, d).withColumn("chars", F.when(F.col("id") % 5 == 0, 0).otherwise(F.col("chars")))
    return rows.withColumns(
        {"markers_hit": T.markers_together(F.col("text"), _markers(2), 50), "engines": F.col("id") % 4, "primary_source": U.primary_source(F.col("domain")), "wave": (F.col("id") % 3 + 1).cast("int")}
    )


_JUDGED = """
judged AS (
  SELECT question, id, url, domain, CASE WHEN id % 5 = 0 THEN 0 ELSE chars END AS chars, id % 4 AS engines, ends_with(domain, '.sec.gov') AS primary_source, CAST(id % 3 + 1 AS INTEGER) AS wave,
         strpos(lower(text), 'the') > 0 AND strpos(lower(text), 'and') > 0 AND abs(strpos(lower(text), 'the') - strpos(lower(text), 'and')) <= 50 AS markers_hit FROM sources
)"""


@query(f"""WITH RECURSIVE {SOURCES}, {_JUDGED}, {_VOCABULARY}, {_GROUPS}, several AS (SELECT DISTINCT question FROM groups)
SELECT question, CASE WHEN question IN (FROM several) THEN 'ambiguous' WHEN count_if(chars > 0) = 0 THEN 'not_found' WHEN question LIKE '%7' THEN 'unknown'
 WHEN bool_or(chars > 0 AND markers_hit) THEN 'found' ELSE 'off_target' END AS outcome FROM judged GROUP BY question""")
def outcome(spark: SparkSession, d: str) -> DataFrame:
    """What was found about each question's subject; pages that fall into several groups make it ambiguous."""
    return C.outcome(_judged(spark, d), ~F.col("question").endswith("7"), _groups(spark, d))


@query(f"""WITH {SOURCES}, {_JUDGED} SELECT question, count(*) AS sources, CAST(count_if(chars > 0) AS BIGINT) AS with_content, CAST(count_if(markers_hit) AS BIGINT) AS on_target,
 CAST(count_if(engines >= 2) AS BIGINT) AS corroborated, CAST(count_if(primary_source) AS BIGINT) AS primary_sources FROM judged GROUP BY question""")
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.source_counts(_judged(spark, d))


@query(f"""WITH {SOURCES}, {_JUDGED}, s AS (SELECT *, max(CAST(markers_hit AS INTEGER)) OVER (PARTITION BY question) AS hit FROM judged WHERE chars > 0),
k AS (SELECT question, id, hit, CAST(row_number() OVER (PARTITION BY question ORDER BY id) AS INTEGER) AS place FROM s WHERE hit = 0 OR markers_hit)
SELECT question, id, place FROM k WHERE place <= CASE hit WHEN 1 THEN 6 ELSE 3 END""")
def pick_for_digest(spark: SparkSession, d: str) -> DataFrame:
    return C.pick_for_digest(_judged(spark, d))


@query(f"""WITH {SOURCES}, {_JUDGED}, w AS (SELECT question, wave, bool_or(markers_hit AND id % 7 = 0) AS hit FROM judged GROUP BY ALL)
SELECT question, wave, hit FROM w WHERE NOT EXISTS (SELECT 1 FROM w e WHERE e.question = w.question AND e.wave < w.wave AND e.hit)""")
def wave_stop(spark: SparkSession, d: str) -> DataFrame:
    waves = _judged(spark, d).groupBy("question", "wave").agg(F.bool_or(F.col("markers_hit") & (F.col("id") % 7 == 0)).alias("hit"))
    return C.waves_run(waves)


@query("SELECT 'q' || event_id AS query, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 7 = 0 THEN 'partial' WHEN event_id % 5 = 0 THEN 'empty' ELSE 'returned' END AS fate FROM events")
def query_fates(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    asked = V.read(spark, d, "events").select(F.concat(F.lit("q"), n.cast("string")).alias("query"), (F.col("event_type") != "error").alias("ok"), F.when(n % 7 == 0, "timeout").otherwise("").alias("aborted"), (n % 5).alias("links"))
    return C.query_fates(asked)


def _wave_results(spark: SparkSession, d: str) -> DataFrame:
    """Each question's pages as the results of four queries; some links come up in two of them."""
    rows = V.sources(spark, d).withColumn("domain", F.concat(F.lit("d"), (F.col("id") % 5).cast("string")))
    again = F.explode(F.array(F.col("id") % 4, (F.col("id") + 1) % 4)).alias("query")
    rows = rows.select("question", again, "id", "url", "domain").withColumn("query", F.col("query").cast("int"))
    return rows.withColumn("rank", (F.col("id") % 1000).cast("int")).select("question", "query", "rank", "url", "domain")


@query()
def wave_pick(spark: SparkSession, d: str) -> DataFrame:
    return C.wave_pick(_wave_results(spark, d))


@query()
def wave_sources(spark: SparkSession, d: str) -> DataFrame:
    """The pages that a wave picks, with what is checked on each."""
    picked = C.wave_pick(_wave_results(spark, d)).select("question", "url").distinct()
    pages = V.sources(spark, d).join(picked, ["question", "url"])
    return pages.select("question", "url", "chars", T.markers_together(F.col("text"), _markers(2)).alias("markers_hit"), U.primary_source(F.col("domain")).alias("primary_source"))


_PLANS = [
    '{"queries": ["a", " b "], "markers": ["M"]}',
    'Sure:\n```json\n{"queries": ["c"], "markers": []}\n```',
    '["d", "e"]',
    "no plan at all",
    'Here {"queries": [], "markers": ["N"]} is it',
    '{"queries": {"first": "a"}, "markers": ["K", "", 7]}',
    '{"queries": ["f", null, 12, 1.5], "markers": "L", "more": {"x": [1]}}',
    '{"answer": 42}',
    '["g", ["h"], "i"',
]


@query(f"""SELECT event_id AS id, (['a|b', 'c', 'd|e', 'q' || event_id, 'q' || event_id, 'q' || event_id, 'f|12|1.5', 'q' || event_id, 'q' || event_id])[CAST(event_id % {len(_PLANS)} AS INTEGER) + 1] AS queries,
 (['M', '', '', '', 'N', 'K|7', '', '', ''])[CAST(event_id % {len(_PLANS)} AS INTEGER) + 1] AS markers, event_id % {len(_PLANS)} IN (2, 3, 8) AS bad_format FROM events""")
def parse_plan(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    answer = F.get(F.array(*map(F.lit, _PLANS)), (n % len(_PLANS)).cast("int"))
    rows = V.read(spark, d, "events").select(n.alias("id"), C.parse_plan(answer, F.concat(F.lit("q"), n.cast("string"))).alias("p"))
    return rows.select("id", F.array_join("p.queries", "|").alias("queries"), F.array_join("p.markers", "|").alias("markers"), "p.bad_format")


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 5 AS deep, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderkey % 7 > 0)
SELECT id, CAST(2 * deep + 1 AS INTEGER) AS depth, 'datePublished' AS name, day AS value FROM o
UNION ALL SELECT id, CAST(2 * deep + 2 AS INTEGER), 'uploadDate', 'later ' || id FROM o WHERE id % 3 = 0
UNION ALL SELECT id, 1, 'dateCreated', 'own' FROM o WHERE deep > 0 AND id % 2 = 0""")
def json_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates in linked data, within up to four objects and lists; one text in seven is cut off."""
    n, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    inner = F.concat(F.lit('{"datePublished": "'), day, F.lit('", "dateCreated": 7, "@graph": '), F.when(n % 3 == 0, F.concat(F.lit('{"uploadDate": "later '), n.cast("string"), F.lit('"}'))).otherwise("[1, null]"), F.lit("}"))
    own = F.when(n % 2 == 0, F.lit('"dateCreated": "own", ')).otherwise(F.lit(""))
    wrap = F.when(n % 5 > 0, F.concat(F.lit("{"), own, F.lit('"x": ['), F.repeat(F.lit('{"x": ['), (n % 5 - 1).cast("int")), inner, F.repeat(F.lit("]}"), (n % 5).cast("int")))).otherwise(inner)
    text = F.when(n % 7 > 0, wrap).otherwise(F.concat(F.lit("{"), wrap))
    return C.dates_in_json(V.read(spark, d, "orders").select(n.alias("id"), text.alias("json")))
