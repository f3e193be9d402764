"""Queries over recorded answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers as A
from ..operators import observe as O
from ..operators import results as R
from ..sources import views as V
from .catalogue import query
from .observations import _CONFIRMED as CONFIRMED
from .observations import _TRUST as TRUST
from .views_sql import PROBES, RESPONSES

N = 25

_SWEEP = f"""
firsts AS (SELECT query, url, min(pos) AS pos FROM responses GROUP BY ALL),
news AS (SELECT query, pos, count(*) AS new_links FROM firsts GROUP BY ALL),
engines AS (SELECT DISTINCT query, pos, engine FROM responses),
steps AS (
  SELECT e.query, e.pos, e.engine, coalesce(new_links, 0) AS new_links,
         CAST(coalesce(sum(coalesce(new_links, 0)) OVER (PARTITION BY e.query ORDER BY e.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM engines e LEFT JOIN news n ON n.query = e.query AND n.pos = e.pos
)"""


@query(f"WITH {RESPONSES}, {_SWEEP} SELECT *, before < {N} AS asked FROM steps")
def sweep(spark: SparkSession, d: str) -> DataFrame:
    return R.sweep(V.responses(spark, d), N)


@query(f"WITH {RESPONSES}, {_SWEEP} SELECT *, row_number() OVER (PARTITION BY query ORDER BY pos) <= 3 AS asked FROM steps")
def sweep_corroborate(spark: SparkSession, d: str) -> DataFrame:
    return R.sweep(V.responses(spark, d), N, least_engines=3)


@query(f"WITH {RESPONSES.replace('rank <= 10', 'rank <= 4')}, {_SWEEP} SELECT *, before < {N} AS asked FROM steps")
def sweep_per_engine(spark: SparkSession, d: str) -> DataFrame:
    """The sweep where each engine is asked for four links."""
    return R.sweep(R.per_engine(V.responses(spark, d), 4), N)


_RESULTS = f"""
got AS (SELECT r.* FROM responses r JOIN steps s ON s.query = r.query AND s.pos = r.pos WHERE before < {N}),
merged AS (SELECT query, url, min(pos * 1000 + rank) AS came, string_agg(DISTINCT engine, ',' ORDER BY engine) AS via FROM got GROUP BY ALL),
placed AS (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY came, url) AS INTEGER) AS place, url, via FROM merged)"""


@query(f"WITH {RESPONSES}, {_SWEEP}, {_RESULTS} SELECT * FROM placed WHERE place <= {N}")
def sweep_results(spark: SparkSession, d: str) -> DataFrame:
    return R.sweep_results(V.responses(spark, d), N).withColumn("via", F.array_join("via", ","))


@query(f"WITH {RESPONSES} SELECT query, url, string_agg(DISTINCT engine, ',' ORDER BY engine) AS via FROM responses GROUP BY ALL")
def merge_witnesses(spark: SparkSession, d: str) -> DataFrame:
    return R.merge_witnesses(V.responses(spark, d)).withColumn("via", F.array_join("via", ","))


@query(f"""WITH {RESPONSES}, r AS (SELECT *, regexp_replace(split_part(split_part(url, '//', 2), '/', 1), '^www\\.', '') AS domain FROM responses),
u AS (SELECT query, url, domain, count(DISTINCT engine) AS by_url FROM r GROUP BY ALL),
v AS (SELECT query, domain, count(DISTINCT engine) AS by_domain FROM r GROUP BY ALL),
w AS (SELECT query, count(DISTINCT engine) AS n FROM r GROUP BY ALL)
SELECT query, url, CASE WHEN n >= 2 THEN by_url END AS by_url, CASE WHEN n >= 2 THEN by_domain END AS by_domain FROM u JOIN v USING (query, domain) JOIN w USING (query)""")
def corroboration(spark: SparkSession, d: str) -> DataFrame:
    return R.corroboration(V.responses(spark, d))


_BEST = "best AS (SELECT * FROM responses)"
_WORDS = r"""
wordlist AS (SELECT DISTINCT query, w FROM (SELECT query, unnest(regexp_split_to_array(lower(query), '[^\p{L}\p{N}_]+')) AS w FROM (SELECT DISTINCT query FROM responses)) WHERE length(w) >= 4),
hay AS (SELECT *, lower(title || ' ' || snippet || ' ' || url) AS text FROM best),
judged AS (
  SELECT query, engine, bool_or(NOT EXISTS (SELECT 1 FROM wordlist l WHERE l.query = hay.query) OR EXISTS (SELECT 1 FROM wordlist l WHERE l.query = hay.query AND contains(text, left(w, 5)))) AS relevant
  FROM hay GROUP BY ALL
)"""


@query(f"WITH {RESPONSES}, {_BEST}, {_WORDS} SELECT * FROM judged")
def engine_relevance(spark: SparkSession, d: str) -> DataFrame:
    return R.relevant_engines(V.responses(spark, d))


@query(f"""WITH {RESPONSES}, {_BEST}, {_WORDS}
SELECT b.query, url, string_agg(DISTINCT b.engine, ',' ORDER BY b.engine) AS via FROM best b JOIN judged j ON j.query = b.query AND j.engine = b.engine GROUP BY ALL HAVING bool_or(relevant)""")
def drop_hijacked(spark: SparkSession, d: str) -> DataFrame:
    rows = V.responses(spark, d)
    return R.drop_hijacked(R.merge_witnesses(rows), R.relevant_engines(rows)).withColumn("via", F.array_join("via", ","))


@query(f"WITH {RESPONSES}, best AS (SELECT * REPLACE (query || ' unheard' || pos % 2 AS query) FROM responses), {_WORDS.replace("FROM responses", "FROM best")} SELECT query, w AS word FROM wordlist l WHERE NOT EXISTS (SELECT 1 FROM hay WHERE hay.query = l.query AND contains(text, left(w, 5)))")
def word_coverage(spark: SparkSession, d: str) -> DataFrame:
    """All answers, each question asked in two ways with a word more, which no answer has."""
    answers = V.responses(spark, d)
    return R.word_coverage(answers.withColumn("query", F.concat("query", F.lit(" unheard"), (F.col("pos") % 2).cast("string"))))


@query(r"""WITH w AS (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) AS w, generate_subscripts(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), 1) AS i FROM benchmark),
f AS (SELECT item_id, arg_min(w, i) AS w, min(i) AS i FROM w WHERE length(w) >= 4 GROUP BY item_id, left(w, 5))
SELECT item_id, coalesce(words, '') AS words FROM benchmark LEFT JOIN (SELECT item_id, string_agg(w, ' ' ORDER BY i) AS words FROM f GROUP BY item_id) USING (item_id)""")
def query_words(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "benchmark").select("item_id", F.array_join(T.query_words(F.col("text")), " ").alias("words"))


@query(f"""WITH {RESPONSES}, wanted AS (SELECT DISTINCT engine FROM responses UNION SELECT 'e_new'), registry AS (SELECT DISTINCT engine FROM responses WHERE pos % 3 <> 0)
SELECT engine, engine IN (FROM registry) AS known FROM wanted""")
def registry_split(spark: SparkSession, d: str) -> DataFrame:
    answers = V.responses(spark, d)
    wanted = answers.select("engine").union(spark.sql("SELECT 'e_new'")).distinct()
    known, unknown = R.split_known(wanted, answers.where("pos % 3 <> 0").select("engine").distinct())
    return known.withColumn("known", F.lit(True)).unionByName(unknown.withColumn("known", F.lit(False)))


def _engine_lists(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda c: F.sort_array(F.collect_set(F.when(F.expr(c), F.col("engine"))))
    return V.responses(spark, d).groupBy("query").agg(
        pick("true").alias("known"), pick("pos < 8").alias("asked"), pick("pos < 8 AND rank = 1 AND length(title) % 3 = 0").alias("answered"), pick("pos = 2").alias("silent"), pick("pos = 5").alias("hijacked"), pick("pos = 9").alias("skipped")
    )


@query(f"""WITH {RESPONSES} SELECT query,
 coalesce(string_agg(DISTINCT engine, ',' ORDER BY engine) FILTER (pos < 8 AND pos NOT IN (2, 5) AND engine NOT IN (SELECT engine FROM responses a WHERE a.query = responses.query AND a.pos < 8 AND rank = 1 AND length(title) % 3 = 0)), '') AS quiet,
 CASE WHEN query LIKE '%HIGH%' THEN coalesce(string_agg(DISTINCT engine, ',' ORDER BY engine) FILTER (pos >= 8 AND pos <> 9), '') ELSE '' END AS unasked
FROM responses GROUP BY query""")
def quietly_empty(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    quiet = R.quietly_empty(c("asked"), c("answered"), c("silent"), c("hijacked"))
    left = R.unasked(c("known"), c("asked"), c("skipped"), c("query").contains("HIGH"))
    return _engine_lists(spark, d).select("query", F.array_join(F.sort_array(quiet), ",").alias("quiet"), F.array_join(F.sort_array(left), ",").alias("unasked"))


@query(f"WITH {RESPONSES} SELECT query, engine, arg_min(title, rank) AS reason FROM responses WHERE pos % 2 = 0 GROUP BY ALL")
def silent_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = V.responses(spark, d).where("pos % 2 = 0").select("query", "engine", "rank", F.col("title").alias("reason"))
    return R.first_of_each(rows, ["query", "engine"], ["rank"]).drop("rank")


_TRUST = "CASE WHEN pos IN (1, 4) THEN 'substitutes' WHEN pos < 9 THEN 'clean' END"


@query(f"WITH {RESPONSES} SELECT query, bool_and(coalesce({_TRUST} = 'clean', false)) AS all_engines_clean FROM responses WHERE pos NOT IN (1, 4) OR query LIKE '%LOW%' GROUP BY query")
def all_engines_clean(spark: SparkSession, d: str) -> DataFrame:
    rows = V.responses(spark, d).where("pos NOT IN (1, 4) OR query LIKE '%LOW%'")
    return R.all_clean(rows.withColumn("trust", F.expr(_TRUST)), "query")


@query(f"WITH {RESPONSES}, {_SWEEP} SELECT query, engine, coalesce({_TRUST}, 'not_checked') AS trust FROM steps WHERE before < {N}")
def search_trust_join(spark: SparkSession, d: str) -> DataFrame:
    answers = V.responses(spark, d)
    trust = answers.select("engine", F.expr(_TRUST).alias("trust")).where("trust IS NOT NULL").distinct()
    out = R.sweep(answers, N).where("asked").join(trust, "engine", "left")
    return out.select("query", "engine", F.coalesce("trust", F.lit("not_checked")).alias("trust"))


@query(f"WITH {RESPONSES}, {_SWEEP} SELECT query, CASE WHEN max(pos) < 5 THEN 'core' ELSE 'core, fallback' END AS tiers FROM steps WHERE before < {N} GROUP BY query")
def tiers_used(spark: SparkSession, d: str) -> DataFrame:
    return R.tiers(R.sweep(V.responses(spark, d), N).where("asked"))


@query(f"""WITH {RESPONSES} SELECT query, image, page, place FROM (
 SELECT query, 'img' || CAST(regexp_extract(url, '[0-9]+$') AS BIGINT) % 17 AS image, url AS page, pos, rank, CAST(row_number() OVER (PARTITION BY query ORDER BY pos, rank) AS INTEGER) AS place
 FROM responses QUALIFY row_number() OVER (PARTITION BY query, 'img' || CAST(regexp_extract(url, '[0-9]+$') AS BIGINT) % 17 ORDER BY pos, rank) = 1)""")
def image_merge(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = V.responses(spark, d).withColumn("image", F.concat(F.lit("img"), (F.regexp_extract("url", "[0-9]+$", 0).cast("bigint") % 17).cast("string")))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("pos", "rank")))
    return R.first_of_each(rows, ["query", "image"], ["pos", "rank"]).select("query", "image", F.col("url").alias("page"), "place")


@query(f"""WITH {RESPONSES}, best AS (SELECT query, engine, '' AS title, snippet, url || ' ' || title AS url FROM responses), {_WORDS} SELECT * FROM judged""")
def image_on_topic(spark: SparkSession, d: str) -> DataFrame:
    rows = V.responses(spark, d).select("query", "engine", F.lit("").alias("title"), "snippet", F.concat_ws(" ", "url", "title").alias("url"))
    return R.relevant_engines(rows)


@query(f"""WITH {RESPONSES} SELECT query, CASE WHEN query LIKE '%HIGH%' THEN 'timeout' END AS aborted, coalesce(string_agg(DISTINCT engine, ',' ORDER BY engine) FILTER (pos = 2), 'none') AS silent,
 CASE WHEN query LIKE '%LOW%' THEN 'the pool is the seed list' WHEN query LIKE '%URGENT%' THEN 'the pool is not established' END AS pool FROM responses GROUP BY query""")
def trouble(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    source = F.when(c("query").contains("LOW"), "seed").when(~c("query").contains("URGENT"), "observation")
    none = F.array().cast("array<string>")
    told = R.trouble(F.when(c("query").contains("HIGH"), "timeout").otherwise(""), c("silent"), c("hijacked"), F.coalesce(source, F.lit("?")), none, none)
    out = _engine_lists(spark, d).select("query", told.alias("t"))
    return out.select("query", c("t.search_aborted").alias("aborted"), F.coalesce(F.array_join("t.unresponsive_engines", ","), F.lit("none")).alias("silent"), c("t.pool_unmeasured").alias("pool"))


@query(f"""WITH {RESPONSES}, {_SWEEP}, {_RESULTS} SELECT query, url, via FROM placed WHERE place <= {N}""")
def answer_shape(spark: SparkSession, d: str) -> DataFrame:
    """The default answer: the loud fields of the verbose one."""
    verbose = R.sweep_results(V.responses(spark, d), N).select("query", F.struct("url", F.array_join("via", ",").alias("via"), "place").alias("result"))
    return verbose.select("query", "result.url", "result.via")


# The composed answer. Questions come in three ways, so that some have words that no result has; two engines refuse some.
_ASKED = r"""
asked_answers AS (SELECT * REPLACE (query || (['', ' unheard', ' large brushed'])[q + 1] AS query) FROM responses, range(3) w(q)),
refused AS (SELECT DISTINCT query, pos FROM asked_answers WHERE (pos = 2 AND query LIKE '%MEDIUM%') OR (pos = 0 AND query LIKE '%unheard')),
question AS (SELECT query, list(w ORDER BY i) AS words FROM (SELECT query, w, min(i) AS i FROM (
  SELECT query, unnest(regexp_split_to_array(lower(query), '[^\p{L}\p{N}_]+')) AS w, generate_subscripts(regexp_split_to_array(lower(query), '[^\p{L}\p{N}_]+'), 1) AS i FROM (SELECT DISTINCT query FROM asked_answers)
) WHERE length(w) >= 4 GROUP BY ALL) GROUP BY query),
flagged AS (
  SELECT a.*, lower(title || ' ' || snippet || ' ' || url) AS hay, words IS NULL OR len(list_filter(words, lambda w: contains(lower(title || ' ' || snippet || ' ' || url), left(w, 5)))) > 0 AS told
  FROM asked_answers a LEFT JOIN question USING (query)
),
by_engine AS (
  SELECT query, pos, engine, list(url ORDER BY rank) AS urls, list(told ORDER BY rank) AS told, (query, pos) IN (FROM refused) AS silent,
         row_number() OVER (PARTITION BY query ORDER BY pos) AS k
  FROM flagged GROUP BY query, pos, engine
),
walk AS (
  SELECT query, 0::bigint AS k, NULL::int AS pos, NULL::varchar AS engine, NULL::varchar AS state, NULL::bigint AS wanted, []::varchar[] AS links FROM (SELECT DISTINCT query FROM by_engine)
  UNION ALL
  SELECT query, k, pos, engine, state, wanted, CASE WHEN state = 'answered' THEN list_concat(links, list_filter(urls[:wanted], lambda u: NOT list_contains(links, u))) ELSE links END
  FROM (
    SELECT e.query, e.k, e.pos, e.engine, e.urls, w.links, 25 - len(w.links) AS wanted,
      CASE WHEN len(w.links) >= 25 THEN 'not_reached' WHEN silent THEN 'silent' WHEN list_contains(told[:25 - len(w.links)], true) THEN 'answered' ELSE 'irrelevant' END AS state
    FROM walk w JOIN by_engine e ON e.query = w.query AND e.k = w.k + 1
  )
),
ways AS (SELECT query, pos, engine, state, wanted FROM walk WHERE k > 0),
taken AS (SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY f.query, f.pos ORDER BY rank) AS n, wanted, regexp_replace(split_part(split_part(url, '//', 2), '/', 1), '^www\.', '') AS domain FROM flagged f JOIN ways w ON w.query = f.query AND w.pos = f.pos AND state = 'answered') WHERE n <= wanted),
links AS (
  SELECT t.query, url, min(pos * 1000 + rank) AS came, string_agg(DISTINCT engine, ',' ORDER BY engine) AS via, count(DISTINCT engine) AS by_url, arg_min(hay, pos * 1000 + rank) AS hay,
    any_value((SELECT count(DISTINCT engine) FROM taken d WHERE d.query = t.query AND d.domain = t.domain)) AS by_domain, any_value((SELECT count(DISTINCT engine) FROM taken d WHERE d.query = t.query)) AS witnesses
  FROM taken t GROUP BY t.query, url
),
found AS (
  SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY came, url) AS INTEGER) AS place, url, via, CASE WHEN witnesses >= 2 THEN by_url END AS by_url, CASE WHEN witnesses >= 2 THEN by_domain END AS by_domain,
    coalesce(list_filter(words, lambda w: contains(hay, left(w, 5))), []) AS words
  FROM links LEFT JOIN question USING (query)
)"""


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    answers = V.responses(spark, d)
    ways = F.explode(F.array(F.lit(""), F.lit(" unheard"), F.lit(" large brushed")))
    answers = answers.withColumn("_way", ways).withColumn("query", F.concat("query", "_way")).drop("_way")
    refuses = ((F.col("pos") == 2) & F.col("query").contains("MEDIUM")) | ((F.col("pos") == 0) & F.col("query").endswith("unheard"))
    silent = answers.where(refuses).select("query", "engine", F.lit("refused").alias("reason")).distinct()
    return answers, silent


@query(f"WITH RECURSIVE {RESPONSES}, {_ASKED} SELECT query, place, url, via, by_url, by_domain, array_to_string(words, ' ') AS words FROM found")
def search_results(spark: SparkSession, d: str) -> DataFrame:
    """What a search returns: links without those of engines that answered something else, corroboration, words found."""
    answers, silent = _asked(spark, d)
    out = A.search_results(answers, A.walked(A.engine_answers(answers, silent), N))
    return out.select("query", "place", "url", F.array_join("via", ",").alias("via"), "by_url", "by_domain", F.array_join("words", " ").alias("words"))


@query(f"""WITH RECURSIVE {RESPONSES}, {_ASKED}, {PROBES}, {TRUST},
told AS (
  SELECT query, string_agg(engine, ',' ORDER BY pos) FILTER (state <> 'not_reached') AS asked, string_agg(engine, ',' ORDER BY pos) FILTER (state = 'answered') AS answered, string_agg(engine, ',' ORDER BY pos) FILTER (state = 'irrelevant') AS irrelevant,
    string_agg(engine, ',' ORDER BY pos) FILTER (state = 'silent') AS silent, string_agg(engine || '=' || coalesce(trust, 'not_checked'), ',' ORDER BY pos) FILTER (state <> 'not_reached') AS engines_trust,
    coalesce(bool_and(coalesce(trust, '') = 'clean') FILTER (state = 'answered'), false) AS all_engines_clean, max(pos) FILTER (state <> 'not_reached') AS last
  FROM ways LEFT JOIN trust USING (engine) GROUP BY query
),
counted AS (SELECT query, count(*) AS n, max(by_url) AS most_witnesses, list_distinct(flatten(list(words))) AS had FROM found GROUP BY query)
SELECT query, coalesce(n, 0) AS results, most_witnesses, asked, coalesce(answered, '') AS answered, coalesce(irrelevant, '') AS irrelevant, coalesce(silent, '') AS silent, engines_trust,
  coalesce(array_to_string(list_filter(words, lambda w: NOT list_contains(coalesce(had, []), w)), ' '), '') AS missing, all_engines_clean, CASE WHEN last < 5 THEN 'core' ELSE 'core, fallback' END AS tiers,
  concat_ws('; ', 'silent: ' || silent, 'irrelevant: ' || irrelevant, CASE WHEN query LIKE '%LOW%' THEN 'the pool is the seed list' END,
    'missing: ' || nullif(array_to_string(list_filter(words, lambda w: NOT list_contains(coalesce(had, []), w)), ' '), ''), CASE WHEN query LIKE '%HIGH%' THEN 'adjusted: n' END) AS trouble
FROM told LEFT JOIN counted USING (query) LEFT JOIN question USING (query)""")
def search_answer(spark: SparkSession, d: str) -> DataFrame:
    """The whole answer: sweep without hijacked engines, witnesses, corroboration, words, trust from observations, trouble."""
    answers, silent = _asked(spark, d)
    trust = O.trust(V.probes(spark, d), spark.createDataFrame([(q,) for q in CONFIRMED], "query string"))
    q = F.col("query")
    adjusted = F.when(q.contains("HIGH"), F.array(F.lit("n"))).otherwise(F.array().cast("array<string>"))
    out = A.search(answers, silent, trust, N, F.when(q.contains("LOW"), "seed").otherwise("observation"), adjusted)
    names = {"silent": "unresponsive_engines", "irrelevant": "engines_irrelevant", "": "pool_unmeasured", "missing": "query_words_matched_nowhere", "adjusted": "arguments_adjusted"}
    said = lambda k, f: F.col(f"trouble.{f}") if not k else F.concat(F.lit(f"{k}: "), F.array_join(f"trouble.{f}", " " if k == "missing" else ","))
    lists = [F.array_join(c, " " if c == "missing" else ",").alias(c) for c in ("asked", "answered", "irrelevant", "silent", "engines_trust", "missing")]
    return out.select("query", F.col("count").alias("results"), "most_witnesses", *lists, "all_engines_clean", "tiers", F.concat_ws("; ", *(said(k, f) for k, f in names.items())).alias("trouble"))


@query(r"""SELECT part.p_partkey AS id, trim(regexp_replace(p_name || '  ' || chr(9) || p_type || chr(10) || ' ', '\s+', ' ', 'g')) AS title, 'https://x.org/' || p_partkey AS url, 'e1,e2,e3' AS engines
FROM part WHERE p_partkey % 4 <> 0""")
def response_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Recorded answers as JSON: fields are tidied and cut, entries without a link go, engines beyond three too."""
    part = V.read(spark, d, "part")
    link = F.when(F.col("p_partkey") % 4 == 0, "ftp://x.org/").otherwise("https://x.org/")
    title = F.concat("p_name", F.lit("  \t"), "p_type", F.lit("\n "))
    entry = F.struct(F.concat(link, F.col("p_partkey").cast("string")).alias("url"), title.alias("title"), F.array(*map(F.lit, ("e1", "e2", "e3", "e4"))).alias("engines"))
    raw = part.select(F.col("p_partkey").alias("id"), F.to_json(F.struct(F.array(entry).alias("results"))).alias("body"))
    schema = "results array<struct<url:string,title:string,engines:array<string>>>"
    rows = raw.select("id", F.explode(F.from_json("body", schema)["results"]).alias("r")).where(F.col("r.url").rlike("^https?://"))
    return rows.select("id", F.substring(T.clean(F.col("r.title")), 1, 300).alias("title"), F.col("r.url").alias("url"), F.array_join(F.slice("r.engines", 1, 3), ",").alias("engines"))
