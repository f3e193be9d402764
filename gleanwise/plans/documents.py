"""Queries over pages and documents as pages: reading, classification, slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binary as B
from ..functions import text as T
from ..operators import html as H
from ..operators import tables
from ..sources import views as V
from .catalogue import query


#: Pages with links that resolve: each article ends with three, one of them to another site, one to no page.
_LINKED = """
linked AS (
  SELECT page_id, url, replace(html, '</article>', '<p>See <a href="/more/' || page_id || '?a=1&amp;b=2">more &amp; more</a> <a href="https://other.example.com/x">other
 page</a> <a href="mailto:x@example.com">mail</a></p></article>') AS html FROM pages
)"""


def _linked(spark: SparkSession, d: str) -> DataFrame:
    first, second = '<p>See <a href="/more/', '?a=1&amp;b=2">more &amp; more</a> <a href="https://other.example.com/x">other\n page</a> <a href="mailto:x@example.com">mail</a></p></article>'
    more = F.concat(F.lit(first), F.col("page_id").cast("string"), F.lit(second))
    return V.read(spark, d, "pages").withColumn("html", F.replace("html", F.lit("</article>"), more))


def _read(spark: SparkSession, d: str) -> DataFrame:
    return H.pages_read(_linked(spark, d))


def _plain(x: str) -> str:
    """SQL for text without character references."""
    return f"regexp_replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', chr(39)), '&amp;?', '&', 'g')"


#: What a page shows, in SQL: without head, frames, scripts and comments; a break between blocks is \x01 at first.
_SHOWN = r"""
shown AS (SELECT page_id, regexp_replace(html, '(?s)<title>.*?</title>|<style>.*?</style>|<script>.*?</script>|<nav>.*?</nav>|<!--.*?-->|<footer>.*?</footer>', '', 'g') AS t FROM linked),
broken AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '>\s+<', '><', 'g'), '</?(p|div|article|br|h1)( [^>]*)?>', chr(1), 'g'), '<[^>]*>', '', 'g') AS t FROM shown),
lined AS (SELECT page_id, regexp_replace(regexp_replace(t, '\n\x01+', chr(10), 'g'), '\x01+', chr(10), 'g') AS t FROM broken)"""
_TEXT = rf"""WITH {_LINKED}, {_SHOWN}
SELECT page_id, trim(regexp_replace(regexp_replace({_plain("t")}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text, length(text) AS chars FROM lined"""
_META = rf"""WITH {_LINKED}
SELECT page_id, left(trim(regexp_replace({_plain(_plain("regexp_extract(html, '<title>([^<]*)</title>', 1)"))}, '\s+', ' ', 'g')), 300) AS title,
 regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang, '' AS canonical, '' AS published FROM linked"""
_LINKS = f"""WITH {_LINKED}, a AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*') AS host FROM linked WHERE html LIKE '%</article>%')
SELECT page_id, 0 AS position, host || '/more/' || page_id || '?a=1&b=2' AS target, 'more & more' AS caption FROM a UNION ALL SELECT page_id, 1, 'https://other.example.com/x', 'other page' FROM a"""


@query(_TEXT)
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d).select("page_id", "text", F.length("text").alias("chars"))


@query()
def html_markdown(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d).select("page_id", "markdown")


@query(_META)
def html_meta(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d).select("page_id", "title", "lang", "canonical", "published")


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang FROM pages""")
def html_title_raw(spark: SparkSession, d: str) -> DataFrame:
    """Title and language as they stand in the source, without a parser."""
    page = V.read(spark, d, "pages")
    return page.select("page_id", F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", r'(?i)<html[^>]*\blang="([^"]*)"', 1).alias("lang"))


@query(_LINKS)
def html_links(spark: SparkSession, d: str) -> DataFrame:
    return H.link_graph(_read(spark, d))


@query(rf"""WITH links AS ({_LINKS}), placed AS (SELECT links.*, regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1) AS host, page_id // 64 AS block FROM links JOIN pages USING (page_id))
SELECT page_id, position, target, caption, CAST(min(page_id) OVER (PARTITION BY host, block, target) < page_id AS INTEGER) AS again FROM placed""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Links by a table function over the pages of each host, 64 page numbers together."""
    tables.register(spark)
    pages = _linked(spark, d).select("page_id", "url", "html", F.regexp_extract("url", "^[A-Za-z]+://([^/?#:]*)", 1).alias("host"), F.expr("page_id div 64").alias("block"))
    return spark.sql("SELECT * FROM page_links(TABLE({pages}))", pages=pages)


@query("SELECT item_id AS id, CASE WHEN item_id % 3 < 2 THEN 'Привет, ' || text ELSE text END AS text FROM benchmark")
def charset_detect(spark: SparkSession, d: str) -> DataFrame:
    """Bytes in windows-1251 without a name, in UTF-8, and in a named Latin-1 come out as text."""
    items = V.read(spark, d, "benchmark")
    utf8 = F.encode(F.concat(F.lit("Привет, "), "text"), "UTF-8")
    greeting = F.unhex(F.lit("CFF0E8E2E5F22C20"))  # the same word in windows-1251
    ascii_only = ~F.col("text").rlike(r"[^\x00-\x7F]")
    body = (
        F.when(F.col("item_id") % 3 == 0, F.when(ascii_only, F.concat(greeting, F.encode("text", "US-ASCII"))).otherwise(utf8))
        .when(F.col("item_id") % 3 == 1, utf8)
        .otherwise(F.encode("text", "UTF-8"))
    )
    kind = F.when(F.col("item_id") % 3 == 2, "text/html; charset=utf-8").otherwise("text/html")
    return items.select(F.col("item_id").alias("id"), B.decoded(body, kind).alias("text"))


# Documents as pages: some begin with a marker, some have markup with one, in all status codes.
_HEADS = {0: "Page not found. ", 1: "Капча! ", 2: "404: "}
_RAWS = {3: "<div id=captcha>", 4: "subscribe to continue", 5: "x" * 60_000}
_CODES = [200, 200, 403, 500, 407]


def _pages(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id") % 10
    head = F.coalesce(*(F.when(n == k, F.lit(v)) for k, v in _HEADS.items()), F.lit(""))
    raw = F.coalesce(*(F.when(n == k, F.lit(v)) for k, v in _RAWS.items()), F.lit(""))
    code = F.get(F.array(*map(F.lit, _CODES)), (F.col("doc_id") % 5).cast("int"))
    docs = V.read(spark, d, "documents")
    text = F.when(F.col("doc_id") % 17 == 0, " ").otherwise(F.concat(head, F.col("text")))
    return docs.select(F.col("doc_id").alias("id"), text.alias("text"), F.concat(raw, F.lower("text")).alias("raw"), code.alias("code"), "source")


_PAGES = """
pages0 AS (
  SELECT doc_id AS id, source, CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE (['Page not found. ', 'Капча! ', '404: ', '', '', '', '', '', '', ''])[CAST(doc_id % 10 AS INTEGER) + 1] || text END AS text,
         (['', '', '', '<div id=captcha>', 'subscribe to continue', repeat('x', 60000), '', '', '', ''])[CAST(doc_id % 10 AS INTEGER) + 1] || lower(text) AS raw,
         ([200, 200, 403, 500, 407])[CAST(doc_id % 5 AS INTEGER) + 1] AS code
  FROM documents
), stubs AS (
  SELECT *, CASE WHEN regexp_matches(lower(left(text, 400)), 'not found|404|не найден|недоступн') THEN 'no such page' WHEN length(text) >= 1200 THEN NULL
    WHEN contains(left(raw, 20000), 'captcha') OR contains(lower(left(text, 400)), 'капча') OR contains(left(raw, 20000), 'cloudflare') THEN 'shield'
    WHEN contains(raw, 'subscribe to continue') THEN 'paywall' WHEN length(raw) > 50000 THEN 'markup' WHEN code IN (401, 403, 429) THEN 'code' END AS stub
  FROM pages0
), status AS (
  SELECT *, CASE WHEN id % 13 = 0 THEN 'forbidden' WHEN stub IS NOT NULL THEN 'stub' WHEN id % 7 > 0 AND (code IN (401, 403, 407, 429) OR code >= 500) THEN 'refused' WHEN trim(text) = '' THEN 'empty' ELSE 'read' END AS status FROM stubs
)"""


def _status(spark: SparkSession, d: str) -> DataFrame:
    rows = _pages(spark, d).withColumn("stub", T.stub_reason(F.col("text"), F.col("raw"), F.col("code")))
    status = T.page_status(F.col("stub"), F.col("code"), F.col("text"), F.col("id") % 13 > 0, F.col("id") % 7 == 0)
    return rows.withColumn("status", status)


@query(f"WITH {_PAGES} SELECT id, stub FROM stubs")
def stub_check(spark: SparkSession, d: str) -> DataFrame:
    return _status(spark, d).select("id", "stub")


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query(f"""WITH {_PAGES}, marked AS (
  SELECT *, CASE stub WHEN 'no such page' THEN list_filter({_sql_list(T.NO_SUCH_PAGE)}, lambda m: contains(lower(left(text, 400)), m))[1]
    WHEN 'shield' THEN list_filter({_sql_list(T.SHIELDS)}, lambda m: contains(left(raw, 20000), m) OR contains(lower(left(text, 400)), m))[1]
    WHEN 'paywall' THEN list_filter({_sql_list(T.PAYWALLS)}, lambda m: contains(raw, m))[1] END AS mark
  FROM stubs)
SELECT id, CASE WHEN stub = 'markup' THEN length(raw) || ' bytes of markup for ' || length(text) || ' characters of text' WHEN stub = 'code' THEN 'status ' || code || ' and ' || length(text) || ' characters of text'
  WHEN stub IS NOT NULL THEN CASE stub WHEN 'no such page' THEN 'at the start of the text: ' WHEN 'shield' THEN 'shield marker: ' ELSE 'paywall: ' END || CASE WHEN contains(mark, chr(39)) THEN '"' ELSE chr(39) END || mark || CASE WHEN contains(mark, chr(39)) THEN '"' ELSE chr(39) END END AS detail
FROM marked""")
def stub_detail(spark: SparkSession, d: str) -> DataFrame:
    """Why pages are stubs, in words."""
    return _pages(spark, d).select("id", T.stub_detail(F.col("text"), F.col("raw"), F.col("code")).alias("detail"))


@query(f"WITH {_PAGES} SELECT id, status FROM status")
def page_status(spark: SparkSession, d: str) -> DataFrame:
    return _status(spark, d).select("id", "status")


@query(f"""WITH {_PAGES} SELECT source, count(*) AS pages, CAST(count_if(status = 'read') AS BIGINT) AS with_text, CAST(count_if(status = 'empty') AS BIGINT) AS empty,
 CAST(count_if(status NOT IN ('read', 'empty')) AS BIGINT) AS failed, bool_and(status IN ('read', 'empty') AND stub IS NULL) AS all_pages_clean FROM status GROUP BY source""")
def all_pages_clean(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("status")
    return _status(spark, d).groupBy("source").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(s == "read").alias("with_text"), F.count_if(s == "empty").alias("empty"), F.count_if(~s.isin("read", "empty")).alias("failed"), F.bool_and(s.isin("read", "empty") & F.col("stub").isNull()).alias("all_pages_clean")
    )


@query("""SELECT doc_id AS id, md5(substr(text, CAST(doc_id % 5 * 1000 + 1 AS BIGINT), 2000)) AS part, least(greatest(length(text) - doc_id % 5 * 1000, 0), 2000) AS chars, length(text) > doc_id % 5 * 1000 + least(greatest(length(text) - doc_id % 5 * 1000, 0), 2000) AS truncated,
 CASE WHEN length(text) > doc_id % 5 * 1000 + least(greatest(length(text) - doc_id % 5 * 1000, 0), 2000) THEN doc_id % 5 * 1000 + least(greatest(length(text) - doc_id % 5 * 1000, 0), 2000) END AS next_offset FROM documents""")
def slice_cursor(spark: SparkSession, d: str) -> DataFrame:
    """A part of the text from an offset, whether text is left, and where to go on."""
    offset = (F.col("doc_id") % 5 * 1000).cast("bigint")
    rows = V.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", offset.alias("o"))
    rows = rows.withColumn("p", F.expr("substring(text, cast(o + 1 as int), 2000)")).withColumn("n", F.length("p").cast("bigint"))
    more = F.col("o") + F.col("n") < F.length("text")
    return rows.select("id", F.md5("p").alias("part"), F.col("n").alias("chars"), more.alias("truncated"), F.when(more, F.col("o") + F.col("n")).alias("next_offset"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 > 0 THEN contains(lower(text), 'the') AND (doc_id % 4 < 2 OR contains(lower(text), 'and')) END AS found FROM documents")
def verify_expect(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id") % 4
    markers = F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(F.lit("THE"))).otherwise(F.array(F.lit("The"), F.lit("and")))
    return V.read(spark, d, "documents").select(F.col("doc_id").alias("id"), T.markers_found(F.col("text"), markers).alias("found"))


@query("SELECT page_id, strlen(html) > 4000 AS truncated, least(strlen(html), 4000) AS bytes FROM pages")
def download_truncated(spark: SparkSession, d: str) -> DataFrame:
    """Whether a body passes the download ceiling, and the bytes that are kept."""
    size = F.octet_length("html").cast("bigint")
    return V.read(spark, d, "pages").select("page_id", (size > 4000).alias("truncated"), F.least(size, F.lit(4000).cast("bigint")).alias("bytes"))


_BATCH = (
    _PAGES
    + """,
batch AS (SELECT id // 8 AS call, CAST(id % 8 AS INTEGER) AS ordinal, 's' || id % 37 || '.example.org' AS domain, id, CASE WHEN id % 8 >= 5 THEN 'not_reached' ELSE status END AS status, text, stub FROM status)"""
)


def _batch(spark: SparkSession, d: str) -> DataFrame:
    """Calls of up to eight addresses with what reading them gave; of a call, the first five are read."""
    n = F.col("id")
    host = F.concat(F.lit("s"), (n % 37).cast("string"), F.lit(".example.org"))
    state = F.when(n % 8 >= 5, "not_reached").otherwise(F.col("status"))
    return _status(spark, d).select(F.floor(n / 8).alias("call"), (n % 8).cast("int").alias("ordinal"), host.alias("domain"), "id", state.alias("status"), "text", "stub")


@query(f"WITH {_BATCH} SELECT call, count(*) AS asked, CAST(count_if(status IN ('read', 'empty')) AS BIGINT) AS count, string_agg(status, ',' ORDER BY ordinal) AS statuses, count(DISTINCT domain) AS domains FROM batch GROUP BY call")
def read_batch(spark: SparkSession, d: str) -> DataFrame:
    """Calls of up to eight addresses: the first five are read, the others not reached, answers in the order asked."""
    rows = _batch(spark, d).groupBy("call").agg(
        F.count(F.lit(1)).alias("asked"), F.count_if(F.col("status").isin("read", "empty")).alias("count"), F.sort_array(F.collect_list(F.struct("ordinal", "status"))).alias("s"), F.countDistinct("domain").alias("domains")
    )
    return rows.select("call", "asked", "count", F.array_join(F.transform("s", lambda x: x["status"]), ",").alias("statuses"), "domains")


@query(f"""WITH {_BATCH} SELECT call, ordinal, id, CASE WHEN ordinal < 3 THEN status ELSE 'not_read' END AS page, CASE WHEN ordinal < 3 AND status = 'read' THEN length(text) ELSE 0 END AS chars,
 count_if(ordinal < 3 AND status = 'read') OVER w AS with_text, count_if(ordinal < 3 AND status = 'empty') OVER w AS empty, count_if(ordinal < 3 AND status NOT IN ('read', 'empty')) OVER w AS failed, NOT bool_or(ordinal < 3 AND (status NOT IN ('read', 'empty') OR stub IS NOT NULL)) OVER w AS all_pages_clean
 FROM batch WINDOW w AS (PARTITION BY call)""")
def search_read_merge(spark: SparkSession, d: str) -> DataFrame:
    """Search results with the pages that were read of the first three, and how reading went; the others say that they were not read."""
    found = _batch(spark, d)
    pages = found.where("ordinal < 3").select("call", "ordinal", "status", "stub", F.when(F.col("status") == "read", F.length("text")).otherwise(0).cast("bigint").alias("chars"))
    s = F.col("status")
    told = pages.groupBy("call").agg(
        F.count_if(s == "read").alias("with_text"), F.count_if(s == "empty").alias("empty"), F.count_if(~s.isin("read", "empty")).alias("failed"), F.bool_and(s.isin("read", "empty") & F.col("stub").isNull()).alias("all_pages_clean")
    )
    out = found.select("call", "ordinal", "id").join(pages, ["call", "ordinal"], "left").join(told, "call")
    return out.select("call", "ordinal", "id", F.coalesce("status", F.lit("not_read")).alias("page"), F.coalesce("chars", F.lit(0).cast("bigint")).alias("chars"), "with_text", "empty", "failed", "all_pages_clean")
