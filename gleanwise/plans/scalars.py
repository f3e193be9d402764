"""Queries of column functions: text, URLs, flags, numbers, sizes. Inputs are made from the tables' rows, so each branch is met."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binary as B
from ..functions import text as T
from ..functions import urls as U
from ..functions import verdicts as X
from ..sources import views as V
from .catalogue import query
from .views_sql import PROBES


def _choice(n: Column, values: list[str | None]) -> Column:
    """One of the values, by n modulo their number."""
    return F.get(F.array(*(F.lit(v).cast("string") for v in values)), F.pmod(n, F.lit(len(values))).cast("int"))


def _choice_sql(n: str, values: list[str | None]) -> str:
    quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"([{', '.join(map(quote, values))}])[CAST({n} % {len(values)} AS INTEGER) + 1]"


@query(r"SELECT item_id, trim(regexp_replace('  ' || replace(text, ' ', chr(9) || ' ') || chr(10), '\s+', ' ', 'g')) AS text FROM benchmark")
def text_clean(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("\t ")), F.lit("\n"))
    return V.read(spark, d, "benchmark").select("item_id", T.clean(raw).alias("text"))


@query(r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '') AS domain FROM pages")
def url_domain(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "pages").select("page_id", U.domain(F.col("url")).alias("domain"))


@query(r"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'https://target.net/p' || page_id || '?q=1&r=2' WHEN 2 THEN 'https://go.example.com/r?url=https%3A%2F%2Fgo.example.com%2Fx' ELSE 'https://deep.org/' || page_id END AS target FROM pages""")
def unwrap_redirect(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    link = (
        F.when(F.col("page_id") % 4 == 0, F.col("url"))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit("https://go.example.com/r?id=7&url=https%3A%2F%2Ftarget.net%2Fp"), n, F.lit("%3Fq%3D1%26r%3D2")))
        .when(F.col("page_id") % 4 == 2, "https://go.example.com/r?url=https%3A%2F%2Fgo.example.com%2Fx")
        .otherwise(F.concat(F.lit("https://go.example.com/r?url=/local&u=https%253A%252F%252Fdeep.org%252F"), n))
    )
    return V.read(spark, d, "pages").select("page_id", U.unwrap_redirect(link).alias("target"))


_POLICY = {
    "https://example.org/a?b=1": "",
    "": "empty address",
    "  ": "empty address",
    "ftp://example.org/": "scheme",
    "not an address": "scheme",
    "https:///path": "no host",
    "https://www.google.com/search?q=x": "result page",
    "https://duckduckgo.com/?q=x": "result page",
    "https://bing.com/maps": "",
    "http://127.0.0.1/": "internal",
    "http://10.1.2.3:80/x": "internal",
    "http://192.168.0.9/": "internal",
    "http://172.20.0.1/": "internal",
    "http://8.8.8.8/": "",
    "http://localhost:8080/": "internal",
    "http://searxng/": "internal",
    "https://example.org:99999/": "port",
    "https://example.org:x1/": "port",
    "https://example.org:8443/": "",
}


#: IPv4 networks whose edges are tried, by whether they are inside, and the first and second groups of IPv6 addresses.
_NETS = {"0.0.0.0/8": True, "10.0.0.0/8": True, "100.64.0.0/10": False, "127.0.0.0/8": True, "169.254.0.0/16": True, "172.16.0.0/12": True, "192.0.0.0/24": True, "192.0.2.0/24": True}
_NETS |= {"192.168.0.0/16": True, "198.18.0.0/15": True, "198.51.100.0/24": True, "203.0.113.0/24": True, "224.0.0.0/4": True, "8.8.8.0/24": False}
_GROUPS = "0000 0064 00ff 0100 1fff 2000 2001 2002 2003 2606 3fff 4000 5f00 9fff e000 f7ff fbff fc00 fdff fe7f fe80 febf fec0 feff ff02".split()
_SECOND = "0000 0003 0002 001f 0020 003f 0040 01ff 0200 0db8 0db9 4700".split()


def _policy_url(n: Column) -> Column:
    """Addresses from the list above, and hosts around the edges of networks in all forms."""
    k, long = F.expr("event_id div 3"), lambda c: c.cast("bigint")
    edges = []
    for net in _NETS:
        name, bits = net.split("/")
        first = sum(int(x) << 24 - 8 * i for i, x in enumerate(name.split(".")))
        edges += [first, first + (1 << 32 - int(bits))]
    at = F.expr(f"event_id div {3 * len(edges)}")
    v = F.pmod(F.get(F.array(*map(F.lit, edges)), F.pmod(k, F.lit(len(edges))).cast("int")) + F.pmod(at, F.lit(3)) - 1, F.lit(1 << 32))
    byte = lambda i: F.pmod(F.shiftright(v, 24 - 8 * i), F.lit(256))
    quad = F.concat_ws(".", *[byte(i).cast("string") for i in range(4)])
    forms = [
        quad,
        v.cast("string"),
        F.concat(F.lit("0x"), F.hex(v)),
        F.concat(F.lit("0"), F.conv(v.cast("string"), 10, 8)),
        F.concat_ws(".", byte(0).cast("string"), F.concat(F.lit("0x"), F.hex(byte(1))), long(byte(2) * 256 + byte(3)).cast("string")),
        F.concat(F.lit("user:pass@"), quad, F.lit(":8080")),
    ]
    four = F.get(F.array(*forms), F.pmod(n, F.lit(len(forms))).cast("int"))
    group = lambda values, c: F.get(F.array(*map(F.lit, values)), F.pmod(c, F.lit(len(values))).cast("int"))
    second = group(_SECOND, F.expr(f"event_id div {3 * len(_GROUPS)}"))
    first, low = group(_GROUPS, k), F.lower(F.hex(F.pmod(n, F.lit(65536))))
    six = F.when(F.pmod(n, F.lit(2)) == 0, F.concat_ws(":", first, second, F.lit(""), low)).otherwise(F.upper(F.concat_ws(":", first, second, F.lit("0:0:0:0:0"), low)))
    made = F.concat(F.lit("http://"), F.when(n % 3 == 1, four).otherwise(F.concat(F.lit("["), six, F.lit("]"))), F.lit("/x"))
    return F.when(n % 3 == 0, _choice(k, list(_POLICY))).otherwise(made)


_POLICY_SQL = f"""
nets AS (SELECT row_number() OVER () - 1 AS i, split_part(x, '/', 1) AS name, split_part(x, '/', 2)::int AS bits, inside FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in _NETS.items())}) t(x, inside)),
ranges AS (SELECT i, first, first + (1::bigint << (32 - bits)) AS after, inside FROM (SELECT *, list_reduce(list_transform(string_split(name, '.'), lambda y: y::bigint), lambda u, w: u * 256 + w) AS first FROM nets)),
edges AS (SELECT list(e ORDER BY i, e) AS e FROM (SELECT i, unnest([first, after]) AS e FROM ranges)),
four AS (SELECT event_id, ((e[(event_id // 3 % len(e) + 1)::int] + event_id // (3 * len(e)) % 3 - 1) % 4294967296 + 4294967296) % 4294967296 AS v FROM events, edges WHERE event_id % 3 = 1),
four_told AS (SELECT event_id, EXISTS (FROM ranges r WHERE inside AND v >= first AND v < after) OR v >= 4026531840 AS bad FROM four),
six AS (SELECT event_id, ('0x' || ({_GROUPS})[(event_id // 3 % {len(_GROUPS)} + 1)::int])::int AS g, ('0x' || ({_SECOND})[(event_id // {3 * len(_GROUPS)} % {len(_SECOND)} + 1)::int])::int AS h FROM events WHERE event_id % 3 = 2),
six_told AS (SELECT event_id, g < 8192 OR (g >= 16384 AND NOT g BETWEEN 65216 AND 65279) OR g = 8194 OR (g = 8193 AND (h = 3512 OR (h < 512 AND h <> 3 AND NOT h BETWEEN 32 AND 63))) AS bad FROM six),
policy AS (
  SELECT event_id AS id, {_choice_sql("(event_id // 3)", list(_POLICY.values()))} AS reason FROM events WHERE event_id % 3 = 0
  UNION ALL SELECT event_id, CASE WHEN bad THEN 'internal' ELSE '' END FROM (FROM four_told UNION ALL FROM six_told)
)"""


@query(f"WITH {_POLICY_SQL} SELECT id, reason FROM policy")
def url_policy(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "events").select(F.col("event_id").alias("id"), U.url_policy(_policy_url(F.col("event_id"))).alias("reason"))


@query(f"WITH {_POLICY_SQL} SELECT id, reason <> '' AS blocked FROM policy")
def redirect_hops(spark: SparkSession, d: str) -> DataFrame:
    """Whether any hop of a redirect chain leads where no page may be read."""
    hops = F.array(F.lit("https://example.org/"), _policy_url(F.col("event_id")), F.lit("http://8.8.8.8/"))
    return V.read(spark, d, "events").select(F.col("event_id").alias("id"), F.exists(hops, lambda h: U.url_policy(h) != "").alias("blocked"))


@query(rf"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, (['*', '{U.AGENT}', 'other', '{U.AGENT}x', '{U.AGENT.upper()}', '*'])[CAST(page_id % 6 AS INTEGER) + 1] AS agent, left(path, CAST(1 + page_id // 6 % 12 AS INTEGER)) AS head, page_id % 5 AS kind FROM p)
SELECT page_id, CASE WHEN page_id % 17 = 0 THEN 'not_checked' WHEN agent IN ('*', '{U.AGENT}') AND kind IN (0, 1, 3) AND head <> '' THEN 'disallowed_by_site' ELSE 'allowed' END AS verdict FROM r""")
def robots_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Rules about the beginnings of each page's own path: for this reader and others, with comments, blanks and escapes, or empty."""
    n, path = F.col("page_id"), U.path(F.col("url"))
    agent = _choice(n, ["*", U.AGENT, "other", U.AGENT + "x", U.AGENT.upper(), "*"])
    head = F.substring(path, F.lit(1), (1 + F.expr("page_id div 6") % 12).cast("int"))
    told = F.get(F.array(head, F.concat(head, F.lit("  # not here")), F.concat(head, F.lit("zz")), F.replace(head, F.lit("e"), F.lit("%65")), F.lit("")), (n % 5).cast("int"))
    field = _choice(n, ["User-agent: ", "user-AGENT:", "User-agent:  "])
    rules = F.concat(F.lit("# robots\r\nUser-agent: first\nDisallow: /\n"), field, agent, F.lit("\nAllow: /\nDisallow: "), told, F.lit("\n"))
    return V.read(spark, d, "pages").select("page_id", U.robots_verdict(F.when(n % 17 > 0, rules), path).alias("verdict"))


_FLAGS = ["true", " YES ", "0", "off", "", None, "maybe", "T"]


@query(f"""WITH r AS (SELECT event_id AS id, {_choice_sql("event_id", _FLAGS)} AS v, event_id % 8 AS i, event_id % 3 > 0 AS given, event_id % 5 = 0 AS is_number, event_id % 4 > 0 AS n FROM events)
SELECT id, CASE WHEN NOT given THEN true WHEN is_number THEN n ELSE i IN (0, 1, 7) END AS value, given AND NOT is_number AND i IN (4, 5, 6) AS adjusted FROM r""")
def parse_flag(spark: SparkSession, d: str) -> DataFrame:
    """Words in any case, with blanks around them; one in five came as a number: 0.0, 0.5, 1.0 or 1.5."""
    number = F.when(F.col("event_id") % 5 == 0, (F.col("event_id") % 4) / 2)
    word = _choice(F.col("event_id"), _FLAGS)
    cased = F.when(F.expr("event_id div 8") % 2 == 0, F.upper(word)).otherwise(F.lower(word))
    padded = F.concat(F.repeat(F.lit(" "), (F.col("event_id") % 3).cast("int")), cased, F.repeat(F.lit(" "), (F.col("event_id") % 7).cast("int")))
    told = X.flag(padded, F.col("event_id") % 3 > 0, True, number)
    return V.read(spark, d, "events").select(F.col("event_id").alias("id"), told.alias("t")).select("id", "t.value", "t.adjusted")


_NUMBERS = ["5", "0", "99", "abc", "", None, " 7", "-3", "3.5"]


@query(f"""SELECT event_id AS id, ([5, 1, 50, 6, 6, 6, 7, 1, 6])[CAST(event_id % 9 AS INTEGER) + 1]::BIGINT AS value, event_id % 9 NOT IN (0, 6) AS adjusted,
 ([5, 4, 99, 4, 4, 4, 7, 4, 4])[CAST(event_id % 9 AS INTEGER) + 1]::BIGINT AS positive FROM events""")
def parse_num(spark: SparkSession, d: str) -> DataFrame:
    v = _choice(F.col("event_id"), _NUMBERS)
    rows = V.read(spark, d, "events").select(F.col("event_id").alias("id"), X.number(v, 1, 50, 6).alias("t"), X.positive(v, 4).alias("positive"))
    return rows.select("id", "t.value", F.coalesce("t.adjusted", F.lit(True)).alias("adjusted"), "positive")


@query("""SELECT user_id AS id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (event_type NOT IN ('view', 'click')) AS unknown FROM events GROUP BY user_id""")
def unknown_args(spark: SparkSession, d: str) -> DataFrame:
    args = V.read(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.collect_set("event_type").alias("given"))
    left = F.sort_array(F.array_except("given", F.array(F.lit("view"), F.lit("click"))))
    return args.select("id", F.when(F.size(left) > 0, F.array_join(left, ",")).alias("unknown"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'no name given' WHEN c_custkey % 5 = 1 THEN 'no name given'
 ELSE c_name || ' x' || CASE WHEN c_custkey % 2 = 0 THEN '/1.' || c_custkey ELSE '' END END AS name FROM customer""")
def client_name(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    name = F.when(key % 5 != 1, F.concat(F.lit("  "), F.col("c_name"), F.lit("\n \t x ")))
    version = F.when(key % 2 == 0, F.concat(F.lit(" 1."), key.cast("string")))
    return V.read(spark, d, "customer").select(key.alias("id"), X.client_name(name, version, key % 5 != 0).alias("name"))


_ERRORS = ["query is required", "metasearch unavailable", "EMPTY QUERY", None, "the port is not usable"]


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 200 WHEN event_id % 5 IN (0, 2, 4) THEN 400 ELSE 502 END AS code FROM events")
def status_for(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "events").select(F.col("event_id").alias("id"), X.status_code(F.col("event_id") % 3 == 0, F.concat(F.lit("call "), F.col("event_id").cast("string"), F.lit(": "), _choice(F.col("event_id"), _ERRORS), F.lit(" (tried twice)"))).alias("code"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'ru' ELSE 'en' END AS lang FROM documents")
def lang_guess(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts, one in three with one Cyrillic letter somewhere."""
    n = F.col("doc_id")
    letter = F.chr(n % 32)  # of no alphabet
    cyrillic = _choice(F.expr("doc_id div 3"), list("абвгдежзийклмнопрстуфхцчшщъыьэюяёЁЯ"))
    at = F.expr("cast(doc_id % (length(text) + 1) as int)")
    text = F.concat(F.substring("text", F.lit(1), at), F.when(n % 3 == 0, cyrillic).otherwise(letter), F.substring(F.col("text"), at + 1, F.length("text")))
    return V.read(spark, d, "documents").select(n.alias("id"), T.language(text).alias("lang"))


@query("SELECT n_regionkey AS region, left(sha256(string_agg(n_name, chr(10) ORDER BY n_name)), 8) AS generation FROM nation GROUP BY 1")
def ref_generation(spark: SparkSession, d: str) -> DataFrame:
    rows = V.read(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.sort_array(F.collect_list("n_name")).alias("q"))
    return rows.select("region", F.substring(F.sha2(F.array_join("q", "\n"), 256), 1, 8).alias("generation"))


@query(f"""WITH n AS (SELECT doc_id AS id, ({list(U.PRIMARY_DOMAINS)})[CAST(doc_id % {len(U.PRIMARY_DOMAINS)} AS INTEGER) + 1] AS base, doc_id // {len(U.PRIMARY_DOMAINS)} % 7 AS kind FROM documents),
named AS (SELECT id, CASE kind WHEN 0 THEN base WHEN 1 THEN 'd' || id || '.' || base WHEN 2 THEN 'd' || id || base WHEN 3 THEN base || '.d' || id || '.com' WHEN 4 THEN base WHEN 5 THEN base ELSE '' END AS name FROM n)
SELECT id, len(list_filter({list(U.PRIMARY_DOMAINS)}, lambda d: name = d OR ends_with(name, '.' || d))) > 0 AS primary_source FROM named""")
def primary_source(spark: SparkSession, d: str) -> DataFrame:
    """Names of disclosure domains, below them, and that only look so; with capitals and dots around them."""
    n = F.col("doc_id")
    base, kind, own = _choice(n, list(U.PRIMARY_DOMAINS)), F.expr(f"doc_id div {len(U.PRIMARY_DOMAINS)}"), n.cast("string")
    forms = [base, F.concat(F.lit("d"), own, F.lit("."), base), F.concat(F.lit("d"), own, base), F.concat(base, F.lit(".d"), own, F.lit(".com")), F.upper(base), F.concat(F.lit("."), base, F.lit("."))]
    name = F.get(F.array(*forms, F.lit(None).cast("string")), F.pmod(kind, F.lit(7)).cast("int"))
    return V.read(spark, d, "documents").select(n.alias("id"), U.primary_source(name).alias("primary_source"))


@query("""SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'a|u' || event_id WHEN 1 THEN NULL ELSE '' END AS urls FROM events""")
def json_list_parse(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id").cast("string")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('["a", "", "u'), n, F.lit('"]'))).when(F.col("event_id") % 3 == 1, "[broken").otherwise("[]")
    parsed = F.filter(F.from_json(raw, "array<string>"), lambda x: x != "")
    return V.read(spark, d, "events").select(F.col("event_id").alias("id"), F.array_join(parsed, "|").alias("urls"))


@query(f"WITH {PROBES} SELECT id, CASE WHEN k % 4 = 3 THEN 'browser' ELSE '' END AS degraded FROM probes")
def degraded_paths(spark: SparkSession, d: str) -> DataFrame:
    state = _choice(F.col("k"), ["alive", "not_wired_up", "alive (slow)", "no answer"])
    paths = F.array(F.struct(F.lit("plain").alias("name"), F.lit("alive").alias("state")), F.struct(F.lit("browser").alias("name"), state.alias("state")))
    bad = F.filter(paths, lambda p: ~p["state"].startswith("alive") & ~p["state"].startswith("not_wired_up"))
    return V.probes(spark, d).select("id", F.array_join(F.transform(bad, lambda p: p["name"]), ",").alias("degraded"))


@query("SELECT doc_id AS id, CASE WHEN length(text) * 40 > 400000 THEN least(length(text), 20000) ELSE length(text) END AS n, CASE WHEN length(text) * 40 > 400000 THEN md5(left(text, 20000)) ELSE md5(text) END AS digest FROM documents")
def shrink(spark: SparkSession, d: str) -> DataFrame:
    """Page text is cut to 20 000 characters if the whole answer, here forty times as long, would pass 400 000."""
    cut = F.when(F.length("text") * 40 > 400_000, F.substring("text", 1, 20_000)).otherwise(F.col("text"))
    return V.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.length(cut).cast("bigint").alias("n"), F.md5(cut).alias("digest"))


@query("SELECT event_id AS id, ([true, false, NULL, NULL])[CAST(event_id % 4 AS INTEGER) + 1] AS truncated FROM events")
def finish_state(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "events").select(F.col("event_id").alias("id"), X.finish_state(_choice(F.col("event_id"), ["length", "stop", None, "tool"])).alias("truncated"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 7 > 0 THEN p_size * 10 END AS width, CASE WHEN p_partkey % 7 > 0 THEN CAST(p_partkey AS INTEGER) END AS height FROM part")
def png_size(spark: SparkSession, d: str) -> DataFrame:
    be = lambda c: F.unhex(F.lpad(F.hex(c.cast("bigint")), 8, "0"))
    head = F.when(F.col("p_partkey") % 7 > 0, F.unhex(F.lit("89504E470D0A1A0A0000000D49484452"))).otherwise(F.unhex(F.lit("FFD8FFE000104A464946000101000001")))
    image = F.concat(head, be(F.col("p_size") * 10), be(F.col("p_partkey")), F.unhex(F.lit("0802")))
    return V.read(spark, d, "part").select(F.col("p_partkey").alias("id"), B.png_width(image).alias("width"), B.png_height(image).alias("height"))


@query("""SELECT p_partkey AS id, coalesce((SELECT max(dpi) FROM (VALUES (300), (220), (160), (110), (72)) l(dpi) WHERE (p_size * p_partkey * dpi * dpi // 100 + 2) // 3 * 4 <= 20000000), 72) AS dpi FROM part""")
def dpi_ladder(spark: SparkSession, d: str) -> DataFrame:
    size = lambda dpi: F.floor(F.col("p_size") * F.col("p_partkey") * dpi * dpi / 100).cast("bigint")
    return V.read(spark, d, "part").select(F.col("p_partkey").alias("id"), B.first_fitting_dpi(size, 20_000_000).alias("dpi"))


@query("SELECT item_id AS id, 'М: ' || text || 'Я' AS text FROM benchmark")
def glyph_repair(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("/uni041C: "), F.col("text"), F.lit("/uni042F"))
    return V.read(spark, d, "benchmark").select(F.col("item_id").alias("id"), T.glyphs_repaired(raw).alias("text"))


@query("SELECT doc_id AS id, length(text) < 20 * (doc_id % 60) AS scan FROM documents")
def scan_detect(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.length("text") < 20 * (F.col("doc_id") % 60)).alias("scan"))


@query("SELECT event_id AS id, CASE WHEN event_id % 7 > 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' (' || 1800000000 - epoch_us(ts) // 1000000 || ' s ago)' END AS last FROM events")
def time_ago(spark: SparkSession, d: str) -> DataFrame:
    at = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return V.read(spark, d, "events").select(F.col("event_id").alias("id"), X.ago(F.when(F.col("event_id") % 7 > 0, at), F.lit(1_800_000_000)).alias("last"))


@query()
def url_ascii(spark: SparkSession, d: str) -> DataFrame:
    """Addresses as they go over the wire: host in IDNA, path and query percent-encoded, no fragment."""
    pages = V.read(spark, d, "pages").select("page_id", F.concat(F.replace("url", F.lit(".example."), F.lit(".пример.")), F.lit("/путь?к=1#x")).alias("url"))
    return pages.select("page_id", B.ascii_url("url").alias("url"))
