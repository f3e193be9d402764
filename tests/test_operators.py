"""Operators on small literals: cases of pool, trust, results, pages and corpora."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from gleanwise.functions import text as T
from gleanwise.functions import urls as U
from gleanwise.functions import verdicts as X
from gleanwise.operators import corpus, html, markup, observe, results, state
from gleanwise.operators.graph import components

PROBES = "id int, ts int, engine string, query string, results int, relevant int, hit int, category string, latency int, verdict string"


def probes(spark, *fills):
    """Each fill: engine, probes, hits, newest first."""
    rows, i = [], 0
    for engine, n, hits in fills:
        for k in range(n):
            i += 1
            rows.append((i, 100_000 - 60 * k, engine, f"q{k % 4}", 8, 8, int(k < hits), "general", 300, "ok"))
    return spark.createDataFrame(rows, PROBES)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_rating_needs_observations(spark):
    got = observe.rating(probes(spark, ("veteran", 120, 100), ("newcomer", 2, 2))).collect()
    assert [r["engine"] for r in got] == ["veteran"]


def test_rating_order(spark):
    df = observe.rating(probes(spark, ("worst", 100, 30), ("middling", 100, 60), ("best", 100, 95)))
    assert [r["engine"] for r in df.orderBy(*observe.by_rating()).collect()] == ["best", "middling", "worst"]


def test_family_cap(spark):
    fills = [(f"shop{i}", 60, 59 - i) for i in range(4)] + [(f"own{i}", 60, 40 - i) for i in range(4)]
    rated = observe.rating(probes(spark, *fills))
    family = spark.createDataFrame([(f"shop{i}", "shop0") for i in range(4)], "engine string, family string")
    got = {r["engine"]: r["why_not"] for r in observe.breakdown(rated, family, size=6).collect()}
    assert [e for e, why in got.items() if not why and e.startswith("shop")] == ["shop0", "shop1"]
    assert got["shop2"] == "family cap" and sum(not w for w in got.values()) == 6


def test_breakdown_is_the_walk(spark):
    import random

    r = random.Random(1)
    for _ in range(5):
        fills = [(f"e{i:02d}", 40, r.randint(0, 40)) for i in range(15)]
        family = {f"e{i:02d}": f"f{r.randint(0, 4)}" for i in range(15)}
        rated = observe.rating(probes(spark, *fills))
        got = {x["engine"]: x["in_pool"] for x in observe.breakdown(rated, spark.createDataFrame(list(family.items()), "engine string, family string"), 6, 2).collect()}
        pool, used = [], {}
        for e, n, h in sorted(fills, key=lambda x: (-x[2] / x[1], x[0])):
            if len(pool) < 6 and used.get(family[e], 0) < 2:
                pool.append(e)
                used[family[e]] = used.get(family[e], 0) + 1
        assert {e for e, inside in got.items() if inside} == set(pool)


def test_families(spark):
    urls = [(e, q, f"https://{s}.example/{q}/{i}") for e, s in (("a", "ab"), ("b", "ab"), ("c", "c")) for q in ("x", "y", "z") for i in range(8)]
    got = {r["engine"]: r["family"] for r in observe.families(spark.createDataFrame(urls, "engine string, query string, url string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "c"}


def test_trust_recovers_and_breaks(spark):
    old = [(0, 1, "recovered", "q", 8, 8, 0, "general", 1, "miss")]
    rows = old + [(i, 100_000 - 60 * i, "recovered", "q", 8, 8, 1, "general", 1, "ok") for i in range(1, 13)]
    rows += [(20 + i, 100_000 - 60 * i, "broke", "q", 8, 8, int(i > 0), "general", 1, "ok") for i in range(12)]
    rows += [(40 + i, 5, "short", "q", 8, 8, 1, "general", 1, "ok") for i in range(2)]
    df = spark.createDataFrame(rows, PROBES)
    judged = observe.trust(df, df.select("query"))
    assert {r["engine"]: r["trust"] for r in judged.collect()} == {"recovered": "clean", "broke": "substitutes", "short": "candidate"}
    engines = spark.createDataFrame([("broke",), ("never",), ("new",)], "engine string")
    never = spark.createDataFrame([("never",), ("broke",)], "engine string")
    got = {r["engine"]: r["trust"] for r in observe.trust_labels(engines, judged, never).collect()}
    assert got == {"broke": "substitutes", "never": "unavailable", "new": "not_checked"}


def test_dead_zone():
    shares = {f"e{i}": 0.9 - 0.01 * i for i in range(8)} | {"e8": 0.91}
    now, want = [f"e{i}" for i in range(8)], ["e8"] + [f"e{i}" for i in range(7)]
    assert set(state.swapped(now, want, shares)) == set(now)
    assert state.swapped(now, want, shares | {"e7": 0.3})[0] == "e8"


def test_hijacked(spark):
    columns = "query string, engine string, pos int, rank int, url string, title string, snippet string"
    rows = [
        ("Ghost Automotive registration", "yandex", 0, 0, "https://a.org/1", "GA Ltd, Sheffield", "Ghost Automotive"),
        ("Ghost Automotive registration", "privacywall", 1, 0, "https://a.org/1", "GA Ltd, Sheffield", "Ghost Automotive"),
        ("Ghost Automotive registration", "bing", 2, 0, "https://b.org/", "Windows help", ""),
        ("who", "bing", 2, 0, "https://c.org/", "Speedtest", ""),
    ]
    df = spark.createDataFrame(rows, columns)
    judged = results.relevant_engines(df)
    bad = {(r["query"], r["engine"]) for r in judged.where("NOT relevant").collect()}
    assert bad == {("Ghost Automotive registration", "bing")}
    kept = {r["url"] for r in results.drop_hijacked(results.merge_witnesses(df), judged).collect()}
    assert kept == {"https://a.org/1", "https://c.org/"}


def test_sweep_is_the_loop(spark):
    import random

    r = random.Random(2)
    rows = [("q", f"e{p}", p, k, f"u{r.randint(0, 30)}", "t", "s") for p in range(8) for k in range(6)]
    df = spark.createDataFrame(rows, "query string, engine string, pos int, rank int, url string, title string, snippet string")
    seen, asked = [], []
    for p in range(8):
        if len(seen) >= 15:
            break
        asked.append(p)
        for row in rows:
            if row[2] == p and row[4] not in seen:
                seen.append(row[4])
    assert sorted(x["pos"] for x in results.sweep(df, 15).where("asked").collect()) == asked
    assert [x["url"] for x in results.sweep_results(df, 15).orderBy("place").collect()] == seen[:15]


@pytest.mark.parametrize(
    ("text", "raw", "code", "reason"),
    [
        ("Page not found " + "x" * 3000, "", 200, "no such page"),
        ("y" * 1200, "captcha cloudflare", 200, None),
        ("short", "<input captcha>", 200, "shield"),
        ("short", "z" * 20_001 + "captcha", 200, None),
        ("short", "subscribe to continue", 200, "paywall"),
        ("short", "z" * 50_001, 200, "markup"),
        ("short", "", 403, "code"),
        ("y" * 1900, "", 403, None),
        ("short", "", 500, None),
    ],
)
def test_stub_order(spark, text, raw, code, reason):
    assert value(spark, T.stub_reason(F.lit(text), F.lit(raw), F.lit(code))) == reason


def test_page_status(spark):
    of = lambda stub, code, text, kind=True, stale=False: value(spark, T.page_status(F.lit(stub), F.lit(code), F.lit(text), F.lit(kind), F.lit(stale)))
    assert [of(None, 403, "y"), of(None, 403, "y", stale=True), of("x", 403, ""), of(None, 200, " "), of(None, 200, "y"), of(None, 200, "y", kind=False)] == ["refused", "read", "stub", "empty", "read", "forbidden"]


def test_near_each_other(spark):
    text = "Method-A 28.4 41.8 " + "x" * 50 + " Method-B 99.9"
    near = lambda a, b, t=text: value(spark, T.near_each_other(F.lit(t), F.lit(a), F.lit(b), 20))
    assert near("Method-A", "28.4") and not near("Method-A", "99.9") and not near("Method-A", "none")
    assert near("Method-B", "28.4", "28.4 " + text + " 28.4")
    assert value(spark, T.positions(F.lit("aaa"), F.lit("aa"))) == [0, 1] and value(spark, T.positions(F.lit("abc"), F.lit(""))) == []


def test_dates_and_conflicts(spark):
    pages = [("q", i, f"https://s{i}.org/", f"Kimi K2.6 вышла {20 + i // 2} апреля 2026 года", 30) for i in range(4)]
    pages += [("q", 9, "https://far.org/", "Kimi " + "x" * 700 + " 1 мая 2020", 700)]
    df = spark.createDataFrame(pages, "question string, id int, url string, text string, chars int")
    got = corpus.date_conflicts(df, F.array(F.lit("Kimi"), F.lit("K2.6"))).orderBy("value").collect()
    assert [(r["value"], r["sources"]) for r in got] == [("2026-04-20", 2), ("2026-04-21", 2)]
    assert corpus.date_conflicts(df.where("id < 3"), F.array(F.lit("Kimi"))).count() == 0
    assert corpus.date_conflicts(df, F.array().cast("array<string>")).count() == 0
    dates = lambda t: value(spark, T.dates_near(F.lit(t), F.array(F.lit("m"))))
    assert dates("m 3 марта 2020 и 4 Мая 2021, 2026-99-99") == ["2020-03-03", "2021-05-04", "2026-99-99"]
    assert dates("2026-01-01 without") == [] and dates("") == []


def test_namesakes(spark):
    a, b = "корпус металл шкаф сервер стойка", "розница магазин одежда обувь скидка"
    pages = [("q", i, a if i < 3 else b, 30) for i in range(6)] + [("one", 10 + i, a, 30) for i in range(5)] + [("one", 20, "совсем другое содержание страницы", 30), ("q", 30, None, 0)]
    df = spark.createDataFrame(pages, "question string, id int, text string, chars int")
    got = corpus.namesake_groups(df, F.array(F.lit("Powercase")))
    assert {(r["id"], r["group"]) for r in got.collect()} == {(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 3)}
    markers = spark.createDataFrame([("q", "шкаф"), ("q", "обувь")], "question string, marker string")
    assert corpus.question_structure(got, df, markers).first()["structure"]
    assert not corpus.question_structure(got, df, markers.limit(1)).first()["structure"]


def test_outcome(spark):
    rows = [("none", 0, True), ("found", 5, True), ("off", 5, False), ("unknown", 5, True)]
    df = spark.createDataFrame(rows, "question string, chars int, markers_hit boolean")
    got = {r["question"]: r["outcome"] for r in corpus.outcome(df, F.col("question") != "unknown").collect()}
    assert got == {"none": "not_found", "found": "found", "off": "off_target", "unknown": "unknown"}


def test_window_takes_markers_together():
    text = "acme " * 300 + "z" * 20_000 + "acme 2024 revenue" + "z" * 9_000
    got = corpus.densest_window(text, ["acme", "2024", "revenue"])
    assert "acme 2024 revenue" in got and len(got) == corpus.WINDOW
    assert corpus.densest_window("abc", []) == "abc" and corpus.densest_window("", ["x"]) == ""


def test_markers_from_question(spark):
    got = lambda q: value(spark, T.markers_from_question(F.lit(q)))
    assert got("What is the revenue of Tesla in 2025") == ["Tesla", "2025"]
    assert got("Когда вышла Kimi K2.6?") == ["Kimi", "K2.6"]
    assert got("Где Сбербанк") == ["Сберба"]
    assert got("what is http") == []


def test_plans(spark):
    got = lambda a: value(spark, corpus.parse_plan(F.lit(a), F.lit("Q")))
    assert got('{"queries": ["a"], "markers": ["m"]}').asDict() == {"queries": ["a"], "markers": ["m"], "bad_format": False}
    assert got('["a", "b"]').asDict() == {"queries": ["a", "b"], "markers": [], "bad_format": True}
    assert got("nothing").asDict() == {"queries": ["Q"], "markers": [], "bad_format": True}


def test_urls(spark):
    of = lambda f, u: value(spark, f(F.lit(u)))
    assert of(U.domain, "HTTPS://WWW.Example.ORG:8080/x") == "example.org"
    assert of(U.domain, "no address") == "" and of(U.domain, "https://user:pw@h/") == "user"
    assert of(U.unwrap_redirect, "https://go.example.com?id=1&url=https%3A%2F%2Fa.org%2Fx") == "https://a.org/x"
    assert of(U.unwrap_redirect, "https://a.org/?url=/local") == "https://a.org/?url=/local"
    assert of(U.url_policy, "http://192.168.1.1/") == "internal" and of(U.url_policy, None) == "empty address"
    robots = lambda rules, p: value(spark, U.robots_verdict(F.lit(rules), F.lit(p)))
    assert robots("User-agent: *\nDisallow: /disallowed", "/disallowed/here") == "disallowed_by_site"
    assert robots("User-agent: other\nDisallow: /", "/x") == "allowed" and robots(None, "/") == "not_checked"


def test_flags_and_numbers(spark):
    flag = lambda v, given=True: value(spark, X.flag(F.lit(v).cast("string"), F.lit(given), True)).asDict()
    assert flag("off") == {"value": False, "adjusted": False} and flag("?") == {"value": False, "adjusted": True}
    assert flag(None) == {"value": False, "adjusted": True} and flag(None, False) == {"value": True, "adjusted": False}
    of = lambda n: value(spark, X.flag(F.lit(str(n)), F.lit(True), True, F.lit(n))).asDict()
    assert [of(n) for n in (2, 0, 0.0, -1.5)] == [{"value": v, "adjusted": False} for v in (True, False, False, True)]
    assert value(spark, X.ago(F.lit(86_461.5), F.lit(86_465))) == "1970-01-02T00:01:01Z (3 s ago)" and value(spark, X.ago(F.lit(None).cast("double"), F.lit(1))) is None
    number = lambda v: value(spark, X.number(F.lit(v).cast("string"), 1, 10, 6))["value"]
    assert [number("99"), number("-1"), number("x"), number(None)] == [10, 1, 6, 6]


PAGE = """<!doctype html><html lang="ru"><head><title>A &amp;amp; B</title><link rel="canonical" href="/c">
<script type="application/ld+json">{"@graph": [{"datePublished": "2024-05-06"}]}</script></head>
<body><nav><a href="/menu">menu</a></nav><h2>Head</h2><p>One <a href="/x">two\n three</a></p><ul><li>item</ul>
<table><tr><td>a<td>b</table><form>no</form><footer>foot</footer></body></html>"""


def test_page_reading():
    got = html.read_page(PAGE, "https://h.org/d/")
    assert got["title"] == "A & B" and got["lang"] == "ru" and got["canonical"] == "https://h.org/c" and got["published"] == "2024-05-06"
    assert got["links"] == [("https://h.org/x", "two three")]
    assert got["text"].split() == "Head One two three item a b".split()
    assert "## Head" in got["markdown"] and "[two\n three](https://h.org/x)" in got["markdown"] and "- item" in got["markdown"]
    assert html.read_page(None, None)["text"] == ""


@pytest.mark.parametrize("source", ["<a " * 100_000, '<a b="' * 50_000, "<!--" * 100_000, '<script type="application/ld+json">' + "[" * 100_000, "&#" + "9" * 9000 + ";", "<a href='http://[x'>y</a>", "<script type='application/ld+json'>" + '{"a":' * 50_000])
def test_no_page_kills_the_reader(source):
    """Broken tags, deep JSON, endless numbers and bad addresses: read in little time, without an error."""
    began = time.process_time()
    got = html.read_page(source, "https://h.org/")
    assert time.process_time() - began < 10 and got["published"] == "" and got["links"] == []


def test_dates_in_json():
    """Own dates come before those within, later branches before earlier ones."""
    value = {"x": {"datePublished": "a"}, "dateCreated": "b", "y": [{"uploadDate": "c"}, {"z": {"datePublished": "d"}}]}
    assert list(html.dates_in(value)) == ["b", "d", "c", "a"]


def test_markup():
    told = [(k, v) for k, v, _ in markup.tokens("a<b c='x>y' C=2>&lt;</B ><br/>1 < 2<script>if (a</b>) '</x'</script >z<!-- q -->&amp")]
    assert told == [("data", "a"), ("start", "b"), ("data", "<"), ("end", "b"), ("start", "br"), ("end", "br"), ("data", "1 "), ("data", "<"), ("data", " 2"), ("start", "script"), ("raw", "if (a</b>) '</x'"), ("end", "script"), ("data", "z"), ("data", "&")]
    assert [f for _, _, f in markup.tokens("<a b='x>y&amp;' B=2 c d=e/>")][0] == {"b": "x>y&", "c": "", "d": "e/"}


def test_stub_detail(spark):
    told = lambda t, raw, code: value(spark, T.stub_detail(F.lit(t), F.lit(raw), F.lit(code)))
    assert told("Page not found", "", 200) == "at the start of the text: 'page not found'" and told("x", "<div id=captcha>", 200) == "shield marker: 'captcha'"
    assert told("x", "y" * 60_000, 200) == "60000 bytes of markup for 1 characters of text" and told("x", "", 403) == "status 403 and 1 characters of text"
    assert told("long " * 2000, "", 200) is None


def test_ledger(spark):
    lines = ['{"ts":1,"model":"m","in":10,"out":5,"cached":null}', '{"ts":2,"model":"m","in":1,"out":1}', '{"ts":3,"model":"n","in":1,"out":1,"cached":0}', "{broken"]
    got = {r["model"]: r for r in state.ledger(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert (got["m"]["calls"], got["m"]["tokens_in"], got["m"]["cached_reported"], got["m"]["cost"]) == (2, 11, False, None)
    assert got["n"]["cached_reported"] and got[None]["calls"] == 1
    other = ['{"ts":1,"in":3,"out":1}', '{"ts":1,"model":"","in":4,"out":1}', "  ", "[1", "{}"]
    got = {r["model"]: r for r in state.ledger(spark.createDataFrame([(x,) for x in other], "value string")).collect()}
    assert (got["?"]["calls"], got["?"]["tokens_in"], got[None]["calls"], len(got)) == (3, 7, 1, 2)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_partition_count_does_not_matter(spark, folder):
    from gleanwise.plans import QUERIES

    for name in ("engine_health_full", "sweep_results", "pacing_admit"):
        one = sorted(map(str, QUERIES[name](spark, folder).collect()))
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        try:
            assert sorted(map(str, QUERIES[name](spark, folder).collect())) == one
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)


def test_wave_pick_is_the_walk(spark):
    import random

    r = random.Random(6)
    rows = [(f"q{r.randint(0, 1)}", r.randint(0, 3), k, f"u{r.randint(0, 60)}", f"d{r.choice([0, 0, 0, 1, 2, 3, 4])}") for k in range(400)]
    rows = [(q, n, k, f"{u}.{d}", d) for q, n, k, u, d in rows] + [("q0", 0, -1, "", "d1")]
    df = spark.createDataFrame(rows, "question string, query int, rank int, url string, domain string")
    want = []
    for question in ("q0", "q1"):
        seen, of_domain, taken = set(), {}, {}
        for q, n, k, u, d in sorted((x for x in rows if x[0] == question), key=lambda x: (x[1], x[2], x[3])):
            if u and taken.get(n, 0) < 4 and u not in seen and of_domain.get(d, 0) < 2:
                seen.add(u)
                of_domain[d] = of_domain.get(d, 0) + 1
                taken[n] = taken.get(n, 0) + 1
                want.append((q, n, k, u))
    assert sorted((x["question"], x["query"], x["rank"], x["url"]) for x in corpus.wave_pick(df).collect()) == sorted(want)


def test_windows_are_made_by_slices(spark):
    """What a batch of texts needs beside itself is its windows, not an object for each text and marker."""
    import tracemalloc

    import pyarrow as pa

    text = pa.array(["acme " + "x" * 3000] * 9_999 + [None])
    markers = pa.array([["acme", "none"]] * 10_000)
    tracemalloc.start()
    got = corpus.marker_window.func(text, markers)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 10_000 and got[0].as_py().startswith("acme") and got[9_999].as_py() == "" and most < 8_000_000
