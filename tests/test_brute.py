"""Queries that SQL can't express, over whole tables, against plain Python."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from urllib.parse import quote, urlsplit

from pyspark.sql import functions as F

from gleanwise.plans import QUERIES, corpora
from gleanwise.sources import views as V


def test_marker_window(spark, folder):
    def window(text):
        low = text.lower()
        spots = []
        for number, marker in enumerate(corpora._MARKERS):
            at, found = 0, 0
            while (at := low.find(marker, at)) >= 0 and found < 200:
                spots.append((at, number))
                at, found = at + len(marker), found + 1
        if not spots:
            return text[:6000]
        score = lambda s: (len({n for a, n in spots if s <= a < s + 4500}), sum(s <= a < s + 4500 for a, _ in spots))
        starts = sorted({a for a, _ in spots})
        best = max(starts, key=lambda s: (score(s), -s))
        begin = max(0, best - 1500)
        return text[begin : begin + 6000]

    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: window(r["text"] or "") for r in rows}
    got = {r["id"]: (r["chars"], r["digest"]) for r in QUERIES["marker_window"](spark, folder).collect()}
    assert got == {i: (len(w), hashlib.md5(w.encode()).hexdigest()) for i, w in want.items()}


def walked(rows):
    """The links that a wave reads: four for a query and two from a domain at most, each once."""
    seen, of_domain, of_query, out = set(), Counter(), Counter(), []
    for question, query, rank, url, domain in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        if url and (question, url) not in seen and of_query[question, query] < 4 and of_domain[question, domain] < 2:
            seen.add((question, url))
            of_query[question, query] += 1
            of_domain[question, domain] += 1
            out.append((question, query, rank, url, domain))
    return out


def test_waves(spark, folder):
    rows = [tuple(r[c] for c in ("question", "query", "rank", "url", "domain")) for r in corpora._wave_results(spark, folder).collect()]
    picked = walked(rows)
    assert sorted(tuple(r) for r in QUERIES["wave_pick"](spark, folder).select("question", "query", "rank", "url", "domain").collect()) == sorted(picked)
    wanted = {(q, u) for q, _, _, u, _ in picked}
    want = []
    for r in V.sources(spark, folder).collect():
        if (r["question"], r["url"]) in wanted:
            places = [r["text"].lower().find(m) for m in corpora._MARKERS[:2]]
            hit = min(places) >= 0 and max(places) - min(places) <= 1500
            want.append((r["question"], r["url"], r["chars"], hit, r["domain"].endswith(".sec.gov")))
    assert want and sorted(map(tuple, QUERIES["wave_sources"](spark, folder).collect())) == sorted(want)


def test_pool_recompute(spark, folder):
    probes = V.probes(spark, folder).where(F.col("ts") >= V.NOW_S - V.WINDOW_S).collect()
    want = []
    for category, current in (("general", ["e11", "e10", "e3", "e2", "e1", "e5", "e6", "e7"]), ("images", None)):
        n, hits, links = Counter(), Counter(), Counter()
        for r in probes:
            if (r["category"] or "general") == category:
                n[r["engine"]] += 1
                hits[r["engine"]] += r["hit"] or 0
                links[r["engine"]] += r["results"]
        share = {e: hits[e] / n[e] for e in n if n[e] >= 5}
        wanted = sorted(share, key=lambda e: (-share[e], -links[e] / n[e], e))[:8]
        pool = wanted
        if current is not None:
            pool = list(current)
            for engine in wanted:
                stale = [e for e in pool if e not in wanted]
                if engine in current or not stale:
                    continue
                worst = min(stale, key=lambda e: share.get(e, -1))
                if share[engine] - share.get(worst, -1) >= 0.10:
                    pool[pool.index(worst)] = engine
            pool = sorted(pool, key=lambda e: -share.get(e, 0))
        want += [(category, k, e) for k, e in enumerate(pool, 1)]
    got = QUERIES["pool_recompute"](spark, folder).select("category", "place", "engine").collect()
    assert sorted((c, int(k), e) for c, k, e in got) == sorted(want)


def test_addresses_in_ascii(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url").collect()
    want = {}
    for r in pages:
        if r["url"] is None:
            want[r["page_id"]] = None
            continue
        x = urlsplit(r["url"].replace(".example.", ".пример.") + "/путь?к=1#x")
        host = ".".join(label if label.isascii() else "xn--" + label.encode("punycode").decode() for label in x.hostname.split("."))
        keep = "/%:@!$&'()*+,;=~-._"
        query = f"?{quote(x.query, safe=keep + '?')}" if x.query else ""
        want[r["page_id"]] = f"{x.scheme}://{host}{quote(x.path, safe=keep)}{query}"
    assert {r["page_id"]: r["url"] for r in QUERIES["url_ascii"](spark, folder).collect()} == want


def test_markdown_is_the_text_with_marks(spark, folder):
    """Headings, items and links are marked; without the marks it is the text."""
    import re

    text = {r["page_id"]: r["text"] for r in QUERIES["html_text"](spark, folder).collect()}
    rows = QUERIES["html_markdown"](spark, folder).collect()
    plain = lambda x: re.sub(r"\]\(https?://[^)\s]*\)|[\[\]#]|\s", "", x)
    assert {r["page_id"]: plain(r["markdown"]) for r in rows} == {i: re.sub(r"[\[\]#]|\s", "", t) for i, t in text.items()}
    marks = Counter(bool(re.search(r"^# ", r["markdown"], re.M)) and "](https://other.example.com/x)" in r["markdown"] for r in rows)
    assert marks[True] > 0.9 * len(rows)


def test_stub_details(spark, folder):
    """A page has a detail if and only if it is a stub, of the same kind."""
    kinds = {r["id"]: r["stub"] for r in QUERIES["stub_check"](spark, folder).collect()}
    begins = {"no such page": "at the start of the text: '", "shield": "shield marker: '", "paywall": "paywall: '", "code": "status "}
    seen = defaultdict(int)
    for r in QUERIES["stub_detail"](spark, folder).collect():
        kind = kinds[r["id"]]
        assert (r["detail"] is None) == (kind is None)
        if kind is not None:
            assert r["detail"].startswith(begins[kind]) if kind in begins else "bytes of markup" in r["detail"]
            seen[kind] += 1
    assert len(seen) >= 3
