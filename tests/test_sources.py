"""Tables on disk: pruned scans, added columns, the ledger, recorded answers."""

from __future__ import annotations

import gzip
import json
import zlib

import pytest
from pyspark.sql import functions as F

from gleanwise.functions import binary as B
from gleanwise.operators import state
from gleanwise.sources import tables


def test_append_and_scan(spark, tmp_path):
    path = str(tmp_path / "probes")
    rows = [(d * 86_400 + 5, "e", "q", "ok", 1, 1, 10, 1, None if d % 2 else "images") for d in range(10)]
    df = spark.createDataFrame(rows, "ts bigint, engine string, query string, verdict string, results int, relevant int, latency_ms int, hit int, category string")
    tables.append(df.where("ts < 400000"), path, "probes")
    tables.append(df.where("ts >= 400000").drop("category"), path, "probes")
    assert tables.scan(spark, path, "probes").count() == 10
    late = tables.scan(spark, path, "probes", since=8 * 86_400)
    assert late.count() == 2 and {r["category"] for r in late.collect()} == {None}
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "GreaterThanOrEqual(ts,691200)" in plan
    assert tables.scan(spark, path, "probes", category="images").count() == 3
    assert tables.scan(spark, path, "probes").columns == [x.split()[0] for x in tables.SCHEMAS["probes"].split(", ")]


def test_ledger_file(spark, tmp_path):
    path = str(tmp_path / "ledger")
    calls = spark.createDataFrame([(1, "p", "m", 10, 5), (2, "p", "m", 1, 1)], "ts int, provider string, model string, `in` int, `out` int")
    assert tables.append_ledger(calls, path)
    with pytest.warns(UserWarning, match="was not written"):  # a file stands where the ledger's folder should be
        (tmp_path / "file").write_text("")
        assert not tables.append_ledger(calls, str(tmp_path / "file" / "ledger"))
    (tmp_path / "ledger" / "part-broken.json").write_text("{broken\n")
    got = {r["model"]: r for r in state.ledger(tables.ledger_lines(spark, path), 1.0, 2.0).collect()}
    assert (got["m"]["calls"], got["m"]["tokens_in"], got["m"]["cost"]) == (2, 11, 0.023) and got[None]["calls"] == 1


def test_recorded_answers(spark, tmp_path):
    body = {"results": [{"url": "https://a.org/", "title": " A \n b", "content": "x" * 400, "engines": ["1", "2", "3", "4"]}, {"url": "mailto:x"}, {"url": "https://c.org/"}]}
    (tmp_path / "one.json").write_text(json.dumps(body))
    (tmp_path / "none.json").write_text("{}")
    spark.dataSource.register(tables.RecordedAnswers)
    got = spark.read.format("recorded_answers").load(str(tmp_path)).orderBy("rank").collect()
    assert [(r["url"], r["title"], len(r["snippet"]), r["engines"]) for r in got] == [("https://a.org/", "A b", 300, ["1", "2", "3"]), ("https://c.org/", "", 0, [])]


def test_bodies(spark, monkeypatch):
    raw = b"page " * 10
    rows = [(gzip.compress(raw), "gzip"), (zlib.compress(raw), "deflate"), (zlib.compress(raw)[2:-4], "deflate"), (raw, None), (b"broken", "gzip"), (raw, "br"), (gzip.compress(b"0" * (B.CEILING + 10)), "gzip"), (None, None)]
    df = spark.createDataFrame(rows, "body binary, encoding string").select(B.unpacked("body", "encoding").alias("x")).select("x.*")
    got = [(r["ok"], r["truncated"], None if r["body"] is None else len(r["body"])) for r in df.collect()]
    assert got == [(True, False, 50)] * 4 + [(False, False, None)] * 2 + [(True, True, B.CEILING), (True, False, None)]


def test_charsets(spark):
    rows = [("Привет".encode("cp1251"), "text/html"), ("Привет".encode(), None), ('<meta charset="windows-1251">Привет'.encode("cp1251"), "text/html"), ("é".encode("latin-1"), "text/html; charset=latin-1"), (b"x", "text/html; charset=nonsense"), (None, None)]
    df = spark.createDataFrame(rows, "body binary, kind string").select(B.decoded("body", "kind").alias("t"))
    assert [r["t"] for r in df.collect()] == ["Привет", "Привет", '<meta charset="windows-1251">Привет', "é", "x", None]


def test_images(spark):
    png = F.unhex(F.lit("89504E470D0A1A0A0000000D49484452000001400000007B08"))
    row = spark.range(1).select(B.png_width(png).alias("w"), B.png_height(png).alias("h"), B.png_width(F.lit(b"no")).alias("n")).first()
    assert (row["w"], row["h"], row["n"]) == (320, 123, None)


def test_pdf_files(spark, tmp_path):
    """Pages up to the most, glyph names, blank runs; a file that can't be read says why; other files are left alone."""
    from gleanwise.sources.files import pdf_texts

    (tmp_path / "a.pdf").write_bytes(b"/uni041Cir  x\n\n\n\ny|two|three")
    (tmp_path / "b.PDF").write_bytes(b"!")
    (tmp_path / "c.txt").write_bytes(b"no")

    def parser(body, most):
        if body == b"!":
            raise ValueError("no such format")
        pages = body.decode().split("|")
        return len(pages), pages[:most]

    got = {r["path"].rsplit("/", 1)[1]: tuple(r)[1:] for r in pdf_texts(spark, str(tmp_path), 2, parser).collect()}
    assert got == {"a.pdf": (3, 2, True, "Мir x\n\ny\ntwo", ""), "b.PDF": (None, 0, False, "", "ValueError: no such format")}


def test_page_links_says_what_it_needs(spark):
    from pyspark.errors import AnalysisException

    from gleanwise.operators import tables

    tables.register(spark)
    spark.range(1).createOrReplaceTempView("no_pages")
    with pytest.raises(AnalysisException, match="no column page_id, url, html, host, block"):
        spark.sql("SELECT * FROM page_links(TABLE(no_pages))")
    with pytest.raises(AnalysisException, match="takes a table"):
        spark.sql("SELECT * FROM page_links(1)")
