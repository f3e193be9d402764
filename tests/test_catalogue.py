"""Every query of the catalogue against its SQL in DuckDB, or for rows where SQL can't say it."""

from __future__ import annotations

import pytest
from helpers import told

from gleanwise.plans import QUERIES, SQL

#: Queries whose plan runs Python on purpose: parsers, codecs, ordered walks, streaming state.
PYTHON = {"html_text", "html_markdown", "html_meta", "html_links", "page_links", "charset_detect", "url_ascii", "marker_window", "wave_pick", "wave_sources", "pool_recompute", "pacing_admit", "cooldown_admit", "cache_evict", "sweep_paced", "pool_history", "rare_schedule", "cache_replay", "stream_trust"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, duck, name):
    df = QUERIES[name](spark, folder)
    if name not in PYTHON and not name.startswith("stream_"):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    columns = sorted(df.columns)
    got = told(df.select(*columns).collect(), columns)
    if name not in SQL:
        assert got  # test_brute holds these against plain Python
        return
    found = duck.sql(SQL[name])
    assert sorted(found.columns) == columns
    rows = [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]
    assert got == told(rows, columns)


def test_scan_pushes_down(spark, folder):
    from pyspark.sql import functions as F

    from gleanwise.sources import views

    df = views.read(spark, folder, "events").where(F.col("event_type") == "error").select("event_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in plan
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in plan


def test_catalogue_contract():
    import __spark_entry__ as e

    assert set(SQL) <= set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
