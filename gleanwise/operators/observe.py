"""Analytics over observation tables: ratings, health, trust, latest rows, families, the pool.

`now` and the window are always parameters, in seconds. No data means "not checked", never "sound".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components, spread_join

#: Least observations of a rated engine, places in the pool, places of a family, dead zone of a swap.
LEAST_PROBES, POOL_SIZE, FAMILY_CAP, DEAD_ZONE = 20, 8, 2, 0.10

#: Containment of a family, queries that must agree, links an engine must have, observations that decide trust.
FAMILY_OVERLAP, LEAST_QUERIES, LEAST_LINKS, TRUST_LAST = 0.6, 3, 5, 10

#: Probes of a rare engine are due after so many seconds.
RARE_S = 86_400


def in_window(rows: DataFrame, now: int, window: int, category: str | None = None) -> DataFrame:
    """Rows of the last `window` seconds; rows without a category count as general."""
    out = rows.where(F.col("ts") >= now - window)
    return out if category is None else out.where(F.coalesce("category", F.lit("general")) == category)


def rating(probes: DataFrame, least: int = LEAST_PROBES) -> DataFrame:
    """engine, probes, hits, share, links_avg of engines with at least `least` probes, unrounded."""
    counted = probes.groupBy("engine").agg(
        F.count(F.lit(1)).alias("probes"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.sum("results").alias("links")
    )
    counted = counted.where(F.col("probes") >= least)
    return counted.select("engine", "probes", "hits", (F.col("hits") / F.col("probes")).alias("share"), (F.col("links") / F.col("probes")).alias("links_avg"))


def by_rating() -> list[Column]:
    """The order of a rating: share, then links, then name."""
    return [F.col("share").desc(), F.col("links_avg").desc(), F.col("engine")]


def health(probes: DataFrame) -> DataFrame:
    """For each engine: probes, by verdict, probes with relevant links, hits, mean latency (truncated), latest ts."""
    when = lambda v: F.count_if(F.col("verdict") == v)
    return probes.groupBy("engine").agg(
        F.count(F.lit(1)).alias("probes"),
        when("ok").alias("ok"),
        when("refused").alias("refused"),
        when("empty").alias("empty"),
        when("irrelevant").alias("irrelevant"),
        when("miss").alias("miss"),
        F.count_if((F.col("results") > 0) & (F.col("relevant") > 0)).alias("on_topic"),
        F.count_if(F.col("hit") == 1).alias("hits"),
        F.expr("CAST(sum(latency) DIV count(latency) AS BIGINT)").alias("latency_avg"),
        F.max("ts").alias("last_ts"),
    )


def trust(probes: DataFrame, confirmed: DataFrame, last: int = TRUST_LAST, category: str | None = None) -> DataFrame:
    """Each engine's verdict over its last `last` judged probes of confirmed references: clean, candidate or substitutes."""
    rows = probes if category is None else probes.where(F.coalesce("category", F.lit("general")) == category)
    rows = rows.join(confirmed.select("query").distinct(), "query", "left_semi")
    rows = rows.where("hit IS NOT NULL AND results > 0 AND relevant > 0")
    order = Window.partitionBy("engine").orderBy(F.col("ts").desc(), F.col("id").desc())
    rows = rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= last)
    told = rows.groupBy("engine").agg(F.count(F.lit(1)).alias("judged"), F.sum("hit").alias("hits"), (F.max("ts") - F.min("ts")).alias("span_s"))
    verdict = F.when(F.col("hits") < F.col("judged"), "substitutes").when(F.col("judged") >= 3, "clean").otherwise("candidate")
    return told.withColumn("trust", verdict)


def unavailable(probes: DataFrame) -> DataFrame:
    """Engines that never gave a relevant link."""
    return probes.groupBy("engine").agg(F.count_if((F.col("results") > 0) & (F.col("relevant") > 0)).alias("_n")).where("_n = 0").select("engine")


def trust_labels(engines: DataFrame, judged: DataFrame, never: DataFrame) -> DataFrame:
    """A label for each engine: its verdict, else unavailable if it never answered, else not_checked."""
    out = engines.join(judged.select("engine", "trust"), "engine", "left").join(never.withColumn("_never", F.lit(True)), "engine", "left")
    return out.select("engine", F.coalesce("trust", F.when(F.col("_never"), F.lit("unavailable")), F.lit("not_checked")).alias("trust"))


def latest(rows: DataFrame, keys: list[str], tie: str = "id") -> DataFrame:
    """The latest row of each key; ties go to the larger `tie`."""
    order = Window.partitionBy(*keys).orderBy(F.col("ts").desc(), F.col(tie).desc())
    return rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def latest_by_join(rows: DataFrame, keys: list[str]) -> DataFrame:
    """All rows that have their key's latest ts; ties give several rows."""
    last = rows.groupBy(*keys).agg(F.max("ts").alias("ts"))
    return rows.join(last, [*keys, "ts"])


def reading_state(reads: DataFrame, now: int, window: int) -> DataFrame:
    """For each (url, path) of the window: probes, hits, latest ts, mean latency, and of all time the latest status and expectation."""
    told = reads.where(F.col("ts") >= now - window).groupBy("url", "path")
    told = told.agg(
        F.count(F.lit(1)).alias("probes"),
        F.sum("hit").alias("hits"),
        F.max("ts").alias("last_ts"),
        F.expr("CAST(sum(latency) DIV count(latency) AS BIGINT)").alias("latency_avg"),
        F.max_by("expected", F.struct("ts", "id")).alias("expected"),
    )
    last = latest(reads, ["url", "path"]).select("url", "path", F.col("status").alias("last_status"))
    return told.join(last, ["url", "path"], "left").withColumn("last_status", F.coalesce("last_status", F.lit("")))


def path_alive(state: DataFrame) -> DataFrame:
    """For each path whether any of its probes hit."""
    told = state.groupBy("path").agg(F.sum("probes").alias("probes"), F.sum("hits").alias("hits"))
    return told.withColumn("state", F.when(F.col("hits") > 0, "alive").otherwise("unconfirmed"))


def query_urls(links: DataFrame) -> DataFrame:
    """The distinct links of each engine and query."""
    return links.where("url IS NOT NULL AND url <> ''").select("engine", "query", "url").distinct()


def containment(urls: DataFrame, least_links: int = LEAST_LINKS, least_queries: int = LEAST_QUERIES) -> DataFrame:
    """How much of engine a's links engine b also has, as the mean over queries where a has enough links and b has any.

    Pairs come from an equi-join on (query, url), so engines without a common link meet only in the counts.
    """
    own = urls.groupBy("engine", "query").agg(F.count(F.lit(1)).alias("n"))
    a, b = urls.select("query", "url", F.col("engine").alias("a")), urls.select("query", "url", F.col("engine").alias("b"))
    both = a.join(b, ["query", "url"]).where("a <> b").groupBy("a", "b", "query").agg(F.count(F.lit(1)).alias("common"))
    left = own.where(F.col("n") >= least_links).select(F.col("engine").alias("a"), "query", "n")
    pairs = left.join(own.select(F.col("engine").alias("b"), "query"), "query").where("a <> b").join(both, ["a", "b", "query"], "left")
    ratio = F.floor(F.coalesce("common", F.lit(0)) * 1_000_000 / F.col("n")).cast("bigint")
    told = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("queries"), F.sum(ratio).alias("sum_ppm"))
    return told.where(F.col("queries") >= least_queries)


def families(urls: DataFrame, overlap: float = FAMILY_OVERLAP, least_links: int = LEAST_LINKS) -> DataFrame:
    """engine, family (its smallest member). Engines with few links on average are families of their own."""
    sizes = urls.groupBy("engine").agg((F.count(F.lit(1)) / F.countDistinct("query")).alias("links"))
    known = sizes.where(F.col("links") >= least_links).select("engine")
    close = containment(urls, least_links).where(F.col("sum_ppm") >= overlap * 1_000_000 * F.col("queries"))
    close = close.join(known.withColumnRenamed("engine", "a"), "a", "left_semi").join(known.withColumnRenamed("engine", "b"), "b", "left_semi")
    groups = components(close, "a", "b").select(F.col("node").alias("engine"), F.col("component").alias("family"))
    return sizes.select("engine").join(groups, "engine", "left").select("engine", F.coalesce("family", "engine").alias("family"))


def overlap(urls: DataFrame) -> DataFrame:
    """For each engine: its distinct links, and how many of them another engine also has for the same query."""
    witnesses = urls.groupBy("query", "url").agg(F.countDistinct("engine").alias("w"))
    told = spread_join(urls.withColumn("_key", F.struct("query", "url")), witnesses.select(F.struct("query", "url").alias("_key"), "w"), "_key")
    return told.groupBy("engine").agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("w") >= 2).alias("shared"))


def breakdown(rated: DataFrame, family: DataFrame, size: int = POOL_SIZE, cap: int = FAMILY_CAP) -> DataFrame:
    """Each rated engine with its place: in the pool, or why not ("by share" or "family cap").

    The walk down the rating in closed form: an engine can enter if fewer than `cap` of its family stand before it, and
    does if fewer than `size` of those that can stand before it. A rating has a row for each engine, so one ordered
    window over it is small whatever the number of probes.
    """
    rows = rated.join(family, "engine", "left").withColumn("family", F.coalesce("family", "engine"))
    within = Window.partitionBy("family").orderBy(*by_rating())
    rows = rows.withColumn("_can", F.row_number().over(within) <= cap)
    before = Window.orderBy(*by_rating()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum(F.col("_can").cast("int")).over(before), F.lit(0)))
    place = F.row_number().over(Window.orderBy(*by_rating()))
    why = F.when(F.col("_before") >= size, "by share").when(~F.col("_can"), "family cap").otherwise("")
    return rows.select("engine", "family", "probes", "hits", place.alias("place"), (why == "").alias("in_pool"), why.alias("why_not"))


def latest_pool(history: DataFrame, seeds: DataFrame) -> DataFrame:
    """category, engines, source (observation or seed): the latest snapshot of each category, else its seed."""
    rows = history.withColumn("category", F.coalesce("category", F.lit("general")))
    last = rows.groupBy("category").agg(F.max_by("engines", F.struct("ts", "id")).alias("engines"))
    out = seeds.join(last, "category", "left")
    return out.select("category", F.coalesce("engines", "seed").alias("engines"), F.when(F.col("engines").isNull(), "seed").otherwise("observation").alias("source"))


def due(probes: DataFrame, engines: DataFrame, now: int, every: int = RARE_S) -> DataFrame:
    """Engines never probed, or not for `every` seconds, with the seconds since (null: never)."""
    last = probes.groupBy("engine").agg(F.max("ts").alias("last_ts"))
    out = engines.join(last, "engine", "left").withColumn("idle_s", now - F.col("last_ts"))
    return out.where(F.col("last_ts").isNull() | (F.col("idle_s") >= every)).select("engine", "idle_s")


def round_robin(engines: DataFrame, references: int, ticks: int) -> DataFrame:
    """The schedule of `ticks` probes: tick, engine, reference (its number); the reference moves on after each lap."""
    listed = engines.withColumn("_i", F.row_number().over(Window.orderBy("engine")) - 1)
    n = engines.select(F.count(F.lit(1)).alias("_n"))
    plan = engines.sparkSession.range(ticks).select(F.col("id").alias("tick")).join(F.broadcast(n))  # one row
    plan = plan.withColumns({"_i": F.col("tick") % F.col("_n"), "reference": F.floor(F.col("tick") / F.col("_n")) % references})
    return plan.join(listed, "_i").select("tick", "engine", "reference")


def bounded_keys(rows: DataFrame, key: str, most: int, other: str = "other") -> DataFrame:
    """Calls by key, where keys that came up after `most` others count as `other`.

    The first `most` keys are a top-k over the keys' first calls, so no task sorts all keys.
    """
    first = rows.groupBy(key).agg(F.min(F.struct("ts", "id")).alias("_first"), F.count(F.lit(1)).alias("calls"))
    named = first.orderBy("_first").limit(most).select(key, F.col(key).alias("_named"))
    out = first.join(F.broadcast(named), key, "left")  # `most` rows
    return out.groupBy(F.coalesce("_named", F.lit(other)).alias(key)).agg(F.sum("calls").alias("calls"))
