"""Result-set algebra over recorded answers: rows of (query, pos, engine, url, title, snippet, rank).

A query's answers are few (engines times results per engine), so windows by query stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U


def per_engine(answers: DataFrame, k: int) -> DataFrame:
    """The first `k` rows of each engine's answer."""
    place = F.row_number().over(Window.partitionBy("query", "engine").orderBy("rank", "url"))
    return answers.withColumn("_k", place).where(F.col("_k") <= k).drop("_k")


def sweep(answers: DataFrame, n: int, least_engines: int | None = None) -> DataFrame:
    """query, pos, engine, new_links, before, asked: engines are asked in order until `n` links are together.

    An engine brings the links that no engine before it has; it is asked if those before it brought fewer than `n`, or,
    with `least_engines`, if fewer engines than that stand before it.
    """
    first = answers.groupBy("query", "url").agg(F.min("pos").alias("pos")).groupBy("query", "pos").agg(F.count(F.lit(1)).alias("new_links"))
    out = answers.select("query", "pos", "engine").distinct().join(first, ["query", "pos"], "left").na.fill({"new_links": 0})
    order = Window.partitionBy("query").orderBy("pos")
    before = F.coalesce(F.sum("new_links").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = out.withColumn("before", before)
    asked = F.col("before") < n if least_engines is None else F.row_number().over(order) <= least_engines
    return out.withColumn("asked", asked)


def sweep_results(answers: DataFrame, n: int) -> DataFrame:
    """The first `n` links of the asked engines, in order of arrival: query, place, url, via (all asked engines that have it)."""
    asked = answers.join(sweep(answers, n).where("asked").select("query", "pos"), ["query", "pos"])
    merged = asked.groupBy("query", "url").agg(F.min(F.struct("pos", "rank")).alias("_at"), F.sort_array(F.collect_set("engine")).alias("via"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("_at", "url"))
    return merged.withColumn("place", place).where(F.col("place") <= n).select("query", "place", "url", "via")


def merge_witnesses(answers: DataFrame) -> DataFrame:
    """query, url, via: each link once, with the sorted set of engines that found it."""
    return answers.groupBy("query", "url").agg(F.sort_array(F.collect_set("engine")).alias("via"))


def corroboration(answers: DataFrame) -> DataFrame:
    """query, url, by_url, by_domain: engines that found the link, and any link of its domain; null if the query has fewer than two witnesses."""
    rows = answers.withColumn("domain", U.domain(F.col("url")))
    by_url = rows.groupBy("query", "url", "domain").agg(F.countDistinct("engine").alias("by_url"))
    by_domain = rows.groupBy("query", "domain").agg(F.countDistinct("engine").alias("by_domain"))
    all_of = rows.groupBy("query").agg(F.countDistinct("engine").alias("_all"))
    out = by_url.join(by_domain, ["query", "domain"]).join(all_of, "query")
    some = lambda c: F.when(F.col("_all") >= 2, F.col(c)).alias(c)
    return out.select("query", "url", some("by_url"), some("by_domain"))


def relevant_engines(answers: DataFrame) -> DataFrame:
    """query, engine, relevant: whether any of the engine's rows has any word of the query; a query without words can't tell, so true."""
    stems = T.stems(T.query_words(F.col("query")))
    here = T.result_text(F.col("title"), F.col("snippet"), F.col("url"))
    hit = (F.size(stems) == 0) | F.exists(stems, lambda s: here.contains(s))
    return answers.groupBy("query", "engine").agg(F.bool_or(hit).alias("relevant"))


def drop_hijacked(merged: DataFrame, judged: DataFrame) -> DataFrame:
    """Links of `merged` (query, url, via) that at least one engine found which answered this question."""
    good = judged.where("relevant").groupBy("query").agg(F.collect_set("engine").alias("_good"))
    out = merged.join(good, "query", "left")
    return out.where(F.arrays_overlap("via", F.coalesce("_good", F.array().cast("array<string>")))).drop("_good")


def word_coverage(answers: DataFrame) -> DataFrame:
    """query, word: words of the query that stand in none of its results."""
    words = answers.select("query").distinct().select("query", F.explode(T.query_words(F.col("query"))).alias("word"))
    here = T.result_text(F.col("title"), F.col("snippet"), F.col("url"))
    stem = F.substring("word", 1, 5)
    found = words.join(answers, "query").groupBy("query", "word").agg(F.bool_or(here.contains(stem)).alias("_found"))
    return found.where("NOT _found").select("query", "word")


def split_known(wanted: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The wanted engines that the registry has, and those it has not."""
    return wanted.join(registry.select("engine"), "engine", "left_semi"), wanted.join(registry.select("engine"), "engine", "left_anti")


def quietly_empty(asked: Column, answered: Column, silent: Column, hijacked: Column) -> Column:
    """Asked engines that neither answered nor refused nor answered something else."""
    return F.array_except(F.array_except(F.array_except(asked, answered), silent), hijacked)


def unasked(known: Column, asked: Column, skipped: Column, aborted: Column) -> Column:
    """Known engines that an aborted search did not get to."""
    return F.when(aborted, F.array_except(F.array_except(known, asked), skipped)).otherwise(F.array().cast("array<string>"))


def first_of_each(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def all_clean(answered: DataFrame, key: str) -> DataFrame:
    """Whether all engines that answered are clean; no engine, or one not checked, is not clean."""
    return answered.groupBy(key).agg(F.bool_and(F.coalesce(F.col("trust") == "clean", F.lit(False))).alias("all_engines_clean"))


def tiers(asked: DataFrame, core: int = 5) -> DataFrame:
    """query, tiers: core if all asked engines are of the first `core`, else core, fallback."""
    inside = F.bool_and(F.col("pos") < core)
    return asked.groupBy("query").agg(F.when(inside, "core").otherwise("core, fallback").alias("tiers"))


def trouble(aborted: Column, silent: Column, irrelevant: Column, pool_source: Column, missing: Column, adjusted: Column) -> Column:
    """What makes an answer less than it looks; fields that are in order are null."""
    some = lambda x: F.when(F.size(x) > 0, x)
    pool = F.when(pool_source == "seed", "the pool is the seed list").when(pool_source != "observation", "the pool is not established")
    return F.struct(
        F.when(aborted != "", aborted).alias("search_aborted"),
        some(silent).alias("unresponsive_engines"),
        some(irrelevant).alias("engines_irrelevant"),
        pool.alias("pool_unmeasured"),
        some(missing).alias("query_words_matched_nowhere"),
        some(adjusted).alias("arguments_adjusted"),
    )
