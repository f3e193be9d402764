"""The whole answer to a question: whom to ask, what to keep of what they bring, and what speaks against it.

Rows of recorded answers (query, pos of the engine, engine, url, title, snippet, rank) go through six steps: the sweep
over the engines, where links of engines that answered something else are dropped before they count; the merge of
witnesses; corroboration; the question's words, in each result and in none; trust in the engines; and what is wrong.
A question's rows are few (engines times results of each), so they are folded as arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..sources.shared import written
from . import results as R


def engine_answers(answers: DataFrame, silent: DataFrame) -> DataFrame:
    """query, pos, engine, rows (url and whether it has a word of the question, in order) and why the engine was silent (null: it was not)."""
    stems = T.stems(T.query_words(F.col("query")))
    here = T.result_text(F.col("title"), F.col("snippet"), F.col("url"))
    told = (F.size(stems) == 0) | F.exists(stems, lambda s: here.contains(s))
    row = F.struct("rank", "url", told.alias("told"))
    rows = answers.groupBy("query", "pos", "engine").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    rows = rows.join(silent.select("query", "engine", F.col("reason").alias("silent")), ["query", "engine"], "left")
    return rows.withColumn("rows", F.when(F.col("silent").isNull(), F.col("rows")).otherwise(F.slice("rows", 1, 0)))


def walked(engines: DataFrame, n: int) -> DataFrame:
    """query, pos, engine, wanted and state of each engine: not_reached, silent, irrelevant, empty or answered.

    Engines are asked in order until `n` links are together, each for as many as are missing. None of an engine's links
    count if none of those asked for has a word of the question.
    """
    step_type = "array<struct<pos:int,engine:string,state:string,wanted:int>>"
    start = F.struct(F.array().cast("array<string>").alias("links"), F.array().cast(step_type).alias("steps"))

    def step(state: Column, x: Column) -> Column:
        wanted = F.lit(n) - F.size(state["links"])
        some = F.slice(x["rows"], F.lit(1), F.greatest(wanted, F.lit(1)))
        good = F.exists(some, lambda r: r["told"])
        what = F.when(wanted <= 0, "not_reached").when(x["silent"].isNotNull(), "silent").when(F.size(some) == 0, "empty").when(good, "answered").otherwise("irrelevant")
        links = F.when(what == "answered", F.array_union(state["links"], F.transform(some, lambda r: r["url"]))).otherwise(state["links"])
        told = F.struct(x["pos"].cast("int").alias("pos"), x["engine"].alias("engine"), what.alias("state"), F.when(wanted > 0, wanted).alias("wanted"))
        return F.struct(links.alias("links"), F.array_append(state["steps"], told).alias("steps"))

    ways = engines.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("pos", "engine", "rows", "silent"))).alias("e"))
    return ways.select("query", F.explode(F.aggregate("e", start, step)["steps"]).alias("s")).select("query", "s.*")


def search_results(answers: DataFrame, ways: DataFrame) -> DataFrame:
    """query, place, url, title, snippet, via, by_url, by_domain, words: the links that were kept, in order of arrival.

    by_url and by_domain (engines that found the link, and any link of its domain) are null if the question had fewer
    than two witnesses in all. `words` are those of the question that the result has.
    """
    asked = ways.where("state = 'answered'").select("query", "pos", "wanted")
    rows = answers.join(asked, ["query", "pos"])
    order = Window.partitionBy("query", "pos").orderBy("rank")
    rows = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= F.col("wanted")).withColumn("domain", U.domain(F.col("url")))
    first = F.min_by(F.struct("title", "snippet"), F.struct("pos", "rank"))
    merged = rows.groupBy("query", "url", "domain").agg(F.min(F.struct("pos", "rank")).alias("_at"), first.alias("_first"), F.sort_array(F.collect_set("engine")).alias("via"))
    domains = rows.groupBy("query", "domain").agg(F.count_distinct("engine").alias("by_domain"))
    witnesses = rows.groupBy("query").agg(F.count_distinct("engine").alias("_all"))
    out = merged.join(domains, ["query", "domain"]).join(witnesses, "query")
    some = lambda c: F.when(F.col("_all") >= 2, c)
    here = T.result_text(F.col("_first.title"), F.col("_first.snippet"), F.col("url"))
    words = F.filter(T.query_words(F.col("query")), lambda w: here.contains(F.substring(w, 1, 5)))
    place = F.row_number().over(Window.partitionBy("query").orderBy("_at", "url"))
    return out.select("query", place.alias("place"), "url", F.col("_first.title").alias("title"), F.col("_first.snippet").alias("snippet"), "via", some(F.size("via").cast("bigint")).alias("by_url"), some(F.col("by_domain")).alias("by_domain"), words.alias("words"))


def search(answers: DataFrame, silent: DataFrame, trust: DataFrame, n: int, pool_source: Column, adjusted: Column, core: int = 5) -> DataFrame:
    """One row for each question, whole: lists of engines by what became of them, trust, missing words, and `trouble`.

    `silent`: query, engine, reason (the first one counts); `trust`: engine, trust. `pool_source` and `adjusted` (names of
    arguments that were adjusted) are columns over query.
    """
    answers = written(answers, "answers")
    silent = R.first_of_each(silent, ["query", "engine"], ["reason"])
    ways = written(walked(engine_answers(answers, silent), n), "ways")
    results = search_results(answers, ways)
    labelled = ways.join(trust.select("engine", F.col("trust").alias("_trust")), "engine", "left").withColumn("_trust", F.coalesce("_trust", F.lit("not_checked")))
    listed = lambda where, name: F.transform(F.sort_array(F.collect_list(F.when(where, F.struct("pos", "engine")))), lambda x: x["engine"]).alias(name)
    state = F.col("state")
    told = labelled.groupBy("query").agg(
        listed(state != "not_reached", "asked"),
        listed(state == "answered", "answered"),
        listed(state == "irrelevant", "irrelevant"),
        listed(state == "silent", "silent"),
        listed(state == "empty", "quietly_empty"),
        F.transform(F.sort_array(F.collect_list(F.when(state != "not_reached", F.struct("pos", F.concat_ws("=", "engine", "_trust").alias("t"))))), lambda x: x["t"]).alias("engines_trust"),
        F.bool_and(F.when(state == "answered", F.col("_trust") == "clean")).alias("_clean"),
        F.max(F.when(state != "not_reached", F.col("pos"))).alias("_last"),
    )
    found = results.groupBy("query").agg(F.count(F.lit(1)).alias("count"), F.array_distinct(F.flatten(F.collect_list("words"))).alias("_words"), F.max("by_url").alias("most_witnesses"))
    out = told.join(found, "query", "left").withColumns({"count": F.coalesce("count", F.lit(0)), "missing": F.array_except(T.query_words(F.col("query")), F.coalesce("_words", F.array().cast("array<string>")))})
    trouble = R.trouble(F.lit(""), F.col("silent"), F.col("irrelevant"), pool_source, F.col("missing"), adjusted)
    return out.select(
        "query", "count", "most_witnesses", "asked", "answered", "irrelevant", "silent", "quietly_empty", "engines_trust", "missing",
        F.coalesce("_clean", F.lit(False)).alias("all_engines_clean"), F.when(F.col("_last") < core, "core").otherwise("core, fallback").alias("tiers"), trouble.alias("trouble"),
    )
