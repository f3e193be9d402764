"""Views in the shape of observation, response and corpus tables, over the star-schema tables of a folder.

Each view is a DataFrame function; `plans.views_sql` says the same in SQL, written apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Now" in seconds after the first day of the events, and the length of the observation window.
NOW_S, WINDOW_S = 30 * 86400, 10 * 86400

#: Engines in the views.
ENGINES = 12


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def probes(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each probe of an engine: id, ts (seconds), engine, query, category, results, relevant, hit, latency, verdict."""
    return probes_of(read(spark, folder, "events"))


def probes_of(events: DataFrame) -> DataFrame:
    """The probes of a table or stream of events."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    out = events.select(
        F.col("event_id").alias("id"),
        F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)").alias("ts"),
        F.concat(F.lit("e"), (F.col("user_id") % ENGINES).cast("string")).alias("engine"),
        F.col("event_type").alias("query"),
        F.when(k % 5 == 0, "images").when(k % 13 != 0, "general").alias("category"),
        (k % 11).alias("results"),
        (k % 7).alias("relevant"),
        F.when(k != 50, (F.col("value") >= 5 * (F.col("user_id") % ENGINES)).cast("int")).alias("hit"),
        F.floor("value").cast("int").alias("latency"),
        k.alias("k"),
    )
    verdict = (
        F.when(F.col("query") == "error", "refused")
        .when(F.col("results") == 0, "empty")
        .when(F.col("relevant") == 0, "irrelevant")
        .when(F.coalesce("hit", F.lit(0)) == 0, "miss")
        .otherwise("ok")
    )
    return out.withColumn("verdict", verdict)


def reads(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each page-reading probe: id, ts, url, path, expected, status, hit, latency, chars."""
    p = probes(spark, folder)
    status = F.when(F.col("k") % 4 == 0, "stub").when(F.col("k") % 9 == 0, "error").otherwise("read")
    expected = F.when(F.col("k") % 8 == 0, "stub").otherwise("read")
    return p.select(
        "id",
        "ts",
        F.concat(F.lit("https://site"), (F.col("id") % 20).cast("string"), F.lit(".example.com/p")).alias("url"),
        F.when(F.col("k") % 2 == 0, "plain").otherwise("browser").alias("path"),
        expected.alias("expected"),
        status.alias("status"),
        (status == expected).cast("int").alias("hit"),
        "latency",
        (F.col("k") * 100).alias("chars"),
    )


def engine_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Links by engine and query: engine, query, url (repeated where a probe found it again)."""
    keep = F.col("l_partkey") % (1 + F.col("l_suppkey") % 4) == 0
    return read(spark, folder, "lineitem").where(keep).select(
        F.concat(F.lit("e"), (F.col("l_suppkey") % ENGINES).cast("string")).alias("engine"),
        F.col("l_returnflag").alias("query"),
        F.concat(F.lit("u"), F.col("l_partkey").cast("string")).alias("url"),
    )


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded answers: query, pos (of the engine, from 0), engine, url, title, snippet, rank (1 to 10)."""
    from pyspark.sql import Window

    line = read(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = read(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    part = read(spark, folder, "part").select("p_partkey", "p_name", "p_type")
    hits = (
        line.join(orders, line["l_orderkey"] == orders["o_orderkey"])
        .groupBy(F.col("o_orderpriority").alias("query"), (F.col("l_suppkey") % ENGINES).cast("int").alias("pos"), "l_partkey")
        .agg(F.min((F.col("l_partkey") * 7919 + F.col("l_suppkey") % 3) % 1009).alias("h"))
    )
    order = Window.partitionBy("query", "pos").orderBy("h", "l_partkey")
    hits = hits.withColumn("rank", F.row_number().over(order)).where("rank <= 10")
    hits = hits.join(part, hits["l_partkey"] == part["p_partkey"])
    domain = F.concat(F.lit("www.p"), (F.col("l_partkey") % 40).cast("string"), F.lit(".example.com"))
    return hits.select(
        "query",
        "pos",
        F.concat(F.lit("e"), F.col("pos").cast("string")).alias("engine"),
        F.concat(F.lit("https://"), domain, F.lit("/i/"), F.col("l_partkey").cast("string")).alias("url"),
        F.col("p_name").alias("title"),
        F.concat_ws(" ", F.col("p_type"), F.when(F.col("l_partkey") % 3 == 0, F.col("query"))).alias("snippet"),
        "rank",
    )


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of a corpus by question: question, id, url, domain, text, chars."""
    host = F.concat(F.lit("s"), (F.col("doc_id") % 37).cast("string"), F.when(F.col("doc_id") % 11 == 0, ".sec.gov").otherwise(".example.org"))
    return read(spark, folder, "documents").select(
        F.col("source").alias("question"),
        F.col("doc_id").alias("id"),
        F.concat(F.lit("https://"), host, F.lit("/d/"), F.col("doc_id").cast("string")).alias("url"),
        host.alias("domain"),
        "text",
        F.length("text").cast("bigint").alias("chars"),
        "lang",
    )
