"""What each filter of a chain does, in every order of the chain, by lattice-edge aggregation.

The sets of filters already applied are a lattice; an order of the filters is a path from the empty set to the full one,
and a step of it is an edge: (set applied so far, next filter). A document's fate at an edge depends on the edge alone,
so it contributes to n * 2 ** (n - 1) edges, 80 for five filters, instead of n * n! steps. Documents that fail the same
filters contribute alike: they are counted first, by part and pattern, and each pattern then contributes its count to all
edges. The sums of the edges are joined to the steps of all orders, a table whose size depends on n alone.

The Shapley value of a filter is the mean over all orders of what it removes; an edge lies on |S|! * (n - 1 - |S|)! of
the paths, so the values come from the edges too. It is given as the sum over all orders, an integer.

A text is read once; only its digest (SHA-256), its doc_id and its pattern are shuffled, never the text. Copies are
counted before the shuffle and joined with sides dealt anew, so AQE splits a text that a third of all rows share.

Defined results: a null text counts as empty, a null lang as the empty part. Every part has all steps, zeros included. A
null doc_id is smaller than none and greater than none: such a row is no copy of a smaller one, nor makes others copies,
and has no label. Rows that tie in doc_id and text aren't copies of each other. Of several label rows of a doc_id one
that says 1 is enough. Repeated rows count each. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import spread_join
from .common import SPACE, let, table, written
from .quality import words_of

#: Filters by letter: when a document fails, over the measures below (parameters of the audit).
FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 3 * n_chars",
    "D": "n_marks > 0",
    "E": "is_copy",
}

#: Measures of a text; is_copy (a smaller doc_id has the same text) is told from the whole table.
MARKS, CAPITALS = "[#$%&*|]", "[A-Z]"


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """doc_id, part, digest and the measures of each row of `docs`."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumn("words", let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("distinct"))))
    return own.select(
        "doc_id",
        "part",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.col("words.n").alias("n_words"),
        F.col("words.distinct").alias("n_distinct"),
        F.regexp_count("text", F.lit(CAPITALS)).cast("long").alias("n_capitals"),
        F.length("text").cast("long").alias("n_chars"),
        F.col("text").rlike(MARKS).cast("int").alias("n_marks"),
    )


def with_copies(rows: DataFrame) -> DataFrame:
    """`rows` (a written table) with is_copy: a smaller doc_id has the same digest."""
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return spread_join(rows, groups, "digest", "left").withColumn("is_copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("first")


def patterns(rows: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS, doc_id: str = "doc_id") -> DataFrame:
    """part, fails (a bit for each filter), good, toxic and how many documents: rows of one part at most 4 * 2 ** n."""
    told = labels.groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.expr("quality <=> 1")).alias("good"), F.max(F.expr("toxic <=> 1")).alias("toxic"))
    fails = sum((F.when(F.expr(c), 1 << i).otherwise(0) for i, c in enumerate(filters.values())), F.lit(0))
    own = spread_join(with_copies(rows).select("doc_id", "part", fails.cast("int").alias("fails")), told, "doc_id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return own.select("part", "fails", flag("good"), flag("toxic")).groupBy("part", "fails", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))


def edges(counted: DataFrame, n_filters: int) -> DataFrame:
    """The counts at each edge of each part: applied (a bit for each filter), filter (its number) and what happens there."""
    at = F.explode(F.sequence(F.lit(0), F.lit(n_filters * 2 ** (n_filters - 1) - 1))).alias("edge")
    own = counted.select("*", at).withColumn("filter", (F.col("edge") % n_filters).cast("int"))
    # The rest of an edge's number has a bit for each other filter: those below the edge's own stay, those above move up.
    own = own.withColumn("others", F.expr(f"cast(edge div {n_filters} as int)"))
    low = F.expr("others & (shiftleft(1, filter) - 1)")
    own = own.withColumn("applied", low + F.expr("shiftleft(shiftright(others, filter), filter + 1)"))
    kept_before, fails = F.expr("fails & applied") == 0, F.expr("shiftright(fails, filter) & 1") == 1
    count = lambda where, name: F.sum(F.when(where, F.col("n")).otherwise(0)).alias(name)
    return own.groupBy("part", "applied", "filter").agg(
        count(kept_before & ~fails, "kept"),
        count(kept_before & fails, "removed"),
        count(~kept_before & fails, "redundant"),
        count(F.expr("fails = shiftleft(1, filter)"), "unique_fails"),
        count(kept_before & fails & F.col("good"), "good_lost"),
        count(kept_before & fails & F.col("toxic"), "toxic_lost"),
    )


def with_shapley(edges: DataFrame, n_filters: int) -> DataFrame:
    """`edges` with what each filter removes, summed over all orders."""
    paths = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n_filters - 1 - k)) for k in range(n_filters)]), F.bit_count("applied") + 1)
    of_filter = Window.partitionBy("part", "filter")  # 2 ** (n - 1) rows
    return edges.withColumn("shapley", F.sum(F.col("removed") * paths).over(of_filter))


def steps(spark: SparkSession, letters: str) -> DataFrame:
    """All orders of the filters and their steps: n * n! rows."""
    number = {c: i for i, c in enumerate(letters)}
    rows = [
        ("".join(order), k + 1, sum(1 << number[c] for c in order[:k]), number[order[k]])
        for order in permutations(letters)
        for k in range(len(letters))
    ]
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, filter int")


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """What each step of each order of `filters` (one letter each) does to each part of `docs`."""
    rows = written(measured(docs, doc_id, text, part), "measures")
    sums = with_shapley(edges(patterns(rows, labels, filters, doc_id), len(filters)), len(filters))
    paths = F.broadcast(steps(docs.sparkSession, "".join(filters)))  # 600 rows for five filters
    return sums.join(paths, ["applied", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
told AS (SELECT doc_id, bool_or(quality IS NOT DISTINCT FROM 1) AS good, bool_or(toxic IS NOT DISTINCT FROM 1) AS toxic FROM labels GROUP BY doc_id),
words AS (SELECT *, list_filter(string_split_regex(t, '[{SPACE}]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM texts),
failed AS (
  SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > first, false) AS e,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM words LEFT JOIN told USING (doc_id)
),
counted AS (
  SELECT part, concat(if(a, 'A', ''), if(b, 'B', ''), if(c, 'C', ''), if(d, 'D', ''), if(e, 'E', '')) AS fails, good, toxic, count(*) AS n
  FROM failed GROUP BY ALL
),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
stepped AS (SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS before FROM orders, range(1, 6) AS s(step)),
fates AS (
  SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS hit, fails = f AS alone,
    before <> '' AND fails <> '' AND regexp_matches(fails, concat('[', before, '_]')) AS gone
  FROM counted, stepped
),
summed AS (
  SELECT part, filter_order, step, f, sum(n) FILTER (NOT gone AND NOT hit) AS kept, sum(n) FILTER (NOT gone AND hit) AS removed,
    sum(n) FILTER (gone AND hit) AS redundant, sum(n) FILTER (alone) AS unique_fails,
    sum(n) FILTER (NOT gone AND hit AND good) AS good_lost, sum(n) FILTER (NOT gone AND hit AND toxic) AS toxic_lost
  FROM fates GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step::int AS step, coalesce(kept, 0)::bigint AS kept, coalesce(removed, 0)::bigint AS removed,
  coalesce(redundant, 0)::bigint AS redundant, coalesce(unique_fails, 0)::bigint AS unique_fails, coalesce(good_lost, 0)::bigint AS good_lost,
  coalesce(toxic_lost, 0)::bigint AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, f))::bigint AS shapley
FROM summed
"""
