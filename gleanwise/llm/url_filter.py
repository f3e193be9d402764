"""URL filters: host-suffix and path-prefix expressions, equi-joined with rules on short hash prefixes.

Each URL gives its host and all its parent domains. A first join on the short hash prefix of the host part finds the
rule hosts among them, with the lengths of these hosts' rule paths; so a URL expands into path prefixes of only those
lengths. A second join, on the short hash prefix of host and path prefix, finds candidate rules. Full digests confirm
them, and the longest rule wins.

Only rules are broadcast, and only after they were counted; a longer list is joined by a shuffle, whose skewed
partitions AQE splits. Expressions are made for distinct (host, path) pairs, which are told apart before the shuffle
(map-side); pairs that a rule fits are joined back with both sides dealt anew, so a pair that a third of all rows have is
split. URLs without a host take no part in any join.

Defined results: a null URL or one without `://` has an empty host and path; an empty host has no suffix and gets the
default verdict. Rules with a null part are dropped, repeated rules count once; of the same rule with both verdicts,
block wins. Equal lengths: the longer host wins. Repeated rows stay. Columns of the input whose names clash with the
new ones are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import spread_join
from .common import table

#: Rules up to this number are broadcast: under 1 kB each, so under 100 MB.
BROADCAST_RULES = 100_000

#: The rules that the query applies (fixed values).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, with A-Z in lower case; empty without `://` or url."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host, then each parent domain."""
    labels = F.split(host, r"\.", -1)
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def short_hash(text: Column) -> Column:
    """32 bits of the hash: short enough to be a cheap key, and confirmed by `digest`."""
    return F.hash(text)


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def rule_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A small literal rule list as a table (rule_host, rule_path, rule_verdict)."""
    if not rules:
        return spark.sql("SELECT '' AS rule_host, '' AS rule_path, '' AS rule_verdict WHERE false")
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join("(" + ", ".join(map(quote, rule)) + ")" for rule in rules)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(rule_host, rule_path, rule_verdict)")


def filter_urls(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """`urls` with host, path, rule (null if none fits) and verdict of the longest rule that fits (else `default`)."""
    rules = (
        rules.where("rule_host IS NOT NULL AND rule_path IS NOT NULL AND rule_verdict IS NOT NULL")
        .groupBy("rule_host", "rule_path")
        .agg(F.max("rule_verdict").alias("rule_verdict"))  # block sorts after allow
        .withColumn("_rule", F.concat("rule_host", "rule_path"))
    )
    hint = F.broadcast if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else (lambda df: df)
    hosts = hint(
        rules.groupBy("rule_host")
        .agg(F.sort_array(F.collect_set(F.length("rule_path"))).alias("_lengths"))
        .select(short_hash(F.col("rule_host")).alias("_hk"), digest(F.col("rule_host")).alias("_hd"), "_lengths")
    )
    known = hint(
        rules.select(
            short_hash(F.col("_rule")).alias("_rk"),
            digest(F.concat_ws("\n", "rule_host", "rule_path")).alias("_rd"),
            F.struct(
                F.length("_rule").alias("size"),
                F.length("rule_host").alias("host_size"),
                F.col("_rule").alias("rule"),
                F.col("rule_verdict").alias("verdict"),
            ).alias("_found"),
        )
    )
    out = urls.select(F.struct("*").alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    hosted, rest = out.where("host <> ''"), out.where("host = ''").withColumn("_found", F.lit(None).cast(dict(known.dtypes)["_found"]))
    pairs = hosted.select("host", "path").distinct()
    suffixes = pairs.select("host", "path", F.explode(host_suffixes(F.col("host"))).alias("_suffix"))
    suffixes = suffixes.withColumn("_hk", short_hash(F.col("_suffix"))).join(hosts, "_hk")
    suffixes = suffixes.where(digest(F.col("_suffix")) == F.col("_hd"))
    prefixes = suffixes.select("host", "path", "_suffix", F.explode("_lengths").alias("_n")).where(
        F.length("path") >= F.col("_n")
    )
    prefixes = prefixes.withColumn("_prefix", F.expr("substring(path, 1, _n)"))
    hits = prefixes.withColumn("_rk", short_hash(F.concat("_suffix", "_prefix"))).join(known, "_rk")
    hits = hits.where(digest(F.concat_ws("\n", "_suffix", "_prefix")) == F.col("_rd"))
    best = hits.groupBy("host", "path").agg(F.max("_found").alias("_found"))
    kept = [c for c in urls.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    return spread_join(hosted, best, ["host", "path"], "left").unionByName(rest).select(
        *(F.col("row")[c].alias(c) for c in kept),
        "host",
        "path",
        F.col("_found.rule").alias("rule"),
        F.coalesce(F.col("_found.verdict"), F.lit(default)).alias("verdict"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rule_frame(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


def _rule_sql(host: str, path: str, verdict: str) -> str:
    return f"SELECT '{host}' AS rh, '{path}' AS rp, '{verdict}' AS rv"


SQL = f"""
WITH rules AS ({reduce(lambda a, b: f"{a} UNION ALL {b}", (_rule_sql(*r) for r in RULES))}),
cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h0, rest FROM cut
), parts AS (
  SELECT page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*') AS path
  FROM split
), ranked AS (
  SELECT page_id, host, path, rh || rp AS rule, rv,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rh) + length(rp) DESC NULLS LAST) AS k
  FROM parts LEFT JOIN rules
    ON (host = rh OR (length(host) > length(rh) AND right(host, length(rh) + 1) = '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(rv, 'allow') AS verdict FROM ranked WHERE k = 1
"""
