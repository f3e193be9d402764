"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule looks at one measure of a document and votes good (1), bad (2) or not at all (0). Documents with the same
votes are counted together over the whole table; there are at most 3 ** (number of rules) such patterns, whatever the
size of the table, so the counts come to the driver and EM runs over them. It estimates the share of good documents and,
for each rule, how often it votes good or bad given either kind, freely but for a weak prior that says which kind is
which. The posterior of a pattern is then the probability that its documents are good; it replaces a filter that all
rules must pass.

Words are maximal runs of characters other than white space. All measures come from built-in functions over whole texts.

Defined results: a null or empty text has no words, all measures 0 and fails the base rule. Repeated rows count each.
An empty table gives an empty result. Other columns are not looked at; `keep_good` gives them all back as they are,
whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, as_rows, let, table, written

#: Production parameters: base rule, EM rounds, least posterior of a kept document.
LEAST_WORDS, MOST_REPEATED, ROUNDS, LEAST_POSTERIOR = 50, 0.5, 100, 0.5

#: The prior: worth this share of the documents, it says how a rule votes (abstains, good, bad) on good and on bad
#: documents, and how large a share is good. EM starts there; what the votes say then outweighs it twenty to one.
PRIOR, PRIOR_GOOD, PRIOR_BAD, GOOD_SHARE = 0.05, (0.15, 0.80, 0.05), (0.40, 0.30, 0.30), 0.9

#: Very frequent words of some languages (fixed values): prose of one of them has several.
STOP_WORDS = """
the of and to in is that it for with was on are as by this be at from or
der die das und ist nicht von mit zu ein eine den auf im
le la les et des est une un en que dans qui pour pas il
el los las y se del por con una para no lo
di che non per het een van dat
""".split()

#: Each rule: SQL for bad, SQL for good; between them it abstains.
RULES = {
    "symbols": ("n_symbols > 0.1 * n_words", "n_symbols < 0.02 * n_words"),
    "repeats": ("n_repeat_words > 0.4 * n_words", "n_repeat_words < 0.2 * n_words"),
    "lines": ("n_dup_lines > 0.3 * n_lines", "n_dup_lines < 0.05 * n_lines"),
    "capitals": ("n_capitals > 0.3 * word_chars", "n_capitals < 0.1 * word_chars"),
    "word_length": ("word_chars < 2 * n_words OR word_chars > 12 * n_words", "word_chars > 4 * n_words AND word_chars < 7 * n_words"),
    "variety": ("n_distinct < 0.1 * least(n_words, 1000)", "n_distinct > 0.3 * least(n_words, 1000)"),
    "letters": ("n_others > 0.25 * word_chars", "n_others < 0.1 * word_chars"),
    "stop_words": ("n_stop_words < 2", "n_stop_words >= 5"),
    "plain_words": ("n_plain_words < 0.4 * n_words", "n_plain_words > 0.8 * n_words"),
    "sentences": ("100 * n_sentences < n_words OR 3 * n_sentences > n_words", "40 * n_sentences > n_words AND 4 * n_sentences < n_words"),
    "digits": ("n_digits > 0.2 * word_chars", "n_digits < 0.05 * word_chars"),
    "bullets": ("n_bullets > 0.5 * n_lines", "n_bullets < 0.1 * n_lines"),
}


def words_of(text: Column) -> Column:
    """The words of a text, in order; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """How many words stand in a 3-word window that the text has twice or more, the first one included.

    Only a text with repeated windows goes on to sort them: equal windows then are neighbours, and the words from one
    repeated window to the next, at most three, are counted.
    """
    window = lambda w, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    windows = F.when(
        F.size(words) >= 3, let(words, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: window(w, i)))
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(ws: Column) -> Column:
        placed = F.sort_array(F.transform(ws, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            placed,
            lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])),
        )
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        gap = lambda p, x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))
        return let(starts, lambda p: F.aggregate(F.transform(p, lambda x, k: gap(p, x, k)), F.lit(0), lambda a, b: a + b))

    return let(
        windows, lambda ws: F.when(F.size(F.array_distinct(ws)) == F.size(ws), F.lit(0)).otherwise(covered(ws))
    ).cast("long")


def measured(rows: DataFrame) -> DataFrame:
    """`rows` (columns row and text, as `as_rows` gives) with the measures of the base rule and of the rules."""
    t = F.coalesce(F.col("text"), F.lit(""))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
    out = rows.withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    bullet = lambda x: x.rlike(f"^[{SPACE}]*[-*|>\u2022]")
    distinct = F.array_distinct("words")
    out = out.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": count(r"[#*$%&|<>]"),
            "lines": let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"), F.size(F.filter(x, bullet)).alias("b"))),
            "n_repeat_words": repeat_words(F.col("words")),
            "n_capitals": count(r"\p{Lu}"),
            "distinct": let(distinct, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_intersect(x, F.array(*map(F.lit, STOP_WORDS)))).alias("stop"))),
            "n_others": count(rf"[^\p{{L}}\p{{M}}{SPACE}]"),
            "n_digits": count(r"\p{Nd}"),
            "n_plain_words": count(rf"(?<![^{SPACE}])[\p{{L}}\p{{M}}]++[.,;:!?]?(?![^{SPACE}])"),
            "n_sentences": count(rf"[.!?\u3002](?=[{SPACE}]|$)"),
        }
    )
    long = {"n_lines": "lines.n", "n_bullets": "lines.b", "n_distinct": "distinct.n", "n_stop_words": "distinct.stop"}
    out = out.withColumns({k: F.col(v).cast("long") for k, v in long.items()} | {"n_dup_lines": (F.col("lines.n") - F.col("lines.d")).cast("long")})
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MOST_REPEATED) * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("words", "lines", "distinct", "text")


def votes(rules: dict[str, tuple[str, str]]) -> Column:
    """All rules' votes as one number, base 3."""
    vote = [F.when(F.expr(bad), 2).when(F.expr(good), 1).otherwise(0) for bad, good in rules.values()]
    return sum((v * 3**i for i, v in enumerate(vote)), F.lit(0)).cast("int")


def posteriors(counts: dict[int, int], n_rules: int, rounds: int = ROUNDS) -> dict[int, float]:
    """EM over counted vote patterns: the posterior probability of good for each pattern.

    Documents are good or bad; given that, rules vote good, bad or abstain independently. Shares and rates are free, but
    for the prior, which is worth PRIOR of the documents.
    """
    if not counts or not sum(counts.values()):
        return {}
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    votes = np.array(patterns)[:, None] // 3 ** np.arange(n_rules) % 3
    cast = votes[:, :, None] == np.arange(3)  # pattern, rule, vote
    share = np.array([GOOD_SHARE, 1 - GOOD_SHARE])
    rate = np.array([[PRIOR_GOOD] * n_rules, [PRIOR_BAD] * n_rules])
    prior_share, prior_rate, total = share, rate * share[:, None, None], n.sum()
    good = np.zeros(len(n))
    for _ in range(rounds):
        weight = share * np.stack([rate[k][np.arange(n_rules), votes].prod(1) for k in (0, 1)], 1)
        good = weight[:, 0] / weight.sum(1)
        parts = np.stack([n * good, n * (1 - good)])
        share = (parts.sum(1) + PRIOR * total * prior_share) / ((1 + PRIOR) * total)
        rate = PRIOR * total * prior_rate + np.einsum("kp,prv->krv", parts, cast)
        rate /= rate.sum(2, keepdims=True)
    return dict(zip(patterns, good.tolist(), strict=True))


def judged(features: DataFrame, rules: dict[str, tuple[str, str]] = RULES, least: float = LEAST_POSTERIOR) -> DataFrame:
    """Measured documents with `posterior` and `kept`. `features` is read twice: it should be a written table."""
    voted = features.withColumn("votes", votes(rules))
    counts = {r["votes"]: r["count"] for r in voted.groupBy("votes").count().collect()}  # at most 3 ** len(rules) rows
    told = [(p, x) for p, x in posteriors(counts, len(rules)).items()]
    by = features.sparkSession.createDataFrame(told, "votes int, posterior double")
    out = voted.join(F.broadcast(by), "votes", "left")  # a row for each pattern that occurs
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least)).drop("votes")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without the documents that the rules reject; all columns stay as they are."""
    features = written(measured(as_rows(docs, text)), "quality")
    return judged(features).where("kept").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.struct("doc_id").alias("row"), "text")
    return judged(written(measured(rows), "quality")).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )
