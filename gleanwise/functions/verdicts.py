"""Verdicts as column expressions. Conditions are tried in order; a null condition counts as not met."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def probe_verdict(failed: Column, refused: Column, results: Column, on_topic: Column, hit: Column) -> Column:
    """error, refused, empty, irrelevant, miss or ok. Image probes have no relevance test: give a true `on_topic`."""
    return (
        F.when(failed, "error")
        .when(refused & (results == 0), "refused")
        .when(results == 0, "empty")
        .when(~F.coalesce(on_topic, F.lit(False)), "irrelevant")
        .when(~F.coalesce(hit, F.lit(False)), "miss")
        .otherwise("ok")
    )


def read_hit(status: Column, expected: Column, marker_found: Column, near: Column) -> Column:
    """Whether a reading probe met its expectation: status, marker (null: none asked for) and all `near` relations."""
    return (status == expected) & F.coalesce(marker_found, F.lit(True)) & F.forall(near, lambda x: x)


#: Words that say yes or no (fixed values).
TRUE_WORDS, FALSE_WORDS = ("1", "true", "yes", "on", "y", "t"), ("0", "false", "no", "off", "n", "f")

#: What an error that the caller caused says (fixed values).
CALLER_ERRORS = (
    "is required",
    "was expected",
    "not a single address",
    "empty query",
    "empty question",
    "empty address",
    "not usable",
    "only http and https",
)


def flag(value: Column, given: Column, default: bool, number: Column | None = None) -> Column:
    """A flag as the caller meant it: struct of value and whether it was unreadable, then off. Not given: the default.

    `number` is the value where it came as a number: any but zero means yes.
    """
    word = F.lower(F.trim(value))
    yes, no = word.isin(*TRUE_WORDS), word.isin(*FALSE_WORDS)
    read = F.coalesce(yes | no, F.lit(False))
    if number is not None:
        yes, read = F.coalesce(number != 0, yes), read | number.isNotNull()
    return F.struct(
        F.when(~given, F.lit(default)).otherwise(F.coalesce(yes, F.lit(False))).alias("value"),
        (given & ~read).alias("adjusted"),
    )


def number(value: Column, low: int, high: int, default: int) -> Column:
    """An integer argument clamped into [low, high]; what is no integer gives the default. Struct of value and whether it was changed."""
    text = F.trim(value)
    n = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))
    out = F.when(n.isNull(), F.lit(default)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), n))).cast("bigint")
    return F.struct(out.alias("value"), (n.isNull() | (text != out.cast("string"))).alias("adjusted"))


def positive(value: Column, default: int) -> Column:
    """A positive integer, else the default."""
    n = F.trim(value).try_cast("bigint")
    return F.when(n > 0, n).otherwise(F.lit(default).cast("bigint"))


def ago(ts: Column, now: Column) -> Column:
    """A time in seconds as ISO time and how many seconds ago; null if there is none."""
    at = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(secs=F.floor(ts))
    shown = F.concat(F.replace(at.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z ("))
    return F.concat(shown, (now - ts).cast("bigint").cast("string"), F.lit(" s ago)"))


def status_code(ok: Column, error: Column) -> Column:
    """200, 400 for what the caller caused, 502 for the rest."""
    low = F.lower(F.coalesce(error, F.lit("")))
    caller = F.exists(F.array(*map(F.lit, CALLER_ERRORS)), lambda m: low.contains(m))
    return F.when(F.coalesce(ok, F.lit(False)), 200).when(caller, 400).otherwise(502)


def finish_state(reason: Column) -> Column:
    """Whether a model's answer was cut off: true, false, or null if it was not told."""
    return F.when(reason == "length", True).when(reason.isin("stop", "end_turn"), False)


def client_name(name: Column, version: Column, given: Column) -> Column:
    """name/version for a view: white space collapsed, 60 and 16 characters at most, printable only."""
    tidy = lambda x, n: F.substring(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")), 1, n)
    shown, v = F.regexp_replace(tidy(name, 60), r"\p{C}", ""), tidy(version, 16)
    named = F.when(v == "", shown).otherwise(F.concat_ws("/", shown, v))
    return F.when(~given | (shown == ""), "no name given").otherwise(named)
