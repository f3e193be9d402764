"""URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .addresses import address, bound, internal

#: Domains where a document is primary (fixed values).
PRIMARY_DOMAINS = (
    "sec.gov",
    "e-disclosure.ru",
    "disclosure.skrin.ru",
    "nalog.gov.ru",
    "rkn.gov.ru",
    "cbr.ru",
    "gks.ru",
    "rosstat.gov.ru",
    "eur-lex.europa.eu",
    "europa.eu",
    "investor.gov",
    "sedar.com",
    "companieshouse.gov.uk",
)

#: Hosts and paths of search-engine result pages (fixed values).
RESULT_HOSTS = (
    r"^(www\.)?(google\.[a-z.]+|bing\.com|duckduckgo\.com|yandex\.[a-z]+|search\.marcia|baidu\.com|search\.brave\.com|lite\.duckduckgo\.com"
    r"|searx|mojeek\.com|startpage\.com|ecosia\.org|qwant\.com|imgur\.com|search\.yahoo\.com)$"
)
RESULT_PATHS = ("/search", "/images/search", "/web", "/?q=", "/s")

#: Parameters in which redirect links carry their target, in the order they are tried (fixed values).
REDIRECT_PARAMETERS = ("url", "u", "target", "redirect", "to", "link")

#: The name by which robots files address this reader.
AGENT = "gleanwise"

#: Names of hosts inside the perimeter (fixed values, and this reader's own); an operator adds the names of its own services.
INTERNAL_NAMES = ("localhost", "searxng", AGENT)


def authority(url: Column) -> Column:
    """What stands between `//` and the path, query or fragment; empty without a scheme."""
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit(""))


def domain(url: Column) -> Column:
    """The lower-case authority up to the first colon, without one leading www."""
    return F.regexp_replace(F.element_at(F.split(F.lower(authority(url)), ":", 2), 1), r"^www\.", "")


def host(url: Column) -> Column:
    """The host without user and port; IPv6 keeps its brackets."""
    return F.regexp_extract(F.regexp_replace(F.lower(authority(url)), r"^.*@", ""), r"^(\[[^\]]*\]|[^:]*)", 1)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_string(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.lit(""))


def domain_matches(d: Column, expected: Column) -> Column:
    """Whether the domain is one of `expected` or below one."""
    return F.exists(expected, lambda e: (d == e) | d.endswith(F.concat(F.lit("."), e)))


def primary_source(d: Column) -> Column:
    """A disclosure or regulator domain, by name suffix."""
    return domain_matches(F.trim(F.lower(F.coalesce(d, F.lit(""))), F.lit(".")), F.array(*map(F.lit, PRIMARY_DOMAINS)))


def parameter(url: Column, name: str) -> Column:
    """The first non-empty value of a query parameter, as written; null without one."""
    value = F.regexp_extract(query_string(url), rf"(?:^|&){name}=([^&]+)", 1)
    return F.when(value != "", value)


def unwrap_redirect(url: Column) -> Column:
    """The full address on another domain that a redirect parameter carries, decoded twice; else the link itself."""
    out = url
    for name in reversed(REDIRECT_PARAMETERS):
        once = F.try_url_decode(parameter(url, name))
        target = F.coalesce(F.try_url_decode(once), once)
        out = F.when(target.rlike("^https?://") & (domain(target) != domain(url)), target).otherwise(out)
    return out


def result_page(url: Column) -> Column:
    """A search engine's own result page."""
    where = F.element_at(F.split(F.lower(authority(url)), ":", 2), 1)
    p = F.regexp_replace(path(url), "/+$", "")
    p = F.when(p == "", "/").otherwise(p)
    starts = F.exists(F.array(*map(F.lit, RESULT_PATHS)), lambda x: p.startswith(x))
    return where.rlike(RESULT_HOSTS) & (starts | query_string(url).contains("q="))


def internal_name(h: Column) -> Column:
    """A known name inside the perimeter; other names are not resolved here."""
    return h.isin(*INTERNAL_NAMES) | h.endswith(".localhost")


def url_policy(url: Column) -> Column:
    """Why a page may not be read; empty if it may. The first reason that fits counts."""

    def reason(u: Column) -> Column:
        scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
        port = F.regexp_extract(authority(u), r":([^:\]@]*)$", 1)
        bad_port = (port != "") & (~port.rlike("^[0-9]+$") | (F.coalesce(port.try_cast("bigint"), F.lit(1 << 20)) > 65535))
        literal = F.struct(host(u).alias("host"), address(host(u)).alias("address"))
        no_host = lambda h: (authority(u) == "") | (h["host"].startswith("[") & h["address"].isNull())
        inside = lambda h: internal_name(h["host"]) | internal(h["address"])
        of_host = bound(literal, lambda h: F.when(no_host(h), "no host").when(result_page(u), "result page").when(inside(h), "internal").when(bad_port, "port").otherwise(""))
        return F.when(u == "", "empty address").when(~scheme.isin("http", "https"), "scheme").otherwise(of_host)

    return bound(F.trim(F.coalesce(url, F.lit(""))), reason)


def robots_verdict(rules: Column, page_path: Column) -> Column:
    """allowed, disallowed_by_site, or not_checked for a file that could not be read (null).

    The last User-agent line decides whether Disallow lines count; paths are compared decoded.
    """
    decoded = lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)
    lines = F.transform(F.split(rules, r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    start = F.struct(F.lit(False).alias("ours"), F.array().cast("array<string>").alias("denied"))

    def step(state: Column, line: Column) -> Column:
        field, value = F.lower(F.trim(F.regexp_extract(line, "^([^:]*):", 1))), F.trim(F.regexp_extract(line, "^[^:]*:(.*)$", 1))
        ours = F.when(field == "user-agent", value.isin("*", AGENT)).otherwise(state["ours"])
        denies = (field == "disallow") & state["ours"] & (value != "")
        return F.struct(ours.alias("ours"), F.when(denies, F.array_append(state["denied"], decoded(value))).otherwise(state["denied"]).alias("denied"))

    denied = F.aggregate(lines, start, step)["denied"]
    hit = F.exists(denied, lambda x: decoded(page_path).startswith(x))
    return F.when(rules.isNull(), "not_checked").when(hit, "disallowed_by_site").otherwise("allowed")
