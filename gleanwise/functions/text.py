"""Text as column expressions. Words are runs of letters, digits and underscores of any script."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markers of pages that are not there, sought in the first 400 characters (fixed values).
NO_SUCH_PAGE = (
    "публикация недоступна",
    "недоступна для просмотра",
    "страница не найдена",
    "страница не существует",
    "нет такой страницы",
    "page not found",
    "not found",
    "404",
    "ничего не найдено",
    "материал недоступен",
    "удалена или перемещена",
)

#: Markers of shields, sought in the first 20 000 characters of the source (fixed values).
SHIELDS = (
    "qrator",
    "servicepipe",
    "ddos-guard",
    "incapsula",
    "cloudflare",
    "just a moment",
    "checking your browser",
    "проверка браузера",
    "enable javascript",
    "включите javascript",
    "captcha",
    "капча",
    "attention required",
    "access denied",
    "доступ ограничен",
    "are you a robot",
    "являетесь ли вы роботом",
)

#: Markers of paywalls (fixed values).
PAYWALLS = (
    '"isaccessibleforfree":false',
    '"isaccessibleforfree": false',
    "оформите подписку",
    "продолжить чтение",
    "subscribe to continue",
    "for subscribers only",
    "только для подписчиков",
)

#: Months of dates in words, by the beginning of their names (fixed values).
MONTHS = {"январ": 1, "феврал": 2, "март": 3, "апрел": 4, "май": 5, "мая": 5, "июн": 6, "июл": 7, "август": 8, "сентябр": 9, "октябр": 10, "ноябр": 11, "декабр": 12}

#: Words that begin a question and are no markers (fixed values).
NOT_MARKERS = (
    "Когда Какие Какая Какой Какое Кто Что Чем Где Почему Зачем Сколько Как Компания Организация Фирма "
    "What When Where Which Who Why How Does Did Is Are Can Should The This Company Compare"
).split()

#: Little text, and markup that is too much for it.
THIN, HEAD, MARKUP = 1200, 400, 50_000


def clean(text: Column) -> Column:
    """White space collapsed and trimmed; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def query_words(text: Column) -> Column:
    """Lower-case words of four letters and more, one for each beginning of five letters, in order.

    For short texts such as queries: it compares each word with those before it.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= 4)
    is_new = lambda out, w: ~F.exists(out, lambda o: F.substring(o, 1, 5) == F.substring(w, 1, 5))
    return F.aggregate(words, F.array().cast("array<string>"), lambda out, w: F.when(is_new(out, w), F.array_append(out, w)).otherwise(out))


def stems(words: Column) -> Column:
    return F.transform(words, lambda w: F.substring(w, 1, 5))


def result_text(title: Column, snippet: Column, url: Column) -> Column:
    """What a result says: title, snippet and decoded link, in lower case."""
    none = F.lit("")
    link = F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url, none)
    return F.lower(F.concat_ws(" ", F.coalesce(title, none), F.coalesce(snippet, none), link))


def language(text: Column) -> Column:
    """ru for text with Cyrillic letters, else en."""
    return F.when(F.coalesce(text, F.lit("")).rlike("(?iu)[а-яё]"), "ru").otherwise("en")


def any_of(text: Column, markers: tuple[str, ...]) -> Column:
    """The first of the markers that the text has; null for none."""
    return F.coalesce(*(F.when(text.contains(m), F.lit(m)) for m in markers))


def stub_reason(text: Column, raw: Column, code: Column) -> Column:
    """Why a page is a stub; null if it is clean. Raw source in lower case. The order of the checks decides."""
    head = F.lower(F.substring(text, 1, HEAD))
    thin = F.length(text) < THIN
    shield = F.coalesce(any_of(F.substring(raw, 1, 20_000), SHIELDS), any_of(head, SHIELDS))
    return (
        F.when(any_of(head, NO_SUCH_PAGE).isNotNull(), "no such page")
        .when(~thin, None)
        .when(shield.isNotNull(), "shield")
        .when(any_of(raw, PAYWALLS).isNotNull(), "paywall")
        .when(F.length(raw) > MARKUP, "markup")
        .when(code.isin(401, 403, 429), "code")
    )


def stub_detail(text: Column, raw: Column, code: Column) -> Column:
    """What makes a page a stub, with the marker that was found; null if it is clean. The checks are those of `stub_reason`."""
    head, early = F.lower(F.substring(text, 1, HEAD)), F.substring(raw, 1, 20_000)
    quoted = lambda m: F.lit(f'"{m}"' if "'" in m else f"'{m}'")
    first = lambda markers, *places: F.coalesce(*(F.when(reduce(or_, (p.contains(m) for p in places)), quoted(m)) for m in markers))
    size = lambda x: F.length(x).cast("string")
    told = {
        "no such page": F.concat(F.lit("at the start of the text: "), first(NO_SUCH_PAGE, head)),
        "shield": F.concat(F.lit("shield marker: "), first(SHIELDS, early, head)),
        "paywall": F.concat(F.lit("paywall: "), first(PAYWALLS, raw)),
        "markup": F.concat(size(raw), F.lit(" bytes of markup for "), size(text), F.lit(" characters of text")),
        "code": F.concat(F.lit("status "), code.cast("string"), F.lit(" and "), size(text), F.lit(" characters of text")),
    }
    kind = stub_reason(text, raw, code)
    return F.coalesce(*(F.when(kind == k, v) for k, v in told.items()))


def page_status(stub: Column, code: Column, text: Column, kind_ok: Column, stale: Column) -> Column:
    """forbidden, stub, refused, empty or read. A stale code (of a page that a browser rendered) is not looked at."""
    refused = ~stale & (code.isin(401, 403, 407, 429) | (code >= 500))
    return F.when(~kind_ok, "forbidden").when(stub.isNotNull(), "stub").when(refused, "refused").when(F.trim(text) == "", "empty").otherwise("read")


def markers_found(text: Column, markers: Column) -> Column:
    """Whether the text has all markers, in any case; null without markers."""
    low = F.lower(text)
    return F.when(F.size(markers) > 0, F.forall(markers, lambda m: low.contains(F.lower(m))))


def markers_together(text: Column, markers: Column, within: int = 1500) -> Column:
    """Whether all markers stand in the text, their first places at most `within` characters apart; false without markers."""
    low = F.lower(text)
    at = F.transform(markers, lambda m: F.call_function("locate", F.lower(m), low))
    return (F.size(markers) > 0) & F.forall(at, lambda i: i > 0) & (F.array_max(at) - F.array_min(at) <= within)


def positions(text: Column, part: Column) -> Column:
    """Places (from 0) where `part` stands in the text, overlapping ones too; none for an empty part.

    The text is split before each place, so the places are the running sums of the pieces' lengths.
    """
    pieces = F.transform(F.split(text, F.concat(F.lit(r"(?=\Q"), part, F.lit(r"\E)")), -1), lambda x: F.length(x))
    start = F.struct(F.lit(0).alias("at"), F.when(text.startswith(part), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")).alias("out"))
    step = lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["out"], s["at"] + n).alias("out"))
    found = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), start, step)["out"]
    return F.when((F.length(part) > 0) & (text != ""), found).otherwise(F.array().cast("array<int>"))


def near_each_other(text: Column, a: Column, b: Column, window: int) -> Column:
    """Whether `a` and `b` stand anywhere at most `window` characters apart."""
    pa, pb = positions(text, a), positions(text, b)
    return F.exists(pa, lambda i: F.exists(pb, lambda j: F.abs(i - j) <= window))


def markers_from_question(question: Column) -> Column:
    """Up to three names, versions and numbers of a question; long Cyrillic words lose their last two letters."""
    found = F.concat(
        F.regexp_extract_all(question, F.lit(r"(?U)\b([A-Z][A-Za-z0-9.\-]{2,})\b"), F.lit(1)),
        F.regexp_extract_all(question, F.lit(r"(?U)\b([A-Za-zА-Яа-яЁё]*\d[\w.\-]*)\b"), F.lit(1)),
        F.regexp_extract_all(question, F.lit(r"(?U)\b([А-ЯЁ][а-яё\-]{2,})\b"), F.lit(1)),
    )
    tidy = F.transform(found, lambda w: F.regexp_replace(w, r"^[.,;:!?()\[\]«»\"']+|[.,;:!?()\[\]«»\"']+$", ""))
    kept = F.array_distinct(F.filter(tidy, lambda w: (F.length(w) >= 3) & ~w.isin(*NOT_MARKERS)))
    long = lambda w: (F.length(w) >= 7) & w.rlike(r"^[А-Яа-яЁё\-]+$")
    return F.transform(F.slice(kept, 1, 3), lambda w: F.when(long(w), F.call_function("substring", w, F.lit(1), F.length(w) - 2)).otherwise(w))


def glyphs_repaired(text: Column) -> Column:
    """`/uni041C` names as the characters they stand for."""
    parts = F.split(text, "/uni(?=[0-9A-Fa-f]{4})")
    mend = lambda x: F.concat(F.decode(F.unhex(F.substring(x, 1, 4)), "UTF-16BE"), F.call_function("substring", x, F.lit(5)))
    return F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), mend), ""))


def dates_near(text: Column, markers: Column, window: int = 300, most: int = 41) -> Column:
    """The sorted dates (YYYY-MM-DD, not validated) that begin at most `window` characters from a marker.

    Dates stand as day, month in words and year, or in ISO form. Of all markers together, the first gives up to `most`
    places, the others one each once these are used up.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    spots = F.aggregate(
        F.transform(F.filter(markers, lambda m: m != ""), lambda m: positions(low, F.lower(m))),
        F.array().cast("array<int>"),
        lambda out, at: F.concat(out, F.slice(at, 1, F.greatest(F.lit(most) - F.size(out), F.lit(1)))),
    )

    def near(pattern: str, read) -> Column:
        # Matches and the pieces between them alternate, so running lengths give the places of the matches.
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def step(s: Column, i: Column) -> Column:
            at, own = s["at"] + F.get(gaps, i), F.get(found, i)
            close = F.exists(spots, lambda p: F.abs(p - at) <= window)
            return F.struct((at + F.length(own)).alias("at"), F.when(close, F.array_append(s["out"], read(own))).otherwise(s["out"]).alias("out"))

        empty = F.array().cast("array<int>")
        steps = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(empty)
        return F.aggregate(steps, start, step)["out"]

    def in_words(own: Column) -> Column:
        part = lambda i: F.regexp_extract(own, r"(?iU)^(\d{1,2})\s+(\w+)\s+(\d{4})$", i)
        month = F.coalesce(*(F.when(F.lower(part(2)).startswith(m), F.lit(f"{k:02d}")) for m, k in MONTHS.items()))
        return F.concat(part(3), F.lit("-"), month, F.lit("-"), F.lpad(part(1), 2, "0"))  # null if the word is no month

    words = r"(?U)\b\d{1,2}\s+\w+\s+\d{4}"
    iso = r"(?U)\b\d{4}-\d{2}-\d{2}\b"
    return F.array_sort(F.array_distinct(F.filter(F.concat(near(words, in_words), near(iso, lambda own: own)), lambda x: x.isNotNull())))


def vocabulary(text: Column, markers: Column) -> Column:
    """The distinct words of four letters and more (hyphens count) that are in no marker."""
    words = lambda t: F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}_\-]{4,}"), F.lit(0))
    return F.array_except(F.array_distinct(words(F.coalesce(text, F.lit("")))), F.flatten(F.transform(markers, words)))
