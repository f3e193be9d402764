"""HTML source as tags and text, read forward in linear time, by HTML's own rules for broken markup.

A tag that never ends is markup to the end of the page, and so is an open comment; a quote that never closes ends with its
tag; "<" before anything but a letter, "/", "!" or "?" is text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

_GAP = re.compile(r"[\s/]*+")
_TAG_NAME = re.compile(r"[^\s/>]++")
_NAME = re.compile(r"[^\s/>][^\s/>=]*+")
_EQUALS = re.compile(r"\s*+=\s*+")
_VALUE = re.compile(r"[^\s>]*+")
_PLAIN = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+([^\s>]*+))?")
_LONG_NUMBER = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")


#: Elements whose content is no markup and no text (fixed values).
RAW = frozenset("script style".split())


def decoded(text: str) -> str:
    """Character references as their characters; numbers beyond all characters as the replacement character."""
    return unescape(_LONG_NUMBER.sub("�", text)) if "&" in text else text


class Source:
    """A page's source, read forward: what was not found once is not sought again."""

    def __init__(self, html: str):
        self.html, self.end = html, len(html)
        self.missing: dict[str, int] = {}
        self.closings: dict[str, re.Pattern] = {}

    def find(self, what: str, at: int) -> int:
        if at >= self.missing.get(what, self.end + 1):
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self.missing[what] = at
        return found

    def after(self, what: str, at: int) -> int:
        """The place after the next `what`; without one, the end."""
        found = self.find(what, at)
        return found + len(what) if found >= 0 else self.end

    def after_comment(self, at: int) -> int:
        """The place after the comment that begins at `at`."""
        for short in ("<!-->", "<!--->"):
            if self.html.startswith(short, at):
                return at + len(short)
        return min(self.after("-->", at + 4), self.after("--!>", at + 4))

    def attributes(self, at: int) -> tuple[dict[str, str], int, bool]:
        """A tag's attributes from `at` on, the place after the tag, and whether it ends in a slash."""
        html, close = self.html, self.find(">", at)
        if close < 0:
            return {}, self.end, False
        rest = html[at:close]
        if '"' not in rest and "'" not in rest:
            told = rest.strip()
            return ({k.lower(): v for k, v in reversed(_PLAIN.findall(told))} if told else {}), close + 1, rest.endswith("/")
        found: dict[str, str] = {}
        while True:
            at = _GAP.match(html, at).end()
            if at >= self.end:
                return found, self.end, False
            if html[at] == ">":
                return found, at + 1, html[at - 1] == "/"
            name = _NAME.match(html, at)
            at, value = name.end(), ""
            if equals := _EQUALS.match(html, at):
                at = equals.end()
                if (quote := html[at : at + 1]) in ('"', "'") and quote:
                    close = self.find(quote, at + 1)
                    if close >= 0:
                        value, at = html[at + 1 : close], close + 1
                    else:  # it never closes: the value ends with the tag
                        close = self.find(">", at)
                        if close < 0:
                            return found, self.end, False
                        value, at = html[at + 1 : close], close
                else:
                    value = _VALUE.match(html, at)[0]
                    at += len(value)
            found.setdefault(name[0].lower(), value)

    def tag(self, at: int) -> tuple[str, str, dict[str, str], bool, int]:
        """What the "<" at this place begins: kind (start, end, other, or data for a mere "<"), name, attributes, whether it ends in a slash, the place after it."""
        html = self.html
        sign = html[at + 1 : at + 2]
        closes = sign == "/"
        first = html[at + 2 : at + 3] if closes else sign
        if not (first.isascii() and first.isalpha()):
            if html.startswith("<!--", at):
                return "other", "", {}, False, self.after_comment(at)
            if sign in ("!", "?") and sign or closes and first:
                return "other", "", {}, False, self.after(">", at)
            return "data", "", {}, False, at + 1
        name = _TAG_NAME.match(html, at + 1 + closes)
        found, after, slash = self.attributes(name.end())
        return "end" if closes else "start", name[0].lower(), found, slash, after

    def after_element(self, tag: str, at: int) -> int:
        """The place after the next end tag of `tag`, -1 without one."""
        closing = self.closings.get(tag)
        if closing is None:
            closing = self.closings[tag] = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)
        key = "</" + tag
        if at >= self.missing.get(key, self.end + 1):
            return -1
        found = closing.search(self.html, at)
        if not found:
            self.missing[key] = at
            return -1
        return self.attributes(found.end())[1]


def tokens(html: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, value, attributes) in order: start and end with the tag's name, data with text, raw with what a script or style holds."""
    source, at = Source(html), 0
    while at < source.end:
        open_at = html.find("<", at)
        if open_at < 0:
            yield "data", decoded(html[at:]), {}
            return
        if open_at > at:
            yield "data", decoded(html[at:open_at]), {}
        kind, tag, found, slash, at = source.tag(open_at)
        if kind == "data":
            yield kind, "<", {}
        elif kind == "end":
            yield kind, tag, {}
        elif kind == "start":
            yield kind, tag, {k: decoded(v) for k, v in found.items()}
            if tag in RAW:
                after = source.after_element(tag, at)
                body = html[at : after if after >= 0 else source.end]
                end = body.rfind("</")
                yield "raw", body[:end] if after >= 0 else body, {}
                yield "end", tag, {}
                at = after if after >= 0 else source.end
            elif slash:
                yield "end", tag, {}
