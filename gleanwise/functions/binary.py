"""Bytes, sizes and what needs Python's own codecs (as Arrow-batched functions)."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, BooleanType, StringType, StructField, StructType

#: Resolutions that are tried for page images, best first (fixed values).
DPI_LADDER = (300, 220, 160, 110, 72)

#: Most bytes of a page.
CEILING = 2 * 1024 * 1024

_UNPACKED = StructType([StructField("body", BinaryType()), StructField("truncated", BooleanType()), StructField("ok", BooleanType())])

#: The signature of a PNG file (fixed value).
PNG = "89504E470D0A1A0A"


def _png_number(image: Column, at: int) -> Column:
    is_png = F.hex(F.substring(image, 1, 8)) == PNG
    return F.when(is_png & (F.octet_length(image) >= 24), F.conv(F.hex(F.substring(image, at, 4)), 16, 10).cast("int"))


def png_width(image: Column) -> Column:
    """The width in a PNG's header; null for other bytes."""
    return _png_number(image, 17)


def png_height(image: Column) -> Column:
    return _png_number(image, 21)


def base64_size(size: Column) -> Column:
    return F.floor((size + 2) / 3).cast("bigint") * 4


def first_fitting_dpi(size: Callable[[int], Column], most: int) -> Column:
    """The best resolution whose image, of `size(dpi)` bytes, fits into `most` bytes as base64; else the lowest."""
    return F.coalesce(*(F.when(base64_size(size(dpi)) <= most, dpi) for dpi in DPI_LADDER), F.lit(DPI_LADDER[-1]))


@pandas_udf(StringType())
def ascii_url(url: pd.Series) -> pd.Series:
    """The address with its host in IDNA and everything else percent-encoded; as it is if the host can't be."""

    def one(u: str | None) -> str | None:
        if not u:
            return u
        try:
            x = urlsplit(u)
            host = (x.hostname or "").encode("idna").decode()
            if x.port:
                host += f":{x.port}"
            return urlunsplit((x.scheme, host, quote(x.path, safe="/%:@!$&'()*+,;=~-._"), quote(x.query, safe="/%:@!$&'()*+,;=~-._?"), ""))
        except (UnicodeError, ValueError):
            return u

    return url.map(one)


@pandas_udf(StringType())
def decoded(body: pd.Series, content_type: pd.Series) -> pd.Series:
    """A page's text by the charset that its header or first 4096 bytes name, else UTF-8 if it is that, else windows-1251."""
    import re

    named = re.compile(rb"""charset\s*=\s*["']?([\w\-]+)""", re.I)

    def one(raw: bytes | None, kind: str | None) -> str | None:
        if raw is None:
            return None
        m = named.search((kind or "").encode()) or named.search(raw[:4096])
        if m:
            try:
                return raw.decode(m[1].decode("ascii"), "replace")
            except LookupError:
                pass
        try:
            raw[:20000].decode("utf-8")
            return raw.decode("utf-8", "replace")
        except UnicodeDecodeError as e:
            return raw.decode("utf-8" if e.start >= 19990 else "cp1251", "replace")

    return pd.Series([one(b, c) for b, c in zip(body, content_type, strict=True)])


@pandas_udf(_UNPACKED)
def unpacked(body: pd.Series, encoding: pd.Series) -> pd.DataFrame:
    """A response body without its gzip or deflate encoding, up to the ceiling. Not ok: broken bytes or another encoding."""
    import zlib

    def one(raw: bytes | None, kind: str | None) -> tuple[bytes | None, bool, bool]:
        kind = (kind or "").strip().lower()
        if raw is None or kind in ("", "identity"):
            return raw, raw is not None and len(raw) > CEILING, True
        if kind not in ("gzip", "x-gzip", "deflate"):
            return None, False, False
        for bits in (47, -15) if kind == "deflate" else (47,):
            try:
                out = zlib.decompressobj(bits).decompress(raw, CEILING + 1)
                return out[:CEILING], len(out) > CEILING, True
            except zlib.error:
                continue
        return None, False, False

    return pd.DataFrame([one(b, e) for b, e in zip(body, encoding, strict=True)], columns=["body", "truncated", "ok"])
