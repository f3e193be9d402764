"""Documents in files: PDF files read as binary, their text by a parser that may be absent."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Pages of a file that are parsed at most (fixed value).
MOST_PAGES = 60

#: A parser: from a file's bytes and the most pages, how many pages it has and the texts of the first ones.
Parser = Callable[[bytes, int], tuple[int, list[str]]]


def parsed_by_library(body: bytes, most: int) -> tuple[int, list[str]]:
    """By pypdf, if it is there. A page that breaks has no text and does not cancel the rest."""
    import io

    try:
        import pypdf
    except ImportError as e:
        raise ValueError("the PDF parser is not installed") from e
    pages = pypdf.PdfReader(io.BytesIO(body)).pages
    out = []
    for page in pages[:most]:
        try:
            out.append(page.extract_text() or "")
        except Exception:  # somebody else's format breaks in many ways
            out.append("")
    return len(pages), out


def pdf_texts(spark: SparkSession, path: str, most: int = MOST_PAGES, parser: Parser = parsed_by_library) -> DataFrame:
    """One row for each PDF file in a folder: path, pages, pages_parsed, truncated_by_pages, text, error (empty if it was read).

    Glyph names become characters, runs of blanks one blank, and of more than two line ends two are left. A file that the
    parser can't read has no text and says why, an empty file has no row; files are read one at a time by a worker.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, body in zip(batch["path"], batch["content"], strict=True):
                try:
                    total, texts = parser(bytes(body), most)
                    row = (name, total, min(total, most), total > most, "\n".join(texts[:most]), "")
                except Exception as e:  # a broken file is a row that says so
                    row = (name, None, 0, False, "", f"{type(e).__name__}: {e}"[:200])
                yield pd.DataFrame([row], columns=["path", "pages", "pages_parsed", "truncated_by_pages", "text", "error"]).astype({"pages": "Int32", "pages_parsed": "int32"})

    read = files.mapInPandas(run, "path string, pages int, pages_parsed int, truncated_by_pages boolean, text string, error string")
    tidy = F.regexp_replace(F.regexp_replace(T.glyphs_repaired(F.col("text")), "[ \\t\\u00a0]+", " "), "\\n{3,}", "\n\n")
    return read.withColumn("text", F.trim(tidy, F.lit(" \n\r\t")))
