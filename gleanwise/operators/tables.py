"""Table functions: Python that takes whole partitions of a table and gives rows, called from SQL.

    register(spark)
    spark.sql("SELECT * FROM page_links(TABLE(pages))")
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from .html import MOST_LINKS, read_page


class PageLinks:
    """The links of each page of a table with page_id, url, html, host and block: page_id, position, target, caption, again.

    The function asks for the table by host and block, pages in order of page_id; blocks (some part of a host's pages, a
    caller's choice) keep a large host from being one partition. `again` is 1 if a page before it in the block has the
    link too.
    """

    @staticmethod
    def analyze(pages: AnalyzeArgument) -> AnalyzeResult:
        if not pages.isTable:
            raise ValueError("page_links takes a table: page_links(TABLE(...))")
        kinds = {f.name: f.dataType for f in pages.dataType.fields}
        missing = [c for c in ("page_id", "url", "html", "host", "block") if c not in kinds]
        if missing:
            raise ValueError(f"page_links: the table has no column {', '.join(missing)}")
        schema = StructType().add("page_id", kinds["page_id"]).add("position", IntegerType()).add("target", StringType()).add("caption", StringType()).add("again", IntegerType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("host"), PartitioningColumn("block")], orderBy=[OrderingColumn("page_id")])

    def __init__(self):
        self.seen: set[str] = set()

    def eval(self, page: Row) -> Iterator[tuple]:
        links = read_page(page["html"], page["url"])["links"][:MOST_LINKS]
        yield from ((page["page_id"], k, target, caption, int(target in self.seen)) for k, (target, caption) in enumerate(links))
        self.seen.update(target for target, _ in links)


def register(spark: SparkSession) -> None:
    """Makes page_links known to SQL."""
    spark.udtf.register("page_links", udtf(PageLinks))
