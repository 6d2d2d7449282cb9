"""Table functions for SQL: the links and the parts of a page, by LATERAL joins."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tessera.sources.html import PageLayout, absolute, parse_page


def _checked(arguments: tuple[AnalyzeArgument, ...], name: str, most: int) -> None:
    if not 1 <= len(arguments) <= most or not all(isinstance(a.dataType, (T.StringType, T.NullType)) for a in arguments):
        raise ValueError(f"{name} takes a page's html and up to {most - 1} more texts")


class _Links:
    """html_links(html [, url]): place, href, address (resolved against url, if given) for each link of a page."""

    @staticmethod
    def analyze(*arguments: AnalyzeArgument) -> AnalyzeResult:
        _checked(arguments, "html_links", 2)
        return AnalyzeResult(T.StructType().add("place", T.IntegerType()).add("href", T.StringType()).add("address", T.StringType()))

    def eval(self, *arguments: str | None) -> Iterator[tuple]:
        html, url = arguments[0], arguments[1] if len(arguments) > 1 else None
        for i, href in enumerate(parse_page(url or "", html or "", PageLayout())[5]):
            yield i, href, absolute(url, href) if url else href


class _Page:
    """html_page(html [, url]): page_title, raw_title, lines, n_links, n_images of a page, one row; nothing for a null page."""

    @staticmethod
    def analyze(*arguments: AnalyzeArgument) -> AnalyzeResult:
        _checked(arguments, "html_page", 2)
        shape = T.StructType().add("page_title", T.StringType()).add("raw_title", T.StringType()).add("lines", T.ArrayType(T.StringType()))
        return AnalyzeResult(shape.add("n_links", T.IntegerType()).add("n_images", T.IntegerType()))

    def eval(self, *arguments: str | None) -> Iterator[tuple]:
        if arguments[0] is not None:
            row = parse_page((arguments[1] if len(arguments) > 1 else None) or "", arguments[0], PageLayout())
            yield row[1], row[2], row[4], len(row[5]), len(row[8])


def register(spark: SparkSession) -> None:
    """Makes html_links and html_page known to the session's SQL."""
    spark.udtf.register("html_links", udtf(_Links))
    spark.udtf.register("html_page", udtf(_Page))
