"""Audits of one table against another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import blank, strip, text
from tessera.operators.changes import one_each


def audit(expected: DataFrame, published: DataFrame, key: str = "url") -> DataFrame:
    """Rows of expected (key, year, title, title_cn) that are missing in published or differ there: is_missing, bad_year (the
    section's year is not in the expected one), bad_title, bad_title_cn (filled, but absent from the published one). Of rows
    that repeat a published key the greatest counts."""
    there = one_each(published, key, ["year", "title", "title_cn"]).select(F.col(key).alias("_key"), F.col("year").alias("_year"), F.col("title").alias("_title"), F.col("title_cn").alias("_cn"))
    df = expected.join(there, F.col(key) == F.col("_key"), "left")
    here = F.col("_key").isNotNull()
    flags = {
        "is_missing": ~here,
        "bad_year": here & ~F.contains(text("year"), text("_year")),
        "bad_title": here & (strip("title") != strip("_title")),
        "bad_title_cn": here & ~blank("title_cn") & ~F.contains(text("_cn"), strip("title_cn")),
    }
    return df.withColumns(flags).filter(" OR ".join(flags)).select(key, *flags)
