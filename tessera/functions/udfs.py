"""The few functions that no built-in expression equals, as Arrow-batched pandas UDFs."""

from __future__ import annotations

from difflib import SequenceMatcher
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import fixed
from tessera.functions.predicates import is_foreign_title, is_type_name, mentioned_works, title_fits_slug
from tessera.functions.text import any_of, blank, slug_words, strip, text


@F.pandas_udf(T.DoubleType())
def seq_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Similarity by longest matching blocks; the order of the two matters."""
    return pd.Series([None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)], dtype="float64")


@F.pandas_udf(T.BooleanType())
def is_title_cased(values: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else v.istitle() for v in values], dtype="boolean")


@F.pandas_udf(T.StringType())
def url_join(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or k is None else urljoin(b, k) for b, k in zip(base, link, strict=True)], dtype="object")


def plain_title(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text(c)), r"[^\p{L}\p{N}\s]", ""), r"(?U)\s+", " "))


def with_similar(df: DataFrame, left: str, right: str, out: str, least: float = 0.7) -> DataFrame:
    """Adds out: the normal forms' ratio is at least least. Of equal and blank ones only nulls reach Python."""
    a, b, empty = plain_title(left), plain_title(right), blank(left) | blank(right)
    open_ = ~empty & (a != b)
    ratio = seq_ratio(F.when(open_, a), F.when(open_, b))
    return df.withColumn(out, F.coalesce(ratio >= least, ~empty & (a == b)))


def with_title_check(df: DataFrame, url: str, title: str, out: str, owners: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """Adds out: the title belongs to the page. Only titles that word overlap leaves open are compared in Python; the others
    reach it as nulls."""
    never = blank(title) | blank(url) | is_type_name(title) | is_foreign_title(url, title, owners or [])
    fits = title_fits_slug(url, title)
    clean = F.regexp_replace(F.lower(text(title)), r"[^\p{L}\p{N}\s]", " ")
    open_ = ~never & ~fits
    ratio = seq_ratio(F.when(open_, slug_words(url)), F.when(open_, clean))
    return df.withColumn(out, F.coalesce(ratio >= 0.6, ~never & fits))


def with_other_work(df: DataFrame, description: str, title: str, url: str, out: str, owners: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """Adds out: the description introduces a work that is neither the title's nor the page's, or names one that is known to
    leak. As names_other_work, but a mentioned title may also belong to the page by its similarity to the slug."""
    low, current = F.lower(strip(description)), F.lower(text(title))
    marks = []
    for i, (mention, least) in enumerate(zip(mentioned_works(low), (0, 2), strict=True)):
        at, ok = f"_m{i}", f"_ok{i}"
        open_ = (F.length(mention) > least) & ~F.contains(current, mention)
        df = with_title_check(df.withColumn(at, F.when(open_, mention)), url, at, ok, owners)
        marks.append(F.col(at).isNotNull() & ~F.col(ok))
    others = any_of(F.contains(low, F.lit(k)) & ~F.contains(slug_words(url), F.lit(k)) & ~F.contains(current, F.lit(k)) for k in fixed.LEAKING_WORKS)
    told = (F.length(text(description)) >= 30) & (current != "") & (any_of(marks) | others)
    return df.withColumn(out, told).drop("_m0", "_m1", "_ok0", "_ok1")
