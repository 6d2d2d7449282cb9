"""Text helpers as Column expressions. Missing is null or the empty string; regular expressions see Unicode classes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CJK = r"[一-鿿]"

# What (?U)\s matches: Unicode's white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def blank(c: Column | str) -> Column:
    return text(c) == ""


def filled(c: Column | str) -> Column:
    """c, or null where it is blank."""
    return F.when(~blank(c), col(c))


def first_filled(*columns: Column | str) -> Column:
    return F.coalesce(*[filled(c) for c in columns], F.lit(""))


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends; trim() knows spaces only."""
    return F.btrim(text(c), F.lit(WHITE))


def upper_each(c: Column | str) -> Column:
    """Capitals, each character by itself: one whose capital form is of several letters stays, except that of ß, which is ẞ."""
    return F.array_join(F.transform(F.split(F.translate(text(c), "ß", "ẞ"), ""), lambda x: F.when(F.length(F.upper(x)) == 1, F.upper(x)).otherwise(x)), "")


def collapse(c: Column | str) -> Column:
    return strip(F.regexp_replace(text(c), r"(?U)\s+", " "))


def any_of(values: Iterable[Column]) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | v
    return out


def contains_any(c: Column | str, words: Iterable[str]) -> Column:
    return any_of(F.contains(text(c), F.lit(w)) for w in words)


def count_contained(c: Column | str, words: Iterable[str]) -> Column:
    return sum((F.contains(text(c), F.lit(w)).cast("int") for w in words), F.lit(0))


def starts_with_any(c: Column | str, words: Iterable[str]) -> Column:
    return any_of(F.startswith(text(c), F.lit(w)) for w in words)


def found(c: Column | str, pattern: str) -> Column:
    """The pattern is somewhere in c, without regard to case."""
    return text(c).rlike(f"(?iU){pattern}")


def matches_any(c: Column | str, patterns: Sequence[str]) -> Column:
    """One of the patterns matches c from its start, without regard to case."""
    return text(c).rlike("(?iU)^(?:" + "|".join(p.removeprefix("^") for p in patterns) + ")")


def first_match(c: Column | str, patterns: Sequence[str], group: int = 1) -> Column:
    """The group of the first pattern that c has; null without any."""
    return F.coalesce(*[filled(F.regexp_extract(text(c), f"(?iU){p}", group)) for p in patterns], F.lit(None).cast("string"))


def first_line_match(c: Column | str, patterns: Sequence[str]) -> Column:
    """Line by line: the first pattern of the first line that matches any; else the empty string."""
    lines = F.transform(F.split(text(c), "\n"), lambda line: strip(let(strip(line), lambda x: first_match(x, patterns))))
    hits = F.filter(lines, lambda x: x != "")
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(""))


def has_cjk(c: Column | str) -> Column:
    return text(c).rlike(CJK)


def count_chars(c: Column | str, pattern: str) -> Column:
    return F.length(text(c)) - F.length(F.regexp_replace(text(c), pattern, ""))


def mean_segment(c: Column | str, by: str = "[,，]") -> Column:
    """The average length of a text's parts, without white space at their ends."""
    parts = F.split(text(c), by)
    return F.aggregate(parts, F.lit(0), lambda acc, x: acc + F.length(strip(x))) / F.size(parts)


def is_bilingual(c: Column | str) -> Column:
    """A slash, an ASCII letter and a Chinese character."""
    return text(c).rlike("[/／]") & text(c).rlike("[A-Za-z]") & has_cjk(c)


def slug(url: Column | str) -> Column:
    """The last segment of a URL's path."""
    return F.element_at(F.split(F.regexp_replace(text(url), "/+$", ""), "/"), -1)


def slug_words(url: Column | str) -> Column:
    return F.lower(F.translate(slug(url), "-_", "  "))


def compared(c: Column | str) -> Column:
    """Lower-case ASCII letters and digits, words parted by one space."""
    return F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", " "))


def tokens(c: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(text(c), " "), lambda x: x != ""))


def safe_name(c: Column | str, most: int = 50) -> Column:
    """Letters, digits, '-', '_' and spaces; others become '_'."""
    return F.substring(F.regexp_replace(text(c), r"[^\p{L}\p{N}\-_ ]", "_"), 1, most)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def settle(df: DataFrame) -> DataFrame:
    """The same rows, computed up to here: later expressions refer to columns instead of repeating what made them. Without
    it the optimizer may merge a long chain of projections into expressions of many times their size."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows, dealt out by keys over all cores. A small file is one task, however dear its rows are; the number of
    partitions is given, as those of few bytes would else be joined again."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
