"""Normal forms of years, types, titles, URLs and placeholders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.functions.text import any_of, blank, col, contains_any, has_cjk, let, strip, text


def normalize_year(c: Column | str) -> Column:
    """The one year of 19xx or 20xx in c, or 'first-last' in order of appearance; c itself without any."""
    years = F.array_distinct(F.regexp_extract_all(text(c), F.lit(r"(?<![\p{L}\p{N}_])((?:19|20)\d{2})(?![\p{L}\p{N}_])"), 1))
    return let(
        years,
        lambda y: F.when(F.size(y) == 0, col(c)).when(F.size(y) == 1, F.get(y, F.lit(0))).otherwise(F.concat(F.get(y, F.lit(0)), F.lit("-"), F.element_at(y, -1))),
    )


def _first_key(c: Column, table: Sequence[tuple[str, str]]) -> Column:
    """The name of the first key that c contains; null without any."""
    return F.coalesce(*[F.when(F.contains(c, F.lit(k)), F.lit(v)) for k, v in table], F.lit(None).cast("string"))


def normalize_type(
    c: Column | str,
    table: Sequence[tuple[str, str]] = fixed.CANONICAL_TYPES,
    pollutants: Sequence[str] = fixed.TYPE_POLLUTANTS,
    formats: Sequence[str] = fixed.FORMAT_WORDS,
) -> Column:
    """struct(type, materials). A key's spelling gives its name; a short clean type the first key in it, else itself; others
    are split at separators into types, formats (dropped) and materials. The table's order decides."""
    answer = lambda a, b: F.struct(a.alias("type"), b.alias("materials"))
    nothing = F.lit("")

    def split(whole: Column) -> Column:
        raw = F.split(whole, "[,;/，；]")
        parts = F.filter(F.transform(raw, lambda x: let(strip(x), lambda y: F.struct(y.alias("part"), F.lower(y).alias("low")))), lambda x: x["part"] != "")
        named = F.transform(parts, lambda x: F.struct(x["part"].alias("part"), x["low"].alias("low"), _first_key(x["low"], table).alias("type")))

        def of(found: Column) -> Column:
            types = F.array_distinct(F.array_compact(F.transform(found, lambda x: x["type"])))
            other = lambda x: x["type"].isNull() & ~contains_any(x["low"], formats) & (contains_any(x["low"], pollutants) | (F.length(x["part"]) > 3))
            rest = F.transform(F.filter(found, other), lambda x: x["part"])
            return answer(F.when(F.size(types) > 0, F.array_join(types, " / ")).otherwise(strip(F.get(raw, F.lit(0)))), F.array_join(rest, ", "))

        return let(named, of)

    def decide(x: Column) -> Column:
        whole, low, tight = x["whole"], x["low"], x["tight"]
        exact = F.coalesce(*[F.when((low == k) | (tight == k.replace(" ", "")), F.lit(v)) for k, v in table], F.lit(None).cast("string"))
        clean = ~contains_any(low, pollutants) & (F.length(whole) < 50)
        rest = F.when(clean, answer(F.coalesce(_first_key(low, table), whole), nothing)).otherwise(split(whole))
        return F.when(whole == "", answer(nothing, nothing)).otherwise(let(exact, lambda e: F.when(e.isNotNull(), answer(e, nothing)).otherwise(rest)))

    forms = let(strip(c), lambda w: let(F.lower(w), lambda v: F.struct(w.alias("whole"), v.alias("low"), F.replace(v, F.lit(" "), F.lit("")).alias("tight"))))
    return let(forms, decide)


def title_case(c: Column | str) -> Column:
    """Capitals after anything that is no letter; initcap knows spaces only."""
    pieces = F.regexp_extract_all(F.lower(text(c)), F.lit(r"\p{L}+|[^\p{L}]+"), 0)
    return F.array_join(F.transform(pieces, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1_000_000))), "")


def type_facet(c: Column | str) -> Column:
    """A type's top-level facet."""
    t = strip(F.lower(text(c)))
    has = lambda *words: contains_any(t, words)
    install = F.when(has("video"), "Video Installation").when(has("sound"), "Sound Installation").when(has("interactive"), "Interactive Installation").otherwise("Installation")
    return (
        F.when(blank(c), "(空)").when(has("installation"), install).when(has("video"), "Video").when(has("website", "网站"), "Website").when(has("performance"), "Performance")
        .when(has("sculpture", "雕塑"), "Sculpture").when(has("print", "printing", "印刷", "打印"), "Print").when(has("software", "app"), "Software/App")
        .when(has("photo"), "Photography").otherwise(F.substring(title_case(t), 1, 30))
    )


def normalize_url(c: Column | str) -> Column:
    return F.regexp_replace(strip(c), "/+$", "")


def drop_placeholder(c: Column | str, words: Sequence[str] = fixed.PLACEHOLDERS) -> Column:
    return F.when(F.lower(strip(c)).isin(*words), F.lit("")).otherwise(text(c))


def split_bilingual(c: Column | str) -> Column:
    """struct(title, title_cn) of 'English / Chinese'; without Chinese on the right the whole is the title."""
    parts = F.split(text(c), "/", 2)
    right = strip(F.get(parts, F.lit(1)))
    both = F.contains(text(c), F.lit("/")) & has_cjk(right)
    return F.struct(F.when(both, strip(F.get(parts, F.lit(0)))).otherwise(text(c)).alias("title"), F.when(both, right).otherwise(F.lit("")).alias("title_cn"))


def _halved(c: Column) -> Column:
    """Of 'x / ... / x' the x; else c."""
    parts = F.transform(F.split(c, "/"), strip)
    return F.when(F.contains(c, F.lit("/")) & (F.get(parts, F.lit(0)) == F.element_at(parts, -1)), F.get(parts, F.lit(0))).otherwise(c)


def clean_title(title: Column | str, title_cn: Column | str) -> Column:
    """struct(title, title_cn) without languages or halves that repeat."""
    t, cn = text(title), text(title_cn)
    parts = F.transform(F.split(t, "/"), strip)
    first, last = F.get(parts, F.lit(0)), F.element_at(parts, -1)
    chosen = F.when((cn != "") & (last != cn) & ~F.contains(cn, last) & ~F.contains(last, cn), cn).otherwise(last)
    answer = lambda a, b: F.struct(a.alias("title"), b.alias("title_cn"))
    slashed = F.contains(t, F.lit("/"))
    two = ~has_cjk(t) & (F.size(parts) == 2) & F.contains(F.lower(last), F.lower(first))
    return (
        F.when(slashed & ~has_cjk(first) & has_cjk(last), answer(first, _halved(chosen)))
        .when(slashed & two, answer(first, _halved(cn)))
        .otherwise(answer(t, F.when(t != "", _halved(cn)).otherwise(cn)))
    )


def is_repeated_half(c: Column | str) -> Column:
    parts = F.transform(F.split(text(c), "/"), strip)
    return F.contains(text(c), F.lit("/")) & (F.get(parts, F.lit(0)) == F.element_at(parts, -1))


def sort_year(c: Column | str, missing: str = "0000") -> Column:
    """What years are ordered by: the end of a range."""
    return F.when(blank(c), F.lit(missing)).otherwise(strip(F.element_at(F.split(text(c), "-"), -1)))


def any_blank(*columns: Column | str) -> Column:
    return any_of(blank(c) for c in columns)
