"""Repairs of single records: fields that hold what belongs in others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.functions.normalize import title_case
from tessera.functions.predicates import is_date_as_duration, is_repair_credits, is_title_as_materials, is_type_name, is_url, reads_as_repair_description
from tessera.functions.text import blank, contains_any, filled, found, has_cjk, is_bilingual, let, slug_words, starts_with_any, strip, text


def repair_credits(df: DataFrame) -> DataFrame:
    """Credits in materials or type go to credits if those are blank; URLs and descriptions leave the type; dimensions leave
    the materials for a blank size. Adds changes, the names of the moves."""
    mat, typ, cred = text("materials"), text("type"), text("credits")
    mat_cred, typ_cred = is_repair_credits(mat), is_repair_credits(typ)
    from_mat = mat_cred & (cred == "")
    credits = F.when(from_mat, mat).otherwise(cred)
    from_typ = typ_cred & (credits == "")
    url_typ, long_typ = is_url(typ), F.length(typ) > 100
    left = F.when(mat_cred, F.lit("")).otherwise(mat)
    sized = (left != "") & left.rlike("(?i)^Dimension")
    to_size = sized & blank("size")
    names = ((from_mat, "materials_to_credits"), (from_typ, "type_to_credits"), (url_typ, "type_url"), (long_typ, "type_long"), (to_size, "materials_to_size"))
    return df.withColumns(
        {
            "changes": F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in names])),
            "size": F.when(to_size, left).otherwise(text("size")),
            "materials": F.when(sized, F.lit("")).otherwise(left),
            "credits": F.when(from_typ, typ).otherwise(credits),
            "type": F.when(typ_cred | url_typ | long_typ, F.lit("")).otherwise(typ),
        }
    )


def split_materials(c: Column | str) -> Column:
    """struct(materials, size, duration): a pure size, else the first embedded duration and the first embedded size taken out."""
    whole = text(c)
    pure = F.lit(False)
    for p in fixed.PURE_SIZE_PATTERNS:
        pure = pure | strip(whole).rlike(f"(?iU){p}")

    def durations(value: Column) -> Column:
        out = F.struct(value.alias("rest"), F.lit("").alias("duration"))
        for take, drop in reversed(fixed.EMBEDDED_DURATIONS):
            out = F.when(found(value, take), F.struct(F.regexp_replace(value, f"(?iU){drop}", "").alias("rest"), strip(F.regexp_extract(value, f"(?iU){take}", 1)).alias("duration"))).otherwise(out)
        return out

    def sizes(x: Column) -> Column:
        value = x["rest"]
        out = F.struct(value.alias("rest"), F.lit("").alias("size"), x["duration"].alias("duration"))
        for pattern, name in reversed(fixed.EMBEDDED_SIZES):
            size = F.lit(name) if name else strip(F.regexp_extract(value, f"(?iU){pattern}", 1))
            out = F.when(found(value, pattern), F.struct(F.regexp_replace(value, f"(?iU){pattern}", "").alias("rest"), size.alias("size"), x["duration"].alias("duration"))).otherwise(out)
        return out

    def tidy(x: Column) -> Column:
        rest = F.regexp_replace(x["rest"], r"(?U)[,;]\s*[,;]", ",")
        rest = F.regexp_replace(F.regexp_replace(rest, r"(?U)^[,;\s]+|[,;\s]+$", ""), r"(?U)\s{2,}", " ")
        return F.struct(strip(rest).alias("materials"), x["size"].alias("size"), x["duration"].alias("duration"))

    nothing = F.lit("")
    return (
        F.when(whole == "", F.struct(nothing.alias("materials"), nothing.alias("size"), nothing.alias("duration")))
        .when(pure, F.struct(nothing.alias("materials"), strip(whole).alias("size"), nothing.alias("duration")))
        .otherwise(let(let(durations(whole), sizes), tidy))
    )


def repair_sizes(df: DataFrame) -> DataFrame:
    """split_materials where size or duration is blank; filled ones stay."""
    need = (blank("size") | blank("duration")) & ~blank("materials")
    df = df.withColumn("_s", split_materials("materials"))
    return df.withColumns(
        {
            "materials": F.when(need, F.col("_s.materials")).otherwise(text("materials")),
            "size": F.when(need & blank("size"), F.col("_s.size")).otherwise(text("size")),
            "duration": F.when(need & blank("duration"), F.col("_s.duration")).otherwise(text("duration")),
        }
    ).drop("_s")


def repair_problems(df: DataFrame) -> DataFrame:
    """A type that says null, materials that are a title, credits or a description, and dates as durations are cleared. Adds
    fixed_type, fixed_materials, fixed_duration."""
    null_type = F.lower(strip("type")) == "null"
    as_title = is_title_as_materials("materials", "title", "title_cn")
    described = ~as_title & reads_as_repair_description("materials")
    to_credits = described & blank("credits") & contains_any(F.lower(text("materials")), ("team:", "concept:", "collaboration"))
    dated = is_date_as_duration("duration")
    return df.withColumns(
        {
            "fixed_type": null_type, "fixed_materials": as_title | described, "fixed_duration": dated,
            "credits": F.when(to_credits, text("materials")).otherwise(text("credits")),
            "type": F.when(null_type, F.lit("")).otherwise(text("type")),
            "materials": F.when(as_title | described, F.lit("")).otherwise(text("materials")),
            "duration": F.when(dated, F.lit("")).otherwise(text("duration")),
        }
    )


def type_as_title(title: Column | str, type_: Column | str, url: Column | str) -> Column:
    """struct(title, type): a title that is a type becomes the type (if blank), and the slug the title."""
    wrong = is_type_name(title)
    return F.struct(F.when(wrong, title_case(slug_words(url))).otherwise(text(title)).alias("title"), F.when(wrong & blank(type_), title_case(title)).otherwise(text(type_)).alias("type"))


def split_type(c: Column | str, artist: tuple[str, ...] = ()) -> Column:
    """struct(type, duration, size): an embedded duration and size taken out; credits, URLs, sizes and long texts are no types."""
    t = text(c)
    low = F.lower(t)
    limit = F.when(is_bilingual(t), F.lit(150)).otherwise(F.lit(80))
    colon = F.contains(t, F.lit(":")) & ~low.rlike("^[a-z]+:") & (F.length(strip(F.regexp_extract(t, r"(?s):(.*)$", 1))) > 30)
    no = (
        low.rlike(r"^(?:photo(?:\s+by)?:|concept:|sound:|software:|copyright|made possible)") | starts_with_any(t, ("http",)) | (F.length(t) > limit)
        | contains_any(low, fixed.SIZE_MARKS) | contains_any(low, [a.lower() for a in artist]) | colon
    )
    quotes = "'‘’′\""
    head = rf"(?sU)^(\d+[{quotes}]{{1,2}}\d*[{quotes}]*)\s*(.*)$"
    minutes = r"(?iU),?\s*(\d+\s*(?:min(?:utes?)?|seconds?)[^,]*)"
    unit, by = r"\s*(?:cm|mm|m)?\s*", "[×xX]"
    size = rf"(?U)(\d+{unit}{by}\s*\d+\s*(?:cm|mm|m)?(?:\s*{by}\s*\d+\s*(?:cm|mm|m)?)?)"

    def timed() -> Column:
        plain = F.struct(t.alias("rest"), F.lit("").alias("duration"))
        by_minutes = F.struct(F.regexp_replace(strip(F.regexp_replace(t, minutes, "")), ",+$", "").alias("rest"), strip(F.regexp_extract(t, minutes, 1)).alias("duration"))
        by_quotes = F.struct(F.regexp_replace(strip(F.regexp_extract(t, head, 2)), f"^[{quotes}″“” ]+", "").alias("rest"), strip(F.regexp_extract(t, head, 1)).alias("duration"))
        return F.when(t.rlike(head), by_quotes).when(t.rlike(minutes), by_minutes).otherwise(plain)

    def sized(x: Column) -> Column:
        r = x["rest"]
        rest = F.regexp_replace(strip(F.regexp_replace(r, r"\s*" + size.removeprefix("(?U)"), "")), ",+$|/+$", "")
        return F.struct(F.when(r.rlike(size), rest).otherwise(r).alias("type"), x["duration"].alias("duration"), strip(F.regexp_extract(r, size, 1)).alias("size"))

    nothing = F.lit("")
    return F.when((t == "") | no, F.struct(nothing.alias("type"), nothing.alias("duration"), nothing.alias("size"))).otherwise(let(timed(), sized))


def tidy_type(c: Column | str) -> Column:
    """struct(type, duration, size): the first duration that a type starts or ends with, else its minutes, then its sizes and
    then ranges of years taken out."""
    own, every = fixed.TYPE_DURATION, "(?iU)"
    ends = lambda x, signs: F.regexp_replace(x, f"[{signs}]+$", "")

    def timed(t: Column) -> Column:
        head, tail, minutes = rf"(?U)^({own})\s*(.*)$", rf"(?U)\s+({own})\s*$", rf"{every},?\s*({fixed.TYPE_MINUTES})"
        answer = lambda rest, pattern: F.struct(rest.alias("rest"), strip(F.regexp_extract(t, pattern, 1)).alias("duration"))
        after = F.regexp_replace(strip(F.regexp_extract(t, head, 2)), "^[\"'′″“”‘’ ]+", "")
        return (
            F.when(t.rlike(head), answer(after, head)).when(t.rlike(tail), answer(strip(F.regexp_replace(t, tail, "")), tail))
            .when(t.rlike(minutes), answer(ends(strip(F.regexp_replace(t, minutes, "")), ","), minutes)).otherwise(F.struct(t.alias("rest"), F.lit("").alias("duration")))
        )

    def sized(x: Column) -> Column:
        size = rf"(?U)({fixed.TYPE_SIZE})"
        rest = strip(ends(ends(strip(F.regexp_replace(x["rest"], rf"(?U)\s*{fixed.TYPE_SIZE}", "")), ","), "/"))
        rest = F.when(x["rest"].rlike(size), rest).otherwise(x["rest"])
        bare = strip(ends(strip(F.regexp_replace(rest, f"(?U){fixed.TYPE_YEARS}", "")), ","))
        return F.struct(bare.alias("type"), x["duration"].alias("duration"), strip(F.regexp_extract(x["rest"], size, 1)).alias("size"))

    return let(let(strip(c), timed), sized)


def changes_counted(df: DataFrame) -> DataFrame:
    """change, n: in how many rows each change was made."""
    return df.select(F.explode("changes").alias("change")).groupBy("change").agg(F.count("*").alias("n"))


def split_title(title: Column | str, title_cn: Column | str) -> Column:
    """struct(title, title_cn) of 'A / B' titles. Unlike clean_title it leaves two equal halves alone, and a Chinese title that
    has nothing to do with the right half."""
    t, cn = text(title), text(title_cn)
    parts = F.transform(F.split(t, "/"), strip)
    first, last = F.get(parts, F.lit(0)), F.element_at(parts, -1)
    answer = lambda a, b: F.struct(a.alias("title"), b.alias("title_cn"))
    near = (cn == t) | (cn == last) | (cn == "") | F.contains(cn, last) | F.contains(last, cn)
    english = ~has_cjk(first) & ~has_cjk(last) & (F.size(parts) == 2)
    same = (F.size(parts) == 2) & (first == last)
    halves = F.transform(F.split(cn, "/"), strip)
    half = F.when(F.contains(cn, F.lit("/")) & (F.get(halves, F.lit(0)) == F.element_at(halves, -1)), F.get(halves, F.lit(0))).otherwise(cn)
    shorter = F.when(english & F.contains(F.lower(last), F.lower(first)), first).otherwise(t)
    return (
        F.when(~F.contains(t, F.lit("/")), answer(t, cn)).when(~has_cjk(first) & has_cjk(last) & near, answer(first, last))
        .when(same, answer(t, cn)).otherwise(answer(shorter, half))
    )


def repair_counts(df: DataFrame) -> DataFrame:
    """One row: how many rows each change was made in."""
    return df.agg(F.count("*").alias("total"), F.count_if(F.size("changes") > 0).alias("modified")).crossJoin(
        df.select(F.explode("changes").alias("change")).agg(F.count("*").alias("moves"))
    )


__all__ = ["changes_counted", "filled", "repair_counts", "repair_credits", "repair_problems", "repair_sizes", "split_materials", "split_title", "split_type", "tidy_type", "type_as_title"]
