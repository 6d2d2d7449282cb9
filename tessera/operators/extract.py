"""Work records from parsed pages and Markdown: ordered rules over lines, all as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.functions.normalize import normalize_type, normalize_year, split_bilingual, title_case
from tessera.functions.predicates import is_credits_line, is_description_line, is_image, is_language_cn, is_type_line, is_video_link, names_material
from tessera.functions.text import (
    CJK, any_of, blank, contains_any, count_chars, count_contained, filled, first_filled, first_line_match, has_cjk, is_bilingual, let, matches_any, settle, starts_with_any, strip, text,
)
from tessera.operators.repair import split_type, tidy_type
from tessera.sources.html import PageLayout


def size_and_duration(c: Column | str) -> Column:
    """struct(size, duration) of a text's first 3,000 characters, line by line."""
    head = F.substring(text(c), 1, 3000)
    return F.struct(first_line_match(head, fixed.SIZE_PATTERNS).alias("size"), first_line_match(head, fixed.DURATION_PATTERNS).alias("duration"))


def content_lines(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~matches_any(x, fixed.INTERFERENCE_LINES))


def _first(values: Column, where) -> Column:
    return F.coalesce(F.get(F.filter(values, where), F.lit(0)), F.lit(""))


def type_from_tags(tags: Column) -> Column:
    """The first tag under /filter/ that is an excluded one, a canonical type, or has a type word; as its name."""
    names = F.transform(F.filter(tags, lambda t: F.contains(t["href"], F.lit("/filter/"))), lambda t: strip(t["text"]))
    low = F.lower
    keys = dict(fixed.CANONICAL_TYPES)
    canonical = lambda x: F.coalesce(*[F.when(low(x) == k, F.lit(v)) for k, v in keys.items()])
    worded = lambda x: any_of(F.contains(low(x), F.lit(w.lower())) for w in fixed.TYPE_WORDS)
    name = lambda x: F.when(low(x).isin(*fixed.EXCLUDED_TAGS), x).when(low(x).isin(*keys), canonical(x)).when(worded(x), x)
    return F.coalesce(F.get(F.array_compact(F.transform(names, name)), F.lit(0)), F.lit(""))


def year_of(tags: Column, lines: Column) -> Column:
    """A tag that is a year or range of 20xx, else the first one within a line, with '-' for its dash."""
    tag = _first(F.transform(F.filter(tags, lambda t: F.contains(t["href"], F.lit("/filter/"))), lambda t: strip(t["text"])), lambda x: x.rlike(r"^20\d{2}(?:-20\d{2})?$"))
    within = F.transform(lines, lambda x: F.regexp_extract(x, r"(?U)\b(20\d{2}(?:\s*[-–]\s*20\d{2})?)\b", 1))
    return first_filled(tag, F.translate(_first(within, lambda x: x != ""), "–", "-"))


def is_materials_line(c: Column, title: Column, title_cn: Column, artist: Sequence[str] = ()) -> Column:
    """A list, not a sentence, credit, type, year, size, title, URL, date or address, with a known material or three parts.
    What most lines fail on at little cost comes first."""
    n, parts = F.length(c), F.split(c, r"[,/、，]")
    plain = (n < 10) | (n > 150) | ~any_of(F.contains(c, F.lit(x)) for x in ",/、，") | ((n > 80) & ~is_bilingual(c))
    vetoed = plain | is_type_line(c, artist) | let(F.lower(text(c)), lambda low: _no_materials(c, low, title, title_cn)) | is_credits_line(c)
    worded = F.exists(F.transform(F.slice(parts, 1, 2), lambda x: F.lower(strip(x))), lambda x: F.regexp_extract(x, r"(?U)^(\S+)", 1).isin(*fixed.PART_STARTERS))
    return ~vetoed & (names_material(c) | ((F.size(parts) >= 3) & ~worded))


def _no_materials(c: Column, low: Column, title: Column, title_cn: Column) -> Column:
    """A sentence, credit, year, size, title, URL, date, address or Chinese prose; low is c in small letters."""
    sentence = c.rlike(r"^\p{Lu}") & (F.endswith(c, F.lit(".")) | F.endswith(c, F.lit("。"))) & contains_any(low, fixed.LINE_SENTENCE_WORDS)
    told = contains_any(low, fixed.LINE_CREDIT_MARKS) | starts_with_any(c, fixed.LINE_QUOTES) | contains_any(low, fixed.LINE_VERBS)
    starts = F.lower(F.regexp_extract(c, r"(?U)^\s*(\S+)", 1)).isin(*fixed.LINE_STARTERS)
    shape = (
        c.rlike(r"^20\d{2}(?:\s*[-–]\s*20\d{2})?$") | c.rlike(r"(?i)^\d+\s*[×x]\s*\d+(?:\s*[×x]\s*\d+)?\s*(?:cm|mm|m)?$") | (F.contains(low, F.lit("dimension")) & F.contains(low, F.lit("variable")))
        | F.contains(c, F.lit("尺寸可变")) | contains_any(low, ("http://", "https://", "www."))
    )
    titled = (title != "") & (F.contains(low, F.lower(strip(title))) | ((title_cn != "") & F.contains(c, title_cn)))
    dated = c.rlike(r"\d{1,2}[.,]\s*\d{4}") & low.rlike(rf"(?iU)\b(?:Opening|{fixed.MONTHS})\b")
    placed = count_contained(low, fixed.ADDRESS_WORDS) >= 2
    chinese = count_chars(c, CJK)
    prose = (F.length(c) > 20) & (chinese > 20) & (chinese > 0.7 * F.length(c))
    return told | sentence | starts | shape | titled | placed | dated | prose


def names_type(c: Column) -> Column:
    return any_of(F.contains(F.lower(c), F.lit(w.lower())) for w in fixed.TYPE_WORDS)


def is_size_or_year(c: Column) -> Column:
    """Starts with a size, says that dimensions vary, or is a year or range of 20xx."""
    low = F.lower(c)
    variable = (F.contains(low, F.lit("dimension")) & F.contains(low, F.lit("variable"))) | F.contains(c, F.lit("尺寸可变"))
    return c.rlike(r"(?U)^\d+\s*[×xX]\s*\d+") | variable | c.rlike(r"(?U)^20\d{2}(?:\s*[-–]\s*20\d{2})?$")


def position_kind(c: Column) -> Column:
    """Of a line after the title: 'type', 'materials' (a list, or one known material), or '' for sizes, years, descriptions and others."""
    stop = F.endswith(c, F.lit("."))
    long_ = (F.length(c) > 80) & (F.contains(c, F.lit("。")) | stop)
    sentence = c.rlike(r"^\p{Lu}") & stop & any_of(F.contains(F.lower(c), F.lit(w)) for w in fixed.BLOCK_SENTENCE_WORDS)
    return F.when(is_size_or_year(c), "").when(names_type(c), "type").when(long_ | sentence, "").when(c.rlike("[/,、]") | names_material(c), "materials").otherwise("")


def block_after_title(lines: Column, title: Column, title_cn: Column) -> Column:
    """The five lines after the first of fifteen that has the title in one of its languages; none without such a line."""
    titled = F.transform(F.slice(lines, 1, 15), lambda x: F.contains(F.lower(x), F.lower(title)) | ((title_cn != "") & F.contains(x, title_cn)))
    at = F.array_position(titled, F.lit(True)).cast("int")
    return F.when(at > 0, F.slice(lines, at + 1, 5)).otherwise(F.slice(lines, 1, 0))


def after_type(lines: Column, artist: Sequence[str], title: Column, title_cn: Column) -> Column:
    """The first materials line of the three after the first type line."""
    typed = F.transform(lines, lambda x: is_type_line(x, artist) & names_type(F.substring(x, 1, 30)))
    at = F.array_position(typed, F.lit(True)).cast("int")
    return F.when(at > 0, _first(F.slice(lines, at + 1, 3), lambda x: ~is_size_or_year(x) & is_materials_line(x, title, title_cn, artist))).otherwise("")


def images_of_page(images: Column, parts: Column, layout: PageLayout | None = None) -> Column:
    """Addresses of a page's real images, each once: those in the slideshow of the project that is shown; else those in the
    first element of each container; else those that have an original. Containment is that of start tags' numbers."""
    layout = layout or PageLayout()
    first = lambda kind: F.get(F.filter(parts, lambda p: p["kind"] == kind), F.lit(0))
    item = F.replace(F.coalesce(first("thumb")["key"], F.lit("")), F.lit("item_"), F.lit(""))
    slides = let(item, lambda i: F.get(F.filter(parts, lambda p: (p["kind"] == "slides") & (i != "") & F.contains(p["key"], F.concat(F.lit(f"{layout.slideshow}_"), i))), F.lit(0)))

    # Each step is made once, not anew for every image that asks for it.
    def picked(real: Column) -> Column:
        inside = lambda part: let(part, lambda p: F.filter(real, lambda x: F.coalesce((x["at"] > p["first"]) & (x["at"] <= p["last"]), F.lit(False))))
        held = F.flatten(F.array(*[inside(first(s)) for s in layout.containers]))
        rest = let(held, lambda h: F.when(F.size(h) > 0, h).otherwise(F.filter(real, lambda x: x["original"])))
        return let(inside(slides), lambda s: F.when(F.size(s) > 0, s).otherwise(rest))

    real = F.filter(images, lambda x: is_image(x["raw"]))
    return F.array_distinct(F.transform(let(real, picked), lambda x: x["src"]))


def extract_works(parsed: DataFrame, artist: Sequence[str] = (), layout: PageLayout | None = None) -> DataFrame:
    """A work record for each parsed page that has a title: fields by tags, position and patterns of its lines."""
    bilingual = split_bilingual("raw_title")
    df = parsed.filter(F.col("raw_title") != "").withColumns({"_l": content_lines(F.col("lines")), "_t": bilingual})
    df = settle(df)
    title, cn = F.col("_t.title"), F.col("_t.title_cn")
    led = _first(F.slice("_l", 1, 10), lambda x: (F.length(x) <= 80) & F.contains(x, F.lit("/")) & F.startswith(x, title) & has_cjk(x))
    df = df.withColumns({"title": title, "title_cn": F.when(cn != "", cn).otherwise(split_bilingual(led)["title_cn"]), "year": year_of(F.col("tags"), F.col("_l"))})
    candidate = lambda x: (F.length(x) < 150) & (x != F.col("year"))
    df = settle(df).withColumns({"_c": F.filter("_l", candidate), "_b": block_after_title(F.col("_l"), F.col("title"), F.col("title_cn"))})
    df = settle(settle(df).withColumn("_k", F.transform("_b", position_kind)))
    type_at, materials_at = (F.array_position("_k", F.lit(kind)).cast("int") for kind in ("type", "materials"))
    placed_type = F.when((type_at > 0) & ((materials_at == 0) | (type_at < materials_at)), F.get("_b", type_at - 1)).otherwise("")
    placed = F.when(materials_at > 0, F.get("_b", materials_at - 1)).otherwise("")
    by_line = _first(F.col("_c"), lambda x: is_type_line(x, artist) & ~is_credits_line(x))
    joined = F.array_join("_c", "\n")
    scanned = _first(F.col("_c"), lambda x: is_materials_line(x, F.col("title"), F.col("title_cn"), artist))
    materials = first_filled(placed, after_type(F.col("_c"), artist, F.col("title"), F.col("title_cn")), scanned)
    sized = {"size": first_line_match(joined, fixed.LINE_SIZES), "duration": first_line_match(joined, fixed.LINE_DURATIONS)}
    vimeo = F.transform("vimeo_ids", lambda x: F.concat(F.lit("https://vimeo.com/"), x))
    video = first_filled(_first(F.col("links"), is_video_link), _first(F.col("iframes"), is_video_link), F.coalesce(F.get(vimeo, F.lit(0)), F.lit("")))
    df = df.withColumns(
        {
            "_type": first_filled(type_from_tags(F.col("tags")), placed_type, by_line), "_m": materials, "credits": _first(F.col("_c"), is_credits_line), "size": sized["size"],
            "duration": sized["duration"], "video_link": video, "images": images_of_page(F.col("images"), F.col("parts"), layout),
        }
    )
    df = settle(settle(df).withColumns({"_e": tidy_type("_type"), "_d": F.filter("_l", lambda x: is_description_line(x, F.col("_m")))}))
    kind = F.when((F.col("_e.type") == "") & (F.col("video_link") != ""), F.lit("Video")).otherwise(F.col("_e.type"))
    told = lambda where: F.array_join(F.filter("_d", where), "\n\n")
    df = settle(
        df.withColumns({"_n": normalize_type(kind), "description_cn": told(is_language_cn), "description_en": told(lambda x: ~is_language_cn(x))})
    )
    return df.select(
        "url", "title", "title_cn", normalize_year("year").alias("year"), F.col("_n.type").alias("type"), first_filled("_m", "_n.materials").alias("materials"),
        first_filled("size", "_e.size").alias("size"), first_filled("duration", "_e.duration").alias("duration"),
        "credits", "description_en", "description_cn", "video_link", "images", F.col("images").alias("high_res_images"), F.lit("local").alias("source"),
    )


def type_of_markdown(md: Column | str) -> Column:
    """Exhibition or Catalog if one of the first ten lines is such a word; else the type that a line of the first 1,000
    characters starts with, in title case; else empty."""
    head = F.substring(text(md), 1, 1000)
    lines = F.slice(F.filter(F.transform(F.split(head, "\n"), lambda x: F.lower(strip(x))), lambda x: x != ""), 1, 10)
    named = _first(lines, lambda x: x.isin(*fixed.EXHIBITION_LINES, *fixed.CATALOG_LINES))
    kind = strip(F.regexp_extract(F.lower(head), rf"(?Um)^({fixed.MARKDOWN_TYPES})", 1))
    return let(named, lambda first: F.when(first.isin(*fixed.EXHIBITION_LINES), "Exhibition").when(first != "", "Catalog").otherwise(title_case(kind)))


def credits_of_markdown(md: Column | str) -> Column:
    """What the first of the credits' patterns finds anywhere in the lines of the first 3,000 characters."""
    every = lambda head: F.array(*[F.regexp_extract(head, f"(?imdU){p}", 0) for p in fixed.CREDIT_PATTERNS])
    return _first(F.transform(let(F.substring(text(md), 1, 3000), every), strip), lambda x: x != "")


def from_markdown(md: Column | str) -> dict[str, Column]:
    """type, title_cn, materials, credits, size, duration, video_link of a page's Markdown."""
    lines = F.filter(F.transform(F.split(text(md), "\n"), strip), lambda x: x != "")
    few = F.slice(lines, 1, 30)
    credits = credits_of_markdown(md)
    sized = size_and_duration(md)
    video = F.regexp_extract(text(md), r"(https?://(?:www\.)?(?:vimeo\.com|youtube\.com|youtu\.be|bilibili\.com)[^\s)\]]+)", 1)
    cn = strip(F.regexp_extract(text(md), r"\*\*([^*]+)\s*/\s*([^*]+)\*\*", 2))
    return {
        "type": type_of_markdown(md), "title_cn": F.when(has_cjk(cn), cn).otherwise(""), "materials": _first(few, lambda x: is_materials_line(x, F.lit(""), F.lit(""))), "credits": credits,
        "size": sized["size"], "duration": sized["duration"], "video_link": video,
    }


def enrich(record: Mapping[str, Column], md: Column | str) -> dict[str, Column]:
    """record with its blank fields filled from Markdown; an embedded size and duration leave the type and fill theirs; the
    year in normal form. A type that is none (a credit, a URL, a size) becomes blank."""
    found = from_markdown(md)
    out = {f: F.when(blank(c) & F.lit(f in found and f != "type"), found.get(f, F.lit(""))).otherwise(text(c)) for f, c in record.items()}
    kind = split_type(record["type"])
    out["type"] = kind["type"]
    for f in ("duration", "size"):
        out[f] = F.coalesce(let(out[f], filled), text(kind[f]))
    out["year"] = normalize_year(record["year"])
    return out
