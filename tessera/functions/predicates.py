"""Predicates over links, lines and fields, all Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.functions.text import (
    any_of, blank, compared, contains_any, count_chars, count_contained, filled, first_filled, found, has_cjk, is_bilingual, let, matches_any, mean_segment, slug, slug_words,
    starts_with_any, strip, text, tokens,
)


def is_work(type_: Column | str, category: Column | str | None = None, excluded: Sequence[str] = fixed.EXCLUDED_TYPES) -> Column:
    """No excluded word is anywhere in the type (or, where that is blank, the category)."""
    value = first_filled(type_, category) if category is not None else text(type_)
    return ~contains_any(F.lower(value), excluded)


def is_work_link(url: Column | str, base: str, navigation: Sequence[str] = fixed.NAVIGATION_PATHS) -> Column:
    """Under base, not the root, not a tag page, and no short path of navigation. Paths of 20 characters or more pass."""
    path = F.replace(text(url), F.lit(base), F.lit(""))
    short = any_of((path == n) | F.startswith(path, F.lit(n + "/")) for n in navigation) & (F.length(path) < 20)
    return F.startswith(text(url), F.lit(base)) & ~path.isin("", "/") & ~short & ~F.contains(path, F.lit("/tag/"))


def names_material(c: Column | str) -> Column:
    return let(F.lower(text(c)), lambda low: any_of(F.contains(low, F.lit(w.lower())) for w in fixed.MATERIAL_WORDS))


def is_credits_line(c: Column | str) -> Column:
    return (F.length(text(c)) <= 100) & matches_any(strip(F.lower(text(c))), fixed.CREDIT_PATTERNS)


def is_repair_credits(c: Column | str) -> Column:
    return matches_any(strip(F.lower(text(c))), fixed.REPAIR_CREDIT_PATTERNS)


def has_credit_marks(c: Column | str) -> Column:
    return contains_any(F.lower(text(c)), fixed.CREDIT_MARKS)


def is_type_name(c: Column | str) -> Column:
    """A canonical type's spelling, or such spellings parted by slashes."""
    keys = [k for k, _ in fixed.CANONICAL_TYPES]
    parts = F.filter(F.transform(F.split(text(c), "/"), lambda x: F.lower(strip(x))), lambda x: x != "")
    return ~blank(c) & (F.lower(strip(c)).isin(*keys) | (F.contains(text(c), F.lit("/")) & F.forall(parts, lambda x: x.isin(*keys))))


def is_known_type(c: Column | str) -> Column:
    return compared(c).isin(*fixed.KNOWN_TYPES)


def is_empty_material(c: Column | str) -> Column:
    return F.lower(strip(c)).isin(*fixed.WIDE_PLACEHOLDERS)


def reads_as_description(c: Column | str) -> Column:
    """Too long, sentence-like, quoted, or Chinese prose: no list of materials."""
    low = F.lower(text(c))
    chinese = contains_any(c, fixed.CHINESE_MARKS) & (count_chars(c, r"[一-鿿]") > 20)
    return (F.length(text(c)) > 150) | (count_contained(low, fixed.SENTENCE_MARKS) >= 2) | starts_with_any(c, fixed.QUOTE_MARKS) | chinese


def reads_as_repair_description(c: Column | str) -> Column:
    low = F.lower(text(c))
    chinese = contains_any(c, fixed.CHINESE_MARKS) & (count_chars(c, r"[一-鿿]") > 20)
    return ~blank(c) & (
        contains_any(low, fixed.REPAIR_CREDIT_MARKS)
        | (count_contained(low, fixed.REPAIR_SENTENCE_MARKS) >= 2)
        | starts_with_any(c, fixed.REPAIR_QUOTE_MARKS)
        | (F.length(text(c)) > 150)
        | F.contains(text(c), F.lit("©"))
        | chinese
    )


def is_title_as_materials(materials: Column | str, title: Column | str, title_cn: Column | str) -> Column:
    """The materials are one of the titles."""
    m = F.lower(strip(materials))
    return ~blank(materials) & (((m == F.lower(strip(title))) & ~blank(title)) | ((m == F.lower(strip(title_cn))) & ~blank(title_cn)))


def is_video_link(c: Column | str) -> Column:
    return contains_any(c, fixed.VIDEO_DOMAINS)


def is_image(src: Column | str, skipped: Sequence[str] = fixed.SKIPPED_IMAGES, extensions: Sequence[str] = fixed.IMAGE_EXTENSIONS) -> Column:
    """No skipped mark; an image's extension at the end or before '?', or else 'image', 'img' or 'photo'."""
    low = F.lower(text(src))
    ends = any_of(F.endswith(low, F.lit(e)) | F.contains(low, F.lit(e + "?")) for e in extensions)
    return ~blank(src) & ~contains_any(low, skipped) & (ends | contains_any(low, ("image", "img", "photo")))


def is_complete(f: Mapping[str, Column], strict: bool = False) -> Column:
    """Of a work: title, year and type; no equipment in a long type without materials; a video's duration or link; with
    strict, materials of physical types. f: title, year, type, materials, duration, video_link."""
    low = F.lower(text(f["type"]))
    bare = blank(f["materials"])
    polluted = (F.length(text(f["type"])) > 60) & contains_any(low, fixed.EQUIPMENT_WORDS) & bare
    silent = F.contains(low, F.lit("video")) & blank(f["duration"]) & blank(f["video_link"])
    out = ~blank(f["title"]) & ~blank(f["year"]) & ~blank(f["type"]) & ~polluted & ~silent
    return out & ~(contains_any(low, fixed.PHYSICAL_TYPES) & bare) if strict else out


def missing_fields(f: Mapping[str, Column]) -> Column:
    """What a work of its type should have and has not, in order: a video its duration (or a link), a made thing its size
    (unless the type says that it varies) and materials, any work a description (which counts twice)."""
    low = F.lower(text(f["type"]))
    video, made = contains_any(low, fixed.VIDEO_TYPES), contains_any(low, fixed.MADE_TYPES)
    bare = blank(f["description_en"]) & blank(f["description_cn"])
    absent = [
        (video & blank(f["duration"]) & blank(f["video_link"]), "duration"), (made & blank(f["size"]) & ~contains_any(low, ("variable", "可变")), "size"),
        (made & blank(f["materials"]), "materials"), (bare, "description_en"), (bare, "description_cn"),
    ]
    return F.array_compact(F.array(*[F.when(holds, F.lit(name)) for holds, name in absent]))


def slug_matches_title(url: Column | str, title: Column | str) -> Column:
    """Normal forms of slug and title contain each other, or share two words (one, if the slug has one)."""
    s, t = compared(slug(url)), compared(title)
    shared, n = F.size(F.array_intersect(tokens(s), tokens(t))), F.size(tokens(s))
    return (s != "") & (t != "") & (F.contains(t, s) | F.contains(s, t) | (shared >= F.least(F.lit(2), F.greatest(F.lit(1), n))))


def titles_agree(left: Column | str, right: Column | str) -> Column:
    """Equal normal forms, or as many shared words as the shorter has, two at most."""
    a, b = compared(left), compared(right)
    x, y = tokens(a), tokens(b)
    return (a != "") & (b != "") & ((a == b) | (F.size(F.array_intersect(x, y)) >= F.least(F.size(x), F.size(y), F.lit(2))))


def title_fits_slug(url: Column | str, title: Column | str) -> Column:
    """Half of the slug's words are the title's, or letters and digits contain each other. What is false here may still pass
    a fuzzy comparison (udfs.seq_ratio of at least 0.6)."""
    s = slug_words(url)
    t = F.regexp_replace(F.lower(text(title)), r"[^\p{L}\p{N}\s]", " ")
    a, b = tokens(F.regexp_replace(s, r"\s+", " ")), tokens(F.regexp_replace(t, r"\s+", " "))
    share = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))
    x, y = F.regexp_replace(s, r"[^\p{L}\p{N}]", ""), F.regexp_replace(t, r"[^\p{L}\p{N}]", "")
    inside = (x != "") & (y != "") & (F.contains(y, x) | F.contains(x, y))
    return ~blank(title) & ~blank(url) & ~is_type_name(title) & (((F.size(a) > 0) & (F.size(b) > 0) & (share >= 0.5)) | inside)


def is_foreign_title(url: Column | str, title: Column | str, owners: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The title holds a known one (the first in order) of a page with another slug. owners: title, slugs of its page."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower(strip(title)), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))
    own = F.lower(slug(url))
    out = F.lit(False)
    for known, slugs in reversed(list(owners)):
        out = F.when(F.contains(clean, F.lit(known)), ~contains_any(own, slugs)).otherwise(out)
    return ~blank(title) & out


def reads_as_foreign(body: Column | str, title: Column | str, url: Column | str) -> Column:
    """Navigation phrases, another page's URL, or a short title-like line at the head of a text about something else."""
    low, own = F.lower(strip(body)), F.lower(slug(url))
    phrases = contains_any(low, ("related projects", "selected works"))
    other = low.rlike(r"https?://\S+") & ~F.contains(low, own)
    head = F.slice(F.split(strip(body), "\n"), 1, 3)
    cased = r"(?U)^[^\p{L}]*(?:\p{Lu}\p{Ll}*[^\p{L}]+)*\p{Lu}\p{Ll}*[^\p{L}]*$"
    titled = F.exists(head, lambda x: (strip(x) != "") & (F.size(F.split(strip(x), r"(?U)\s+")) <= 6) & strip(x).rlike(cased))
    about = ~blank(title) & ~titles_agree(title, body) & ~F.contains(low, F.translate(own, "-", " "))
    return (low != "") & (phrases | other | (about & titled))


def mentioned_works(low: Column) -> tuple[Column, Column]:
    """What a small-letter description introduces at its start: a quoted title, and a name that 'is a' work of some kind."""
    return strip(F.regexp_extract(low, fixed.QUOTED_WORK, 1)), strip(F.regexp_extract(low, fixed.NAMED_WORK, 1))


def names_other_work(description: Column | str, title: Column | str, url: Column | str, known: Sequence[str] = fixed.LEAKING_WORKS) -> Column:
    """A description that introduces a work which is neither this title's nor this page's."""
    low, current = F.lower(strip(description)), F.lower(text(title))
    quoted, named = mentioned_works(low)
    other = lambda x, least: (F.length(strip(x)) > least) & ~F.contains(current, strip(x)) & ~title_fits_slug(url, strip(x))
    others = any_of(F.contains(low, F.lit(k)) & ~F.contains(slug_words(url), F.lit(k)) & ~F.contains(current, F.lit(k)) for k in known)
    return (F.length(text(description)) >= 30) & (current != "") & (other(quoted, 0) | other(named, 2) | others)


def is_type_line(c: Column | str, artist: Sequence[str] = ()) -> Column:
    """A line that names a type: short, no size, no artist, no long text after a colon (unless one word stands before it), no
    start of a description, a type word at its start or after a slash. What most lines fail on at little cost comes first."""
    words = "|".join(w.lower() for w in fixed.TYPE_WORDS)

    def told(low: Column) -> Column:
        colon = (F.length(strip(F.regexp_extract(text(c), r"(?s)^[^:]*:(.*)$", 1))) > 30) & ~low.rlike("^[a-z]+:")
        size = contains_any(low, fixed.SIZE_MARKS) | starts_with_any(low, fixed.TYPE_STARTERS)
        return low.rlike(rf"(?:^|/\s*)(?:{words})") & ~size & ~contains_any(low, [a.lower() for a in artist]) & ~colon

    n = F.length(text(c))
    return ((n <= 80) | ((n <= 150) & is_bilingual(c))) & let(F.lower(text(c)), told)


def is_language_cn(c: Column | str) -> Column:
    """More than half of the letters are Chinese."""
    return count_chars(c, r"\p{L}") < 2 * count_chars(c, r"[一-鿿]")


def is_description_line(c: Column, materials: Column) -> Column:
    """60 characters or more, half of them letters; no credits, list of short parts, materials, event with a year or address."""
    parts = F.split(c, "[,，]")
    listed = (F.length(c) < 120) & (F.size(parts) > 3) & (mean_segment(c) < 20)
    same = (materials != "") & (strip(c) == strip(materials))
    unwritten = 2 * count_chars(c, r"\p{L}") < F.length(c)
    return (F.length(c) >= 60) & ~is_credits_line(c) & ~listed & ~same & ~unwritten & ~c.rlike(f"(?iU){fixed.EVENT_LINE}") & ~c.rlike(f"(?iU){fixed.ADDRESS_LINE}")


def is_date_as_duration(c: Column | str) -> Column:
    dates = text(c).rlike(r"^\d{1,2}\.\d{2}\.\d{4}\s*[-–]\s*\d{1,2}\.\d{2}\.\d{4}")
    return ~blank(c) & (found(c, f"(?:{fixed.MONTHS})") | dates)


def is_url(c: Column | str) -> Column:
    return F.startswith(text(c), F.lit("http"))


def signal(c: Column | str) -> Column:
    return filled(strip(c)).isNotNull()


__all__ = [x for x in dir() if x.startswith(("is_", "has_", "names_", "reads_", "title", "slug_", "missing", "signal"))] + ["has_cjk"]
