"""Quality rules: counts of words, symbols, repeats, and the divergence of a document's character classes and common words
from references for its language.

Everything is one pass of Column expressions over each row: no shuffle, no Python. The distance is Jensen-Shannon's (the
square root of the divergence, base 2: from 0 to 1). Texts too short for a histogram to mean anything are not compared
(minimum-length guards), nor are documents whose language has no reference.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, doc_text

# Usual shares of running prose, rounded. Classes: letters without capitals, capitals, digits, white space,
# sentence punctuation, anything else.
CLASSES = ("lower", "upper", "digit", "space", "point", "other")
CLASS_SHARES = {
    "en": (0.785, 0.025, 0.005, 0.16, 0.022, 0.003),
    "de": (0.785, 0.045, 0.005, 0.14, 0.022, 0.003),
    "fr": (0.775, 0.022, 0.005, 0.165, 0.03, 0.003),
    "es": (0.785, 0.022, 0.005, 0.16, 0.025, 0.003),
}
# Common words with their usual share of all words.
WORD_SHARES = {
    "en": {"the": 0.055, "of": 0.029, "and": 0.026, "to": 0.022, "a": 0.019, "in": 0.017, "is": 0.01, "that": 0.01, "it": 0.008, "for": 0.008, "was": 0.008, "with": 0.006},
    "de": {"der": 0.036, "die": 0.034, "und": 0.027, "in": 0.018, "den": 0.013, "von": 0.011, "zu": 0.01, "das": 0.01, "mit": 0.008, "sich": 0.007, "des": 0.007, "ist": 0.006},
    "fr": {"de": 0.047, "la": 0.029, "le": 0.022, "et": 0.021, "les": 0.018, "des": 0.014, "en": 0.012, "un": 0.01, "du": 0.01, "une": 0.009, "que": 0.008, "est": 0.007},
    "es": {"de": 0.058, "la": 0.035, "que": 0.027, "el": 0.026, "en": 0.025, "y": 0.022, "los": 0.015, "se": 0.011, "del": 0.011, "las": 0.01, "un": 0.009, "por": 0.008},
}
SYMBOLS = "#*$%&|<>"
POINTS = r".,;:!?'\"()\-"


@dataclass(frozen=True)
class Rules:
    """max_class_distance and max_word_distance: a document farther from its language's reference is rejected.
    min_chars, min_words: below, the character (word) histogram is not compared."""

    min_doc_words: int = 50
    max_repeat_percent: int = 50
    min_chars: int = 200
    min_words: int = 100
    max_class_distance: float = 0.25
    max_word_distance: float = 0.27
    class_shares: Mapping[str, Sequence[float]] = field(default_factory=lambda: CLASS_SHARES)
    word_shares: Mapping[str, Mapping[str, float]] = field(default_factory=lambda: WORD_SHARES)


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Bits of a sort key that hold the place of a window; the others hold its hash. Texts of more words sort the windows themselves.
PLACE_BITS = 24


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more.

    Keys of hash and place are sorted: windows with an equal neighbour are the repeated ones, once their words have been
    compared. Where words differ under one hash (or places need more bits) the windows' texts are sorted instead.
    """
    n = F.size(words)
    mask = (1 << PLACE_BITS) - 1

    def count(starts: Column) -> Column:
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["p"])).alias("n"), p.alias("p"))
        return F.aggregate(F.sort_array(starts), F.struct(F.lit(0).alias("n"), F.lit(-3).alias("p")), step, lambda acc: acc["n"])

    def compared(sorted_: Column) -> Column:
        last = F.size(sorted_) - 1
        same = lambda x, y: x["w"] == y["w"]
        return count(
            F.array_compact(
                F.transform(sorted_, lambda x, i: F.when(((i > 0) & same(x, F.get(sorted_, i - 1))) | ((i < last) & same(x, F.get(sorted_, i + 1))), x["i"]))
            )
        )

    def window(i: Column) -> Column:
        return F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i"))

    def by_texts() -> Column:
        return let(F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window)), compared)

    same = lambda x, y: F.shiftright(x.bitwiseXOR(y), PLACE_BITS) == 0  # noqa: E731  null beside the ends
    place = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")

    def of_twice(twice: Column) -> Column:
        def equal(x: Column, i: Column) -> Column:
            before = F.get(twice, i - 1)
            p, q = place(x), place(before)
            texts = (F.get(words, p) == F.get(words, q)) & (F.get(words, p + 1) == F.get(words, q + 1)) & (F.get(words, p + 2) == F.get(words, q + 2))
            return F.coalesce(~same(x, before), F.lit(True)) | texts

        sound = F.size(F.filter(twice, lambda x, i: ~equal(x, i))) == 0
        return F.when(F.size(twice) == 0, F.lit(0)).when(sound, count(F.transform(twice, place))).otherwise(by_texts())

    def of_keys(keys: Column) -> Column:
        return let(F.filter(keys, lambda x, i: same(x, F.get(keys, i - 1)) | same(x, F.get(keys, i + 1))), of_twice)

    key = lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))
    keys = F.sort_array(F.slice(F.transform(words, key), 1, n - 2))
    found = F.when(n <= mask, let(keys, of_keys)).otherwise(by_texts())
    return F.when(n < 4, F.lit(0)).otherwise(found).cast("long")


def _js_distance(counts: Column, total: Column, shares: Column) -> Column:
    """Between counts / total and shares (arrays of one length); null where there are no shares."""

    def part(x: Column) -> Column:
        p, q = x["p"], x["q"]
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0)) + F.when(q > 0, q * F.log2(q / m)).otherwise(F.lit(0.0))

    pairs = F.zip_with(counts, shares, lambda n, q: F.struct((n / total).alias("p"), q.alias("q")))
    divergence = F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + part(x)) / 2
    return F.when(total > 0, F.sqrt(F.greatest(divergence, F.lit(0.0))))


def _by_language(lang: Column, values: Mapping[str, Sequence]) -> Column:
    """The array of lang's values; null for other languages."""
    out = F.lit(None)
    for name in sorted(values):
        out = F.when(lang == name, F.array(*[F.lit(x) for x in values[name]])).otherwise(out)
    return out


def measured(docs: DataFrame, rules: Rules, own: Sequence[str], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Struct columns own (those columns of docs, whatever their names), base (counts) and far (class_distance,
    word_distance; null where not compared)."""
    lang = F.col("_lang")
    common = {name: list(own) for name, own in rules.word_shares.items()}
    word_shares = {name: [float(x) for x in own.values()] + [1.0 - sum(own.values())] for name, own in rules.word_shares.items()}
    class_shares = {name: [float(x) for x in own] for name, own in rules.class_shares.items()}

    def of_words(words: Column) -> Column:
        n = F.size(words)
        each = F.transform(F.coalesce("_common", F.array().cast("array<string>")), lambda r: n - F.size(F.array_remove(words, r)))
        return F.struct(
            n.cast("long").alias("n_words"), _repeat_words(words).alias("n_repeat_words"), each.alias("common"), let(F.array_join(words, ""), of_joined).alias("left")
        )

    def of_lines(lines: Column) -> Column:
        return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")

    def removed(text: Column, pattern: str, body) -> Column:
        return let(F.regexp_replace(text, pattern, ""), body)

    # What is left of the words without letters, capitals, digits, points; ASCII letters go first, by a faster pattern.
    letters, capitals, digits, points = r"[\p{L}\p{M}&&[^\p{Lu}]]+", r"\p{Lu}+", r"\p{Nd}+", f"[{POINTS}]+"

    def of_joined(joined: Column) -> Column:
        symbols = lambda c: F.regexp_count(c, F.lit(f"[{SYMBOLS}]"))
        counts = lambda a, b, c, d: F.array(F.length("_t"), F.length(joined), F.length(a), F.length(b), F.length(c), F.length(d), symbols(c))
        return removed(
            joined,
            "[a-z]+",
            lambda x: removed(x, letters, lambda a: removed(a, capitals, lambda b: removed(b, digits, lambda c: removed(c, points, lambda d: counts(a, b, c, d))))),
        )

    df = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("own"), doc_text(text_col).alias("_t"), (F.col(f"`{lang_col}`") if lang_col in docs.columns else F.lit(None)).cast("string").alias("_lang")
    )
    df = df.withColumn("_common", _by_language(lang, common))
    df = df.withColumns(
        {
            "_w": let(F.array_remove(F.split("_t", SPACES), ""), of_words),
            "_n_dup_lines": let(F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != ""), of_lines),
        }
    )
    df = df.withColumn("_left", F.col("_w.left"))
    at = lambda i: F.get("_left", F.lit(i))
    classes = F.array(at(1) - at(2), at(2) - at(3), at(3) - at(4), at(0) - at(1), at(4) - at(5), at(5))
    words = F.concat("_w.common", F.array(F.col("_w.n_words") - F.aggregate("_w.common", F.lit(0), lambda acc, x: acc + x)))
    class_distance = _js_distance(classes, at(0), _by_language(lang, class_shares))
    word_distance = _js_distance(words, F.col("_w.n_words"), _by_language(lang, word_shares))
    base = F.struct(
        F.col("_w.n_words").alias("n_words"),
        at(1).cast("long").alias("word_chars"), at(6).cast("long").alias("n_symbols"), F.col("_n_dup_lines").alias("n_dup_lines"), F.col("_w.n_repeat_words").alias("n_repeat_words")
    )
    far = F.struct(
        F.when(at(0) >= rules.min_chars, class_distance).alias("class_distance"),
        F.when(F.col("_w.n_words") >= rules.min_words, word_distance).alias("word_distance"),
    )
    return df.select("own", base.alias("base"), far.alias("far"))


def verdict(rules: Rules) -> tuple[Column, Column]:
    """(base_failed, kept) from base and far."""
    base_failed = (F.col("base.n_words") < rules.min_doc_words) | (100 * F.col("base.n_repeat_words") > rules.max_repeat_percent * F.col("base.n_words"))
    near = (F.coalesce(F.col("far.class_distance"), F.lit(0.0)) <= rules.max_class_distance) & (
        F.coalesce(F.col("far.word_distance"), F.lit(0.0)) <= rules.max_word_distance
    )
    return base_failed, ~base_failed & near


def quality_rules(docs: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each row of docs: id, the counts, base_failed, kept, class_distance, word_distance.

    A null text is empty and fails the base rules, as any text of under 50 words does. A null or unknown language is not
    compared. Repeated rows are measured each by itself. Other columns of docs are ignored; an empty table gives an empty one.
    """
    rules = rules or Rules()
    base_failed, kept = verdict(rules)
    return measured(docs, rules, [id_col], text_col, lang_col).select("own.*", "base.*", base_failed.alias("base_failed"), kept.alias("kept"), "far.*")


def keep_good(docs: DataFrame, rules: Rules | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, whatever they are called.

    A null or empty text goes, as any text of under 50 words does; a null or unknown language is not compared; repeated
    rows are judged each by itself; an empty table gives an empty one. The verdict passes a generator before it filters:
    the optimizer would else push the filter below the projection and compute all counts once for each use of them.
    """
    rules = rules or Rules()
    judged = measured(docs, rules, docs.columns, text_col, lang_col).select("own", verdict(rules)[1].alias("kept"))
    return judged.select(F.inline(F.array(F.struct("own", "kept")))).filter("kept").select("own.*")
