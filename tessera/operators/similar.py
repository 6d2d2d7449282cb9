"""Pairs of similar titles of two tables, without comparing each with each.

The similarity is that of longest matching blocks: 2 M / T, where M characters are matched and T is the length of both. If it
is r or more, then the shorter text has at least r T / 2 characters, and the texts share many grams (runs of q characters):
M matched characters lie in at most T - 2 M + 1 blocks, as two blocks have an unmatched character between them, and a block
of n has n - q + 1 grams. So at least (2 q - 1) M - (q - 1) (T + 1) grams are common, each counted as often as both have it.
Two sets with that many common members share one among the first few of each, in any order that both follow: only those
are joined on. Rare grams come first, so few rows meet. Of those that meet, the join itself drops nearly all: parities of hashed
grams of two differ in no more bits than the sets differ in members, and one text becomes the other by T - 2 M edits, as
what is not matched is left out or put in. So what is written for the join grows with the texts, not with the pairs that
meet. What is left is compared for real.

Equal texts are one until the end: what is joined and compared are different texts, and a pair of them becomes the pairs of
their rows only when all is known. A text that many rows have is dealt out in parts for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import settle
from tessera.functions.udfs import seq_ratio

#: Titles whose grams tell which ones are frequent, and how many hash values of grams are told apart for that.
SAMPLE, HASHES = 10_000, 1 << 14
#: Longs of parity bits for each text; rows of one text that meet the rows of another in one task.
SIGNATURE, PART = 4, 512
#: Characters up to which a text is its own key and so goes along with its grams. Edits of longer ones are counted after the join.
ALONG = 200


def grams(c: Column, q: int) -> Column:
    """The runs of q characters, each with its number among equal ones, so that they are a set."""
    n = F.length(c) - q + 1
    runs = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(c, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(F.array_distinct(runs), lambda g: F.transform(F.sequence(F.lit(1), F.size(F.filter(runs, lambda x: x == g))), lambda k: F.concat(g, F.lit("\x00"), k.cast("string")))))


def common_grams(total: Column, q: int, least: float) -> Column:
    """Grams that two texts of total characters have in common at least, if their similarity is least or more."""
    return F.ceil((2 * q - 1) * least * total / 2 - (q - 1) * (total + 1) - 1e-9)


def _partner(n: Column, least: float) -> Column:
    """The least length of a text that one of n characters can be similar to."""
    return F.ceil(n * least / (2 - least) - 1e-9)


def _key(t: Column) -> Column:
    """A text of up to ALONG characters after a mark, the digest of a longer one after another."""
    return F.when(F.length(t) <= ALONG, F.concat(F.lit("t"), t)).otherwise(F.concat(F.lit("#"), F.sha2(t, 256)))


def _few_edits(a: Column, b: Column, total: Column, least: float) -> Column:
    """Two texts of total characters can have a similarity of least or more by their edits. They may both follow one mark."""
    return F.call_function("levenshtein", a, b, (total - 2 * F.ceil(least * total / 2 - 1e-9)).cast("int")) >= 0


def _hash(g: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring_index(g, "\x00", 1)), F.lit(HASHES)).cast("int")


def _parities(g: Column) -> list[Column]:
    """SIGNATURE longs: each bit tells whether an odd number of the grams has its hash value."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x, F.lit(1)), F.lit(64)).cast("int"))

    def word(i: int) -> Column:
        return F.aggregate(g, F.lit(0).cast("long"), lambda acc, x: F.when(F.pmod(F.xxhash64(x), F.lit(SIGNATURE)) == i, acc.bitwiseXOR(bit(x))).otherwise(acc))

    return [word(i).alias(f"s{i}") for i in range(SIGNATURE)]


def _postings(df: DataFrame, frequent: DataFrame, q: int, least: float, test: Column) -> DataFrame:
    """gram, key, n and parities for the first grams of each text that test admits."""
    need = common_grams(F.col("n") + _partner(F.col("n"), least), q, least)
    made = df.filter(test).select("key", "n", grams(F.col("t"), q).alias("g"), grams(F.col("t"), 2).alias("g2"))
    ranked = settle(settle(made).select("key", "n", "g", *_parities(F.col("g2")))).crossJoin(frequent)  # one row
    place = lambda g: F.struct(F.get("f", _hash(g)), F.xxhash64(g), g.alias("g"))
    first = F.slice(F.array_sort(F.transform("g", place)), 1, F.greatest(F.size("g") - F.greatest(need, F.lit(1)).cast("int") + 1, F.lit(0)))
    held = ["key", "n", *[f"s{i}" for i in range(SIGNATURE)]]
    return ranked.select(*held, F.explode(first).alias("x")).select(F.col("x.g").alias("gram"), *held)


def _frequent(df: DataFrame, q: int) -> DataFrame:
    """One row: how often grams of each hash value are in a sample of the texts (those of the least hashes)."""
    some = df.select("t").orderBy(F.xxhash64("t")).limit(SAMPLE).select(F.explode(grams(F.col("t"), q)).alias("g"))
    counts = some.groupBy(_hash(F.col("g")).alias("h")).agg(F.count("*").cast("int").alias("k"))
    at = F.explode(F.sequence(F.lit(0), F.lit(HASHES - 1)))
    every = df.sparkSession.range(1).select(at.alias("h")).join(counts, "h", "left").select("h", F.coalesce("k", F.lit(0)).alias("k"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "k"))), lambda x: x["k"]).alias("f"))


def _expanded(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, right_id, ratio: pairs (key, key_, ratio) of texts as pairs of their rows (key, id). No task meets more than
    about PART rows of a right text at once with those of a left one."""
    parts = right.groupBy("key").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = right.join(parts, "key").select(F.col("key").alias("key_"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("right_id"))
    counted = pairs.join(parts.withColumnRenamed("key", "key_"), "key_")
    each = left.join(counted, "key").select(F.col("id").alias("left_id"), "key_", "ratio", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return each.join(dealt, ["key_", "part"]).select("left_id", "right_id", "ratio")


def similar_pairs(left: DataFrame, right: DataFrame, id_col: str, text_col: str, least: float = 0.9) -> DataFrame:
    """left_id, right_id, ratio of all pairs of a left and a right text whose ratio is least or more (above 2/3).

    Blank texts are similar to nothing. Texts that are equal, repeated or have no id are rows like others. Pairs of grams
    of two are found by them; those with a text too short for a common one, by single characters.
    """
    if not 2 / 3 < least <= 1:
        raise ValueError("least must be above 2/3 and at most 1")
    rows = lambda df: df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).filter("trim(t) <> ''").withColumn("key", _key(F.col("t")))
    all_a = rows(left)
    all_b = all_a if right is left else rows(right)
    different = lambda df: df.groupBy("key").agg(F.first("t").alias("t")).withColumn("n", F.length("t"))
    a = different(all_a)
    b = a if right is left else different(all_b)
    lengths = (F.col("n") * (2 - least) >= F.col("n_") * least - 1e-9) & (F.col("n_") * (2 - least) >= F.col("n") * least - 1e-9)
    # Sets of grams of two that differ in more members than a similar pair's do not belong to one.
    apart = F.greatest(F.col("n") - 1, F.lit(0)) + F.greatest(F.col("n_") - 1, F.lit(0)) - 2 * F.greatest(common_grams(F.col("n") + F.col("n_"), 2, least), F.lit(0))
    near = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"s{i}_"))) for i in range(SIGNATURE)), F.lit(0)) <= apart
    edits = (F.greatest("n", "n_") > ALONG) | _few_edits(F.col("key"), F.col("key_"), F.col("n") + F.col("n_"), least)
    found, longest = a.join(b.select("key"), "key").select("key", F.col("key").alias("key_")), None
    for q in _sizes(least):
        frequent = _frequent(a.select("t").unionByName(b.select("t")), q)
        # Texts of which every partner shares a gram; those too short for that, and their partners, are left to shorter grams.
        test = F.lit(True) if q == 1 else F.col("n") > _shortest(q, least)
        test = test if longest is None else test & (F.col("n") <= longest)
        x = _postings(a, frequent, q, least, test)
        y = x if right is left else _postings(b, frequent, q, least, test)
        # Names change after the join only: a table that meets itself is then written once.
        sides = [F.col(f"{side}.{c}").alias(c + end) for side, end in (("x", ""), ("y", "_")) for c in x.columns if c != "gram"]
        pairs = x.alias("x").join(y.alias("y"), F.col("x.gram") == F.col("y.gram")).select(*sides).filter((F.col("key") != F.col("key_")) & lengths & near & edits)
        found = found.unionByName(pairs.select("key", "key_"))
        longest = F.floor(F.lit(_shortest(q, least) * (2 - least) / least) + 1e-9) if q > 1 else None
    texts = b.select(*[F.col(c).alias(c + "_") for c in ("key", "t", "n")])
    met = settle(found.distinct().join(a, "key").join(texts, "key_"))
    short = F.greatest("n", "n_") <= ALONG
    open_ = met.filter((F.col("key") == F.col("key_")) | short | _few_edits(F.col("t"), F.col("t_"), F.col("n") + F.col("n_"), least))
    ratio = F.when(F.col("t") == F.col("t_"), F.lit(1.0)).otherwise(seq_ratio(F.col("t"), F.col("t_")))
    similar = open_.select("key", "key_", ratio.alias("ratio")).filter(F.col("ratio") >= least)
    return _expanded(similar, all_a.select("key", "id"), all_b.select("key", "id"))


def _sizes(least: float) -> list[int]:
    """Lengths of grams to look by, longest first: the longer, the rarer, but only while similar texts share enough of them."""
    share = lambda q: (2 * q - 1) * least / 2 - (q - 1)
    return [*[q for q in (4, 3) if share(q) >= 0.1][:1], 2, 1]


def _shortest(q: int, least: float) -> int:
    """The greatest length from which no common gram of q follows."""
    import math

    total = lambda n: n + math.ceil(n * least / (2 - least) - 1e-9)
    n = 1
    while math.ceil((2 * q - 1) * least * total(n) / 2 - (q - 1) * (total(n) + 1) - 1e-9) < 1:
        n += 1
    return n - 1
