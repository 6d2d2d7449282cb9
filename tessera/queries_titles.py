"""Titles by longest matching blocks, beside SQL that finds the blocks by itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.functions.text import upper_each
from tessera.functions.udfs import seq_ratio, with_other_work, with_similar
from tessera.operators.similar import similar_pairs
from tessera.queries_rules import Made, among, quoted, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def blocks_sql(pairs: str, name: str) -> str:
    """CTEs that end in name (id, ratio) for pairs (id, a, b) of texts of under 200 characters (the rule about popular ones is
    for longer texts): the longest common run, the first one of equals, then the same to its left and right."""
    return f"""
{name}_a AS (SELECT id, i, substr(a, i, 1) AS c FROM (SELECT id, a, unnest(range(1, length(a) + 1)) AS i FROM {pairs})),
{name}_b AS (SELECT id, j, substr(b, j, 1) AS c FROM (SELECT id, b, unnest(range(1, length(b) + 1)) AS j FROM {pairs})),
{name}_e AS (SELECT id, i, j, i - row_number() OVER (PARTITION BY id, i - j ORDER BY i) AS island FROM {name}_a JOIN {name}_b USING (id, c)),
{name}_m AS (SELECT id, i, j, max(i) OVER (PARTITION BY id, i - j, island) - i + 1 AS run FROM {name}_e),
{name}_w(id, alo, ahi, blo, bhi, found) AS (
  SELECT id, 1::BIGINT, length(a) + 1, 1::BIGINT, length(b) + 1, 0::BIGINT FROM {pairs}
  UNION ALL
  SELECT id, CASE WHEN side = 0 THEN alo ELSE i + n END, CASE WHEN side = 0 THEN i ELSE ahi END, CASE WHEN side = 0 THEN blo ELSE j + n END, CASE WHEN side = 0 THEN j ELSE bhi END,
         CASE WHEN side = 0 THEN n ELSE 0 END
  FROM (
    SELECT id, alo, ahi, blo, bhi, best // 1000000 AS n, 999 - best // 1000 % 1000 AS i, 999 - best % 1000 AS j
    FROM (
      SELECT w.id, alo, ahi, blo, bhi, max(least(run, ahi - i, bhi - j) * 1000000 + (999 - i) * 1000 + (999 - j)) AS best
      FROM {name}_w w JOIN {name}_m m ON w.id = m.id AND i >= alo AND i < ahi AND j >= blo AND j < bhi GROUP BY ALL)), (VALUES (0), (1)) s(side)),
{name} AS (
  SELECT p.id, CASE WHEN length(a) + length(b) = 0 THEN 1.0 ELSE 2.0 * sum(found) / (length(a) + length(b)) END::DOUBLE AS ratio
  FROM {pairs} p JOIN {name}_w USING (id) GROUP BY p.id, a, b)"""


_TITLE = "regexp_extract(html, '<title>(.*?)</title>', 1)"
_PLAIN = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\s]', '', 'g'), '\s+', ' ', 'g'))"
_WORDS = "string_split(t, ' ')"
_VARIED = f"""CASE page_id % 4 WHEN 0 THEN array_to_string(list_reverse({_WORDS}), ' ')
  WHEN 1 THEN array_to_string([w FOR w, i IN {_WORDS} IF i % 3 <> 0], ' ') WHEN 2 THEN translate(t, 'eta', 'aXe')
  ELSE upper(substr(t, 1, length(t) // 3)) || substr(t, length(t) // 3 + 1) || ' and more' END"""


@query(f"""
WITH RECURSIVE t AS (SELECT page_id, {_TITLE} AS t FROM pages),
v AS (SELECT page_id, t, {_VARIED} AS v FROM t),
raw AS (SELECT page_id AS id, t AS a, v AS b FROM v), plain AS (SELECT page_id AS id, {_PLAIN.format("t")} AS a, {_PLAIN.format("v")} AS b FROM v),
{blocks_sql("raw", "x")},
{blocks_sql("plain", "y")}
SELECT page_id, x.ratio, CASE WHEN trim(t) = '' OR trim(v) = '' THEN false ELSE y.ratio >= 0.7 END AS is_similar FROM v JOIN x ON x.id = page_id JOIN y ON y.id = page_id
""")
def title_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles against variants of themselves: words turned round, left out, letters exchanged, capitals."""
    t = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    words, k, third = F.split("t", " "), F.col("page_id") % 4, F.floor(F.length("t") / 3).cast("int")
    varied = (
        F.when(k == 0, F.array_join(F.reverse(words), " ")).when(k == 1, F.array_join(F.filter(words, lambda w, i: i % 3 != 2), " ")).when(k == 2, F.translate("t", "eta", "aXe"))
        .otherwise(F.concat(upper_each(F.substring(F.col("t"), F.lit(1), third)), F.substring(F.col("t"), third + 1, F.length("t")), F.lit(" and more")))
    )
    df = table(spark, sf_dir, "pages").select("page_id", t.alias("t")).withColumn("v", varied)
    return with_similar(df, "t", "v", "is_similar").select("page_id", seq_ratio(F.col("t"), F.col("v")).alias("ratio"), "is_similar")


_SLUG = "lower(translate(list_extract(string_split(regexp_replace(url, '/+$', ''), '/'), -1), '-_', '  '))"
_SPLIT = r"list_distinct(list_filter(string_split(regexp_replace({0}, '\s+', ' ', 'g'), ' '), lambda x: x <> ''))"

#: Of the query of this name in tessera.queries.
ORACLES["fuzzy_titles"] = rf"""
WITH RECURSIVE t AS (SELECT page_id, url, {_TITLE} AS t, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS h, {_SLUG} AS s FROM pages),
c AS (SELECT *, regexp_replace(lower(t), '[^\p{{L}}\p{{N}}\s]', ' ', 'g') AS clean FROM t),
f AS (
  SELECT *, trim(t) = '' OR trim(url) = '' OR lower(trim(t)) IN {among([k for k, _ in fixed.CANONICAL_TYPES])} AS never,
         (len({_SPLIT.format("s")}) > 0 AND len({_SPLIT.format("clean")}) > 0 AND len(list_intersect({_SPLIT.format("s")}, {_SPLIT.format("clean")})) / greatest(len({_SPLIT.format("s")}), 1)::DOUBLE >= 0.5)
         OR (regexp_replace(s, '[^\p{{L}}\p{{N}}]', '', 'g') <> '' AND regexp_replace(clean, '[^\p{{L}}\p{{N}}]', '', 'g') <> ''
             AND (contains(regexp_replace(clean, '[^\p{{L}}\p{{N}}]', '', 'g'), regexp_replace(s, '[^\p{{L}}\p{{N}}]', '', 'g')) OR contains(regexp_replace(s, '[^\p{{L}}\p{{N}}]', '', 'g'), regexp_replace(clean, '[^\p{{L}}\p{{N}}]', '', 'g')))) AS fits
  FROM c),
slugs AS (SELECT page_id AS id, s AS a, clean AS b FROM f), heads AS (SELECT page_id AS id, {_PLAIN.format("t")} AS a, {_PLAIN.format("h")} AS b FROM f),
{blocks_sql("slugs", "x")},
{blocks_sql("heads", "y")}
SELECT page_id, NOT never AND (fits OR x.ratio >= 0.6) AS fits_page, trim(t) <> '' AND trim(h) <> '' AND y.ratio >= 0.7 AS like_heading
FROM f JOIN x ON x.id = page_id JOIN y ON y.id = page_id
"""


@query(f"""
WITH RECURSIVE t AS (SELECT page_id, {_TITLE} AS t FROM pages),
p AS (SELECT x.page_id * 1000000000 + y.page_id AS id, x.t AS a, y.t AS b FROM t x, t y WHERE x.page_id < y.page_id AND trim(x.t) <> '' AND trim(y.t) <> '' AND 2 * least(length(x.t), length(y.t)) >= 0.9 * (length(x.t) + length(y.t))),
{blocks_sql("p", "z")}
SELECT id // 1000000000 AS left_id, id % 1000000000 AS right_id, ratio FROM z WHERE ratio >= 0.9
""")
def similar_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of pages that are like other pages' titles (0.9 and more), each pair once: a join by rare grams. The SQL
    compares each with each."""
    t = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("t"))
    return similar_pairs(t, t, "page_id", "t").filter("left_id < right_id")


MENTION = Made(
    "p_partkey", ("\"Guards, I\" is a ", "“Scape data” is an ", "Sacpe.data is a ", "Space Dat is an old ", "The sea of all is a ", "It turns ", "Two rituals and "), ("video", "artwork", "installation about", "thing"),
    (" shown for the first time in a hall.", " of one ritual, in a hall with many lamps.", "."),
)
MENTION_URL = Made("p_partkey // 84", ("https://w.example/",), ("Sacpe-data", "guard-i", "space_data", "two-rituals"), ("", "/"))
MENTION_TITLE = Made("p_partkey // 5", ("Sacpe.data", "", "Guards, I", "a sea of all things"))


@query(rf"""
WITH RECURSIVE x AS (SELECT p_partkey, {MENTION.sql()} AS d, {MENTION_URL.sql()} AS url, lower({MENTION_TITLE.sql()}) AS cur FROM part),
s AS (SELECT *, lower(trim(d)) AS low, {_SLUG} AS s FROM x),
m AS (SELECT *, trim(regexp_extract(low, {quoted(fixed.QUOTED_WORK.removeprefix("(?U)"))}, 1)) AS q, trim(regexp_extract(low, {quoted(fixed.NAMED_WORK.removeprefix("(?U)"))}, 1)) AS n FROM s),
u AS (SELECT p_partkey * 2 AS id, p_partkey, s, q AS t FROM m WHERE length(q) > 0 AND NOT contains(cur, q) UNION ALL SELECT p_partkey * 2 + 1, p_partkey, s, n FROM m WHERE length(n) > 2 AND NOT contains(cur, n)),
c AS (SELECT *, regexp_replace(t, '[^\p{{L}}\p{{N}}\s]', ' ', 'g') AS clean, regexp_replace(s, '[^\p{{L}}\p{{N}}]', '', 'g') AS sc, regexp_replace(t, '[^\p{{L}}\p{{N}}]', '', 'g') AS tc FROM u),
f AS (
  SELECT *, lower(trim(t)) IN {among([k for k, _ in fixed.CANONICAL_TYPES])} AS never,
         len(list_intersect({_SPLIT.format("s")}, {_SPLIT.format("clean")})) / greatest(len({_SPLIT.format("s")}), 1)::DOUBLE >= 0.5 OR (sc <> '' AND tc <> '' AND (contains(tc, sc) OR contains(sc, tc))) AS fits FROM c),
p AS (SELECT id, s AS a, clean AS b FROM f),
{blocks_sql("p", "x_")},
o AS (SELECT p_partkey, bool_or(never OR NOT (fits OR ratio >= 0.6)) AS other FROM f JOIN x_ USING (id) GROUP BY p_partkey)
SELECT p_partkey, length(d) >= 30 AND cur <> '' AND (coalesce(other, false) OR {" OR ".join(f"(contains(low, {quoted(k)}) AND NOT contains(s, {quoted(k)}) AND NOT contains(cur, {quoted(k)}))" for k in fixed.LEAKING_WORKS)}) AS is_other
FROM m LEFT JOIN o USING (p_partkey)
""")
def descriptions_foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions that introduce another work than the title's or the page's, with slugs that are spelt a little otherwise."""
    part = table(spark, sf_dir, "part").withColumns({f"p_partkey // {n}": F.floor(F.col("p_partkey") / n) for n in (5, 84)})
    df = part.select("p_partkey", MENTION.column().alias("d"), MENTION_URL.column().alias("url"), MENTION_TITLE.column().alias("title"))
    return with_other_work(df, "d", "title", "url", "is_other").select("p_partkey", "is_other")
