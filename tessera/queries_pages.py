"""Rules of page extraction over generated lines and whole generated pages, beside SQL that applies the same rules by itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.functions import predicates as P
from tessera.operators import extract, repair
from tessera.queries_rules import Made, quoted, table
from tessera.sources.html import parse_pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


# -- descriptions ---------------------------------------------------------------------------------------------------

PROSE = Made(
    "p_partkey",
    ("The piece turns slowly in a dark room and nobody can tell when it began, ", "wood, steel, ink, paper, oil, glass, ", "12 34 56 78 90 12 34 56 78 90 12 34 56 78 90 12 34 ", "作品在黑暗的房间里慢慢转动没有人知道它是什么时候开始的也没有人知道它会在什么时候结束, ",
     "Photo: ", "at 12 Long Street in the old town ", "one part of it is long enough, the other parts too, though they are many, "),
    ("which is why visitors stay", "Opening at the Gallery 2018", "rope", "an exhibition held in 1999 and later", "and more，and more，and more", "渡轮七点离开旧港中午之前到达岛上冬天每周只有两班而且要看风"),
    ("", " for longer than anyone would have thought before the year was over", ", silk, film, tape, net, dye", " 5 南京 路"),
)


def said(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {quoted(pattern)}, 'i')"


@query(f"""
WITH x AS (SELECT p_partkey, {PROSE.sql()} AS c, CASE WHEN p_partkey % 5 = 0 THEN {PROSE.sql()} ELSE 'ink' END AS m FROM part),
y AS (SELECT *, string_split_regex(c, '[,，]') AS parts, len(regexp_extract_all(c, '\\p{{L}}')) AS letters, len(regexp_extract_all(c, '[一-鿿]')) AS chinese FROM x)
SELECT p_partkey,
       length(c) >= 60
       AND NOT (length(c) <= 100 AND {said("trim(lower(c))", "^(?:" + "|".join(p.removeprefix("^") for p in fixed.CREDIT_PATTERNS) + ")")})
       AND NOT (length(c) < 120 AND len(parts) - 1 >= 3 AND list_sum(list_transform(parts, lambda p: length(trim(p)))) / len(parts)::DOUBLE < 20)
       AND trim(c) <> trim(m) AND letters >= length(c) * 0.5
       AND NOT {said("c", fixed.EVENT_LINE)} AND NOT {said("c", fixed.ADDRESS_LINE.replace(chr(92) + "w", chr(92) + "p{L}"))} AS is_description,
       chinese::DOUBLE / greatest(letters, 1) > 0.5 AS is_cn
FROM y
""")
def descriptions_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines of a page describe a work, and in which language."""
    c, m = PROSE.column(), F.when(F.col("p_partkey") % 5 == 0, PROSE.column()).otherwise("ink")
    df = table(spark, sf_dir, "part").select("p_partkey", c.alias("c"), m.alias("m"))
    return df.select("p_partkey", P.is_description_line(F.col("c"), F.col("m")).alias("is_description"), P.is_language_cn("c").alias("is_cn"))


# -- types ------------------------------------------------------------------------------------------------------------

TYPE = Made(
    "p_partkey", ("", "6′00″ ", "15'30\" ", "4'4'' \"", "Single channel "), ("video", "Video or Live performance", "installation / 装置", "video, color,sound", ""),
    ("", ",15 minutes and 30 seconds", " 4'4''", ", 3 min", " 10\"  ", " 12 Seconds long, silent"), ("", " 76cm × 30cm × 280cm", ", 30 x 40 cm,", " 3X4m/"), ("", ", 2017 – 2018,", " 2001-2002 and on"),
)
_OWN, _SIZE = fixed.TYPE_DURATION, fixed.TYPE_SIZE


@query(f"""
WITH a AS (SELECT p_partkey, trim({TYPE.sql()}) AS t FROM part),
b AS (
  SELECT *, CASE WHEN regexp_matches(t, {quoted(f"^{_OWN}")}) THEN 1 WHEN regexp_matches(t, {quoted(rf"{chr(92)}s+{_OWN}{chr(92)}s*$")}) THEN 2
                 WHEN {said("t", fixed.TYPE_MINUTES)} THEN 3 ELSE 0 END AS form FROM a),
c AS (
  SELECT *,
         CASE form WHEN 1 THEN ltrim(trim(regexp_replace(t, {quoted(f"^{_OWN}")}, '')), '"''′″“”‘’ ') WHEN 2 THEN trim(regexp_replace(t, {quoted(rf"{chr(92)}s+{_OWN}{chr(92)}s*$")}, ''))
           WHEN 3 THEN rtrim(trim(regexp_replace(t, {quoted(rf",?{chr(92)}s*{fixed.TYPE_MINUTES}")}, '', 'gi')), ',') ELSE t END AS r,
         trim(CASE form WHEN 1 THEN regexp_extract(t, {quoted(f"^{_OWN}")}) WHEN 2 THEN trim(regexp_extract(t, {quoted(rf"{chr(92)}s+({_OWN}){chr(92)}s*$")}, 1))
           WHEN 3 THEN regexp_extract(t, {quoted(f"(?i){fixed.TYPE_MINUTES}")}) ELSE '' END) AS duration FROM b),
d AS (
  SELECT *, trim(regexp_extract(r, {quoted(_SIZE)})) AS size,
         CASE WHEN regexp_matches(r, {quoted(_SIZE)}) THEN trim(rtrim(rtrim(trim(regexp_replace(r, {quoted(rf"{chr(92)}s*{_SIZE}")}, '', 'g')), ','), '/')) ELSE r END AS s FROM c)
SELECT p_partkey, trim(rtrim(trim(regexp_replace(s, {quoted(fixed.TYPE_YEARS)}, '', 'g')), ',')) AS type, duration, size FROM d
""")
def types_tidied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations, sizes and ranges of years leave the types of page lines."""
    return table(spark, sf_dir, "part").select("p_partkey", repair.tidy_type(TYPE.column()).alias("x")).select("p_partkey", "x.*")


# -- credits ----------------------------------------------------------------------------------------------------------

CREDITED = Made(
    "p_partkey", ("Title\n", "", "see photo: none\n"), ("Photo: Ann Bo", "concept : Cy", "text, made possible by all of us, and more", "a collaboration with Di", "light: Ann, Bo; sound: Cy", "plain", "  Copyright by Ed  "),
    ("\n", ""), ("sound: Fay", "team: Gus\nvenue: Hall", "", "more text"),
)
_CREDITS = ", ".join(f"nullif(trim(regexp_extract(md, {quoted('(?im)' + p)})), '')" for p in fixed.CREDIT_PATTERNS)


@query(f"WITH x AS (SELECT p_partkey, {CREDITED.sql()} AS md FROM part) SELECT p_partkey, coalesce({_CREDITS}, '') AS credits FROM x")
def credits_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credits anywhere in Markdown, by the first pattern that finds any."""
    return table(spark, sf_dir, "part").select("p_partkey", extract.credits_of_markdown(CREDITED.column()).alias("credits"))


# -- images -----------------------------------------------------------------------------------------------------------

# A page of three projects: which one is shown (none, one without an id, or one whose slideshow is not there), and where else
# images are. Digits of the page's key choose.
_DIGITS = {"shown": (1, 5), "box": (5, 6), "inner": (30, 2), "article": (60, 2), "main": (120, 2), "small": (240, 2), "original": (480, 3)}


def digit(name: str) -> str:
    by, n = _DIGITS[name]
    return f"CAST(floor(p_partkey / {by}) AS BIGINT) % {n}"


@query(f"""
WITH k AS (SELECT p_partkey, {", ".join(f"{digit(name)} AS d_{name}" for name in _DIGITS)} FROM part),
i AS (
  SELECT p_partkey, unnest([
    {{'o': 1, 'n': 's0.jpg', 'shows': 0, 'rank': 0, 'ok': true, 'orig': d_original = 1}},
    {{'o': 2, 'n': CASE d_small WHEN 1 THEN 'thumb_s1.jpg' ELSE 's1.png' END, 'shows': 1, 'rank': 0, 'ok': d_small <> 1, 'orig': d_original = 1}},
    {{'o': 3, 'n': 's2.webp?x=1', 'shows': 2, 'rank': 0, 'ok': true, 'orig': d_original = 1}},
    {{'o': 4, 'n': 'c.jpg', 'shows': NULL, 'rank': CASE WHEN d_box BETWEEN 1 AND 3 THEN d_box END, 'ok': true, 'orig': false}},
    {{'o': 5, 'n': 'second.jpg', 'shows': NULL, 'rank': NULL, 'ok': true, 'orig': false}},
    {{'o': 6, 'n': 'a.gif', 'shows': NULL, 'rank': CASE WHEN d_article = 1 THEN 4 END, 'ok': true, 'orig': d_original = 2}},
    {{'o': 7, 'n': 'm.jpeg', 'shows': NULL, 'rank': CASE WHEN d_main = 1 THEN 5 END, 'ok': true, 'orig': d_original = 2}},
    {{'o': 8, 'n': 'logo.png', 'shows': NULL, 'rank': CASE WHEN d_main = 1 THEN 5 END, 'ok': false, 'orig': true}},
    {{'o': 9, 'n': 'a.gif', 'shows': NULL, 'rank': NULL, 'ok': true, 'orig': false}}], recursive := true), d_shown, d_inner, d_box, d_article, d_main, d_original FROM k),
-- An inner box lies within the first box, which holds 'c.jpg'; slideshows lie in main where inner says so.
p AS (
  SELECT *, d_shown BETWEEN 1 AND 3 AND shows = d_shown - 1 AS in_shown,
         CASE WHEN d_inner = 1 AND d_main = 1 AND shows IS NOT NULL THEN 5 WHEN rank > 0 THEN rank END AS held FROM i WHERE ok),
f AS (SELECT p_partkey, bool_or(in_shown) AS any_shown, count(held) > 0 AS any_held FROM p GROUP BY p_partkey),
c AS (
  SELECT p_partkey, n, min(CASE WHEN any_shown THEN o WHEN any_held THEN held * 100 + o ELSE o END) AS turn
  FROM p JOIN f USING (p_partkey) WHERE CASE WHEN any_shown THEN in_shown WHEN any_held THEN held IS NOT NULL ELSE orig END GROUP BY p_partkey, n)
SELECT p_partkey, coalesce(string_agg('http://w.example/p/' || n, ' ' ORDER BY turn), '') AS images FROM part LEFT JOIN c USING (p_partkey) GROUP BY p_partkey
""")
def project_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images of the project that a page of several shows."""
    d = {name: F.expr(digit(name)) for name in _DIGITS}

    def img(name, original=None):
        plain = F.format_string('<img src="%s">', name if not isinstance(name, str) else F.lit(name))
        big = F.format_string('<img src="small.jpg" data-src="x.jpg" src_o="%s">', name if not isinstance(name, str) else F.lit(name))
        return plain if original is None else F.when(original, big).otherwise(plain)

    def box(test, head: str, inner, tail: str):
        return F.when(test, F.concat(F.lit(head), inner, F.lit(tail))).otherwise(inner)

    shown, own = d["shown"], d["original"] == 1
    thumbs = F.concat(*[F.concat(F.lit('<div class="project_thumb'), F.when(shown == i + 1, " active").otherwise(""), F.lit(f'" id="item_{10 + i}"><p>{i}</div>')) for i in range(3)])
    thumbs = F.concat(thumbs, F.when(shown == 4, '<a class="project_thumb_active">no id</a>').otherwise(""))
    second = F.when(d["small"] == 1, "thumb_s1.jpg").otherwise("s1.png")
    slides = F.concat(
        F.lit('<div id="slideshow_container_10"><p>'), img("s0.jpg", own), F.lit('</div><div id="slideshow_container_11" class="x">'), img(second, own),
        F.lit('<br></div><section id="my_slideshow_container_12"><span>'), img("s2.webp?x=1", own), F.lit("</section>"),
    )
    names = F.when(d["box"] == 1, "project_content big").when(d["box"] == 2, "a slide_content").when(d["box"] == 3, "content_inner").otherwise("none")
    content = F.concat(F.lit('<div class="'), names, F.lit('"><ul><li>'), img("c.jpg"), F.lit('</ul></div><div class="'), names, F.lit('">'), img("second.jpg"), F.lit("</div>"))
    article = box(d["article"] == 1, "<article>", img("a.gif", d["original"] == 2), "</article>")
    main = F.concat(img("m.jpeg", d["original"] == 2), img("logo.png", F.lit(True)))
    within = (d["inner"] == 1) & (d["main"] == 1)
    body = F.concat(F.when(within, "").otherwise(slides), content, article, box(d["main"] == 1, "<main>", F.concat(F.when(within, slides).otherwise(""), main), "</main>"), img("a.gif"))
    pages = table(spark, sf_dir, "part").select(F.lit("http://w.example/p/").alias("url"), F.concat(F.lit('<title>'), F.col("p_partkey").cast("string"), F.lit("</title>"), thumbs, body).alias("html"))
    parsed = parse_pages(pages)
    return parsed.select(F.col("page_title").cast("long").alias("p_partkey"), F.array_join(extract.images_of_page(F.col("images"), F.col("parts")), " ").alias("images"))
