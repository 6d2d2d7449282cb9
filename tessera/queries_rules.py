"""Operators over lines, fields and answers that are made of parts in many combinations, each beside the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.functions import normalize as N
from tessera.functions import predicates as P
from tessera.functions.text import has_cjk, is_bilingual, spread
from tessera.operators import extract, merge, repair, review, stats
from tessera.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; parts are dealt out, as rules over the lines that their keys choose are dear and the file is small."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows, "p_partkey") if name == "part" else rows


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


class Made:
    """Texts put together of parts: the key's digits, in mixed radix, choose one out of each list."""

    def __init__(self, key: str, *lists: Sequence[str]):
        self.key, self.lists = key, lists

    def column(self) -> Column:
        at, parts = F.col(self.key), []
        for values in self.lists:
            parts.append(F.get(F.array(*[F.lit(v) for v in values]), (at % len(values)).cast("int")))
            at = F.floor(at / len(values))
        return F.concat(*parts)

    def sql(self) -> str:
        at, parts = self.key, []
        for values in self.lists:
            parts.append(f"[{', '.join(map(quoted, values))}][(({at}) % {len(values)} + 1)::INT]")
            at = f"({at}) // {len(values)}"
        return "(" + " || ".join(parts) + ")"


def words_sql(column: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


def among(words: Sequence[str]) -> str:
    return "(" + ", ".join(map(quoted, words)) + ")"


STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"

# -- lines ----------------------------------------------------------------------------------------------------------

LINE = Made(
    "p_partkey",
    ("acrylic", "Photo: Ann", "Video", "装置", "a plain line", "concept: Bo", "Dimension variable", "oil", "Installation", "wood", "the work is about", "2019"),
    ("", ", ", " / ", "、", ". "), ("ink", "录像", "steel and paper", "", "made possible by all", "Print", "something longer than it should be, really, as it goes on and on", "纸"), ("", " ", ".", " variable"),
)


@query(f"""
WITH x AS (SELECT p_partkey, {LINE.sql()} AS c FROM part)
SELECT p_partkey, {words_sql("lower(c)", [w.lower() for w in fixed.MATERIAL_WORDS])} AS names_material,
       regexp_matches(c, '[/／]') AND regexp_matches(c, '[A-Za-z]') AND regexp_matches(c, '[一-鿿]') AS is_bilingual, regexp_matches(c, '[一-鿿]') AS has_cjk,
       {words_sql("lower(c)", fixed.CREDIT_MARKS)} AS has_credit_marks,
       length(c) <= 100 AND regexp_matches({STRIP.format("lower(c)")}, '^(?:{"|".join(p.removeprefix("^").replace("'", "''") for p in fixed.CREDIT_PATTERNS)})', 'i') AS is_credits,
       regexp_matches({STRIP.format("lower(c)")}, '^(?:{"|".join(p.removeprefix("^").replace("'", "''") for p in fixed.REPAIR_CREDIT_PATTERNS)})', 'i') AS is_repair_credits,
       lower(trim(c)) IN {among([k for k, _ in fixed.CANONICAL_TYPES])} OR (contains(c, '/') AND len(list_filter(string_split(c, '/'), lambda p: trim(p) <> '' AND lower(trim(p)) NOT IN {among([k for k, _ in fixed.CANONICAL_TYPES])})) = 0) AS is_type_name,
       trim(regexp_replace(lower(c), '[^a-z0-9]+', ' ', 'g')) IN {among(fixed.KNOWN_TYPES)} AS is_known_type,
       len(regexp_extract_all(c, '\\p{{L}}')) < 2 * len(regexp_extract_all(c, '[一-鿿]')) AS is_cn
FROM x
""")
def lines_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What predicates say of lines: materials, languages, credits, types."""
    c = F.col("c")
    return table(spark, sf_dir, "part").select("p_partkey", LINE.column().alias("c")).select(
        "p_partkey", P.names_material(c).alias("names_material"), is_bilingual(c).alias("is_bilingual"), has_cjk(c).alias("has_cjk"), P.has_credit_marks(c).alias("has_credit_marks"),
        P.is_credits_line(c).alias("is_credits"), P.is_repair_credits(c).alias("is_repair_credits"), P.is_type_name(c).alias("is_type_name"), P.is_known_type(c).alias("is_known_type"),
        P.is_language_cn(c).alias("is_cn"),
    )


TYPE_LINE = Made(
    "p_partkey", ("Video", "the installation", "Invite: Video", "Software: ", "cloud.data: ", "Installation of X", "Single channel video", "a Print", "variable size video", "录像"),
    ("", " / 录像", " / Video", ", colour and sound", " what follows this colon is a text of more than thirty characters", " by Some Artist", " / the end"), ("", " and so on until it is too long for a line of a type, unless it is in two languages at once"),
)


@query(f"""
WITH x AS (SELECT p_partkey, {TYPE_LINE.sql()} AS c FROM part), y AS (SELECT *, lower(c) AS low FROM x)
SELECT p_partkey, NOT {words_sql("low", fixed.SIZE_MARKS)} AND NOT contains(low, 'some artist')
  AND NOT (contains(c, ':') AND NOT regexp_matches(low, '^[a-z]+:') AND length(trim(substring(c, position(':' IN c) + 1))) > 30)
  AND NOT ({" OR ".join(f"starts_with(low, {quoted(w)})" for w in fixed.TYPE_STARTERS)})
  AND length(c) <= CASE WHEN contains(c, '/') AND regexp_matches(c, '[A-Za-z]') AND regexp_matches(c, '[一-鿿]') THEN 150 ELSE 80 END
  AND len(list_filter(string_split(low, '/'), lambda part: {" OR ".join(f"starts_with(trim(part), {quoted(w.lower())})" for w in fixed.TYPE_WORDS)})) > 0 AS is_type
FROM y
""")
def type_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that name a type."""
    return table(spark, sf_dir, "part").select("p_partkey", TYPE_LINE.column().alias("c")).select("p_partkey", P.is_type_line(F.col("c"), ("Some Artist",)).alias("is_type"))


MATERIALS_LINE = Made(
    "p_partkey", ("acrylic", "The mirror", "silicone", "Wood", "video", "no. 5", "12 x 30 cm", "2019", "Title", "one", "and"),
    (", ", " / ", "、", " "), ("ink", "hair, seat", "was made for the show.", "road, museum", "www.x.example", "Feb 21, 2014", "glass / 玻璃", "two, three", "curated by Ann", "that explore light"), ("", ", paper", "."),
)


@query(f"""
WITH x AS (SELECT p_partkey, {MATERIALS_LINE.sql()} AS c FROM part), y AS (SELECT *, lower(c) AS low, list_transform(string_split_regex(c, '[,/、，]'), lambda p: lower(trim(p))) AS parts FROM x),
v AS (SELECT *, (regexp_matches(c, '^[A-Z]') AND (ends_with(c, '.') OR ends_with(c, '。')) AND {words_sql("low", fixed.LINE_SENTENCE_WORDS)})
  OR {words_sql("low", fixed.LINE_CREDIT_MARKS)} OR starts_with(c, '"') OR {words_sql("low", fixed.LINE_VERBS)}
  OR string_split(low, ' ')[1] IN {among(fixed.LINE_STARTERS)} OR length(c) > 80 OR NOT regexp_matches(c, '[,/、，]')
  OR starts_with(low, 'video') OR len(list_filter(parts, lambda p: {" OR ".join(f"starts_with(p, {quoted(w.lower())})" for w in fixed.TYPE_WORDS)})) > 0 AND (contains(c, '/') OR {" OR ".join(f"starts_with(low, {quoted(w.lower())})" for w in fixed.TYPE_WORDS)})
     AND len(list_filter(string_split(low, '/'), lambda p: {" OR ".join(f"starts_with(trim(p), {quoted(w.lower())})" for w in fixed.TYPE_WORDS)})) > 0
  OR contains(low, 'www.') OR contains(low, 'title') OR length(c) < 10 OR (contains(low, 'feb') AND regexp_matches(c, '[0-9]{{1,2}}[.,]\\s*[0-9]{{4}}'))
  OR ({" + ".join(f"contains(low, {quoted(w)})::INT" for w in fixed.ADDRESS_WORDS)}) >= 2 AS vetoed FROM y)
SELECT p_partkey, NOT vetoed AND ({words_sql("low", [w.lower() for w in fixed.MATERIAL_WORDS])}
  OR (len(parts) >= 3 AND len(list_filter(parts[1:2], lambda p: string_split(p, ' ')[1] IN {among(fixed.PART_STARTERS)})) = 0)) AS is_materials
FROM v
""")
def materials_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that list materials."""
    df = table(spark, sf_dir, "part").select("p_partkey", MATERIALS_LINE.column().alias("c"))
    return df.select("p_partkey", extract.is_materials_line(F.col("c"), F.lit("Title"), F.lit("")).alias("is_materials"))


CONTENT = Made("p_partkey", ("Previous", "Next work", "(3 of 12)", "Fullscreen", "https://x.example", "12345 Town", "A line", "BERLIN now", "nextdoor", ".pdf", "Previously"), ("", " "), ("", "x"), ("|2018 works", "|from 2015 – 2016, ink", "|1999", "|no. 20181"))


@query(f"""
WITH x AS (SELECT p_partkey, string_split({CONTENT.sql()}, '|') AS ls FROM part),
k AS (SELECT p_partkey, list_filter(ls, lambda c: NOT regexp_matches(c, '^Previous$|^Next|^\\(?([0-9]+)\\s+of\\s+([0-9]+)\\)?$|^Fullscreen$|^\\.pdf$|^https?://|^[0-9]{{5}}\\s+\\w+|^Schöneberger|^Berlin|^Tiergarten', 'i')) AS ls FROM x)
SELECT p_partkey, array_to_string(ls, '|') AS kept, coalesce(replace(list_filter(list_transform(ls, lambda c: regexp_extract(c, '\\b(20[0-9]{{2}}(?:\\s*[-–]\\s*20[0-9]{{2}})?)\\b', 1)), lambda y: y <> '')[1], '–', '-'), '') AS year FROM k
""")
def content_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without interference, and the first year within them."""
    tags = F.array().cast("array<struct<text: string, href: string>>")
    df = table(spark, sf_dir, "part").select("p_partkey", extract.content_lines(F.split(CONTENT.column(), r"\|")).alias("ls"))
    return df.select("p_partkey", F.array_join("ls", "|").alias("kept"), extract.year_of(tags, F.col("ls")).alias("year"))


SIZED = Made("p_partkey", ("work", "180cm x 130 cm", "Variable size", "各种尺寸", "12'30''", "4:30", "10 min loop"), ("", " and ", "|"), ("", "30 × 40 × 5 cm", "尺寸可变", "7'", "1:02:03", "45 sec", "Dimensions variable / 尺寸可变"))


@query(f"""
WITH x AS (SELECT p_partkey, string_split({SIZED.sql()}, '|') AS ls FROM part)
SELECT p_partkey, {{}} AS size, {{}} AS duration FROM x
""".format(*[
    "coalesce(list_filter(list_transform(ls, lambda c: coalesce(" + ", ".join(f"nullif(trim(regexp_extract(c, {quoted(p)}, 1, 'i')), '')" for p in patterns) + ")), lambda v: v IS NOT NULL)[1], '')"
    for patterns in (fixed.LINE_SIZES, fixed.LINE_DURATIONS)
]))
def line_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and durations in the lines of a page: the first pattern of the first line that matches any."""
    from tessera.functions.text import first_line_match

    text_ = F.replace(SIZED.column(), F.lit("|"), F.lit("\n"))
    return table(spark, sf_dir, "part").select("p_partkey", first_line_match(text_, fixed.LINE_SIZES).alias("size"), first_line_match(text_, fixed.LINE_DURATIONS).alias("duration"))


IMAGE = Made("p_partkey", ("/files/", "/assets/", "/photo-", "/icons/", "/THUMB_", "/img/", "/x/logo"), ("a", "b.jpg", "c.AVIF", "d.svg", "e.png?w=2", "placeholder.gif", "f.jpgx"), ("", "?q=1"))


@query(f"""
WITH x AS (SELECT p_partkey, lower({IMAGE.sql()}) AS s FROM part)
SELECT p_partkey, NOT {words_sql("s", fixed.SKIPPED_IMAGES)} AND (regexp_matches(s, '\\.(jpg|jpeg|png|gif|webp|avif)($|\\?)') OR contains(s, 'image') OR contains(s, 'img') OR contains(s, 'photo')) AS is_image FROM x
""")
def real_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", P.is_image(IMAGE.column()).alias("is_image"))


# -- fields of works ----------------------------------------------------------------------------------------------------

WORK: Mapping[str, Made] = {
    "title": Made("p_partkey", ("A title", "")),
    "type": Made("p_partkey // 2", ("Video installation", "video", "Installation with projector, player, screen, computers and more of the like", "Website", "", "Sculpture, variable", "Film", "Media game")),
    "year": Made("p_partkey // 3", ("2019", "2020", "")),
    "materials": Made("p_partkey // 5", ("wood", "")),
    "size": Made("p_partkey // 7", ("30 x 40 cm", "")),
    "duration": Made("p_partkey // 11", ("", "3 min")),
    "video_link": Made("p_partkey // 13", ("", "", "https://vimeo.com/1")),
    "description_en": Made("p_partkey // 17", ("", "It is.")),
    "description_cn": Made("p_partkey // 19", ("", "有")),
}
WORK_SQL = "SELECT p_partkey, " + ", ".join(f"{m.sql()} AS {f}" for f, m in WORK.items()) + " FROM part"


def _work(f: str, made: Made) -> Column:
    key, _, by = made.key.partition(" // ")
    at = F.floor(F.col(key) / int(by)) if by else F.col(key)
    return F.get(F.array(*[F.lit(v) for v in made.lists[0]]), (at % len(made.lists[0])).cast("int")).alias(f)


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", *[_work(f, m) for f, m in WORK.items()])


@query(f"""
WITH w AS ({WORK_SQL}), t AS (SELECT *, lower(type) AS t FROM w),
k AS (SELECT *, regexp_matches(t, 'video|film|animation') AS v, regexp_matches(t, 'installation|sculpture|object|print|painting|media') AS m,
  title <> '' AND year <> '' AND type <> '' AND NOT (length(type) > 60 AND {words_sql("t", fixed.EQUIPMENT_WORDS)} AND materials = '') AND NOT (contains(t, 'video') AND duration = '' AND video_link = '') AS ok FROM t)
SELECT p_partkey, ok AS is_complete, ok AND NOT ({words_sql("t", fixed.PHYSICAL_TYPES)} AND materials = '') AS is_complete_strictly,
       concat_ws(',', CASE WHEN v AND duration = '' AND video_link = '' THEN 'duration' END, CASE WHEN m AND size = '' AND NOT contains(t, 'variable') THEN 'size' END, CASE WHEN m AND materials = '' THEN 'materials' END,
         CASE WHEN description_en = '' AND description_cn = '' THEN 'description_en,description_cn' END) AS missing
FROM k
""")
def works_assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether works are complete, and the fields that send them to a provider."""
    f = {c: F.col(c) for c in WORK}
    return works(spark, sf_dir).select(
        "p_partkey", P.is_complete(f).alias("is_complete"), P.is_complete(f, True).alias("is_complete_strictly"), F.array_join(P.missing_fields(f), ",").alias("missing")
    )


MARKDOWN = Made(
    "p_partkey", ("Title", "**Land / 土地**", "solo exhibition", "Catalogue"), ("|", "||text|"), ("Video installation, 2019", "media sculpture", "exhibition of works", "Websites", "weaving"),
    ("", "|see https://vimeo.com/12)", "|https://x.example/vimeo.com/1"), ("", "|acrylic, ink, wood", "|12'30''", "|Size 30 x 40 cm"),
)


@query(f"""
WITH x AS (SELECT p_partkey, replace({MARKDOWN.sql()}, '|', chr(10)) AS md FROM part),
l AS (SELECT *, list_transform(list_filter(string_split(md, chr(10)), lambda c: trim(c) <> ''), lambda c: trim(c)) AS ls FROM x),
e AS (SELECT *, list_filter(list_transform(ls[1:10], lambda c: CASE WHEN lower(c) IN ('exhibition', 'solo exhibition', 'group exhibition') THEN 'Exhibition' WHEN lower(c) IN ('catalog', 'catalogue') THEN 'Catalog' END), lambda v: v IS NOT NULL)[1] AS page,
  list_filter(list_transform(ls, lambda c: regexp_extract(lower(c), '^(video\\s*installation|installation|video|performance|website|software|media\\s*sculpture)', 1)), lambda v: v <> '')[1] AS kind FROM l)
SELECT p_partkey, coalesce(page, CASE kind WHEN 'video installation' THEN 'Video Installation' WHEN 'media sculpture' THEN 'Media Sculpture' ELSE upper(kind[1]) || kind[2:] END, '') AS type,
       CASE WHEN contains(md, '土地') THEN '土地' ELSE '' END AS title_cn, CASE WHEN contains(md, 'https://vimeo.com') THEN 'https://vimeo.com/12' ELSE '' END AS video_link,
       CASE WHEN contains(md, '12''30') THEN '12''30''''' ELSE '' END AS duration, CASE WHEN contains(md, '30 x 40 cm') THEN '30 x 40 cm' ELSE '' END AS size,
       CASE WHEN contains(md, 'acrylic') THEN 'acrylic, ink, wood' ELSE '' END AS materials
FROM e
""")
def markdown_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a page's Markdown."""
    df = table(spark, sf_dir, "part").select("p_partkey", F.replace(MARKDOWN.column(), F.lit("|"), F.lit("\n")).alias("md"))
    found = extract.from_markdown("md")
    return df.select("p_partkey", *[found[f].alias(f) for f in ("type", "title_cn", "video_link", "duration", "size", "materials")])


ENRICHED = ("video, 12 minutes", "installation 76cm × 30cm", "Photo: Ann", "print", "http://x.example", "")


@query(f"""
WITH x AS (SELECT p_partkey, p_partkey % 6 AS k, replace({MARKDOWN.sql()}, '|', chr(10)) AS md FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'video' WHEN 1 THEN 'installation' WHEN 3 THEN 'print' ELSE '' END AS type,
       CASE WHEN k = 2 THEN '3 min' WHEN contains(md, '12''30') THEN '12''30''''' WHEN k = 0 THEN '12 minutes' ELSE '' END AS duration,
       CASE WHEN contains(md, '30 x 40 cm') THEN '30 x 40 cm' WHEN k = 1 THEN '76cm × 30cm' ELSE '' END AS size, CASE WHEN k = 3 THEN 'own' WHEN contains(md, 'acrylic') THEN 'acrylic, ink, wood' ELSE '' END AS materials,
       CASE WHEN k < 2 THEN '2018-2020' ELSE '' END AS year
FROM x
""")
def records_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank fields filled from Markdown; what is embedded in types moves out of them."""
    k = F.col("p_partkey") % 6
    kind = F.get(F.array(*[F.lit(x) for x in ENRICHED]), k.cast("int"))
    record = {
        "type": kind, "duration": F.when(k == 2, "3 min").otherwise(""), "size": F.lit(""), "materials": F.when(k == 3, "own").otherwise(""), "year": F.when(k < 2, "from 2018 to 2020").otherwise("")
    }
    df = table(spark, sf_dir, "part").select("p_partkey", F.replace(MARKDOWN.column(), F.lit("|"), F.lit("\n")).alias("md"))
    return df.select("p_partkey", *[c.alias(f) for f, c in extract.enrich(record, "md").items()])


# -- merges of sources ---------------------------------------------------------------------------------------------------

PROVIDER = {
    "title": ("My work", "Foreign thing", "", "video"), "materials": ("wood", "Photo: Ann; concept: Bo", "n/a", ""), "credits": ("", "by Cy"),
    "description_en": ("", "made possible by friends", "Guard is a installation about light, shown in many places", "A long text about the work that says what it is and how it came to be."), "year": ("2001", "null"),
}
PAGE = {"title": ("My Work", "", "My work / 我的", "other"), "materials": ("", "glass"), "credits": ("", "Made possible by friends, all"), "description_en": ("", "old"), "year": ("", "1999"), "type": ("", "Print")}


def _side(table_: Mapping[str, Sequence[str]], shift: int) -> tuple[dict[str, Callable[[], Column]], dict[str, str]]:
    """Each field's column (to be made in a session) and SQL."""
    cols, sqls, by = {}, {}, shift
    for f, values in table_.items():
        cols[f] = lambda values=values, by=by: F.get(F.array(*[F.lit(v) for v in values]), (F.floor(F.col("p_partkey") / by) % len(values)).cast("int"))
        sqls[f] = f"[{', '.join(map(quoted, values))}][((p_partkey // {by}) % {len(values)} + 1)::INT]"
        by *= len(values)
    return cols, sqls


_P, _PS = _side(PROVIDER, 1)
_L, _LS = _side(PAGE, 3)


@query(f"""
WITH x AS (SELECT p_partkey, {", ".join(f"{s} AS p_{f}" for f, s in _PS.items())}, {", ".join(f"{s} AS l_{f}" for f, s in _LS.items())}, p_partkey % 7 <> 0 AS l1, (p_partkey % 5 <> 0 OR p_partkey % 7 = 0) AS l2 FROM part),
c AS (SELECT *, p_title IN ('My work') AS fits, p_title = 'My work' AND l_title IN ('My Work', 'My work / 我的') OR p_title = 'My work' AS ok,
  CASE WHEN p_materials = 'n/a' THEN '' ELSE p_materials END AS pm, CASE WHEN p_year = 'null' THEN '' ELSE p_year END AS py FROM x),
d AS (SELECT *, l1 AND l2 AS two, ok OR p_title = '' AS trusted FROM c),
e AS (SELECT *, CASE WHEN two AND trusted AND pm = 'wood' THEN pm WHEN l1 THEN l_materials ELSE pm END AS materials,
  CASE WHEN two AND trusted AND p_credits <> '' THEN p_credits WHEN l1 THEN l_credits ELSE p_credits END AS cr,
  two AND trusted AND p_description_en = 'made possible by friends' AS moved, two AND trusted AND (starts_with(p_description_en, 'A long') OR (starts_with(p_description_en, 'Guard') AND l_title = '')) AS told FROM d),
f AS (SELECT *, CASE WHEN moved AND cr = '' THEN p_description_en WHEN moved AND NOT contains(lower(cr), p_description_en) THEN cr || '. ' || p_description_en ELSE cr END AS credits,
  CASE WHEN told THEN p_description_en WHEN l1 THEN l_description_en ELSE p_description_en END AS description_en,
  CASE WHEN two AND p_title <> '' AND (ok OR l_title = '') THEN p_title WHEN l1 THEN l_title WHEN p_title <> '' AND NOT fits THEN 'My Work' ELSE p_title END AS t,
  CASE WHEN l1 AND l_year <> '' THEN l_year WHEN l2 THEN py ELSE l_year END AS year, CASE WHEN l1 THEN l_type ELSE '' END AS ty FROM e)
SELECT p_partkey, materials, credits, description_en, CASE WHEN t = 'My work / 我的' THEN 'My work' WHEN t = 'video' THEN 'My Work' ELSE t END AS title, CASE WHEN t = 'My work / 我的' THEN '我的' ELSE '' END AS title_cn,
       year, CASE WHEN t = 'video' AND ty = '' THEN 'Video' ELSE ty END AS type, CASE WHEN two THEN 'hybrid_layer2' WHEN l1 THEN 'layer1_only' ELSE 'schema_extract_v2' END AS source
FROM f
""")
def layers_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page fields and a provider's in one record: whose title fits, what moves to credits, and titles that are types."""
    from tessera.functions.udfs import with_similar, with_title_check

    none = F.lit("")
    names = ("title", "title_cn", "materials", "size", "duration", "credits", "description_en", "description_cn", "year", "type")
    k = F.col("p_partkey")
    flat = table(spark, sf_dir, "part").select(
        k, F.lit("https://w.example/my-work").alias("url"), (k % 7 != 0).alias("l1"), ((k % 5 != 0) | (k % 7 == 0)).alias("l2"), *[side.get(f, lambda: none)().alias(by + f) for by, side in (("p_", _P), ("l_", _L)) for f in names]
    )
    flat = with_similar(with_title_check(flat, "url", "p_title", "fits"), "l_title", "p_title", "alike")
    out = merge.hybrid_merge({f: F.col("l_" + f) for f in names}, {f: F.col("p_" + f) for f in names}, F.col("l1"), F.col("l2"), F.col("fits") | F.col("alike"), F.col("fits"), F.col("url"))
    return flat.select("p_partkey", *[out[f].alias(f) for f in ("materials", "credits", "description_en", "title", "title_cn", "year", "type", "source")])


TITLES = Made("p_partkey", ("video", "Video Installation / 视频装置", "land", "Sculpture", "Game / Land", ""), ("",))


TYPED = Made("p_partkey", ("video", "Video Installation", "land", "Sculpture ", "媒体", "装置", " game", ""), ("", " / ", "/"), ("", "Land", "装置", "video", "print / 版画"))
TYPED_URL = Made("p_partkey // 120", ("https://w.example/",), ("my-work", "MY_work_2", "a-1b", "x"), ("", "/"))
_TITLED = "array_to_string(list_transform(regexp_extract_all(lower({0}), '\\p{{{{L}}}}+|[^\\p{{{{L}}}}]+'), lambda w: upper(w[1]) || w[2:]), '')"


@query(f"""
WITH x AS (SELECT p_partkey, {TYPED.sql()} AS t, CASE WHEN p_partkey % 7 < 3 THEN p_type ELSE '' END AS ty, {TYPED_URL.sql()} AS url FROM part),
y AS (SELECT *, lower(translate(regexp_extract(rtrim(url, '/'), '[^/]*$'), '-_', '  ')) AS slug, list_filter(list_transform(string_split(t, '/'), lambda p: lower(trim(p))), lambda p: p <> '') AS parts FROM x),
z AS (SELECT *, lower(trim(t)) IN {among([k for k, _ in fixed.CANONICAL_TYPES])} OR (contains(t, '/') AND len(list_filter(parts, lambda p: p NOT IN {among([k for k, _ in fixed.CANONICAL_TYPES])})) = 0) AS wrong FROM y)
SELECT p_partkey, CASE WHEN wrong THEN {_TITLED.format("slug")} ELSE t END AS title, CASE WHEN wrong AND ty = '' THEN {_TITLED.format("t")} ELSE ty END AS type FROM z
""".replace("{{", "{").replace("}}", "}"))
def types_as_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that are types, in one language or two, give way to the slug."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part").withColumn("p_partkey // 120", F.floor(k / 120))
    out = repair.type_as_title(TYPED.column(), F.when(k % 7 < 3, F.col("p_type")).otherwise(""), TYPED_URL.column())
    return part.select(k, out.alias("x")).select("p_partkey", "x.*")


@query("""
WITH u AS (SELECT o_custkey AS k, arg_max(o_orderstatus, o_orderkey) AS last FROM orders GROUP BY o_custkey)
SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE coalesce(last, '') END AS name, (c_custkey % 2 <> 0 AND last IS NOT NULL)::INT AS n_filled FROM customer LEFT JOIN u ON k = c_custkey
""")
def last_updates_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of many updates of a key the last fills, and no row is multiplied."""
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("").alias("name"))
    updates = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("name"), "o_orderkey")
    return merge.fill_only(base, updates, "k", ["name"], "o_orderkey")


# -- tables of documents --------------------------------------------------------------------------------------------------


@query("SELECT 'https://w.example/' || page_id AS url, CASE WHEN page_id % 3 = 0 THEN '2024-02-01' ELSE '2024-01-0' || (1 + page_id % 9) END AS lastmod FROM pages")
def sitemap_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of two entries for each page; some repeat their URL, and the last counts."""
    k = F.col("page_id").cast("string")
    entry = lambda day: F.concat(F.lit("<url><loc> https://w.example/"), k, F.lit(" </loc><lastmod>"), day, F.lit("</lastmod></url>"))
    first = entry(F.concat(F.lit("2024-01-0"), (1 + F.col("page_id") % 9).cast("string")))
    xml = F.concat(F.lit("<urlset>"), first, F.when(F.col("page_id") % 3 == 0, entry(F.lit("2024-02-01"))).otherwise(F.lit("<url><loc></loc><lastmod>x</lastmod></url>")), F.lit("</urlset>"))
    return readers.parse_sitemaps(table(spark, sf_dir, "pages").select(xml.alias("xml")))


@query("""
SELECT 'https://w.example/' || p_partkey AS url, (1990 + p_partkey // 10)::VARCHAR AS year, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN '中文' || p_size ELSE '' END AS title_cn FROM part WHERE p_partkey % 10 <> 0
""")
def markdown_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of works under headings of years."""
    k = F.col("p_partkey")
    title = F.concat(F.lit("### ["), F.col("p_name"), F.lit("](https://w.example/"), k.cast("string"), F.lit(")"), F.when(k % 3 == 0, F.concat(F.lit(" / 中文"), F.col("p_size").cast("string"))).otherwise(""))
    year = F.concat(F.lit("## "), (1990 + F.floor(k / 10)).cast("string"))
    lines = table(spark, sf_dir, "part").select(k.alias("line_no"), F.when(k % 10 == 0, year).otherwise(title).alias("value"))
    head = spark.createDataFrame([(0, "## 1990"), (-1, "# All")], "line_no long, value string")
    return readers.parse_markdown(lines.unionByName(head))


ANSWER = {"title": Made("event_id", ("", "A work", " Two ", "三")), "category": Made("event_id // 4", ("", "Video", "Print ")), "type": Made("event_id // 12", ("", "other", "Installation")), "year": Made("event_id // 36", ("2019", "", "2001-2003"))}


@query(f"""
WITH x AS (SELECT event_id, {", ".join(f"{m.sql()} AS {f}" for f, m in ANSWER.items())}, (event_id // 108) % 7 AS form, (event_id // 5) % 3 AS n FROM events),
y AS (SELECT *, form IN (0, 1, 2, 5) AS held FROM x)
SELECT 'u' || event_id AS url, form IN (0, 1, 3) AS success, CASE WHEN held THEN title ELSE '' END AS title, CASE WHEN held THEN year ELSE '' END AS year,
       CASE WHEN NOT held THEN '' WHEN category <> '' THEN category ELSE type END AS type, CASE WHEN held AND n > 0 THEN n END AS n_images FROM y
""")
def provider_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in several envelopes: an extract, a JSON field, both, neither, an error, broken text; some fields are missing."""
    events = table(spark, sf_dir, "events").withColumns({f"event_id // {n}": F.floor(F.col("event_id") / n) for n in (4, 12, 36)})
    form, n = F.floor(F.col("event_id") / 108) % 7, F.floor(F.col("event_id") / 5) % 3
    images = F.when(n == 1, F.array(F.lit("a"))).when(n == 2, F.array(F.lit("a"), F.lit("b")))
    record = F.struct(*[m.column().alias(f) for f, m in ANSWER.items()], images.alias("images"), F.lit(1).alias("more"))
    other = F.struct(F.lit("another").alias("title"))
    whole = lambda success, **data: F.to_json(F.struct(*([F.lit(success).alias("success")] if success is not None else []), F.struct(*[c.alias(k) for k, c in data.items()]).alias("data")))
    body = (
        F.when(form == 0, whole(True, extract=record)).when(form == 1, whole(True, json=record)).when(form == 2, whole(False, extract=record, json=other)).when(form == 3, F.lit('{"success": true, "data": {}}'))
        .when(form == 4, F.lit('{"error": "none"}')).when(form == 5, whole(None, json=record)).otherwise(F.lit('{"success": tr'))
    )
    df = events.select(F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("url"), body.alias("json"))
    return readers.parse_answers(df).select("url", "success", "title", "year", "type", F.when(F.col("images").isNotNull(), F.size("images")).alias("n_images"))


@query("SELECT DISTINCT 'https://w.example/' || (user_id % 50) || event_type AS url FROM events UNION SELECT DISTINCT 'https://w.example/' || event_type FROM events")
def mapped_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct links of answers that hold strings and objects."""
    host, kind = F.lit("https://w.example/"), F.col("event_type")
    json = F.concat(F.lit('{"success": true, "links": ["'), host, (F.col("user_id") % 50).cast("string"), kind, F.lit('", {"url": "'), host, kind, F.lit('"}]}'))
    return readers.links_of_map(table(spark, sf_dir, "events").select(json.alias("json")))


@query("""
SELECT o_orderkey, 'u' || i AS url, CASE WHEN i <= o_orderkey % 4 THEN 'r' || i END AS result FROM orders, (SELECT unnest([1, 2, 3]) AS i) t
""")
def answers_zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by position; missing ones are null."""
    urls = F.array(F.lit("u1"), F.lit("u2"), F.lit("u3"))
    results = F.slice(F.array(F.lit("r1"), F.lit("r2"), F.lit("r3"), F.lit("r4")), F.lit(1), (F.col("o_orderkey") % 4).cast("int"))
    zipped = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(readers.zip_answers(urls, results)).alias("x"))
    return zipped.select("o_orderkey", "x.url", "x.result")


@query("""
SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS status FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_orderkey = (SELECT min(l_orderkey) FROM lineitem)
UNION ALL SELECT o_orderkey, 'o' || o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O')
""")
def records_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by status, and by status and batch."""
    line = table(spark, sf_dir, "lineitem")
    least = line.agg(F.min("l_orderkey")).first()[0]
    rec = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("status"), F.col("l_orderkey").alias("batch_id"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return review.list_records(rec, ["A", "R"], least).select("id", "status").unionByName(review.list_records(orders, ["F", "O"]).withColumn("status", F.concat(F.lit("o"), F.col("status"))))


@query("""
SELECT DISTINCT 'c' || o_custkey AS url FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P' AND c_mktsegment = 'BUILDING'
""")
def urls_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of rejected records of incremental batches."""
    o = table(spark, sf_dir, "orders")
    rec = o.select(F.col("o_custkey").alias("batch_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("url"), F.when(F.col("o_orderstatus") == "P", "rejected").otherwise("accepted").alias("status"))
    batches = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", "incremental").otherwise("manual").alias("mode"))
    return review.rejected_urls(rec, batches)


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'X') AS X, count(*) AS total FROM orders")
def outcomes_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.outcomes(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "X"])


BILINGUAL = Made("p_partkey", ("icon", "land 5", "空"), (" / ", "/", " - "), ("图标", "x", "", "图 / 标", " b 土 "))


@query(f"""
WITH x AS (SELECT p_partkey, {BILINGUAL.sql()} AS c FROM part), y AS (SELECT *, trim(substring(c, position('/' IN c) + 1)) AS r, trim(split_part(c, '/', 1)) AS l FROM x)
SELECT p_partkey, CASE WHEN contains(c, '/') AND regexp_matches(r, '[一-鿿]') THEN l ELSE c END AS title, CASE WHEN contains(c, '/') AND regexp_matches(r, '[一-鿿]') THEN r ELSE '' END AS title_cn FROM y
""")
def titles_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles in two languages."""
    return table(spark, sf_dir, "part").select("p_partkey", N.split_bilingual(BILINGUAL.column()).alias("x")).select("p_partkey", "x.*")


FOREIGN = Made("p_partkey", ("", "See selected works below", "A text about something else", "Other Things\nwhat follows", "my work in short", "https://x.example/other"), ("", " and my work", "\nMore Titles Here\nx", " https://w.example/my-work"))


@query(f"""
WITH x AS (SELECT p_partkey, {FOREIGN.sql().replace(chr(10), "' || chr(10) || '")} AS b FROM part), y AS (SELECT *, lower({STRIP.format("b")}) AS low FROM x),
z AS (SELECT *, list_filter(string_split({STRIP.format("b")}, chr(10))[1:3], lambda h: trim(h) <> '' AND len(string_split(trim(h), ' ')) <= 6
  AND regexp_matches(h, '^[^A-Za-z]*([A-Z][a-z]*[^A-Za-z]+)*[A-Z][a-z]*[^A-Za-z]*$')) AS heads, list_filter(string_split(trim(regexp_replace(low, '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w IN ('my', 'work')) AS own FROM y)
SELECT p_partkey, low <> '' AND (contains(low, 'related projects') OR contains(low, 'selected works') OR (regexp_matches(low, 'https?://\\S+') AND NOT contains(low, 'my-work'))
  OR (len(list_distinct(own)) < 2 AND NOT (len(list_distinct(string_split(trim(regexp_replace(low, '[^a-z0-9]+', ' ', 'g')), ' '))) < 2 AND len(own) > 0) AND NOT contains(low, 'my work') AND len(heads) > 0)) AS is_foreign FROM z
""")
def foreign_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that belong to other pages."""
    df = table(spark, sf_dir, "part").select("p_partkey", FOREIGN.column().alias("b"))
    return df.select("p_partkey", P.reads_as_foreign(F.col("b"), F.lit("My work"), F.lit("https://w.example/my-work")).alias("is_foreign"))


OWNED = Made("p_partkey", ("", "The ", "  "), ("One Ritual", "one   ritual!", "Guard, I", "one-ritual", "Two Rituals and one ritual", "land"), ("", " (2014)", " / 仪式"))
OWNED_URL = Made("p_partkey // 54", ("https://w.example/", "https://w.example/x/"), ("One-Ritual-1", "other", "guard_i", "two-rituals", "GUARD"), ("", "/", "//"))
OWNERS = (("two rituals", ("two-rituals", "rituals-2")), ("one ritual", ("one-ritual",)), ("guard", ("guard",)))


@query(f"""
WITH x AS (SELECT p_partkey, {OWNED.sql()} AS title, {OWNED_URL.sql()} AS url FROM part),
y AS (SELECT *, trim(regexp_replace(regexp_replace(lower(trim(title)), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g')) AS clean, lower(regexp_extract(rtrim(url, '/'), '[^/]*$')) AS own FROM x),
o(place, known, slugs) AS (VALUES {", ".join(f"({i}, {quoted(k)}, [{', '.join(map(quoted, s))}])" for i, (k, s) in enumerate(OWNERS))}),
h AS (SELECT p_partkey, arg_min(len(list_filter(slugs, lambda s: contains(own, s))) = 0, place) AS away FROM y JOIN o ON contains(clean, known) GROUP BY p_partkey)
SELECT p_partkey, title, coalesce(away, false) AS is_foreign FROM y LEFT JOIN h USING (p_partkey)
""")
def sidebar_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of another page that leaked from a sidebar: the first known title within one decides."""
    part = table(spark, sf_dir, "part").withColumn("p_partkey // 54", F.floor(F.col("p_partkey") / 54))
    return part.select("p_partkey", OWNED.column().alias("title"), P.is_foreign_title(OWNED_URL.column(), OWNED.column(), OWNERS).alias("is_foreign"))
