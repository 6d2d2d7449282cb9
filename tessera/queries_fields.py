"""Merges, normal forms, repairs and the gate over fields that are made of parts in many combinations, beside SQL that applies
the same rules by itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.functions import normalize as N
from tessera.operators import merge, repair, review
from tessera.queries_rules import Made, among, quoted, table, words_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


class By(Made):
    """As Made, by the key's quotient, so that several fields vary independently."""

    def __init__(self, by: int, *lists):
        super().__init__("p_partkey", *lists)
        self.by = by

    def column(self) -> Column:
        at, parts = F.floor(F.col("p_partkey") / self.by), []
        for values in self.lists:
            parts.append(F.get(F.array(*[F.lit(v) for v in values]), (at % len(values)).cast("int")))
            at = F.floor(at / len(values))
        return F.concat(*parts)

    def sql(self) -> str:
        at, parts = f"(p_partkey // {self.by})", []
        for values in self.lists:
            parts.append(f"[{', '.join(map(quoted, values))}][(({at}) % {len(values)} + 1)::INT]")
            at = f"({at}) // {len(values)}"
        return "(" + " || ".join(parts) + ")"


def patterns_sql(column: str, patterns) -> str:
    return f"regexp_matches({column}, '^(?:{'|'.join(p.removeprefix('^').replace(chr(39), chr(39) * 2) for p in patterns)})', 'i')"


def count_sql(column: str, words) -> str:
    return "(" + " + ".join(f"contains({column}, {quoted(w)})::INT" for w in words) + ")"


TITLE = By(1, ("land", "icon", "空", "404"), (" / ", "/", ""), ("land 005", "图标", "icon", "404", "", "x / 图标"))
TITLE_CN = By(5, ("", "图标", "y", "图标 / 图标", "大图标", "图 / 标", "404 / 404"))
_HALVED = "CASE WHEN contains({0}, '/') AND trim(split_part({0}, '/', 1)) = trim(string_split({0}, '/')[-1]) THEN trim(split_part({0}, '/', 1)) ELSE {0} END"


@query(f"""
WITH x AS (SELECT p_partkey, {TITLE.sql()} AS t, {TITLE_CN.sql()} AS cn FROM part), y AS (SELECT *, trim(split_part(t, '/', 1)) AS l, trim(string_split(t, '/')[-1]) AS r, len(string_split(t, '/')) AS n FROM x),
z AS (SELECT *, contains(t, '/') AND NOT regexp_matches(l, '[一-鿿]') AND regexp_matches(r, '[一-鿿]') AS two_tongues, n = 2 AND NOT regexp_matches(t, '[一-鿿]') AND contains(lower(r), lower(l)) AS doubled,
  CASE WHEN cn <> '' AND r <> cn AND NOT contains(cn, r) AND NOT contains(r, cn) THEN cn ELSE r END AS chosen FROM y)
SELECT p_partkey, CASE WHEN two_tongues OR doubled THEN l ELSE t END AS title, CASE WHEN two_tongues THEN {_HALVED.format("chosen")} ELSE {_HALVED.format("cn")} END AS title_cn FROM z
""")
def titles_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", N.clean_title(TITLE.column(), TITLE_CN.column()).alias("x")).select("p_partkey", "x.*")


LLM_MATERIALS = By(1, ("wood", "N/A", "photo: someone", "this is the work that was made for us", "\"Quoted\" paper", "", "glass and steel", "none specified", "it is for all"), ("", ", ink", " through the night", " - and a long list of things that goes on and on, with paper and glass and steel and wood and much more that nobody would ever call a list of materials, really"))
LLM_TYPE = By(3, ("", "Print", "NULL", " null ", "Video"))
LLM_TITLE = By(7, ("", "Other"))
LLM_TEXT = By(2, ("", "provided"))


@query(f"""
WITH x AS (SELECT p_partkey, p_name, p_type, {LLM_MATERIALS.sql()} AS m, {LLM_TYPE.sql()} AS t, {LLM_TITLE.sql()} AS n FROM part), y AS (SELECT *, lower(m) AS low FROM x)
SELECT p_partkey AS k, CASE WHEN n <> '' THEN n ELSE p_name END AS title, CASE WHEN t <> '' AND lower(trim(t)) <> 'null' THEN t ELSE p_type END AS type,
       CASE WHEN m = '' OR {words_sql("low", fixed.CREDIT_MARKS)} OR trim(low) IN {among(fixed.WIDE_PLACEHOLDERS)} OR length(m) > 150 OR {count_sql("low", fixed.SENTENCE_MARKS)} >= 2 OR starts_with(m, '"') THEN 'base' ELSE m END AS materials,
       CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'd' END AS description_en
FROM y
""")
def sources_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second source's fields over the first's, with vetoes on types and materials; descriptions stay the first's."""
    k = F.col("p_partkey")
    names = ("title", "title_cn", "year", "type", "materials", "size", "duration", "credits", "video_link", "description_en", "description_cn")
    base = dict.fromkeys(names, F.lit("")) | {"title": F.col("p_name"), "type": F.col("p_type"), "materials": F.lit("base"), "description_en": F.when(k % 3 == 0, "").otherwise("d")}
    llm = dict.fromkeys(names, F.lit("")) | {"title": LLM_TITLE.column(), "type": LLM_TYPE.column(), "materials": LLM_MATERIALS.column(), "description_en": LLM_TEXT.column()}
    out = merge.merge_sources(base, llm)
    return table(spark, sf_dir, "part").select(k.alias("k"), *[out[f].alias(f) for f in ("title", "type", "materials", "description_en")])


TYPE = By(1, ("installation", "Video", "Single channel video", "media sculpture", "weaving", "Website", "Screen printing", "", "metal frame", "装置"), ("", ", ", " / ", "; "), ("", "projector", "color", "glass", "chevron board", "sound", "ink", "Print, linen, chevron board, raspberry pi and more"))
_KEY = "coalesce(" + ", ".join(f"CASE WHEN contains({{0}}, {quoted(k)}) THEN {quoted(v)} END" for k, v in fixed.CANONICAL_TYPES) + ")"


@query(f"""
WITH x AS (SELECT p_partkey, trim({TYPE.sql()}) AS w FROM part), y AS (SELECT *, lower(w) AS low, replace(lower(w), ' ', '') AS tight FROM x),
e AS (SELECT *, coalesce({", ".join(f"CASE WHEN low = {quoted(k)} OR tight = {quoted(k.replace(' ', ''))} THEN {quoted(v)} END" for k, v in fixed.CANONICAL_TYPES)}) AS exact,
  NOT {words_sql("low", fixed.TYPE_POLLUTANTS)} AND length(w) < 50 AS clean, string_split_regex(w, '[,;/，；]') AS raw FROM y),
p AS (SELECT *, list_filter(list_transform(raw, lambda c: trim(c)), lambda c: c <> '') AS parts FROM e),
q AS (SELECT *, list_filter(list_transform(parts, lambda c: {_KEY.format("lower(c)")}), lambda v: v IS NOT NULL) AS named FROM p),
d AS (SELECT *, list_filter(named, lambda v, i: list_position(named, v) = i) AS types,
  list_filter(parts, lambda c: {_KEY.format("lower(c)")} IS NULL AND NOT {words_sql("lower(c)", fixed.FORMAT_WORDS)} AND ({words_sql("lower(c)", fixed.TYPE_POLLUTANTS)} OR length(c) > 3)) AS rest FROM q)
SELECT p_partkey, CASE WHEN w = '' THEN '' WHEN exact IS NOT NULL THEN exact WHEN clean THEN coalesce({_KEY.format("low")}, w) WHEN len(types) > 0 THEN array_to_string(types, ' / ') ELSE trim(raw[1]) END AS type,
       CASE WHEN w = '' OR exact IS NOT NULL OR clean THEN '' ELSE array_to_string(rest, ', ') END AS materials
FROM d
""")
def types_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", N.normalize_type(TYPE.column()).alias("x")).select("p_partkey", "x.*")


MATERIALS = By(1, ("wood, ink", "Dimensions variable", "steel; paint", "paper", "", "尺寸可变", "Video 12'30''"), ("", ", 30 x 40 cm", ", 10 min", " , 5 x 6 x 7 mm, oil", ", 4:30", ", Dimension variable / 尺寸可变"))
_DURATION = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(m, {quoted(t)}, 'i') THEN trim(regexp_extract(m, {quoted(t)}, 1, 'i')) END" for t, _ in fixed.EMBEDDED_DURATIONS) + ", '')"
_UNTIMED = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(m, {quoted(t)}, 'i') THEN regexp_replace(m, {quoted(d)}, '', 'gi') END" for t, d in fixed.EMBEDDED_DURATIONS) + ", m)"
_SIZE = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(u, {quoted(p)}, 'i') THEN {quoted(n) if n else f'trim(regexp_extract(u, {quoted(p)}, 1, {quoted('i')}))'} END" for p, n in fixed.EMBEDDED_SIZES) + ", '')"
_UNSIZED = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(u, {quoted(p)}, 'i') THEN regexp_replace(u, {quoted(p)}, '', 'gi') END" for p, _ in fixed.EMBEDDED_SIZES) + ", u)"
_TIDY = r"trim(regexp_replace(regexp_replace(regexp_replace(r, '[,;]\s*[,;]', ',', 'g'), '^[,;\s]+|[,;\s]+$', '', 'g'), '\s{2,}', ' ', 'g'))"


@query(f"""
WITH x AS (SELECT p_partkey, {MATERIALS.sql()} AS m, CASE WHEN p_partkey % 11 = 0 THEN 'own' ELSE '' END AS s, CASE WHEN p_partkey % 13 = 0 THEN 'own' ELSE '' END AS d FROM part),
a AS (SELECT *, {" OR ".join(f"regexp_matches(trim(m), {quoted(p)}, 'i')" for p in fixed.PURE_SIZE_PATTERNS)} AS pure, {_DURATION} AS dur, {_UNTIMED} AS u FROM x), b AS (SELECT *, {_SIZE} AS siz, {_UNSIZED} AS r FROM a),
c AS (SELECT *, m <> '' AND (s = '' OR d = '') AS need FROM b)
SELECT p_partkey, CASE WHEN NOT need THEN m WHEN pure THEN '' ELSE {_TIDY} END AS materials, CASE WHEN s <> '' OR NOT need THEN s WHEN pure THEN trim(m) ELSE siz END AS size, CASE WHEN d <> '' OR NOT need OR pure THEN d ELSE dur END AS duration FROM c
""")
def materials_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    df = table(spark, sf_dir, "part").select(k, MATERIALS.column().alias("materials"), F.when(k % 11 == 0, "own").otherwise("").alias("size"), F.when(k % 13 == 0, "own").otherwise("").alias("duration"))
    return repair.repair_sizes(df)


MAT = By(1, ("Photo: Ann", "wood", "", "Dimension variable", "dimensions 3 cm", "collaboration with Bo", "concept: Cy"))
TYP = By(7, ("Video", "http://x.example/", "sound: Di", "https://y", "", "a type that is not one but goes on and on until it has more than a hundred characters, which no type has"))
CRED = By(5, ("", "", "own"))


@query(f"""
WITH x AS (SELECT p_partkey, {MAT.sql()} AS m, {TYP.sql()} AS t, {CRED.sql()} AS c, CASE WHEN p_partkey % 3 = 0 THEN 'big' ELSE '' END AS s FROM part),
y AS (SELECT *, {patterns_sql("trim(lower(m))", fixed.REPAIR_CREDIT_PATTERNS)} AS mc, {patterns_sql("trim(lower(t))", fixed.REPAIR_CREDIT_PATTERNS)} AS tc FROM x),
z AS (SELECT *, CASE WHEN mc AND c = '' THEN m ELSE c END AS c1, CASE WHEN mc THEN '' ELSE m END AS m1 FROM y), w AS (SELECT *, starts_with(lower(m1), 'dimension') AS dim FROM z)
SELECT p_partkey, CASE WHEN dim THEN '' ELSE m1 END AS materials, CASE WHEN tc AND c1 = '' THEN t ELSE c1 END AS credits, CASE WHEN tc OR starts_with(t, 'http') OR length(t) > 100 THEN '' ELSE t END AS type,
       CASE WHEN dim AND s = '' THEN m1 ELSE s END AS size, (mc AND c = '')::INT + (tc AND c1 = '')::INT + starts_with(t, 'http')::INT + (length(t) > 100)::INT + (dim AND s = '')::INT AS n_changes
FROM w
""")
def credits_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select(
        "p_partkey", MAT.column().alias("materials"), TYP.column().alias("type"), CRED.column().alias("credits"), F.when(F.col("p_partkey") % 3 == 0, "big").otherwise("").alias("size")
    )
    return repair.repair_credits(df).select("p_partkey", "materials", "credits", "type", "size", F.size("changes").alias("n_changes"))


PROBLEM = By(1, ("wood", "TITLE", "Team: someone and others", "\"so it is\"", "this is the work that was made", "paper", "题", "© Ann", "concept: Bo"))
WHEN = By(9, ("3 min", "21.02.2014 - 15.03.2014", "from May on", "", "12'30''"))
KIND = By(4, ("Video", " NULL", "null", ""))
_AS_TITLE = "m <> '' AND (lower(trim(m)) = 'title' OR lower(trim(m)) = '题')"
_DESCRIBED = f"(m <> '' AND ({words_sql('lower(m)', fixed.REPAIR_CREDIT_MARKS)} OR {count_sql('lower(m)', fixed.REPAIR_SENTENCE_MARKS)} >= 2 OR ({' OR '.join(f'starts_with(m, {quoted(q)})' for q in fixed.REPAIR_QUOTE_MARKS)}) OR contains(m, '©')))"


@query(f"""
WITH x AS (SELECT p_partkey, {PROBLEM.sql()} AS m, {WHEN.sql()} AS d, {KIND.sql()} AS t, {CRED.sql()} AS c FROM part), y AS (SELECT *, {_AS_TITLE} AS titled, {_DESCRIBED} AS told FROM x)
SELECT p_partkey, lower(trim(t)) = 'null' AS fixed_type, titled OR told AS fixed_materials, regexp_matches(d, '^[0-9]{{1,2}}\\.[0-9]{{2}}\\.[0-9]{{4}}') OR contains(d, 'May') AS fixed_duration,
       CASE WHEN lower(trim(t)) = 'null' THEN '' ELSE t END AS type, CASE WHEN titled OR told THEN '' ELSE m END AS materials, CASE WHEN regexp_matches(d, '^[0-9]{{1,2}}\\.') OR contains(d, 'May') THEN '' ELSE d END AS duration,
       CASE WHEN NOT titled AND told AND c = '' AND {words_sql("lower(m)", ("team:", "concept:", "collaboration"))} THEN m ELSE c END AS credits
FROM y
""")
def problems_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select(
        "p_partkey", PROBLEM.column().alias("materials"), WHEN.column().alias("duration"), KIND.column().alias("type"), CRED.column().alias("credits"), F.lit("Title").alias("title"), F.lit("题").alias("title_cn")
    )
    return repair.repair_problems(df).select("p_partkey", "fixed_type", "fixed_materials", "fixed_duration", "type", "materials", "duration", "credits")


G_TITLE = By(1, ("My work", "Video installation", "Something else", "", "my WORK!"))
G_TYPE = By(2, ("Video", ""))
G_MATERIALS = By(3, ("", "ink", "see selected works"))
G_EN = By(5, ("", "Related projects: all", "It is.", "https://x.example/other"))
G_PAGE = By(7, ("Artwork", "artwork ", "exhibition", "other"))
G_SAID = By(11, ("", " said "))
G_BASE = By(13, ("My work", "", "Other thing"))
G_SURE = By(17, ("0.9", "0.5", "0.85"))


@query(f"""
WITH x AS (SELECT p_partkey, {G_TITLE.sql()} AS t, {G_TYPE.sql()} AS ty, {G_MATERIALS.sql()} AS m, {G_EN.sql()} AS en, {G_PAGE.sql()} AS pg, trim({G_SAID.sql()}) AS said, {G_SAID.sql()} AS said0, {G_BASE.sql()} AS b, {G_SURE.sql()}::DOUBLE AS c,
  p_partkey % 19 <> 0 AS work, p_partkey % 23 <> 0 AS there, p_partkey % 29 <> 0 AS ok FROM part),
y AS (SELECT *, CASE WHEN lower(trim(pg)) IN ('artwork', 'exhibition') THEN lower(trim(pg)) ELSE 'unknown' END AS kind, CASE WHEN said0 <> '' THEN said0 ELSE '' END AS told FROM x),
z AS (SELECT *, CASE WHEN NOT work THEN 'Local parser marked page as non-artwork' WHEN kind <> 'artwork' THEN CASE WHEN told <> '' THEN told ELSE 'AI classified page as ' || kind END
  WHEN NOT there THEN CASE WHEN told <> '' THEN told ELSE 'AI unavailable' END WHEN t = 'Video installation' THEN 'Title looks like an artwork type, not a title' WHEN t NOT IN ('My work', 'my WORK!') THEN 'Title does not match URL slug'
  WHEN b = 'Other thing' THEN 'AI title does not match the local parser title' WHEN contains(m, 'selected works') THEN 'Materials field looks contaminated by unrelated page content'
  WHEN contains(en, 'Related projects') OR contains(en, 'https') THEN 'English description looks contaminated by unrelated page content'
  WHEN ty = '' OR (m = '' AND en = '' AND p_partkey % 31 <> 0) THEN 'Artwork record is missing required fields' WHEN NOT ok THEN CASE WHEN told <> '' THEN told ELSE 'AI did not approve this record' END
  WHEN c < 0.85 THEN 'Confidence below threshold (0.50)' ELSE '' END AS reason FROM y)
SELECT p_partkey, CASE WHEN NOT work THEN 'exhibition' ELSE kind END AS page_type, reason = '' AS should_apply, reason FROM z
""")
def records_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate's ordered rules over many combinations of proposals and verdicts."""
    k = F.col("p_partkey")
    images = F.when(k % 31 == 0, F.array(F.lit("i"))).otherwise(F.array().cast("array<string>"))
    proposed = {"title": G_TITLE.column(), "type": G_TYPE.column(), "year": F.lit(""), "materials": G_MATERIALS.column(), "description_en": G_EN.column(), "description_cn": F.lit(""), "images": images}
    verdict = {"page_type": G_PAGE.column(), "should_apply": k % 29 != 0, "confidence": G_SURE.column().cast("double"), "reason": G_SAID.column()}
    gated = review.gate(F.lit("https://w.example/my-work"), G_BASE.column(), proposed, verdict, k % 19 != 0, k % 23 != 0)
    return table(spark, sf_dir, "part").select("p_partkey", gated.alias("x")).select("p_partkey", "x.*")
