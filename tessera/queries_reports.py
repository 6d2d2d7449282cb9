"""Whole reports and loads that are composed of several rules, beside SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.queries_more import _HEAD, _NL, _W, _work
from tessera.queries_rules import Made, among, table
from tessera.sources import answers, reports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


# -- reports ---------------------------------------------------------------------------------------------------------


def _report_head(split: str, after: str) -> str:
    return f"""'# Artwork Extraction Report / 作品提取报告{split}' || {_NL} || {_NL} || '> **Extracted At / 提取时间:** 2024-01-01 00:00' || {_NL} || '> **Mode / 提取模式:** QUICK' || {_NL}
       || '> **Total / 作品数量:** ' || (SELECT count(*) FROM part) || {_NL} || {after}"""


_TABLE = " || ".join(
    f"CASE WHEN {c} <> '' THEN '| {n} | ' || {v} || ' |' || {_NL} ELSE '' END"
    for n, c, v in (("Year / 年份", "year", "year"), ("Type / 类型", "type", "type"), ("Video / 视频", "vid", "'[' || vid || '](' || vid || ')'"), ("Materials / 材料", "mat", "mat"), ("Size / 尺寸", "size", "size"), ("Duration / 时长", "dur", "dur"))
)
_ENTRY = f"""CASE WHEN k % 17 = 0 THEN '## ' || r || '. ❌ Extraction Failed / 提取失败: ' || title || {_NL} || {_NL} || '> **Error / 错误:** lost' || {_NL} || '> **URL / 链接:** [' || url || '](' || url || ')' || {_NL} || {_NL} || '---' || {_NL} || {_NL}
  ELSE '## ' || r || '. ' || {_HEAD} || {_TABLE} || {_NL}
  || CASE WHEN en <> '' OR zh <> '' THEN '### Description / 描述' || {_NL} || {_NL} ELSE '' END || CASE WHEN en <> '' THEN '**English:**' || {_NL} || {_NL} || en || {_NL} || {_NL} ELSE '' END
  || CASE WHEN zh <> '' THEN '**中文:**' || {_NL} || {_NL} || zh || {_NL} || {_NL} ELSE '' END || CASE WHEN shown IS NULL THEN '' ELSE '### Images / 图片' || {_NL} || {_NL} || shown END || '---' || {_NL} || {_NL} END"""


def _shown(split: bool) -> str:
    """CTEs up to i: works with their number r and the images' lines, whose files are numbered through or within each item."""
    number = "u.pos" if split else "n.r"
    return f"""w AS ({_W}), l AS (SELECT k, CASE WHEN len(hi) > 0 THEN hi ELSE im END AS xs FROM w), u AS (SELECT k, unnest(xs) AS src, generate_subscripts(xs, 1) AS pos FROM l),
f AS (SELECT src, min(k * 10 + pos) AS o FROM u GROUP BY src), n AS (SELECT src, row_number() OVER (ORDER BY o) AS r FROM f),
g AS (SELECT k, src, pos, './images/' || lpad({number}::VARCHAR, greatest(2, length({number}::VARCHAR))::INT, '0') || CASE WHEN src LIKE '%.png%' THEN '.png' ELSE '.jpg' END AS file FROM u JOIN n USING (src)),
s AS (SELECT k, string_agg('<a href="' || file || '" target="_blank"><img src="' || file || '" width="400"></a>' || {_NL} || {_NL}, '' ORDER BY pos) AS shown FROM g GROUP BY k),
i AS (SELECT *, row_number() OVER (ORDER BY k) AS r FROM w LEFT JOIN s USING (k))"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("_ordinal"), *[c.alias(f) for f, c in _work().items()])


_RULE = "chr(10) || '---' || chr(10) || chr(10)"


@query(f"WITH {_shown(False)} SELECT 0 AS place, {_report_head('', _RULE)} AS text UNION ALL SELECT r, {_ENTRY} FROM i")
def report_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole report of all items in one text, their images by file."""
    return reports.merged_report(_items(spark, sf_dir), F.lit("2024-01-01 00:00"), F.lit("quick"))


_SAFE = r"regexp_replace(title, '[^\\p{L}\\p{N}\\-_ ]', '_', 'g')[:50]".replace("\\\\", "\\")
_PATH = f"lpad(r::VARCHAR, greatest(2, length(r::VARCHAR))::INT, '0') || '_' || {_SAFE}"


@query(f"WITH {_shown(True)} SELECT {_PATH} || '/report.md' AS path, {_ENTRY} AS text FROM i")
def report_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each item, in a folder of its own."""
    return reports.split_report(_items(spark, sf_dir), F.lit("2024-01-01 00:00"), F.lit("quick"))[0]


_CONTENTS = "chr(10) || '## Contents / 目录' || chr(10) || chr(10)"


@query(f"WITH {_shown(True)} SELECT 0 AS place, {_report_head(' (Split Mode)', _CONTENTS)} AS text UNION ALL SELECT r, r || '. [' || title || '](./' || {_PATH} || '/report.md)' || chr(10) FROM i")
def report_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index beside them."""
    return reports.split_report(_items(spark, sf_dir), F.lit("2024-01-01 00:00"), F.lit("quick"))[1]


# -- answers ---------------------------------------------------------------------------------------------------------

# Fields of answers by the key's digits.
TITLE = Made("p_partkey", ("A work", " Null ", "One / 一 / more", "", "N/A"))
TITLE_CN = Made("p_partkey // 5", ("", "作品", "unknown"))
KIND = Made("p_partkey // 15", ("Video", "none", "Exhibition", ""))
CATEGORY = Made("p_partkey // 60", ("", "Group Exhibition", "Print"))
YEAR = Made("p_partkey // 180", ("2019", "from 2001 to 2003", "", "Not Specified", "long ago"))
FORM = Made("p_partkey // 900", ("json", "none", "broken"))
_X = f"x AS (SELECT p_partkey AS k, {TITLE.sql()} AS title, {TITLE_CN.sql()} AS cn, {KIND.sql()} AS kind, {CATEGORY.sql()} AS category, {YEAR.sql()} AS year, {FORM.sql()} AS form FROM part)"
_YEAR = "CASE WHEN len(ys) = 0 THEN {0} WHEN len(ys) = 1 THEN ys[1] ELSE list_min(ys) || '-' || list_max(ys) END"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {"title": TITLE, "title_cn": TITLE_CN, "type": KIND, "category": CATEGORY, "year": YEAR}
    part = table(spark, sf_dir, "part").withColumns({f"p_partkey // {n}": F.floor(F.col("p_partkey") / n) for n in (5, 15, 60, 180, 900)})
    fields = part.select(F.col("p_partkey").cast("string").alias("url"), F.struct(*[m.column().alias(f) for f, m in made.items()]).alias("json"), FORM.column().alias("form"))
    body = F.when(F.col("form") == "json", F.to_json(F.struct(F.struct("json").alias("data")))).when(F.col("form") == "none", F.lit('{"data": {}}')).otherwise(F.lit("{broken"))
    return fields.select("url", body.alias("json"))


def _cleared(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) IN {among((*fixed.PLACEHOLDERS, ''))} THEN '' ELSE {c} END"


@query(f"""
WITH {_X}, c AS (SELECT k, {_cleared("title")} AS title, {_cleared("cn")} AS cn, {_cleared("kind")} AS kind, {_cleared("year")} AS year, regexp_extract_all(year, '(?:19|20)\\d{{2}}') AS ys FROM x WHERE form = 'json')
SELECT k::VARCHAR AS url, title, cn AS title_cn, kind AS type, CASE WHEN year = '' THEN '' ELSE {_YEAR.format("year")} END AS year, 'scrape_json' AS source FROM c
""")
def answers_scraped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of scraped answers, without placeholders."""
    return answers.scraped(_answers(spark, sf_dir)).select("url", "title", "title_cn", "type", "year", "source")


@query(f"""
WITH {_X}, c AS (
  SELECT k, CASE WHEN cn = '' AND contains(title, '/') THEN trim(split_part(title, '/', 1)) ELSE title END AS title, CASE WHEN cn = '' AND contains(title, '/') THEN trim(split_part(title, '/', 2)) ELSE cn END AS cn,
         CASE WHEN category <> '' THEN category ELSE kind END AS kind, year, regexp_extract_all(year, '(?:19|20)\\d{{2}}') AS ys FROM x WHERE form = 'json')
SELECT k::VARCHAR AS url, title, cn AS title_cn, kind AS type, CASE WHEN year = '' THEN '' ELSE {_YEAR.format("year")} END AS year, NOT lower(trim(kind)) IN {among(fixed.EXCLUDED_TYPES)} AS is_work FROM c
""")
def answers_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of described answers, exhibitions marked: they are cached but not returned."""
    return answers.described(_answers(spark, sf_dir)).select("url", "title", "title_cn", "type", "year", "is_work")


_JOB = """
j AS (SELECT p_partkey AS k, p_partkey % 2 = 0 AS cached, CASE WHEN p_partkey % 11 = 0 THEN 500 ELSE 200 END AS code, p_partkey % 7 <> 0 AS success, (p_partkey // 3) % 4 AS status, (p_partkey // 5) % 3 AS shape, p_name FROM part)"""


@query(f"""
WITH {_JOB},
r AS (
  SELECT k::VARCHAR AS url, CASE WHEN code <> 200 THEN '[Error: Submit Failed]' WHEN NOT success THEN '[Error: API Failed]' WHEN status = 0 AND shape = 2 THEN '[Error: Empty Content]' WHEN status = 0 THEN p_name
              WHEN status = 1 THEN '[Error: Job Failed]' ELSE '[Error: Timeout]' END AS title,
         CASE WHEN code <> 200 THEN 'HTTP ' || code WHEN NOT success THEN '{{"success":false}}' WHEN status = 0 AND shape = 2 THEN 'Extraction returned empty data' WHEN status = 0 THEN '' WHEN status = 1 THEN 'Extraction job failed' ELSE 'Extraction timeout' END AS error
  FROM j WHERE NOT cached)
SELECT url, title, error, false AS from_cache, error = '' AS to_cache FROM r UNION ALL SELECT k::VARCHAR, 'cached ' || p_name, '', true, false FROM j WHERE cached
""")
def answers_searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for all parts: those in the cache, and jobs' answers, failed ones too."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    wanted = part.select(k.cast("string").alias("url"), k.alias("place"))
    cache = part.filter(k % 2 == 0).select(k.cast("string").alias("url"), F.concat(F.lit("cached "), F.col("p_name")).alias("title"))
    status, shape = F.floor(k / 3) % 4, F.floor(k / 5) % 3
    item = F.to_json(F.struct(F.col("p_name").alias("title")))
    data = F.when(shape == 0, item).when(shape == 1, F.concat(F.lit("["), item, F.lit(', {"title": "second"}]'))).otherwise("[]")
    done = F.when(status == 0, F.concat(F.lit('{"status": "completed", "data": '), data, F.lit("}"))).when(status == 1, '{"status": "failed"}').when(status == 2, '{"status": "processing"}')
    jobs = part.select(k.cast("string").alias("url"), F.when(k % 11 == 0, 500).otherwise(200).alias("code"), F.when(k % 7 == 0, '{"success":false}').otherwise('{"success":true,"id":"x"}').alias("submitted"), done.alias("status"))
    return answers.searched(wanted, cache, jobs, "place").select("url", "title", "error", "from_cache", "to_cache")


# -- stored works ------------------------------------------------------------------------------------------------------


@query(f"""
SELECT p_partkey::VARCHAR AS url, p_name AS title, CASE p_partkey % 4 WHEN 0 THEN 'Exhibition' WHEN 1 THEN ' catalog ' WHEN 2 THEN p_type ELSE '' END AS type FROM part
WHERE p_partkey % 9 <> 0 AND lower(trim(CASE p_partkey % 4 WHEN 0 THEN 'Exhibition' WHEN 1 THEN ' catalog ' WHEN 2 THEN p_type ELSE '' END)) NOT IN {among(fixed.EXCLUDED_TYPES)}
""")
def works_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works of stored JSON without exhibitions; what is no object is left out."""
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 0, "Exhibition").when(k % 4 == 1, " catalog ").when(k % 4 == 2, F.col("p_type")).otherwise("")
    stored = F.when(k % 9 == 0, '["no work"]').otherwise(F.to_json(F.struct(k.cast("string").alias("url"), F.col("p_name").alias("title"), kind.alias("type"), F.lit("x").alias("other"))))
    return answers.stored_works(table(spark, sf_dir, "part").select(stored.alias("json"))).select("url", "title", "type")


@query("""
SELECT p_partkey::VARCHAR AS url, p_name AS title FROM part WHERE p_partkey % 5 NOT IN (1, 2) AND p_partkey % 7 <> 0
""")
def works_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a cache's entries: not those of extractions and discoveries, nor any without a URL."""
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 5 == 1, "extract_").when(k % 5 == 2, "discovery_").otherwise(""), F.md5(k.cast("string")), F.lit(".pkl"))
    return answers.cached_works(table(spark, sf_dir, "part").select(name.alias("entry"), F.when(k % 7 != 0, k.cast("string")).alias("url"), F.col("p_name").alias("title"))).select("url", "title")
