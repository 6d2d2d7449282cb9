"""Imports into batches, reports, and the last readers, each beside the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.functions import predicates as P
from tessera.functions.text import text
from tessera.operators import changes, dedup, importing, repair, review
from tessera.queries_fields import CRED, MAT, TYP, By, patterns_sql
from tessera.queries_rules import Made, quoted, table, words_sql
from tessera.sources import readers, sinks
from tessera.sources.html import parse_pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


# -- imports and batches ----------------------------------------------------------------------------------------------------


@query("""
SELECT p_partkey, 'least' AS how FROM part WHERE (p_partkey % 2 = 0)::INT + (p_partkey % 3 = 0)::INT + (p_partkey % 5 = 0)::INT + 1 >= 2
UNION ALL SELECT p_partkey, 'first' FROM (SELECT p_partkey FROM part ORDER BY 1 LIMIT 10) x
""")
def update_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works that lack two or more fields; and the first ten of all (the limit is the feature)."""
    k = F.col("p_partkey")
    w = table(spark, sf_dir, "part").select(
        k, k.alias("_ordinal"), *[F.when(k % n == 0, "").otherwise("x").alias(f) for n, f in ((2, "size"), (3, "duration"), (5, "materials"), (1, "description_en"))], F.lit("c").alias("credits")
    )
    some = importing.update_candidates(w).select("p_partkey").withColumn("how", F.lit("least"))
    return some.unionByName(importing.update_candidates(w, everything=True, limit=10).select("p_partkey").withColumn("how", F.lit("first")))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P'")
def visible_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "rejected").otherwise(F.col("o_orderstatus"))
    return importing.visible_records(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"))).select("id")


@query("""
SELECT o_orderkey AS id, o_orderkey % 2 = 1 AS is_update, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS title, CASE WHEN o_orderkey % 3 = 1 THEN '2001' ELSE '' END AS year,
       CASE o_orderkey % 3 WHEN 1 THEN 2 ELSE 0 END AS n_images FROM orders
""")
def record_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of records' proposals, from JSON of several shapes."""
    k = F.col("o_orderkey")
    json = (
        F.when(k % 3 == 1, F.concat(F.lit('{"title": " '), F.col("o_orderpriority"), F.lit(' ", "year": 2001, "images": ["a", "b"], "other": {}}')))
        .when(k % 3 == 2, F.concat(F.lit('{"title": "'), F.col("o_orderpriority"), F.lit('", "year": null, "images": "none"}')))
    )
    rec = table(spark, sf_dir, "orders").select(k.alias("id"), (k % 2).cast("int").alias("is_update"), json.alias("proposed_record_json"), F.lit("").alias("error_message"))
    return importing.record_rows(rec).select("id", "is_update", "title", "year", F.size("images").alias("n_images"))


@query("""
SELECT c_custkey AS id, CASE WHEN o_custkey IS NULL THEN 'draft' WHEN n > 15 THEN 'completed' ELSE 'draft' END AS status, coalesce(n, 0) AS total_records, CASE WHEN o_custkey IS NULL THEN 't0' ELSE 't1' END AS updated_at
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey
""")
def batches_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New batches, some with new values; nulls leave what was."""
    batches = importing.new_batches(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), F.lit("manual"), F.lit("t0"))
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("total_records")).withColumn("status", F.when(F.col("total_records") > 15, "completed"))
    return importing.touch_batches(batches, n, F.lit("t1")).select("id", "status", "total_records", "updated_at")


@query("""
SELECT page_id AS batch_id, regexp_extract(rtrim(url, '/'), '[^/]*$') AS slug, CASE WHEN page_id % 4 = 0 THEN 'failed' WHEN page_id % 4 = 1 THEN 'ready_for_review' ELSE 'needs_review' END AS status,
       (page_id % 3 = 0)::INT AS is_update, CASE WHEN page_id % 2 = 0 THEN '{"title":"t' || page_id || '"}' END AS proposed_record_json, CASE WHEN page_id % 4 = 0 THEN 'broken' ELSE '' END AS error_message FROM pages
""")
def records_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of imported pages."""
    k = F.col("page_id")
    proposed = F.when(k % 2 == 0, F.struct(F.concat(F.lit("t"), k.cast("string")).alias("title")))
    done = table(spark, sf_dir, "pages").select(
        k.alias("batch_id"), "url", F.lit("artwork").alias("page_type"), F.lit(0.9).alias("confidence"), F.when(k % 4 != 2, k % 4 == 1).alias("should_apply"), (k % 3 == 0).alias("is_update"), proposed.alias("proposed"),
        F.when(k % 4 == 0, "broken").otherwise("").alias("error"),
    )
    return importing.new_records(done, F.lit("now")).select("batch_id", "slug", "status", "is_update", "proposed_record_json", "error_message")


@query("""
WITH x AS (SELECT p_partkey AS k, p_partkey % 6 AS m FROM part)
SELECT 'https://w.example/my-work-' || k AS url, CASE WHEN m = 3 THEN 'exhibition' WHEN m IN (1, 4) THEN 'unknown' ELSE 'artwork' END AS page_type, CASE WHEN m = 1 THEN 0.0 WHEN m = 5 THEN 0.5 ELSE 0.95 END::DOUBLE AS confidence,
       m IN (0, 2) AS should_apply, CASE m WHEN 0 THEN 'My own work ' || k ELSE 'My  Work ' || k END AS title, CASE WHEN m IN (1, 2) THEN '2001' ELSE '2001-2003' END AS year,
       CASE WHEN m = 2 THEN 'macos_local' ELSE 'hybrid_layer2' END AS source,
       CASE m WHEN 1 THEN 'AI classified page as unknown' WHEN 3 THEN 'Local parser marked page as non-artwork' WHEN 4 THEN 'no idea' WHEN 5 THEN 'Confidence below threshold (0.50)' ELSE '' END AS reason
FROM x
""")
def pages_imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a provider's and a reviewer's answers, or without, through the gate to proposals."""
    k = F.col("p_partkey")
    m = k % 6
    title = F.concat(F.lit("My  Work "), k.cast("string"))
    fields = dict.fromkeys(importing.TEXTS, F.lit("")) | {"title": title, "type": F.when(m == 3, "Exhibition").otherwise("Video"), "year": F.lit("2001")}
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("https://w.example/my-work-"), k.cast("string")).alias("url"))
    base = p.select("url", *[c.alias(f) for f, c in fields.items()])
    images = [F.array().cast("array<string>").alias(f) for f in importing.IMAGES]
    more = fields | {"year": F.lit("from 2001 to 2003")}
    hybrid = p.filter(m != 2).select("url", *[c.alias(f) for f, c in more.items()], *images, F.lit(" hybrid_layer2 ").alias("source"))
    # A difference of white space alone keeps the old title; the first of six gets another.
    said = dict.fromkeys(importing.TEXTS, F.lit("")) | {"title": F.concat(F.when(m == 0, "My own work ").otherwise("My Work "), k.cast("string"))}
    verdicts = p.filter(m != 1).select(
        "url", F.when(m == 4, "other").otherwise("Artwork").alias("page_type"), F.when(m == 5, 0.5).otherwise(0.95).alias("confidence"), F.lit(True).alias("should_apply"),
        F.when(m == 4, "no idea").otherwise("").alias("reason"), F.lit("").alias("error"), *[c.alias(f) for f, c in said.items()],
    )
    out = importing.import_pages(base, hybrid, verdicts)
    return out.select("url", "page_type", "confidence", "should_apply", F.col("proposed.title").alias("title"), F.col("proposed.year").alias("year"), F.col("proposed.source").alias("source"), "reason")


@query("""
WITH e AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0), a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS accepted_count, (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM e)) AS new_count,
       (SELECT count(*) FROM a WHERE k IN (SELECT k FROM e)) AS updated_count, true AS will_push, '' AS error_message
""")
def apply_previewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    accepted = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("name"))
    return importing.apply_preview(existing, accepted, "k", ["name"], F.lit(True))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderstatus = 'F' THEN 'writing_workspace,failed' ELSE 'writing_workspace,ready_to_apply' END
  WHEN o_orderstatus = 'F' THEN 'writing_workspace,failed' WHEN o_orderstatus = 'P' THEN 'writing_workspace,syncing_repo,syncing_git,failed' ELSE 'writing_workspace,syncing_repo,syncing_git,completed' END AS states,
  CASE WHEN o_orderkey % 5 <> 0 AND (o_orderstatus = 'F' OR (o_orderstatus = 'P' AND o_orderkey % 3 <> 0)) THEN 'bad' ELSE '' END AS last_error
FROM orders
""")
def apply_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states that applied batches go through: nothing accepted, dry runs, failures on the way."""
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    failed = F.when(s == "F", "writing_workspace").when(s == "P", "syncing_git")
    x = importing.apply_states(F.when(k % 5 == 0, 0).otherwise(3), k % 3 == 0, failed, F.lit("bad"))
    return table(spark, sf_dir, "orders").select(k, x.alias("x")).select("o_orderkey", F.array_join("x.states", ",").alias("states"), "x.last_error")


@query("SELECT count(*) FILTER (l_orderkey IS NOT NULL) AS cached_count, count(*) FILTER (l_orderkey IS NULL) AS new_count FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 4) l ON l_orderkey = o_orderkey")
def import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = table(spark, sf_dir, "lineitem").filter("l_linenumber = 4").select(F.col("l_orderkey").alias("k"))
    return importing.import_counts(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), cache, ["k"])


@query("SELECT count(*) AS batches, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS records FROM (SELECT 1 FROM orders WHERE o_orderstatus = 'O') b")
def terminal_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that are over go, with their records."""
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "completed").otherwise("reviewing")
    batches = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"))
    left, kept = review.prune_terminal(batches, batches.select("id", F.col("id").alias("batch_id")))
    return left.agg(F.count("*").alias("batches")).crossJoin(kept.agg(F.count("*").alias("records")))  # one row each


# -- repairs ------------------------------------------------------------------------------------------------------------------

HALVES = Made("p_partkey", ("land", "icon", "空"), (" / ", "/", ""), ("land 005", "图标", "icon", "land", "x"))
CN = Made("p_partkey // 7", ("", "图标", "y", "图标 / 图标", "大图标"))


@query(f"""
WITH x AS (SELECT p_partkey, {HALVES.sql()} AS t, ['', '图标', 'y', '图标 / 图标', '大图标'][((p_partkey // 7) % 5 + 1)::INT] AS cn FROM part),
y AS (SELECT *, trim(split_part(t, '/', 1)) AS l, trim(string_split(t, '/')[-1]) AS r, contains(t, '/') AS slashed FROM x),
z AS (SELECT *, regexp_matches(l, '[一-鿿]') AS lc, regexp_matches(r, '[一-鿿]') AS rc FROM y)
SELECT p_partkey, CASE WHEN NOT slashed THEN t WHEN NOT lc AND rc AND (cn IN (t, r, '') OR contains(cn, r) OR contains(r, cn)) THEN l WHEN l = r THEN t WHEN NOT lc AND NOT rc AND contains(lower(r), lower(l)) THEN l ELSE t END AS title,
       CASE WHEN NOT slashed THEN cn WHEN NOT lc AND rc AND (cn IN (t, r, '') OR contains(cn, r) OR contains(r, cn)) THEN r WHEN l = r THEN cn WHEN cn = '图标 / 图标' THEN '图标' ELSE cn END AS title_cn FROM z
""")
def titles_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of two halves, by the rule of the repair, which leaves two equal halves alone."""
    cn = F.get(F.array(*[F.lit(v) for v in CN.lists[0]]), (F.floor(F.col("p_partkey") / 7) % 5).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", repair.split_title(HALVES.column(), cn).alias("x")).select("p_partkey", "x.*")


@query(f"""
WITH x AS (SELECT {MAT.sql()} AS m, {TYP.sql()} AS t, {CRED.sql()} AS c, CASE WHEN p_partkey % 3 = 0 THEN 'big' ELSE '' END AS s FROM part),
y AS (SELECT *, {patterns_sql("trim(lower(m))", fixed.REPAIR_CREDIT_PATTERNS)} AS mc, {patterns_sql("trim(lower(t))", fixed.REPAIR_CREDIT_PATTERNS)} AS tc FROM x),
z AS (SELECT *, CASE WHEN mc AND c = '' THEN m ELSE c END AS c1, CASE WHEN mc THEN '' ELSE m END AS m1 FROM y),
w AS (
  SELECT unnest([CASE WHEN mc AND c = '' THEN 'materials_to_credits' END, CASE WHEN tc AND c1 = '' THEN 'type_to_credits' END, CASE WHEN starts_with(t, 'http') THEN 'type_url' END,
                 CASE WHEN length(t) > 100 THEN 'type_long' END, CASE WHEN starts_with(lower(m1), 'dimension') AND s = '' THEN 'materials_to_size' END]) AS change FROM z)
SELECT change, count(*) AS n FROM w WHERE change IS NOT NULL GROUP BY change
""")
def repairs_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many rows each repair was made."""
    size = F.when(F.col("p_partkey") % 3 == 0, "big").otherwise("")
    df = table(spark, sf_dir, "part").select(MAT.column().alias("materials"), TYP.column().alias("type"), CRED.column().alias("credits"), size.alias("size"))
    return repair.changes_counted(repair.repair_credits(df))


SPLIT = By(
    1, ("", "6′00″ ", "4'30'' ", "Photo: Ann ", "http://x.example/", "cloud.data: ", "note: "), ("video", "installation", "print by Some Artist", "variable size print", "sound / 声音"),
    ("", ", 12 minutes", ",45 Seconds loop, silent", " and so on until it has more than the eighty characters that a type can have at most"), ("", " 76cm × 30cm", ", 3 x 4 x 5 mm,/", " 30X40/"),
)
_Q, _MIN, _SZ = "[''‘’′\"]", fixed.TYPE_MINUTES, fixed.TYPE_SIZE
_OWN = f"^\\d+{_Q}{{1,2}}\\d*{_Q}*"


@query(rf"""
WITH x AS (SELECT p_partkey, {SPLIT.sql()} AS t FROM part), y AS (SELECT *, lower(t) AS low FROM x),
n AS (
  SELECT *, t = '' OR regexp_matches(low, '^(?:photo(?:\s+by)?:|concept:|sound:|software:|copyright|made possible)') OR starts_with(t, 'http')
         OR length(t) > CASE WHEN regexp_matches(t, '[/／]') AND regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '[一-鿿]') THEN 150 ELSE 80 END
         OR {words_sql("low", fixed.SIZE_MARKS)} OR contains(low, 'some artist')
         OR (contains(t, ':') AND NOT regexp_matches(low, '^[a-z]+:') AND length(trim(substr(t, position(':' IN t) + 1))) > 30) AS none FROM y),
d AS (
  SELECT *, CASE WHEN regexp_matches(t, '{_OWN}') THEN regexp_extract(t, '{_OWN}') WHEN regexp_matches(t, '{_MIN}', 'i') THEN trim(regexp_extract(t, '(?i){_MIN}')) ELSE '' END AS duration,
         CASE WHEN regexp_matches(t, '{_OWN}') THEN ltrim(trim(regexp_replace(t, '{_OWN}', '')), '''‘’′"″“” ')
           WHEN regexp_matches(t, '{_MIN}', 'i') THEN rtrim(trim(regexp_replace(t, ',?\s*{_MIN}', '', 'gi')), ',') ELSE t END AS r FROM n)
SELECT p_partkey, CASE WHEN none THEN '' WHEN regexp_matches(r, '{_SZ}') THEN regexp_replace(trim(regexp_replace(r, '\s*{_SZ}', '', 'g')), ',+$|/+$', '', 'g') ELSE r END AS type,
       CASE WHEN none THEN '' ELSE duration END AS duration, CASE WHEN none THEN '' ELSE trim(regexp_extract(r, '{_SZ}')) END AS size
FROM d
""")
def types_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types without the durations and sizes embedded in them; blank where the text is no type."""
    return table(spark, sf_dir, "part").select("p_partkey", repair.split_type(SPLIT.column(), ("Some Artist",)).alias("x")).select("p_partkey", "x.*")


# -- reports ---------------------------------------------------------------------------------------------------------------------


def _work() -> dict[str, Column]:
    k = F.col("p_partkey")
    some = lambda n, c: F.when(k % n == 0, c).otherwise("")
    images = lambda n, *xs: F.when(k % n == 0, F.array(*[F.concat(F.lit("http://i.example/"), x) for x in xs])).otherwise(F.array().cast("array<string>"))
    return {
        "title": F.col("p_name"), "title_cn": F.when(k % 2 == 0, "题").when(k % 3 == 0, F.col("p_name")).otherwise(""), "year": some(3, F.lit("2001")), "type": some(2, F.col("p_type")), "materials": some(5, F.lit("ink")),
        "size": some(7, F.lit("1 x 2 cm")), "duration": some(11, F.lit("3 min")), "video_link": some(13, F.lit("http://v.example")), "url": F.concat(F.lit("http://w.example/"), k.cast("string")),
        "description_en": some(2, F.lit("It is.")), "description_cn": some(3, F.lit("有")), "error": some(17, F.lit("lost")), "images": images(2, k.cast("string"), F.lit("b.png?x=1")), "high_res_images": images(4, F.lit("hi.jpg")),
    }


_W = """
SELECT p_partkey AS k, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN '题' WHEN p_partkey % 3 = 0 THEN p_name ELSE '' END AS cn, CASE WHEN p_partkey % 3 = 0 THEN '2001' ELSE '' END AS year,
  CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS type, CASE WHEN p_partkey % 5 = 0 THEN 'ink' ELSE '' END AS mat, CASE WHEN p_partkey % 7 = 0 THEN '1 x 2 cm' ELSE '' END AS size,
  CASE WHEN p_partkey % 11 = 0 THEN '3 min' ELSE '' END AS dur, CASE WHEN p_partkey % 13 = 0 THEN 'http://v.example' ELSE '' END AS vid, 'http://w.example/' || p_partkey AS url,
  CASE WHEN p_partkey % 2 = 0 THEN 'It is.' ELSE '' END AS en, CASE WHEN p_partkey % 3 = 0 THEN '有' ELSE '' END AS zh,
  CASE WHEN p_partkey % 2 = 0 THEN ['http://i.example/' || p_partkey, 'http://i.example/b.png?x=1'] ELSE [] END AS im, CASE WHEN p_partkey % 4 = 0 THEN ['http://i.example/hi.jpg'] ELSE [] END AS hi FROM part
"""
_NL = "chr(10)"
_HEAD = "title || CASE WHEN cn <> '' AND cn <> title THEN ' / ' || cn ELSE '' END || chr(10) || chr(10)"


def _img(list_: str, head: str) -> str:
    return f"""CASE WHEN len({list_}) > 0 THEN '{head}' || {_NL} || {_NL} || array_to_string(list_transform({list_}, lambda u: '<a href="' || u || '" target="_blank"><img src="' || u || '" width="400"></a>' || {_NL} || {_NL}), '') ELSE '' END"""


@query(f"""
WITH w AS ({_W})
SELECT k AS p_partkey, CASE WHEN k % 17 = 0 THEN '## ' || k || '. ❌ Extraction Failed / 提取失败: ' || title || {_NL} || {_NL} || '> **Error / 错误:** lost' || {_NL} || '> **URL / 链接:** [' || url || '](' || url || ')' || {_NL} || {_NL} || '---' || {_NL} || {_NL}
  ELSE '## ' || k || '. ' || {_HEAD} || CASE WHEN year <> '' THEN '| Year / 年份 | ' || year || ' |' || {_NL} ELSE '' END || CASE WHEN type <> '' THEN '| Type / 类型 | ' || type || ' |' || {_NL} ELSE '' END
  || CASE WHEN vid <> '' THEN '| Video / 视频 | [' || vid || '](' || vid || ') |' || {_NL} ELSE '' END || CASE WHEN mat <> '' THEN '| Materials / 材料 | ink |' || {_NL} ELSE '' END
  || CASE WHEN size <> '' THEN '| Size / 尺寸 | ' || size || ' |' || {_NL} ELSE '' END || CASE WHEN dur <> '' THEN '| Duration / 时长 | ' || dur || ' |' || {_NL} ELSE '' END || {_NL}
  || CASE WHEN en <> '' OR zh <> '' THEN '### Description / 描述' || {_NL} || {_NL} ELSE '' END || CASE WHEN en <> '' THEN '**English:**' || {_NL} || {_NL} || en || {_NL} || {_NL} ELSE '' END
  || CASE WHEN zh <> '' THEN '**中文:**' || {_NL} || {_NL} || zh || {_NL} || {_NL} ELSE '' END || {_img("(CASE WHEN len(hi) > 0 THEN hi ELSE im END)", "### Images / 图片")} || '---' || {_NL} || {_NL} END AS text FROM w
""")
def report_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of an extraction report."""
    return table(spark, sf_dir, "part").select("p_partkey", sinks.report_item(_work(), F.col("p_partkey")).alias("text"))


@query(f"""
WITH w AS ({_W}), l AS (SELECT k, CASE WHEN len(hi) > 0 THEN hi ELSE im END AS xs FROM w), u AS (SELECT k, unnest(xs) AS url, generate_subscripts(xs, 1) AS pos FROM l),
f AS (SELECT url, min(k * 10 + pos) AS o FROM u GROUP BY url), n AS (SELECT url, o, row_number() OVER (ORDER BY o) AS r FROM f)
SELECT o // 10 AS item, url, 'images/' || lpad(r::VARCHAR, greatest(2, length(r::VARCHAR))::INT, '0') || CASE WHEN url LIKE '%.png%' THEN '.png' ELSE '.jpg' END AS file FROM n
""")
def report_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a report's images: each address once, numbered through."""
    w = _work()
    return sinks.image_files(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("_ordinal"), w["images"].alias("images"), w["high_res_images"].alias("high_res_images")))


@query(f"""
WITH w AS ({_W})
SELECT k AS p_partkey, '## ' || {_HEAD} || {" || ".join(f"CASE WHEN {c} <> '' THEN '**{n}**: ' || {c} || {_NL} || {_NL} ELSE '' END" for n, c in (("Year", "year"), ("Type", "type"), ("Materials", "mat"), ("Size", "size"), ("Duration", "dur"), ("Video", "vid"), ("URL", "url"), ("中文描述", "zh"), ("Description", "en")))}
  || {_img("(CASE WHEN len(im) > 0 THEN im ELSE hi END)", "### 图片")} || '---' || {_NL} || {_NL} AS text FROM w
""")
def rich_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", sinks.rich_markdown(_work()).alias("text"))


@query(f"""
WITH w AS ({_W})
SELECT CASE WHEN year = '' THEN '0000' ELSE year END AS sort_key, k AS _ordinal, '## ' || year || ' - ' || title || CASE WHEN cn <> '' THEN ' / ' || cn ELSE '' END || {_NL} || {_NL} || '**URL**: [' || url || '](' || url || ')' || {_NL} || {_NL}
  || CASE WHEN type <> '' THEN '**Type**: ' || type || {_NL} || {_NL} ELSE '' END || CASE WHEN zh <> '' THEN '> ' || zh || {_NL} || {_NL} ELSE '' END || CASE WHEN en <> '' THEN en || {_NL} || {_NL} ELSE '' END
  || CASE WHEN len(im) > 0 THEN '### Images' || {_NL} || {_NL} || array_to_string(list_transform(im, lambda u: '![](' || u || ')' || {_NL} || {_NL}), '') ELSE '' END || '---' || {_NL} AS text FROM w
""")
def web_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.web_images_report(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("_ordinal"), *[c.alias(f) for f, c in _work().items()]))


# -- readers ---------------------------------------------------------------------------------------------------------------------


@query(r"""
WITH l AS (SELECT unnest(regexp_extract_all(html, '<a href="([^"]+)"', 1)) AS l FROM pages), u AS (SELECT DISTINCT CASE WHEN starts_with(l, 'http') THEN l ELSE 'https://w.example/' || ltrim(l, '/') END AS url FROM l),
p AS (SELECT url, replace(url, 'https://w.example', '') AS path FROM u WHERE starts_with(url, 'https://w.example'))
SELECT url FROM p WHERE path NOT IN ('', '/') AND NOT contains(path, '/tag/')
  AND NOT (length(path) < 20 AND (path IN ('/rss', '/feed', '/filter', '/contact', '/cv', '/about', '/index', '/sitemap') OR regexp_matches(path, '^/(rss|feed|filter|contact|cv|about|index|sitemap)/')))
""")
def links_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all pages that lead to works."""
    return readers.scan_links(parse_pages(table(spark, sf_dir, "pages").select("url", "html")), "https://w.example")


@query("SELECT c_mktsegment || c_custkey AS key, c_nationkey::VARCHAR AS value FROM customer UNION ALL SELECT 'n' || c_custkey, c_name FROM customer")
def manifest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey").cast("string")
    json = F.concat(F.lit('{"'), F.col("c_mktsegment"), k, F.lit('": '), F.col("c_nationkey").cast("string"), F.lit(', "n'), k, F.lit('": "'), F.col("c_name"), F.lit('"}'))
    return readers.read_manifest(c.select(json.alias("json")))


@query("""
WITH x AS (SELECT p_partkey, trim(p_type) AS t FROM part WHERE p_partkey % 7 <> 0)
SELECT DISTINCT t AS value FROM x
""")
def values_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct filled values."""
    df = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.concat(F.lit(" "), F.col("p_type"))).alias("value"))
    return dedup.keep_first(df.select(F.trim(text("value")).alias("value")), "value", ["value"])


@query("SELECT md5(url) || '_' || left(md5('p' || page_id % 3), 8) AS key, page_id FROM pages")
def prompt_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache keys of URLs and prompts."""
    prompt = F.concat(F.lit("p"), (F.col("page_id") % 3).cast("string"))
    return table(spark, sf_dir, "pages").select(changes.cache_key(F.col("url"), prompt).alias("key"), "page_id")


MISPLACED = Made("p_partkey", ("Land", "land 005", "ink, Land", "Land / 土地", " LAND ", "", "土地", " "), ("", "!", ", wood"))
DATED = Made("p_partkey // 24", ("21.02.2014", "3 May", "1.2.2014", "12'30''", "Decembers", "4 min", ""), (" - ", "–", " "), ("15.03.2014", "on", "2015"))
LINKED = Made("p_partkey // 7", ("https://", "http://www.", "HTTPS://"), ("vimeo.com/", "youtu.be/", "w.example/vimeo.com?", "youtube.com", "bilibili.com/video/", "example.org/"), ("1", ""))


@query(rf"""
WITH x AS (SELECT p_partkey, {MISPLACED.sql()} AS m, 'Land' AS title, CASE WHEN p_partkey % 5 = 0 THEN '土地' ELSE '' END AS cn, {DATED.sql()} AS d, {LINKED.sql()} AS l FROM part)
SELECT p_partkey, m <> '' AND (lower(trim(m)) = lower(title) OR (cn <> '' AND lower(trim(m)) = cn)) AS is_title,
       d <> '' AND (regexp_matches(d, '(?:{fixed.MONTHS})', 'i') OR regexp_matches(d, '^\d{{1,2}}\.\d{{2}}\.\d{{4}}\s*[-–]\s*\d{{1,2}}\.\d{{2}}\.\d{{4}}')) AS is_dated, {words_sql('l', fixed.VIDEO_DOMAINS)} AS is_video FROM x
""")
def values_misplaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materials that are a title, durations that are dates, links that are videos."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part").withColumns({f"p_partkey // {n}": F.floor(k / n) for n in (7, 24)})
    cn = F.when(k % 5 == 0, "土地").otherwise("")
    return part.select(k, P.is_title_as_materials(MISPLACED.column(), F.lit("Land"), cn).alias("is_title"), P.is_date_as_duration(DATED.column()).alias("is_dated"), P.is_video_link(LINKED.column()).alias("is_video"))
