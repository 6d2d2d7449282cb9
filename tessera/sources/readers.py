"""Tables from sitemaps, JSON, Markdown, CSV, caches and recorded provider answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions.predicates import is_work_link
from tessera.functions.text import blank, filled, strip, text
from tessera.operators.changes import last_version
from tessera.operators.sections import carried


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """url, lastmod of each <url>; the last of a repeated one. Strings stay strings: inference would make dates of them."""
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    rows = rows.select(strip("loc").alias("url"), strip("lastmod").alias("lastmod"), F.monotonically_increasing_id().alias("_at")).filter("url <> ''")
    return last_version(rows, "url", "_at")


def parse_sitemaps(df: DataFrame, xml: str = "xml") -> DataFrame:
    """As read_sitemap, from a column of documents."""
    urls = F.from_xml(xml, "url array<struct<loc: string, lastmod: string>>", {"rowTag": "urlset"})
    rows = df.select(F.posexplode(urls["url"]).alias("_at", "u")).select(strip("u.loc").alias("url"), strip("u.lastmod").alias("lastmod"), "_at")
    return last_version(rows.filter("url <> ''"), "url", "_at")


def read_works(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of works, in its order (_ordinal)."""
    return spark.read.schema(schemas.WORK).option("multiLine", True).json(path).withColumn("_ordinal", F.monotonically_increasing_id())


def empty_works(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.WORK).withColumn("_ordinal", F.lit(0).cast("long"))


def parse_markdown(df: DataFrame, line: str = "value", order: str = "line_no") -> DataFrame:
    """url, year, title, title_cn of '### [title](url) / title_cn' headings under '## year', a number of four digits or more, taken
    whole; the last of a repeated URL."""
    years = F.when(F.col(line).rlike(r"^##\s+\d{4}"), F.regexp_extract(line, r"^##\s+(\d{4,})", 1))
    heading = r"^###\s+\[(.*?)\]\((.*?)\)(?:\s*/\s*(.*))?$"
    marked = df.filter(F.col(line).startswith("##")).withColumn("_year", years)
    rows = carried(marked, "_year", order, "year").filter(F.col(line).rlike(heading))
    part = lambda i: strip(F.regexp_extract(line, heading, i))
    return last_version(rows.select(part(2).alias("url"), text("year").alias("year"), part(1).alias("title"), part(3).alias("title_cn"), F.col(order).alias("_at")), "url", "_at")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached records with a URL; unreadable files are left out."""
    return spark.read.option("ignoreCorruptFiles", True).parquet(path).filter(~blank("url"))


def parse_answers(df: DataFrame, json: str = "json") -> DataFrame:
    """url and the fields of a provider's answer: data.extract, data.json or data itself; unknown keys go, missing ones are blank."""
    fields = ", ".join(f"{f}: string" for f in (*schemas.TEXT_FIELDS[1:], "category"))
    record = f"struct<{fields}, images: array<string>>"
    parsed = F.from_json(json, f"success boolean, data struct<extract: {record}, json: {record}>", {"mode": "PERMISSIVE"})
    got = F.coalesce(parsed["data"]["extract"], parsed["data"]["json"])
    value = lambda f: text(got[f]).alias(f)
    names = [f for f in schemas.TEXT_FIELDS[1:] if f != "type"]
    kind = F.coalesce(filled(got["category"]), filled(got["type"]), F.lit("")).alias("type")
    return df.select("url", F.coalesce(parsed["success"], F.lit(False)).alias("success"), *[value(f) for f in names], kind, got["images"].alias("images"))


def scan_links(parsed: DataFrame, base: str) -> DataFrame:
    """url: distinct links of parsed pages that lead to works, sorted; those without a scheme are the base's."""
    link = F.explode("links")
    whole = lambda c: F.when(F.startswith(c, F.lit("http")), c).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(c, "^/+", "")))
    return parsed.select(link.alias("l")).select(whole(F.col("l")).alias("url")).filter(is_work_link("url", base)).distinct().orderBy("url")


def read_manifest(df: DataFrame, json: str = "json") -> DataFrame:
    """key, value of a JSON object's fields; anything else is an error."""
    checked = F.when(F.trim(json).startswith("{"), F.from_json(json, "map<string, string>"))
    return df.select(F.explode(F.coalesce(checked, F.raise_error(F.lit("a manifest must be a JSON object")).cast("map<string,string>"))).alias("key", "value"))


def links_of_map(df: DataFrame, json: str = "json") -> DataFrame:
    """Distinct links, sorted, of answers whose links are strings or objects with a url."""
    links = F.explode(F.coalesce(F.from_json(F.get_json_object(json, "$.links"), "array<string>"), F.array().cast("array<string>")))
    raw: Column = F.col("raw")
    return df.select(links.alias("raw")).select(F.coalesce(F.get_json_object(raw, "$.url"), raw).alias("url")).distinct().orderBy("url")


def zip_answers(urls: Column, results: Column) -> Column:
    """array<struct<url, result>>: results by position; missing ones are null."""
    return F.transform(urls, lambda u, i: F.struct(u.alias("url"), F.get(results, i).alias("result")))
