"""Answers of providers in their several envelopes, and stored works, as tables of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import fixed
from tessera.functions.normalize import normalize_year
from tessera.functions.predicates import is_work
from tessera.functions.text import blank, filled, strip, text

SCRAPED = ("title", "title_cn", "year", "type", "materials", "size", "duration", "credits", "description_en", "description_cn")
DESCRIBED = (*SCRAPED, "video_link")
#: Entries of a cache that are no works.
OTHER_ENTRIES = ("extract_", "discovery_")


def _record(df: DataFrame, json: str) -> DataFrame:
    """url, r: data.json of an answer; answers without one go."""
    fields = ", ".join(f"{f}: string" for f in (*DESCRIBED, "category"))
    got = F.from_json(json, f"data struct<json: struct<{fields}>>", {"mode": "PERMISSIVE"})["data"]["json"]
    return df.select("url", got.alias("r")).filter("r IS NOT NULL")


def _year(c: Column) -> Column:
    return F.when(c != "", normalize_year(c)).otherwise("")


def scraped(df: DataFrame, json: str = "json") -> DataFrame:
    """Records of scraped answers (url, json): placeholders are blank, years in normal form. Answers without fields go."""
    held = {f: text(F.col("r")[f]) for f in SCRAPED}
    clean = {f: F.when(F.lower(strip(c)).isin(*fixed.PLACEHOLDERS, ""), "").otherwise(c) for f, c in held.items()}
    return _record(df, json).select("url", *[(_year(c) if f == "year" else c).alias(f) for f, c in clean.items()], F.lit("scrape_json").alias("source"))


def described(df: DataFrame, json: str = "json") -> DataFrame:
    """Records of described answers (url, json): the category is the type where there is one, a title in two languages is
    parted unless the Chinese one is given. is_work tells exhibitions and the like, which are cached but not returned."""
    r = {f: text(F.col("r")[f]) for f in (*DESCRIBED, "category")}
    halves = F.split(r["title"], "/")
    parted = (r["title_cn"] == "") & F.contains(r["title"], F.lit("/"))
    out = {f: r[f] for f in DESCRIBED} | {
        "title": F.when(parted, strip(F.get(halves, F.lit(0)))).otherwise(r["title"]), "title_cn": F.when(parted, strip(F.get(halves, F.lit(1)))).otherwise(r["title_cn"]),
        "type": F.coalesce(filled(r["category"]), r["type"]), "year": _year(r["year"]),
    }
    return _record(df, json).select("url", *[c.alias(f) for f, c in out.items()]).withColumn("is_work", is_work("type"))


def job_answers(jobs: DataFrame) -> DataFrame:
    """url, title, description_en, images, error of extraction jobs: url, code and submitted (status and body of the
    submission), status (the last body that polling got). The first item counts where there are several; what went wrong is
    a title and an error. An answer that names another URL is for that one."""
    item = "struct<url: string, title: string, description_en: string, images: array<string>>"
    said = F.get_json_object("status", "$.status")
    data = F.get_json_object("status", "$.data")
    first = F.when(data.startswith("["), F.get(F.from_json(data, f"array<{item}>"), F.lit(0))).otherwise(F.from_json(data, item))
    df = jobs.select("url", "code", "submitted", said.alias("said"), first.alias("x"))
    empty = blank("x.title") & blank("x.description_en") & (F.coalesce(F.size("x.images"), F.lit(0)) <= 0)
    accepted = F.coalesce(F.get_json_object("submitted", "$.success") == "true", F.lit(False))
    wrong = [
        (~F.col("code").eqNullSafe(200), "[Error: Submit Failed]", F.concat(F.lit("HTTP "), F.coalesce(F.col("code").cast("string"), F.lit("")))), (~accepted, "[Error: API Failed]", text("submitted")),
        ((F.col("said") == "completed") & empty, "[Error: Empty Content]", F.lit("Extraction returned empty data")), (F.col("said") == "failed", "[Error: Job Failed]", F.lit("Extraction job failed")),
        (~F.col("said").eqNullSafe("completed"), "[Error: Timeout]", F.lit("Extraction timeout")),
    ]
    title, error = text("x.title"), F.lit("")
    for holds, name, reason in reversed(wrong):
        title, error = F.when(holds, F.lit(name)).otherwise(title), F.when(holds, reason).otherwise(error)
    out = df.select("url", F.coalesce(filled(F.col("x.url")), F.col("url")).alias("_url"), title.alias("title"), text("x.description_en").alias("description_en"), F.col("x.images").alias("images"), error.alias("error"))
    return out.select(F.when(F.col("error") == "", F.col("_url")).otherwise(F.col("url")).alias("url"), "title", "description_en", "images", "error")


def searched(wanted: DataFrame, cache: DataFrame, jobs: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    """Results for the wanted URLs (the first limit of them in order): what the cache has (from_cache), and the jobs' answers
    for the rest; to_cache marks those that succeeded. cache: url, title and other fields, a row for each URL."""
    some = (wanted.orderBy(order).limit(limit) if limit is not None else wanted).select("url")
    empty = {"description_en": F.lit(""), "images": F.lit(None).cast("array<string>")}
    held = [F.col(f) if f in cache.columns else empty[f].alias(f) for f in empty]
    hits = some.join(cache, "url").select("url", "title", *held, F.lit("").alias("error"), F.lit(True).alias("from_cache"), F.lit(False).alias("to_cache"))
    missing = some.join(cache.select("url").distinct(), "url", "left_anti")
    new = job_answers(jobs.join(missing, "url", "left_semi")).withColumns({"from_cache": F.lit(False), "to_cache": F.col("error") == ""})
    return hits.unionByName(new)


def stored_works(df: DataFrame, json: str = "json") -> DataFrame:
    """Works of stored JSON objects, one a row, without exhibitions and the like. What is no object is left out."""
    fields = ", ".join(f"{f}: string" for f in schemas.TEXT_FIELDS)
    got = df.filter(F.ltrim(F.col(json)).startswith("{")).select(F.from_json(json, f"struct<{fields}, images: array<string>, high_res_images: array<string>>").alias("w"))
    return got.filter("w IS NOT NULL").select(*[text(f"w.{f}").alias(f) for f in schemas.TEXT_FIELDS], "w.images", "w.high_res_images").filter(is_work("type"))


def cached_works(entries: DataFrame, name: str = "entry") -> DataFrame:
    """Records of a cache's entries (name, url and fields): those of works, with a URL."""
    other = F.lit(False)
    for start in OTHER_ENTRIES:
        other = other | F.startswith(F.coalesce(F.col(name), F.lit("")), F.lit(start))
    return entries.filter(~other & F.coalesce(F.col(name), F.lit("")).endswith(".pkl") & ~blank("url")).drop(name)
