"""Importing pages into batches of proposed records, and applying what was accepted, as tables: the provider's and the
reviewer's answers are rows, statuses are columns, and a batch's states follow from what happened to it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.normalize import normalize_year
from tessera.functions.predicates import is_work
from tessera.functions.text import blank, first_filled, slug, strip, text
from tessera.operators.merge import proposed_value, upsert_proposed
from tessera.operators.review import gate, record_status

TEXTS = ("title", "title_cn", "year", "type", "materials", "size", "duration", "credits", "description_en", "description_cn", "video_link")
IMAGES = ("images", "high_res_images")
UPDATE_FIELDS = ("size", "duration", "materials", "description_en", "credits")
DRAFT, READY, WRITING, SYNCING_REPO, SYNCING_GIT, COMPLETED, FAILED = "draft", "ready_to_apply", "writing_workspace", "syncing_repo", "syncing_git", "completed", "failed"
PROPOSED = "struct<" + ", ".join([*(f"{f}: string" for f in ("url", *TEXTS, "source")), *(f"{f}: array<string>" for f in IMAGES)]) + ">"


def update_candidates(works: DataFrame, fields: Sequence[str] = UPDATE_FIELDS, least: int = 2, everything: bool = False, limit: int | None = None, order: str = "_ordinal") -> DataFrame:
    """Works that lack at least so many of fields (or all works); with a limit the first in order."""
    lacking = sum((blank(f).cast("int") for f in fields), F.lit(0))
    some = works if everything else works.filter(lacking >= least)
    return some if limit is None else some.orderBy(order).limit(limit)


def visible_records(records: DataFrame) -> DataFrame:
    return records.filter(~F.col("status").eqNullSafe("rejected"))


def sanitized(fields: Mapping[str, Column], url: Column) -> Column:
    """A proposed record: known fields alone, without white space at their ends, lists where lists belong, and who said it."""
    none = F.lit(None).cast("string")
    source = strip(fields.get("source", none))
    texts = [strip(fields.get(f, none)).alias(f) for f in TEXTS]
    lists = [F.coalesce(fields[f], F.array().cast("array<string>")).alias(f) if f in fields else F.array().cast("array<string>").alias(f) for f in IMAGES]
    return F.struct(text(url).alias("url"), *texts, F.when(source == "", "macos_local").otherwise(source).alias("source"), *lists)


def record_rows(records: DataFrame, proposed: str = "proposed_record_json") -> DataFrame:
    """Records with the fields of their proposals, blank where those say nothing (or something that is no text or list)."""
    got = F.from_json(proposed, PROPOSED, {"mode": "PERMISSIVE"})
    texts = [strip(got[f]).alias(f) for f in TEXTS]
    lists = [F.coalesce(got[f], F.array().cast("array<string>")).alias(f) for f in IMAGES]
    plain = [c for c in ("id", "batch_id", "url", "slug", "status", "page_type", "confidence") if c in records.columns]
    return records.select(*plain, (F.coalesce(F.col("is_update").cast("int"), F.lit(0)) != 0).alias("is_update"), *texts, *lists, "error_message")


def new_batches(ids: DataFrame, mode: Column, now: Column) -> DataFrame:
    """Draft batches for ids (id)."""
    nothing = F.lit("")
    return ids.select("id", mode.alias("mode"), F.lit(DRAFT).alias("status"), now.alias("created_at"), now.alias("updated_at"), F.lit(0).cast("long").alias("total_records"),
                      nothing.alias("applied_commit_sha"), nothing.alias("last_error"))


def touch_batches(batches: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """changes: id and new values; nulls (and columns that are not there) leave what was."""
    names = [c for c in ("status", "total_records", "applied_commit_sha", "last_error") if c in changes.columns]
    news = changes.select(F.col("id").alias("_id"), *[F.col(c).alias("_n_" + c) for c in names])
    joined = batches.join(news, F.col("id") == F.col("_id"), "left")
    values = {c: F.coalesce(F.col("_n_" + c), F.col(c)) for c in names} | {"updated_at": F.when(F.col("_id").isNotNull(), now).otherwise(F.col("updated_at"))}
    return joined.withColumns(values).select(*batches.columns)


def new_records(imported: DataFrame, now: Column) -> DataFrame:
    """imported: batch_id, url, page_type, confidence, should_apply, is_update, proposed (a struct or null), error. Rows to append."""
    error = text("error")
    return imported.select(
        "batch_id", "url", slug("url").alias("slug"), record_status(error, F.coalesce("should_apply", F.lit(False))).alias("status"), "page_type", "confidence", F.col("is_update").cast("int").alias("is_update"),
        F.when(F.col("proposed").isNotNull(), F.to_json("proposed")).alias("proposed_record_json"), "error", now.alias("created_at"), now.alias("updated_at"),
    ).withColumnRenamed("error", "error_message")


def blank_verdict(base: Mapping[str, Column], reason: Column) -> dict[str, Column]:
    """What stands for a reviewer that gave no answer: the page's fields, no confidence, not to be applied."""
    none = F.lit(None).cast("string")
    return {f: strip(base.get(f, none)) for f in TEXTS} | {"page_type": F.lit("unknown"), "confidence": F.lit(0.0), "should_apply": F.lit(False), "reason": reason}


def content_block(content: Mapping[str, Column], most: int = 12_000) -> Column:
    """What a reviewer is shown: texts, images (those of high resolution if there are any), type, year and video."""
    parts = [F.when(strip(content[f]) != "", strip(content[f])) for f in ("title", "title_cn", "materials", "description_en", "description_cn")]
    images = F.when(F.coalesce(F.size("high_res_images"), F.lit(0)) > 0, F.col("high_res_images")).otherwise(F.coalesce("images", F.array().cast("array<string>")))
    return F.struct(F.substring(F.concat_ws("\n\n", *parts), 1, most).alias("main_text"), images.alias("images"), *[strip(content[f]).alias(f) for f in ("type", "year", "video_link")])


def import_pages(base: DataFrame, hybrid: DataFrame, verdicts: DataFrame, least: float = 0.85) -> DataFrame:
    """One row for each URL of base (what the page says) or hybrid (page and provider): url, proposed, page_type, confidence,
    should_apply, reason.

    The page's own fields are what the gate compares with; the content is the hybrid record's, where there is one. A URL
    without a verdict gets a blank one. verdicts: url, page_type, confidence, should_apply, reason, error and the text fields.
    """
    a = base.select("url", F.struct(*[F.col(f) for f in TEXTS]).alias("b"))
    h = hybrid.select("url", F.struct(*[F.col(f) for f in (*TEXTS, *IMAGES, "source")]).alias("h"))
    v = verdicts.select("url", F.struct("page_type", "confidence", "should_apply", "reason", "error", *TEXTS).alias("v"))
    df = a.join(h, "url", "full").join(v, "url", "left")
    said = F.col("v").isNotNull()
    own = {f: F.coalesce(F.col("b")[f], F.col("h")[f]) for f in TEXTS}
    content = {f: F.when(F.col("h").isNotNull(), F.col("h")[f]).otherwise(F.col("b")[f]) for f in TEXTS}
    for fields in (own, content):
        fields["year"] = F.when(~blank(fields["year"]), normalize_year(fields["year"])).otherwise(text(fields["year"]))
    empty = blank_verdict(own, F.lit(""))
    verdict = {f: F.when(said, F.col("v")[f]).otherwise(c) for f, c in empty.items()}
    merged = {f: proposed_value(text(content[f]), text(verdict[f])) for f in TEXTS} | {f: F.col("h")[f] for f in IMAGES}
    df = df.withColumn("proposed", sanitized(merged | {"source": F.col("h")["source"]}, F.col("url")))
    proposed = {f: F.col("proposed")[f] for f in (*TEXTS, "images")}
    answer = gate(F.col("url"), text(own["title"]), proposed, {k: verdict[k] for k in ("page_type", "should_apply", "confidence", "reason")}, is_work(own["type"]), said, least)
    df = df.withColumn("g", answer).withColumn("confidence", F.coalesce(verdict["confidence"], F.lit(0.0)))
    return df.select("url", "proposed", F.col("g.page_type").alias("page_type"), "confidence", F.col("g.should_apply").alias("should_apply"), first_filled("g.reason", verdict["reason"]).alias("reason"))


def apply_preview(existing: DataFrame, accepted: DataFrame, key: str, fields: Sequence[str], can_publish: Column) -> DataFrame:
    """One row: accepted_count, new_count, updated_count, will_push, error_message. accepted: the batch's accepted records."""
    merged = upsert_proposed(existing, accepted, key, fields)
    counts = merged.agg(F.count_if(F.col("is_proposed") & ~F.col("is_update")).alias("new_count"), F.count_if("is_update").alias("updated_count"))
    n = accepted.agg(F.count("*").alias("accepted_count"))
    some = F.col("accepted_count") > 0
    out = n.crossJoin(counts)  # one row each
    return out.select(
        "accepted_count", "new_count", "updated_count", (some & can_publish).alias("will_push"),
        F.when(~some, "No accepted records in batch").when(~can_publish, "Publishing is not set up").otherwise("").alias("error_message"),
    )


def apply_states(accepted: Column, dry_run: Column, failed_at: Column, error: Column) -> Column:
    """The states that an applied batch goes through, in order. failed_at: the state in which an exception came, or null.
    Without accepted records nothing begins; a dry run goes back to ready after writing."""
    full = F.array(*[F.lit(s) for s in (WRITING, SYNCING_REPO, SYNCING_GIT, COMPLETED)])
    way = F.when(dry_run, F.array(F.lit(WRITING), F.lit(READY))).otherwise(full)
    at = F.array_position(way, failed_at).cast("int")
    broken = F.concat(F.slice(way, F.lit(1), at), F.array(F.lit(FAILED)))
    states = F.when(accepted <= 0, F.array().cast("array<string>")).when(F.coalesce(at, F.lit(0)) > 0, broken).otherwise(way)
    last = F.try_element_at(states, F.lit(-1))
    return F.struct(states.alias("states"), last.alias("status"), F.when(F.coalesce(last == FAILED, F.lit(False)), text(error)).otherwise("").alias("last_error"))


def import_counts(wanted: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: cached_count and new_count of what was wanted."""
    there = cache.select(*keys).distinct().withColumn("_hit", F.lit(True))
    joined = wanted.select(*keys).join(there, list(keys), "left")
    return joined.agg(F.count_if(F.col("_hit").isNotNull()).alias("cached_count"), F.count_if(F.col("_hit").isNull()).alias("new_count"))
