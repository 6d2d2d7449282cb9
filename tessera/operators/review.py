"""The review of proposed records: a gate of ordered rules, statuses and their transitions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.predicates import is_known_type, reads_as_foreign, signal, slug_matches_title, titles_agree
from tessera.functions.text import blank, first_filled, strip

PENDING = ("ready_for_review", "needs_review", "accepted")
TERMINAL = ("completed", "failed")


def first_reason(rules: Sequence[tuple[Column, Column | str]]) -> Column:
    """The reason of the first rule that holds; the empty string if none does."""
    out = F.lit("")
    for holds, reason in reversed(list(rules)):
        out = F.when(holds, F.lit(reason) if isinstance(reason, str) else reason).otherwise(out)
    return out


def gate(url: Column, base_title: Column, proposed: Mapping[str, Column], verdict: Mapping[str, Column], is_work: Column, available: Column, least: float = 0.85) -> Column:
    """struct(page_type, should_apply, reason). proposed: title, type, year, materials, description_en, description_cn,
    images; verdict: page_type, should_apply, confidence, reason. The first rule that fails decides."""
    said = first_filled(verdict["reason"])
    kind = F.when(F.lower(strip(verdict["page_type"])).isin("artwork", "exhibition"), F.lower(strip(verdict["page_type"]))).otherwise("unknown")
    title = proposed["title"]
    foreign = lambda f: reads_as_foreign(proposed[f], title, url)
    signals = signal(proposed["year"]) | signal(proposed["materials"]) | signal(proposed["description_en"]) | signal(proposed["description_cn"])
    complete = signal(title) & signal(proposed["type"]) & (signals | (F.coalesce(F.size(proposed["images"]), F.lit(0)) > 0))
    based = ~blank(strip(base_title))
    or_said = lambda other: F.when(said != "", said).otherwise(other)
    rules = [
        (~is_work, "Local parser marked page as non-artwork"),
        (kind != "artwork", or_said(F.concat(F.lit("AI classified page as "), kind))),
        (~available, or_said(F.lit("AI unavailable"))),
        (is_known_type(title), "Title looks like an artwork type, not a title"),
        (~slug_matches_title(url, title), "Title does not match URL slug"),
        (based & ~titles_agree(base_title, title), "AI title does not match the local parser title"),
        (foreign("materials"), "Materials field looks contaminated by unrelated page content"),
        (foreign("description_en"), "English description looks contaminated by unrelated page content"),
        (foreign("description_cn"), "Chinese description looks contaminated by unrelated page content"),
        (~complete, "Artwork record is missing required fields"),
        (~verdict["should_apply"], or_said(F.lit("AI did not approve this record"))),
        (verdict["confidence"] < least, F.concat(F.lit("Confidence below threshold ("), F.format_string("%.2f", verdict["confidence"]), F.lit(")"))),
        (based & ~slug_matches_title(url, base_title), "Base extraction title does not match URL slug"),
    ]
    reason = first_reason(rules)
    page = F.when(~is_work, "exhibition").when(kind != "artwork", kind).otherwise("artwork")
    return F.struct(page.alias("page_type"), (reason == "").alias("should_apply"), reason.alias("reason"))


def record_status(error: Column, should_apply: Column) -> Column:
    return F.when(~blank(error), "failed").when(should_apply, "ready_for_review").otherwise("needs_review")


def decide(records: DataFrame, ids: DataFrame, status: str, now: Column) -> DataFrame:
    """records with the status of ids set, whatever it was."""
    joined = records.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    hit = F.col("_hit").isNotNull()
    return joined.withColumns({"status": F.when(hit, F.lit(status)).otherwise(F.col("status")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}).drop("_hit")


def rejected_urls(records: DataFrame, batches: DataFrame, mode: str = "incremental") -> DataFrame:
    """URLs of rejected records of incremental batches: they leave the snapshot, to be seen again."""
    return records.filter("status = 'rejected'").join(batches.filter(F.col("mode") == mode).select(F.col("id").alias("batch_id")), "batch_id").select("url").distinct()


def list_records(records: DataFrame, statuses: Sequence[str] | None = None, batch_id: int | None = None) -> DataFrame:
    if statuses is not None:
        records = records.filter(F.col("status").isin(*statuses))
    if batch_id is not None:
        records = records.filter(F.col("batch_id") == batch_id)
    return records.orderBy(F.desc("id"))


def delete_batches(batches: DataFrame, records: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batches, records) without those of gone (id)."""
    return batches.join(gone.select("id"), "id", "left_anti"), records.join(gone.select(F.col("id").alias("batch_id")), "batch_id", "left_anti")


def prune_terminal(batches: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    return delete_batches(batches, records, batches.filter(F.col("status").isin(*TERMINAL)))


def has_active_review(records: DataFrame, inactive: Sequence[str] = ("applied", "rejected", "failed")) -> bool:
    return not records.filter(~F.col("status").isin(*inactive)).isEmpty()
