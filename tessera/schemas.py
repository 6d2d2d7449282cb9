"""Schemas of the tables that the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXTS = ("url", "title", "title_cn", "year", "type", "materials", "size", "duration", "credits", "description_en", "description_cn", "video_link")
WORK = T.StructType(
    [T.StructField(f, T.StringType()) for f in _TEXTS]
    + [T.StructField(f, T.ArrayType(T.StringType())) for f in ("images", "high_res_images")]
    + [T.StructField("source", T.StringType())]
)
SNAPSHOT = T.StructType([T.StructField("url", T.StringType()), T.StructField("lastmod", T.StringType())])
BATCH = "id long, mode string, status string, created_at string, updated_at string, total_records int, last_error string"
RECORD = (
    "id long, batch_id long, url string, slug string, status string, page_type string, confidence double, is_update boolean, proposed string, error_message string, "
    "created_at string, updated_at string"
)
VERDICT = (
    "page_type string, title string, title_cn string, year string, type string, materials string, size string, duration string, credits string, description_en string, "
    "description_cn string, video_link string, confidence double, should_apply boolean, rejection_reason string"
)
TEXT_FIELDS = _TEXTS
