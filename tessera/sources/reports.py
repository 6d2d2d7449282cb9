"""Whole extraction reports: one text of all items, or a folder for each item with an index beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import safe_name, text
from tessera.operators.sections import ranked
from tessera.sources.sinks import image_files, report_item

# The heads of reports.
TITLE, SPLIT, CONTENTS = "# Artwork Extraction Report / 作品提取报告", " (Split Mode)", "## Contents / 目录\n\n"
AT, MODE, TOTAL = "> **Extracted At / 提取时间:** ", "> **Mode / 提取模式:** ", "> **Total / 作品数量:** "
UNNAMED, UNNAMED_FOLDER = "作品 ", "artwork_"


def _numbered(items: DataFrame) -> DataFrame:
    """items with number, from 1 by _ordinal."""
    return ranked(items, [F.col("_ordinal")], "_no").withColumn("number", F.col("_no") + 1).drop("_no")


def _head(items: DataFrame, at: Column, level: Column, split: bool, after: str) -> DataFrame:
    total = items.agg(F.count("*").alias("n"))
    lines = F.concat(F.lit(TITLE + SPLIT * split + "\n\n" + AT), at, F.lit("\n" + MODE), F.upper(level), F.lit("\n" + TOTAL), F.col("n").cast("string"), F.lit("\n" + after))
    return total.select(F.lit(0).cast("long").alias("place"), lines.alias("text"))


def _with_files(items: DataFrame, folder: str, split: bool) -> DataFrame:
    """items with _local, the files of their images by address. A file that several items share has one name in all of them."""
    files = image_files(items, folder, split)
    listed = items.select("_ordinal", F.explode(F.array_distinct(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("images", "high_res_images")]))).alias("url"))
    named = listed.join(files.withColumnRenamed("item", "_ordinal") if split else files.drop("item"), ["_ordinal", "url"] if split else ["url"])
    maps = named.groupBy(F.col("_ordinal").alias("_o")).agg(F.map_from_entries(F.collect_list(F.struct("url", "file"))).alias("_local"))
    return items.join(maps, F.col("_ordinal") == F.col("_o"), "left").drop("_o")


def _entry(items: DataFrame) -> Column:
    none = F.lit(None).cast("map<string,string>")
    return report_item({c: F.col(c) for c in items.columns if c != "_local"}, F.col("number"), F.coalesce("_local", none))


def merged_report(items: DataFrame, at: Column, level: Column, folder: str = "images") -> DataFrame:
    """place, text: the report's head (place 0), then every item with the files of its images. items: works with _ordinal and
    error; at, level: when and how they were extracted. Texts follow each other without anything between."""
    named = _with_files(_numbered(items), folder, False)
    return _head(items, at, level, False, "\n---\n\n").unionByName(named.select(F.col("number").alias("place"), _entry(named).alias("text")))


def _folder(number: Column, title: Column) -> Column:
    padded = F.lpad(number.cast("string"), F.greatest(F.lit(2), F.length(number.cast("string"))), F.lit("0"))
    return F.concat(padded, F.lit("_"), safe_name(F.coalesce(title, F.concat(F.lit(UNNAMED_FOLDER), number.cast("string")))))


def split_report(items: DataFrame, at: Column, level: Column, folder: str = "images") -> tuple[DataFrame, DataFrame]:
    """(path, text of each item's report; place, text of the index). Titles that are missing (null) get a number's name."""
    named = _with_files(_numbered(items), folder, True)
    own = _folder(F.col("number"), F.col("title"))
    reports = named.select(F.concat(own, F.lit("/report.md")).alias("path"), _entry(named).alias("text"))
    # The index names what has no title otherwise than its folder; both are fixed.
    title = F.coalesce("title", F.concat(F.lit(UNNAMED), F.col("number").cast("string")))
    listed = F.concat(F.col("number").cast("string"), F.lit(". ["), title, F.lit("](./"), _folder(F.col("number"), title), F.lit("/report.md)\n"))
    index = _head(items, at, level, True, "\n" + CONTENTS).unionByName(_numbered(items).select(F.col("number").alias("place"), listed.alias("text")))
    return reports, index


def write_ordered_text(rows: DataFrame, folder: str, order: str = "place", column: str = "text", parts: int = 16) -> None:
    """Texts as the files of folder; joined in the order of the files' names they are the rows' texts in order, of which
    those that do not end in a newline get one.

    Ranges of the order are written by one task each: the driver reads no row, and a report has no bound. For a report that
    must be one file, write_one_file streams it through the driver."""
    dealt = rows.select(order, text(column).alias("_text")).repartitionByRange(parts, order).sortWithinPartitions(order)
    dealt.select(F.regexp_replace("_text", r"\n\z", "")).write.mode("overwrite").text(folder)
