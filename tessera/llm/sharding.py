"""Sharding by sampled splitters: records are put in the order of a key and cut into shards of near-equal size.

A size-weighted sample of keys is drawn; its quantiles cut the order into ranges of about equal size, many for each shard.
Ranges that turn out to be overfull (by rows or by size) are sampled and cut again, with the record's id and a stored row
number as further parts of the key, so a key that many records share is cut too. The ranges' sums then give every range
its place in the whole order, each range gives its records theirs, and a record goes to the shard in whose share of the
total size its middle lies. What the sample decides is how the work is dealt, not where a record goes: that depends on the
order and the sizes alone, so reruns and other samples agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, doc_text, unused
from tessera.llm.quality import let


@dataclass(frozen=True)
class Sharding:
    """shards: how many. ranges: that the whole, and any overfull range, is cut into. sample: keys drawn for each range to be.
    max_rows: of a range; one of more rows, or of more than twice its share of the size, is overfull."""

    shards: int = 16
    ranges: int = 256
    sample: int = 32
    max_rows: int = 250_000
    seed: str = "shard"


#: The order: key, then id, then the row's stored number, which no two rows share. Nulls come first.
ORDER = ("key", "id", "row")
STEP = 16


def _place() -> Column:
    return F.struct(*[F.col(c) for c in ORDER])


def _index(coarse: Column, splitters: Column) -> Column:
    """How many of the sorted splitters are at or below a row's place. coarse: every STEP-th of them, searched first."""

    def below(places: Column, place: Column) -> Column:
        return F.size(F.filter(places, lambda s: s <= place))

    def search(place: Column) -> Column:
        return let(below(coarse, place), lambda c: c * STEP + below(F.slice(splitters, c * STEP + 1, F.lit(STEP)), place))

    return let(_place(), search)


def _splitters(rows: DataFrame, ranges: DataFrame, sharding: Sharding, level: int) -> DataFrame:
    """range, splitters, coarse for each of ranges (range, n, bytes, pieces): quantiles of a sample of its rows, which are
    drawn in proportion to their sizes (and one, so that rows without a size count too). About pieces * sample rows are
    drawn, whatever the range holds. A row over a piece's size is cut off on both sides, so every cut makes ranges smaller."""
    uniform = F.xxhash64(F.lit(f"{sharding.seed}{level}"), *ORDER).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    each = (F.col("bytes") + F.col("n")) / (F.col("pieces") * sharding.sample)  # the size that a drawn row stands for, unless its own is larger
    drawn = rows.join(ranges, "range").filter(uniform * each <= F.col("size") + 1)
    drawn = drawn.select("range", "pieces", *ORDER, F.greatest(F.col("size") + 1.0, each).alias("weight"))
    own = Window.partitionBy("range")
    drawn = drawn.withColumn("upto", F.sum("weight").over(own.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)))
    drawn = drawn.withColumn("quantile", F.floor(F.col("upto") * F.col("pieces") / F.sum("weight").over(own)))
    drawn = drawn.withColumn("passed", F.col("quantile") - F.lag("quantile", 1, 0).over(own.orderBy(*ORDER))).filter("passed > 0")
    behind = F.when(F.col("passed") > 1, F.struct("key", "id", (F.col("row") + 1).alias("row")))  # above this row, not above any later one
    cuts = drawn.groupBy("range").agg(F.array_sort(F.concat(F.collect_list(_place()), F.collect_list(behind))).alias("splitters"))
    return cuts.withColumn("coarse", F.filter("splitters", lambda s, i: i % STEP == STEP - 1))


def _ranged(rows: DataFrame, sharding: Sharding, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """rows with the path of their range, and the ranges with their sums: range, n, bytes.

    A path has a number for each level, padded so that paths sort as the order does. The first level cuts the whole."""
    width = len(str(sharding.ranges + 1))
    rows, level = rows.withColumn("range", F.lit("")), 0
    while True:
        sums = scratch.keep(rows.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("bytes")), "sums")
        fair = F.lit(max(1, sums.agg(F.sum("bytes")).first()[0] or 0) / sharding.ranges)
        # A second cut makes pieces of half the bounds, so that a third is rare.
        need = F.greatest(2 * F.col("n") / sharding.max_rows, F.col("bytes") / fair, F.lit(2.0))
        over = (F.col("n") > 1) & (F.lit(level == 0) | (F.col("n") > sharding.max_rows) | (F.col("bytes") > 2 * fair))
        overfull = scratch.keep(sums.filter(over).withColumn("pieces", F.least(F.ceil(need), F.lit(sharding.ranges)).cast("int")), "overfull")
        if overfull.isEmpty():
            return rows, sums
        cuts = scratch.keep(_splitters(rows, overfull, sharding, level), "splitters")
        number = F.coalesce(_index(F.col("coarse"), F.col("splitters")), F.lit(0)).cast("string")
        # A range that is not cut anew keeps its path.
        path = F.when(F.col("splitters").isNull(), F.col("range")).otherwise(F.concat("range", F.lpad(number, width, "0")))
        finer = scratch.keep(rows.join(cuts, "range", "left").withColumn("range", path).drop("splitters", "coarse"), "ranged")
        scratch.drop(sums, overfull, cuts, *([rows] if level else []))
        rows, level = finer, level + 1


def _placed(rows: DataFrame, sharding: Sharding, scratch: Scratch) -> DataFrame:
    """rows (key, id, row, size, ...) with shard and slot."""
    ranged, sums = _ranged(rows, sharding, scratch)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges' sums, not over rows
    whole = Window.partitionBy()
    offset = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long")
    sums = sums.select(F.col("range").alias("_range"), offset("n").alias("base_n"), offset("bytes").alias("base"), F.greatest(F.sum("bytes").over(whole), F.lit(1)).alias("total"))
    own = Window.partitionBy("range").orderBy(*ORDER)
    found = ranged.join(sums, F.col("range") == F.col("_range"))
    # Twice the middle of a row's stretch of the total; whole numbers up to a total of 2^62 / shards.
    middle = 2 * (F.col("base") + F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0))) - F.col("size")
    found = found.withColumn("middle", middle).withColumn("number", F.col("base_n") + F.row_number().over(own) - 1)
    shard = F.least(F.expr(f"{sharding.shards}L * middle div (2 * total)"), F.lit(sharding.shards - 1)).cast("int")
    found = scratch.keep(found.withColumn("shard", shard).drop("range", "_range", "base", "base_n", "total", "middle", "key"), "placed")
    first = found.groupBy("shard").agg(F.min("number").alias("first"))  # a row for each shard
    return found.join(F.broadcast(first), "shard").withColumn("slot", F.col("number") - F.col("first")).drop("number", "first")


def _digest(text_col: str) -> Column:
    return F.unhex(F.sha2(doc_text(text_col), 256))


def shard_records(
    docs: DataFrame, sharding: Sharding | None = None, key: Column | None = None, size: Column | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each row of docs: id, size, text_crc32, shard, slot (its place in the shard, from 0, without gaps).

    key: orders the records, by default the text's digest, so equal texts lie together; a group of them is divided only
    where a shard ends. size: by default the text's UTF-8 bytes and one. Every shard's size differs from its share by no
    more than its two outer records. A null text is empty; null ids come first among equal keys; repeated rows follow each
    other. Fewer records than shards leave shards empty; an empty table gives an empty one. Other columns are ignored.
    """
    sharding = sharding or Sharding()
    scratch = Scratch(docs.sparkSession)
    size = F.octet_length(doc_text(text_col)) + 1 if size is None else size
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), size.cast("long").alias("size"), F.crc32(F.encode(doc_text(text_col), "UTF-8")).alias("text_crc32"),
        (_digest(text_col) if key is None else key).alias("key"), F.monotonically_increasing_id().alias("row"),
    )
    placed = _placed(scratch.keep(rows, "rows"), sharding, scratch)
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")


def write_shards(
    docs: DataFrame, path: str, sharding: Sharding | None = None, key: Column | None = None, size: Column | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """docs as Parquet under path/shard=N, its rows in order of the added column slot (slot_, ... where docs has one).

    Shards are cut as shard_records does; each is written by as many tasks as it has blocks of max_rows slots. An empty
    table leaves an empty folder."""
    sharding = sharding or Sharding()
    scratch = Scratch(docs.sparkSession)
    size = F.octet_length(doc_text(text_col)) + 1 if size is None else size
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    whole = scratch.keep(
        docs.select(own, F.col(id_col).cast("long").alias("id"), size.cast("long").alias("size"), (_digest(text_col) if key is None else key).alias("key"), F.monotonically_increasing_id().alias("row")),
        "whole",
    )
    placed = _placed(whole.drop("own"), sharding, scratch)
    out = whole.select("own", "row").join(placed.select("row", "shard", "slot"), "row").withColumn("block", F.expr(f"slot div {sharding.max_rows}"))
    out = out.repartition("shard", "block").sortWithinPartitions("shard", "slot")
    slot, shard = unused(docs, "slot"), unused(docs, "shard")
    out.select("own.*", F.col("slot").alias(slot), F.col("shard").alias(shard)).write.mode("overwrite").partitionBy(shard).parquet(path)
