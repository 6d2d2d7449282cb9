"""Sections of ordered rows: breaks where a value changes, values carried forward, running shares.

Within groups these are windows. Over all rows of a table a window would run in one task, so placed, carried and added_up
cut the rows by an order column of whole numbers into spans, look back over one row for each span, and then run windows
within spans. Order columns should not repeat; each span then has at most 2 ** SPAN_BITS rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN_BITS = 17


def _span(order: str, bits: int) -> Column:
    return F.shiftright(F.col(order).cast("long"), bits)


def placed(df: DataFrame, value: str, major: Column, order: str, bits: int = SPAN_BITS) -> DataFrame:
    """Adds place (from 1) and is_break (value differs from the row before) over all rows, by falling major, then order."""
    cut = df.withColumns({"_major": major, "_span": _span(order, bits)})
    spans = cut.groupBy(F.col("_major").alias("_m"), F.col("_span").alias("_s")).agg(F.count("*").alias("_n"), F.min_by(value, order).alias("_first"), F.max_by(value, order).alias("_last"))
    by = Window.orderBy(F.desc("_m"), "_s")
    new = (F.row_number().over(by) == 1) | ~F.col("_first").eqNullSafe(F.lag("_last").over(by))
    spans = spans.withColumns({"_base": F.coalesce(F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_new": new}).drop("_n", "_first", "_last")
    inside = Window.partitionBy("_major", "_span").orderBy(order)
    at = F.row_number().over(inside)
    breaks = F.when(at == 1, F.col("_new")).otherwise(~F.col(value).eqNullSafe(F.lag(value).over(inside)))
    joined = cut.join(spans, F.col("_major").eqNullSafe(F.col("_m")) & F.col("_span").eqNullSafe(F.col("_s")))
    return joined.withColumns({"place": F.col("_base") + at, "is_break": breaks}).drop("_major", "_span", "_m", "_s", "_base", "_new")


def carried(df: DataFrame, value: str, order: str, out: str, bits: int = SPAN_BITS) -> DataFrame:
    """Adds out: the last value that isn't null up to the row, over all rows."""
    cut = df.withColumn("_span", _span(order, bits))
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))
    back = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    spans = cut.groupBy(F.col("_span").alias("_s")).agg(last.alias("_last")).withColumn("_before", F.last("_last", ignorenulls=True).over(back)).drop("_last")
    inside = Window.partitionBy("_span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(spans, F.col("_span").eqNullSafe(F.col("_s")))
    return joined.withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_before"))).drop("_span", "_s", "_before")


def added_up(df: DataFrame, value: str, order: str, out: str, bits: int = SPAN_BITS) -> DataFrame:
    """Adds out: the sum of value over the rows before, over all rows."""
    cut = df.withColumn("_span", _span(order, bits))
    back = Window.rowsBetween(Window.unboundedPreceding, -1)
    spans = cut.groupBy(F.col("_span").alias("_s")).agg(F.sum(value).alias("_sum")).withColumn("_base", F.sum("_sum").over(back.orderBy("_s"))).drop("_sum")
    inside = back.partitionBy("_span").orderBy(order)
    total = F.coalesce("_base", F.lit(0)) + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return cut.join(spans, F.col("_span").eqNullSafe(F.col("_s"))).withColumn(out, total).drop("_span", "_s", "_base")


def ranked(df: DataFrame, order: Sequence[Column], out: str, ranges: int = 256, sample: int = 32) -> DataFrame:
    """Adds out: a row's place from 0 in the order, which should be total. Whole numbers without gaps, and no task sees all rows.

    The ranges * sample rows with the least hashes are a sample of bounded size; every sample-th of them in order parts the
    rows into ranges, whose counts give each range its first place. df is read three times; where it is dear, write it first."""
    cut = df.withColumn("_at", F.struct(*[c.alias(f"c{i}") for i, c in enumerate(order)]))
    drawn = cut.select("_at", F.xxhash64("_at").alias("_h")).orderBy("_h").limit(ranges * sample)
    fences = drawn.agg(F.array_sort(F.collect_list("_at")).alias("_f")).select(F.filter("_f", lambda x, i: i % sample == sample - 1).alias("_f"))
    cut = cut.crossJoin(fences).withColumn("_range", F.size(F.filter("_f", lambda x: x <= F.col("_at")))).drop("_f")
    counts = cut.groupBy(F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    counts = counts.select("_r", F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    place = F.col("_base") + F.row_number().over(Window.partitionBy("_range").orderBy("_at")) - 1
    return cut.join(counts, F.col("_range") == F.col("_r")).withColumn(out, place.cast("long")).drop("_range", "_r", "_base", "_at")


def sections(df: DataFrame, value: str, order: Sequence[Column], within: Sequence[str] = ()) -> DataFrame:
    """Adds is_break (value differs from the row before) and section (breaks so far), within groups."""
    w = Window.partitionBy(*within).orderBy(*order)
    new = F.coalesce(~F.col(value).eqNullSafe(F.lag(value).over(w)), F.lit(True)) | (F.row_number().over(w) == 1)
    df = df.withColumn("is_break", new)
    return df.withColumn("section", F.sum(F.col("is_break").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def carry_forward(df: DataFrame, value: str, order: Sequence[Column], out: str, within: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def progress(df: DataFrame, order: Sequence[Column], within: Sequence[str] = ()) -> DataFrame:
    """Adds done_pct: the share of the group's rows up to this one, whole percent."""
    w = Window.partitionBy(*within)
    return df.withColumn("done_pct", F.floor(F.row_number().over(w.orderBy(*order)) * 100 / F.count("*").over(w)))
