"""First-wins deduplication and the clearing of values that leaked from one record to others.

Order is a column: the one row of a key that stays is the first by it, never by partition order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import blank, strip, text


def keep_first(df: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key; rows with a blank key go. Spark limits each key to one row before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.filter(~blank(F.col(key).cast("string"))).withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def distinct_in_order(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys by their first place."""
    return df.groupBy(key).agg(F.min(order).alias(order))


def clear_shared(df: DataFrame, column: str, min_length: int, min_rows: int, score: Column, order: Sequence[str]) -> DataFrame:
    """Clears column in all but the best row of each value that is longer than min_length and stands in min_rows rows.

    The best has the highest score; the first by order wins ties. Adds was_cleared. A value that very many rows share is
    summarised by partial aggregation and joined back, so no task holds the group.
    """
    value = strip(column)
    rank = F.struct((-score).alias("_s"), *[F.col(o) for o in order])
    marked = df.withColumns({"_value": F.when(F.length(value) > min_length, value), "_rank": rank})
    groups = marked.filter("_value IS NOT NULL").groupBy(F.col("_value").alias("_key")).agg(F.count("*").alias("_n"), F.min("_rank").alias("_best")).filter(F.col("_n") >= min_rows)
    joined = marked.join(groups, F.col("_value") == F.col("_key"), "left")
    gone = F.col("_key").isNotNull() & (F.col("_rank") != F.col("_best"))
    return joined.withColumns({column: F.when(gone, F.lit("")).otherwise(F.col(column)), "was_cleared": gone}).drop("_value", "_rank", "_key", "_n", "_best")


def value_counts(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds how many rows have the same stripped value; 0 where it is blank."""
    value = F.when(strip(column) != "", strip(column))  # blank ones are neither counted nor joined
    counts = df.select(value.alias("_v")).filter("_v IS NOT NULL").groupBy("_v").agg(F.count("*").alias(out))
    joined = df.join(counts, value == F.col("_v"), "left").drop("_v")
    return joined.withColumn(out, F.coalesce(out, F.lit(0)))


def clear_contamination(works: DataFrame, order: str = "_ordinal") -> DataFrame:
    """Materials that three works share, then descriptions that two share, stay with the work that they fit best.

    Later passes see what earlier ones cleared. Adds n_cleared, the fields cleared in the row.
    """
    low = lambda c: F.lower(text(c))
    df = value_counts(works, "description_en", "_same_desc")
    unique_desc = (F.length(strip("description_en")) > 50) & (F.col("_same_desc") == 1)
    words = F.filter(F.split(low("title"), r"\s+"), lambda x: F.length(x) > 3)
    in_title = F.exists(words, lambda x: F.contains(low("materials"), x))
    score = F.when(unique_desc, 10).otherwise(0) + F.when(in_title, 5).otherwise(0)
    df = clear_shared(df, "materials", 15, 3, score, [order]).drop("_same_desc").withColumnRenamed("was_cleared", "_c0")
    df = value_counts(df, "materials", "_same_mat")
    for i, column in enumerate(("description_en", "description_cn"), 1):
        title = (F.length(strip("title")) > 2) & F.contains(low(column), F.lower(strip("title")))
        slug = F.lower(F.translate(F.element_at(F.split(F.regexp_replace(text("url"), "/+$", ""), "/"), -1), "-_", "  "))
        named = (F.length(slug) > 3) & F.contains(low(column), slug)
        own = ~blank(strip("materials")) & (F.col("_same_mat") == 1)
        score = F.when(title, 10).otherwise(0) + F.when(named, 8).otherwise(0) + F.when(own, 5).otherwise(0)
        df = clear_shared(df, column, 30, 2, score, [order]).withColumnRenamed("was_cleared", f"_c{i}")
    total = sum((F.col(f"_c{i}").cast("int") for i in range(3)), F.lit(0))
    return df.withColumn("n_cleared", total).drop("_c0", "_c1", "_c2", "_same_mat")
