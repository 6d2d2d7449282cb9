"""What several operators need: a shared scratch folder, tables kept there, and distributed running totals."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a longest run without these six characters of white space.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = f"[^{SPACE_CLASS}]+"
SPACES = f"[{SPACE_CLASS}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where it is unset and Spark runs in one process (tests) is a temporary folder of this machine used; on a
    cluster an unset folder is an error.
    """
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own:
        return own.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tessera-")
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{uuid.uuid4().hex}/{name}"


def keep(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later steps neither recompute it nor depend on executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, *paths: str) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Kept tables of one run of an operator. What no later step reads is dropped as soon as that is so; what the lazily
    returned result reads stays until the shared folder is cleared."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, {}

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        df.write.options(**options).parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.tables[id(kept)] = (kept, path)
        return kept

    def keep_bucketed(self, df: DataFrame, name: str, buckets: int, key: str, **options: str) -> DataFrame:
        """As keep, in buckets by key: joins by it read the table where it lies instead of dealing it out again.

        df should be dealt by key into as many partitions. The session's catalog knows the table while its plan is made.
        """
        path, table = fresh_path(self.spark, name), f"tessera_{uuid.uuid4().hex}"
        df.write.options(**options).option("path", path).bucketBy(buckets, key).format("parquet").saveAsTable(table)
        kept = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")
        self.tables[id(kept)] = (kept, path)
        return kept

    def drop(self, *tables: DataFrame) -> None:
        delete(self.spark, *(self.tables.pop(id(t))[1] for t in tables if id(t) in self.tables))

    def release(self) -> None:
        """Frees the shuffles of finished steps: Spark removes their files when the driver no longer refers to them, which
        without a collection may be long after the operator's end."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def doc_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def order_hash(seed: str, id_col: str, text_col: str) -> Column:
    """Uniform lower-case hex that orders rows by their ids; rows without an id go by their texts, so they are spread too."""
    own = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("-"), F.md5(doc_text(text_col))))
    return F.md5(F.concat(F.lit(f"{seed}:"), own))


def hex_digits(rows: int) -> int:
    """Leading hex digits that split rows of uniform hashes into about sqrt(rows) ranges."""
    return min(7, max(1, math.ceil(math.log(max(rows, 1), 16) / 2)))


def running_total(df: DataFrame, key: str, hash_hex: str, ties: Sequence[str], value: str, out: str, rows: int) -> DataFrame:
    """Adds column out: the sum of value over the rows of the same key that come before, by (hash_hex, ties).

    hash_hex holds uniform lower-case hex strings. No task sees a whole key: its rows are cut by leading digits into
    about sqrt(rows) ranges; the ranges' sums are summed up first, then each range by itself. df is read twice, so it
    should be a kept table.
    """
    digits = hex_digits(rows)
    cut = df.withColumn("_range", F.substring(hash_hex, 1, digits))
    sums = cut.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_r")).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy("_key").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(key, "_range").orderBy(hash_hex, *ties).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.join(sums, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_range", "_r", "_key", "_base")
