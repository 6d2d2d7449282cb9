"""Change detection over a stream of snapshots. Each micro-batch is compared with the stored table, which advances only
after the batch's changes are written, so a failed batch is seen again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tessera.operators.changes import changed, last_version
from tessera.operators.merge import keyed_upsert


def follow_snapshots(spark: SparkSession, source: str, schema: str, store: str, out: str, checkpoint: str) -> StreamingQuery:
    """source: Parquet files with url, lastmod. store: folder whose versions v=<batch> hold the known table; out: changes by batch.

    Writing a batch again gives the same result: its input version is the last one before it.
    """

    def apply(batch: DataFrame, number: int) -> None:
        jvm = spark.sparkContext._jvm
        base = jvm.org.apache.hadoop.fs.Path(store)
        fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        versions = [int(s.getPath().getName()[2:]) for s in fs.listStatus(base) if s.getPath().getName().startswith("v=")] if fs.exists(base) else []
        before = [v for v in versions if v < number]
        known = spark.read.parquet(f"{store}/v={max(before)}") if before else spark.createDataFrame([], "url string, lastmod string")
        rows = last_version(batch.select("url", "lastmod", F.monotonically_increasing_id().alias("_at")), "url", "_at")
        changed(rows, known).write.mode("overwrite").parquet(f"{out}/batch={number}")
        keyed_upsert(known, rows.select("url", "lastmod"), ["url"]).write.mode("overwrite").parquet(f"{store}/v={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, key: str, stamp: str, within: str) -> DataFrame:
    """Rows whose key was not seen within the watermark's delay before; state older than that is dropped."""
    return stream.withWatermark(stamp, within).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, stamp: str, key: str, late: str, size: str, slide: str | None = None) -> DataFrame:
    w = F.window(stamp, size, slide) if slide else F.window(stamp, size)
    return stream.withWatermark(stamp, late).groupBy(w, key).agg(F.count("*").alias("n"))
