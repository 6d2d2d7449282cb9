"""Change detection with keyed state: the last version of each key lives in the stream's state store instead of a table.

Rows carry the time at which they were seen. A key's first row is new, and so is one that comes more than within after the
key's last row; others are modified if their version is filled and differs from the last. Rows that are not later than
their key's last one are late or repeated and say nothing. A timer in event time drops the state of keys that were not
seen for so long, so the store holds recent keys only. How rows are cut into batches does not show in the results.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.functions.text import blank

SHAPE = "url string, lastmod string, at timestamp, change string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Versions(StatefulProcessor):
    """The last version of a key, and when it was seen."""

    def __init__(self, within: timedelta):
        self.within = within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "lastmod string, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["at", "lastmod"], kind="stable")
        known = self.seen.get() if self.seen.exists() else None
        version, last = (None, None) if known is None else (known[0], pd.Timestamp(known[1], unit="us"))
        out = []
        for lastmod, at in zip(batch["lastmod"], batch["at"], strict=True):
            if last is not None and at <= last:
                continue
            if last is None or at - last > self.within:
                out.append((key[0], lastmod, at, "new"))
            elif lastmod and lastmod != version:
                out.append((key[0], lastmod, at, "modified"))
            version, last = lastmod, at
        if last is not None:
            self.seen.update((version, last.value // 1000))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int((last + self.within).timestamp() * 1000) + 1)
        yield pd.DataFrame(out, columns=["url", "lastmod", "at", "change"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.seen.clear()
        yield pd.DataFrame({"url": pd.Series(dtype="str"), "lastmod": pd.Series(dtype="str"), "at": pd.Series(dtype="datetime64[ns]"), "change": pd.Series(dtype="str")})

    def close(self) -> None:
        pass


def keyed_changes(stream: DataFrame, within: timedelta = timedelta(hours=24), late: str = "1 hour") -> DataFrame:
    """Rows (url, lastmod, at, change) of a stream (url, lastmod, at) that are new or modified. late: how far behind the
    latest rows others may come before the state of their key may be gone. A null key is a key. A batch's rows of one key
    are in one task: bound a batch by the source's options."""
    rows = stream.select("url", "lastmod", "at").withWatermark("at", late)
    return rows.groupBy("url").transformWithStateInPandas(Versions(within), SHAPE, "Append", "EventTime")


def use_state_store(spark: SparkSession) -> None:
    """Keyed state needs this store; a setting of the session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def changes_in_order(rows: DataFrame, within: timedelta = timedelta(hours=24)) -> DataFrame:
    """The same over a whole table: what keyed_changes gives for its rows in order, however they are cut into batches."""
    own = Window.partitionBy("url").orderBy("at", "lastmod")
    one = rows.select("url", "lastmod", "at", F.lag("at").over(own).alias("_before"))
    # Of rows of one time the first counts; the others are repeated.
    kept = one.filter(F.col("_before").isNull() | (F.col("at") > F.col("_before"))).drop("_before")
    kept = kept.withColumns({"_last": F.lag("at").over(Window.partitionBy("url").orderBy("at")), "_version": F.lag("lastmod").over(Window.partitionBy("url").orderBy("at"))})
    new = F.col("_last").isNull() | (F.unix_micros("at") - F.unix_micros("_last") > int(within.total_seconds() * 1e6))
    change = F.when(new, "new").when(~blank("lastmod") & ~F.col("lastmod").eqNullSafe(F.col("_version")), "modified")
    return kept.select("url", "lastmod", "at", change.alias("change")).filter("change IS NOT NULL")
