"""Keyed changes: any cut into batches gives what the whole table gives; late and repeated rows say nothing."""

import random
from datetime import datetime, timedelta

import pytest

from tessera.streaming.keyed import STORE, changes_in_order, keyed_changes, use_state_store

START = datetime(2024, 1, 1)


def stamped(rows):
    return [(u, v, START + timedelta(minutes=m)) for u, v, m in rows]


def run(spark, tmp_path, batches, **options):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    use_state_store(spark)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == STORE
    try:
        for rows in batches:
            spark.createDataFrame(stamped(rows), "url string, lastmod string, at timestamp").coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema("url string, lastmod string, at timestamp").parquet(src)
            q = keyed_changes(stream, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(120)
    finally:
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return sorted(((r.url, r.lastmod, r["at"], r.change) for r in spark.read.parquet(out).collect()), key=repr)


@pytest.mark.parametrize("cuts", [(), (20, 21, 60)])
def test_any_cut_gives_what_the_table_gives(spark, tmp_path, cuts):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", "c", None]), r.choice(["1", "2", "", None]), m) for m in sorted(r.randrange(6000) for _ in range(90))]
    want = sorted(((x.url, x.lastmod, x["at"], x.change) for x in changes_in_order(spark.createDataFrame(stamped(rows), "url string, lastmod string, at timestamp"), timedelta(hours=5)).collect()), key=repr)
    # Rows of one minute stay in one batch, as their order is by version.
    ends = [0, *[next((i for i in range(c, len(rows)) if rows[i][2] != rows[i - 1][2]), len(rows)) for c in cuts], len(rows)]
    got = run(spark, tmp_path, [rows[a:b] for a, b in zip(ends, ends[1:]) if b > a], within=timedelta(hours=5), late="10 minutes")
    assert got == want and {x[3] for x in got} == {"new", "modified"}


def test_late_and_repeated_rows_and_forgotten_keys(spark, tmp_path):
    batches = [[("a", "1", 0), ("a", "1", 0), ("b", "1", 10)], [("a", "2", 5), ("b", "0", 3), ("b", "1", 10)], [("a", "2", 400), ("c", "9", 2000)], [("b", "1", 2010), ("a", "", 2011), ("a", "3", 2012)]]
    got = [(u, v, (at - START).seconds // 60 + (at - START).days * 1440, c) for u, v, at, c in run(spark, tmp_path, batches, within=timedelta(hours=8), late="30 minutes")]
    assert got == [("a", "", 2011, "new"), ("a", "1", 0, "new"), ("a", "2", 5, "modified"), ("a", "3", 2012, "modified"), ("b", "1", 10, "new"), ("b", "1", 2010, "new"), ("c", "9", 2000, "new")]
