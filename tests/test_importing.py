"""Operators of imports, reports and readers on edge cases."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import changes, importing, merge
from tessera.sources import readers, sinks


def test_one_row_for_each_key(spark):
    base = spark.createDataFrame([("a", ""), ("b", "kept")], "k string, v string")
    twice = spark.createDataFrame([("a", "1", 2), ("a", "2", 1), ("b", "x", 1)], "k string, v string, o int")
    got = lambda df: sorted((r.k, r.v) for r in df.collect())
    assert got(merge.fill_only(base, twice, "k", ["v"], "o")) == [("a", "1"), ("b", "kept")] and got(merge.fill_only(base, twice, "k", ["v"])) == [("a", "2"), ("b", "kept")]
    assert got(merge.overlay(base, twice, "k", ["v"], order="o")) == [("a", "1"), ("b", "x")]
    assert got(merge.upsert_proposed(base, twice, "k", ["v"], "o")) == [("a", "1"), ("b", "x")]
    old = spark.createDataFrame([("a", "1"), ("a", "2")], "url string, lastmod string")
    assert [(r.url, r.change) for r in changes.changed(spark.createDataFrame([("a", "1")], "url string, lastmod string"), old).collect()] == [("a", "modified")]


def test_manifest_must_be_an_object(spark):
    assert readers.read_manifest(spark.createDataFrame([('{"a": 1}',)], "json string")).collect()[0].asDict() == {"key": "a", "value": "1"}
    with pytest.raises(Exception, match="JSON object"):
        readers.read_manifest(spark.createDataFrame([("[1]",)], "json string")).collect()


def test_records_without_a_proposal(spark):
    df = spark.createDataFrame([(1, None, None), (2, "broken", 1)], "id long, proposed_record_json string, is_update int").withColumn("error_message", F.lit(None).cast("string"))
    rows = importing.record_rows(df).orderBy("id").collect()
    assert [(r.is_update, r.title, r.images) for r in rows] == [(False, "", []), (True, "", [])]
    assert importing.record_rows(df.filter("id < 0")).count() == 0


def test_states_of_nothing(spark):
    row = spark.range(1).select(importing.apply_states(F.lit(0), F.lit(False), F.lit(None).cast("string"), F.lit("x")).alias("x")).first()[0]
    assert (row.states, row.status, row.last_error) == ([], None, "")


def test_touching_leaves_what_is_null(spark):
    batches = importing.new_batches(spark.range(2), F.lit("full"), F.lit("t0"))
    changes_ = spark.createDataFrame([(1, None, "lost")], "id long, status string, last_error string")
    assert [(r.id, r.status, r.last_error, r.updated_at) for r in importing.touch_batches(batches, changes_, F.lit("t1")).orderBy("id").collect()] == [(0, "draft", "", "t0"), (1, "draft", "lost", "t1")]


def test_images_are_numbered_once(spark):
    items = spark.createDataFrame([(1, ["u/a.png", "u/b"], []), (2, ["u/a.png"], ["u/c.gif?x=.y"]), (3, None, None)], "_ordinal long, images array<string>, high_res_images array<string>")
    got = lambda split: sorted((r.item, r.url, r.file) for r in sinks.image_files(items, split=split).collect())
    assert got(False) == [(1, "u/a.png", "images/01.png"), (1, "u/b", "images/02.jpg"), (2, "u/c.gif?x=.y", "images/03.gif")]
    assert got(True) == [(1, "u/a.png", "images/01.png"), (1, "u/b", "images/02.jpg"), (2, "u/c.gif?x=.y", "images/01.gif")]
