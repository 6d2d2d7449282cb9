from datetime import datetime

from pyspark.sql import functions as F

from tessera.functions.normalize import sort_year
from tessera.operators import audit, changes, dedup, merge, repair, review, sections, stats

WORK = "_ordinal long, url string, title string, materials string, description_en string, description_cn string"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_keep_first_drops_blank_keys_and_is_idempotent(spark):
    df = spark.createDataFrame([(2, "a"), (1, "a"), (3, ""), (4, None), (5, "b")], "o long, url string")
    once = dedup.keep_first(df, "url", ["o"])
    assert rows(once, "o", "url") == [(1, "a"), (5, "b")] == rows(dedup.keep_first(once, "url", ["o"]), "o", "url")


def test_contamination(spark):
    mat, desc = "acrylic, wood, metal frame", "A description that is long enough to be compared by Alpha"
    df = spark.createDataFrame(
        [(i, f"http://x.example/w{i}", t, m, d, "") for i, (t, m, d) in enumerate([("Alpha", mat, desc), ("Beta", mat, desc), ("Gamma", mat, "other words here"), ("Delta", "ink on paper", "")])], WORK
    )
    once = dedup.clear_contamination(df)
    assert rows(once.filter("materials <> ''"), "title") == [("Alpha",), ("Delta",)]
    assert rows(once.filter("length(description_en) > 30"), "title") == [("Alpha",)]
    assert once.agg(F.sum("n_cleared")).first()[0] == 3
    assert dedup.clear_contamination(once.drop("n_cleared")).agg(F.sum("n_cleared")).first()[0] == 0


def test_changes(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", ""), ("d", "4")], "url string, lastmod string")
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "9"), ("gone", "1")], "url string, lastmod string")
    assert rows(changes.changed(now, old), "url", "change") == [("b", "modified"), ("d", "new")]
    assert changes.changed(now, now).isEmpty()
    assert rows(changes.removed(now, old), "url") == [("gone",)]
    stamped = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2023, 12, 31, 23))], "id long, at timestamp")
    assert rows(changes.fresh(stamped, "at", F.lit(datetime(2024, 1, 2))), "id") == [(1,)]
    last = spark.createDataFrame([("a", "1", 1), ("a", "2", 2)], "url string, lastmod string, o long")
    assert rows(changes.last_version(last, "url", "o"), "url", "lastmod") == [("a", "2")]


def test_proposed_merge_keeps_formatting(spark):
    old = spark.createDataFrame([("u", "a  b", "x", "")], "k string, same string, changed string, empty string")
    new = spark.createDataFrame([("u", "a b", "y", " "), ("v", "1", "2", "3")], "k string, same string, changed string, empty string")
    assert rows(merge.upsert_proposed(old, new, "k", ["same", "changed", "empty"]), "k", "same", "changed", "empty", "is_update") == [("u", "a  b", "y", "", True), ("v", "1", "2", "3", False)]


def test_hybrid_merge(spark):
    df = spark.createDataFrame([("http://x.example/my-work", "My Work", "old", "")], "url string, title string, materials string, credits string")
    none = F.lit("")
    l1 = dict.fromkeys(("title_cn", "size", "duration", "description_en", "description_cn", "year", "type"), none) | {c: F.col(c) for c in ("title", "materials", "credits")}
    l2 = dict.fromkeys(l1, none) | {"title": F.lit("Foreign"), "materials": F.lit("wood"), "size": F.lit("3 x 4 cm"), "year": F.lit("2001"), "description_en": F.lit("made possible by friends")}
    yes = F.lit(True)
    out = merge.hybrid_merge(l1, l2, yes, yes, F.lit(False), F.lit(False), F.col("url"))
    assert rows(df, *[out[c].alias(c) for c in ("title", "materials", "size", "year", "credits", "source")]) == [("My Work", "old", "3 x 4 cm", "2001", "", "hybrid_layer2")]
    out = merge.hybrid_merge(l1, l2 | {"title": F.lit("My work")}, yes, yes, yes, yes, F.col("url"))
    assert rows(df, *[out[c].alias(c) for c in ("title", "materials", "credits", "description_en")]) == [("My work", "wood", "made possible by friends", "")]


def test_repairs(spark):
    df = spark.createDataFrame([("Photo: Ann", "http://x", "", ""), ("Dimension variable", "video", "", "")], "materials string, type string, credits string, size string")
    got = rows(repair.repair_credits(df), "materials", "type", "credits", "size", "changes")
    assert got == [("", "", "Photo: Ann", "", ["materials_to_credits", "type_url"]), ("", "video", "", "Dimension variable", ["materials_to_size"])]


def test_stats_of_no_rows(spark):
    empty = spark.createDataFrame([], "a string")
    assert rows(stats.fill_rates(empty, ["a"]), "total", "a_n", "a_pct") == [(0, 0, 0.0)]


def test_sections_repeat_headers(spark):
    df = spark.createDataFrame([(1, "2020"), (2, "2020"), (3, "2018-2020"), (4, "2020")], "o long, year string")
    assert rows(sections.sections(df, "year", [F.col("o")]), "o", "section") == [(1, 1), (2, 1), (3, 2), (4, 3)]


def test_order_over_all_rows(spark):
    import random

    r = random.Random(7)
    data = [(o, r.choice(["2018", "2018-2020", "2020", None, ""]), r.randrange(5), r.choice([None, None, None, "x", "y"])) for o in r.sample(range(-40, 90), 80)]
    df = spark.createDataFrame(data, "o long, year string, n long, v string").repartition(5)
    end = lambda y: y.split("-")[-1] if y else "0000"
    by_year, by_order = sorted(sorted(data), key=lambda x: end(x[1]), reverse=True), sorted(data)
    breaks = [i == 0 or x[1] != by_year[i - 1][1] for i, x in enumerate(by_year)]
    got = sections.placed(df, "year", sort_year("year"), "o", bits=2)
    assert rows(got.orderBy("place"), "place", "o", "is_break") == sorted(((i, x[0], b) for i, (x, b) in enumerate(zip(by_year, breaks, strict=True), 1)), key=repr)
    last, total, expected = None, 0, []
    for o, _, n, v in by_order:
        last = v if v is not None else last
        expected.append((o, last, total))
        total += n
    got = sections.added_up(sections.carried(df, "v", "o", "carried", bits=2), "n", "o", "before", bits=2)
    assert rows(got, "o", "carried", "before") == sorted(expected, key=repr)
    none = df.filter("o > 1000")
    assert sections.placed(none, "year", sort_year("year"), "o").count() == sections.carried(none, "v", "o", "c").count() == sections.added_up(none, "n", "o", "b").count() == 0


def test_gate_takes_the_first_reason(spark):
    base = {"title": "My work", "type": "Installation", "year": "2001", "materials": "", "description_en": "", "description_cn": ""}
    cases = [
        ({}, {}, True, True, ("artwork", True, "")), ({}, {}, False, True, ("exhibition", False, "Local parser marked page as non-artwork")),
        ({}, {"page_type": "exhibition"}, True, True, ("exhibition", False, "AI classified page as exhibition")), ({}, {}, True, False, ("artwork", False, "AI unavailable")),
        ({"title": "Video installation"}, {}, True, True, ("artwork", False, "Title looks like an artwork type, not a title")),
        ({"title": "Something else"}, {}, True, True, ("artwork", False, "Title does not match URL slug")),
        ({"materials": "see selected works"}, {}, True, True, ("artwork", False, "Materials field looks contaminated by unrelated page content")),
        ({"type": ""}, {}, True, True, ("artwork", False, "Artwork record is missing required fields")),
        ({}, {"confidence": 0.5}, True, True, ("artwork", False, "Confidence below threshold (0.50)")),
    ]
    one = spark.range(1)
    for p, v, work, available, expected in cases:
        proposed = {k: F.lit(x) for k, x in (base | p).items()} | {"images": F.array().cast("array<string>")}
        verdict = {k: F.lit(x) for k, x in ({"page_type": "artwork", "should_apply": True, "confidence": 0.9, "reason": ""} | v).items()}
        got = one.select(review.gate(F.lit("http://x.example/my-work"), F.lit("My work"), proposed, verdict, F.lit(work), F.lit(available))).first()[0]
        assert tuple(got) == expected


def test_review_transitions(spark):
    batches = spark.createDataFrame([(1, "incremental", "reviewing"), (2, "manual", "completed")], "id long, mode string, status string")
    records = spark.createDataFrame([(1, 1, "u1", "needs_review", "t"), (2, 1, "u2", "ready_for_review", "t"), (3, 2, "u3", "applied", "t")], "id long, batch_id long, url string, status string, updated_at string")
    decided = review.decide(records, spark.createDataFrame([(1,)], "id long"), "rejected", F.lit("now"))
    assert rows(review.rejected_urls(decided, batches), "url") == [("u1",)]
    left, kept = review.prune_terminal(batches, decided)
    assert rows(left, "id") == [(1,)] and rows(kept, "id") == [(1,), (2,)]
    assert review.has_active_review(records) and [r.id for r in review.list_records(records, ["needs_review", "applied"]).collect()] == [3, 1]


def test_audit(spark):
    expected = spark.createDataFrame([("a", "2024", "A", "一"), ("b", "2023", "B", ""), ("c", "2022", "C", "")], "url string, year string, title string, title_cn string")
    published = spark.createDataFrame([("a", "2024", "A", ""), ("b", "2024", "B ", "")], "url string, year string, title string, title_cn string")
    assert rows(audit.audit(expected, published), "url", "is_missing", "bad_year", "bad_title", "bad_title_cn") == [("a", False, False, False, True), ("b", False, True, False, False), ("c", True, False, False, False)]


def test_changes_of_repeated_urls(spark, tmp_path):
    """Several pages can have one URL."""
    from tessera import registry

    now = spark.createDataFrame([("a", "3"), ("a", "2"), ("n", "1")], "url string, lastmod string")
    old = spark.createDataFrame([("a", "1"), ("a", "2")], "url string, lastmod string")
    assert rows(changes.changed(now, old), "url", "lastmod", "change") == [("a", "3", "modified"), ("n", "1", "new")]
    assert rows(changes.changed(now, old, every=True), "url", "lastmod", "change") == [("a", "2", "modified"), ("a", "3", "modified"), ("a", "3", "modified"), ("n", "1", "new")]
    spark.createDataFrame([(1, "a"), (2, "a"), (9, "b")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert rows(registry.QUERIES["snapshot_changes"](spark, str(tmp_path)), "url", "lastmod") == [("a", "2024-01-11"), ("a", "2024-01-12")]


def test_removed_pages_of_repeated_urls(spark, tmp_path):
    from tessera import registry

    spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "a"), (5, "b")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert rows(registry.QUERIES["snapshot_removed"](spark, str(tmp_path)), "url") == [("a",), ("a",), ("b",)]


def test_pages_without_ids_are_not_removed(spark, tmp_path):
    from tessera import registry

    spark.createDataFrame([(1, "a"), (None, "a"), (None, "n"), (6, "c"), (7, None)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.url for r in registry.QUERIES["snapshot_removed"](spark, str(tmp_path)).collect()} == {"a", None}
    assert registry.QUERIES["snapshot_removed"](spark, str(tmp_path)).count() == 2
