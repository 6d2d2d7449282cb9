"""Histories, three-way merges, discovery and table functions against plain Python."""

import random

from pyspark.sql import functions as F

from tessera.operators import baseline, discover, history
from tessera.operators.dedup import distinct_in_order
from tessera.sources import functions, readers


def test_histories_equal_one_step_after_another(spark):
    r = random.Random(6)
    kinds = ["propose", "approve", "accept", "reject", "apply", "fail", "other", None]
    rows = [(r.choice(["hot", "hot", "hot", "a", "b", None]), i * r.choice([1, 1, 50]), r.choice(kinds)) for i in range(3000)] + [("tied", 5, "accept"), ("tied", 5, "propose")]
    machine = history.Machine()
    number = {e: i for i, e in enumerate(machine.events)}
    want = {}
    for key in {k for k, *_ in rows}:
        state, n, refused = "", 0, 0
        for _, e in sorted(((at, e) for k, at, e in rows if k == key), key=lambda x: (x[0], number.get(x[1], len(number)))):
            to = history.RECORD_MOVES.get((state, e))
            state, n, refused = state if to is None else to, n + 1, refused + (to is None)
        want[key] = (state, n, refused)
    df = spark.createDataFrame(rows, "k string, at long, what string").selectExpr("*", "'x' AS key", "1 AS span", "2 AS n")
    for bits, levels in ((3, 3), (10, 1), (20, 0)):
        got = {r.k: (r.state, r.n_events, r.n_refused) for r in history.fold_events(df, "k", "at", "what", bits=bits, levels=levels).collect()}
        assert got == want
    assert history.fold_events(df.limit(0), "k", "at", "what").count() == 0
    door = history.Machine({("shut", "push"): "open", ("open", "push"): "shut"}, "shut")
    assert [(r.state, r.n_refused) for r in history.fold_events(spark.range(7).selectExpr("1 AS k", "id AS at", "'push' AS e"), "k", "at", "e", door).collect()] == [("open", 0)]


def merged(b, o, t, fields):
    """One key's rows (dicts or None): the merged row, whether it is gone, conflicts and change."""
    by_us, by_them = o != b, t != b
    if o is None and t is None:
        return b, True, [], "both"
    if o is None or t is None:
        here = t if o is None else o
        if b is None:
            return here, False, [], "theirs" if o is None else "ours"
        if here == b:
            return b, True, [], "ours" if o is None else "theirs"
        return here, False, ["row"], "conflict"
    out, clash = {}, []
    for f in fields:
        x = None if b is None else b[f]
        same = b is not None
        if o[f] == t[f] or (same and t[f] == x):
            out[f] = o[f]
        elif same and o[f] == x:
            out[f] = t[f]
        else:
            out[f], clash = o[f], [*clash, f]
    return out, False, clash, "conflict" if clash else "both" if by_us and by_them else "ours" if by_us else "theirs" if by_them else "unchanged"


def test_three_versions_against_a_row_at_a_time(spark):
    from itertools import product

    states = [None, {"x": "1", "y": "1"}, {"x": "2", "y": "1"}, {"x": "1", "y": "2"}, {"x": None, "y": "3"}]
    cases = [c for c in product(states, repeat=3) if any(c)]
    keys = [*range(len(cases) - 1), None]
    frame = lambda at: spark.createDataFrame([(k, c[at]["x"], c[at]["y"]) for k, c in zip(keys, cases) if c[at]], "k long, x string, y string")
    b, o, t = frame(0), frame(1), frame(2)
    got = {r.k: ({"x": r.x, "y": r.y}, r.is_gone, r.conflicts, r.change) for r in baseline.merge_three(b, o, t, "k", ["x", "y"]).collect()}
    assert got == {k: merged(*c, ["x", "y"]) for k, c in zip(keys, cases)}
    settled = spark.createDataFrame([("applied",), ("rejected",)], "status string")
    free = baseline.refreshed(b, o, t, settled, "k", ["x", "y"]).collect()
    assert {r.k: ({"x": r.x, "y": r.y}, r.is_gone, r.conflicts, r.change) for r in free} == got and not any(r.was_refused for r in free)
    held = baseline.refreshed(b, o, t, settled.union(spark.createDataFrame([("accepted",)], "status string")), "k", ["x", "y"]).filter("NOT is_gone").collect()
    assert {r.k: (r.x, r.y) for r in held} == {k: (c[1]["x"], c[1]["y"]) for k, c in zip(keys, cases) if c[1]}
    assert baseline.merge_three(b.limit(0), o.limit(0), t.limit(0), "k", ["x", "y"]).count() == 0


def test_discovery_to_the_end(spark):
    r = random.Random(3)
    links = [(r.randrange(80), r.randrange(80)) for _ in range(110)] + [(1, 1), (2, None), (None, 3), (200, 201), (201, 200)] + [(i, i + 1) for i in range(300, 320)]
    seeds, want, front, n = {0, 1, 300}, {}, {0, 1, 300, 777}, 0
    while front:
        want |= dict.fromkeys(front, n)
        front, n = {b for a, b in links if a in front and b is not None and b not in want}, n + 1
    edges = spark.createDataFrame(links, "source long, target long")
    start = spark.createDataFrame([(x,) for x in [*seeds, 0, 777, None]], "url long")
    assert {x.url: x["round"] for x in discover.discovered(start, edges, "url").collect()} == want
    assert {x.url: x["round"] for x in discover.discovered(start, edges, "url", most=3).collect()} == {k: v for k, v in want.items() if v <= 3}
    assert discover.discovered(start.limit(0), edges, "url").count() == 0


def test_table_functions_from_sql(spark):
    import pytest

    functions.register(spark)
    pages = spark.createDataFrame([(1, "http://w.example/a/", '<title>T</title><a href="b">x</a><a href="/c"><img src="i.jpg">'), (2, None, None), (3, "u", "")], "k int, url string, html string")
    rows = spark.sql("SELECT k, place, href, address FROM {p}, LATERAL html_links(html, url)", p=pages).collect()
    assert [tuple(r) for r in sorted(rows)] == [(1, 0, "b", "http://w.example/a/b"), (1, 1, "/c", "http://w.example/c")]
    rows = spark.sql("SELECT k, page_title, n_links, n_images FROM {p}, LATERAL html_page(html)", p=pages).collect()
    assert [tuple(r) for r in sorted(rows)] == [(1, "T", 2, 1), (3, "", 0, 0)]
    with pytest.raises(Exception, match="html_links takes"):
        spark.sql("SELECT * FROM html_links(1)").collect()


def test_distinct_in_order_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("a", 5), ("b", 2), ("a", 1), (None, 9), (None, 7)], "k string, o int")
    assert {r.k: r.o for r in distinct_in_order(df, "k", "o").collect()} == {"a": 1, "b": 2, None: 7}
    (tmp_path / "x.csv").write_text('url,title\nhttp://a,"A, ""quoted"""\nhttp://b,\n', encoding="utf-8")
    got = [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "x.csv")).select("url", "title").collect()]
    assert got[0] == ("http://a", 'A, "quoted"') and got[1][0] == "http://b" and not got[1][1]


def test_streams_of_first_rows_and_windows(spark, tmp_path):
    """In batches of any cut: a key once within the delay, counts by window, rows behind the watermark left out."""
    from datetime import datetime, timedelta

    from tessera.streaming.changes import first_seen, windowed_counts

    start = datetime(2024, 1, 1)
    batches = [[("a", 0), ("a", 10), ("b", 20)], [("a", 30), ("c", 400)], [("d", 5), ("c", 410), ("e", 800)], [("f", 1200)]]
    src = str(tmp_path / "src")
    for i, rows in enumerate(batches):
        spark.createDataFrame([(k, start + timedelta(seconds=s)) for k, s in rows], "k string, at timestamp").coalesce(1).write.mode("append").parquet(src)
        for name, make in (("first", lambda s: first_seen(s, "k", "at", "60 seconds")), ("windows", lambda s: windowed_counts(s, "at", "k", "60 seconds", "100 seconds").select("window.start", "k", "n"))):
            stream = spark.readStream.schema("k string, at timestamp").parquet(src)
            q = make(stream).writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/ck_{name}").outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(120)
    first = sorted((r.k, (r["at"] - start).seconds) for r in spark.read.parquet(f"{tmp_path}/first").collect())
    assert [x for x in first if x[0] in "abcef"] == [("a", 0), ("b", 20), ("c", 400), ("e", 800), ("f", 1200)] and ("d", 5) not in first
    counts = sorted(((r.start - start).seconds, r.k, r.n) for r in spark.read.parquet(f"{tmp_path}/windows").collect())
    assert counts == [(0, "a", 3), (0, "b", 1), (400, "c", 2), (800, "e", 1)]


def test_discovery_through_shared_words_makes_no_pairs(spark):
    """Five hundred pages that all name one word, which five hundred lead on to: no step has their product."""
    from tessera.operators import discover

    start = spark.createDataFrame([(0,), (None,)], "k long")
    leads = spark.createDataFrame([(i, "w") for i in range(500)] + [(700, "x"), (0, None)], "source long, via string")
    lands = spark.createDataFrame([("w", i) for i in range(300, 800)] + [("x", 900), ("x", 0)], "via string, target long")
    got = {x.k: x["round"] for x in discover.discovered_through(start, leads, lands, "k").collect()}
    assert got == {0: 0, **dict.fromkeys(range(300, 800), 1), 900: 2}
    assert {x.k for x in discover.discovered_through(start, leads, lands, "k", most=1).collect()} == {0, *range(300, 800)}


def dealt(spark, name, path):
    """How many partitions hold rows of a query over one small file of parts."""
    from tessera import registry

    spark.range(400).selectExpr("id AS p_partkey").coalesce(1).write.parquet(f"{path}/part.parquet")
    return registry.QUERIES[name](spark, str(path)).groupBy(F.spark_partition_id()).count().count()


def test_images_of_many_pages_are_dealt_out(spark, tmp_path):
    assert dealt(spark, "project_images", tmp_path) >= 4


def test_fields_of_much_markdown_are_dealt_out(spark, tmp_path):
    assert dealt(spark, "markdown_fields", tmp_path) >= 4


def test_records_to_enrich_are_dealt_out(spark, tmp_path):
    assert dealt(spark, "records_enriched", tmp_path) >= 4


def planned(spark, name, path):
    """The optimized plan of a query over one part."""
    from tessera import registry

    spark.range(1).selectExpr("id AS p_partkey").write.parquet(f"{path}/part.parquet")
    return registry.QUERIES[name](spark, str(path))._jdf.queryExecution().optimizedPlan().toString()


def test_records_to_enrich_make_their_markdown_once(spark, tmp_path):
    """And put a line in small letters once for all words that it is searched for."""
    plan = planned(spark, "records_enriched", tmp_path)
    assert plan.count("|acrylic, ink, wood") == 1 and plan.count("lower(") < 40


def test_types_of_markdown_look_for_a_named_line_once(spark, tmp_path):
    plan = planned(spark, "markdown_fields", tmp_path)
    assert plan.count("group exhibition") == 2 and plan.count("lower(") < 40
