"""Whole reports as files, and answers beyond what their queries generate."""

import pathlib

from tessera.sources import answers, reports


def items(spark, n):
    rows = [(i * 10, f"Work {i}" if i % 5 else ("a/b: ü?" * 12 if i else None), "", "2001", "Video", "", "", "", "", f"u{i}", "", "", "", [f"http://i/{i % 3}.png", "http://i/x"], None) for i in range(n)]
    shape = "_ordinal long, title string, title_cn string, year string, type string, materials string, size string, duration string, video_link string, url string, description_en string, description_cn string, error string, images array<string>, high_res_images array<string>"
    return spark.createDataFrame(rows, shape)


def test_report_in_parts_is_the_report(spark, tmp_path):
    from pyspark.sql import functions as F

    df = reports.merged_report(items(spark, 40), F.lit("now"), F.lit("full"))
    rows = sorted((r.place, r.text) for r in df.collect())
    assert [p for p, _ in rows] == list(range(41)) and rows[0][1].startswith("# Artwork") and "**Mode / 提取模式:** FULL\n> **Total / 作品数量:** 40\n" in rows[0][1]
    assert "./images/01.png" in rows[1][1] and "./images/02.jpg" in rows[2][1] and "./images/02.jpg" in rows[40][1]
    reports.write_ordered_text(df.repartition(5), str(tmp_path / "r"), parts=6)
    files = sorted(pathlib.Path(tmp_path / "r").glob("part-*"))
    assert len(files) > 2 and "".join(f.read_text() for f in files) == "".join(t for _, t in rows)
    assert [r.text.count("\n") for r in reports.merged_report(items(spark, 0).limit(0), F.lit("now"), F.lit("full")).collect()] == [8]


def test_split_reports_have_paths_of_their_own(spark):
    from pyspark.sql import functions as F

    each, index = reports.split_report(items(spark, 12), F.lit("now"), F.lit("quick"))
    paths = sorted(r.path for r in each.collect())
    assert len(set(paths)) == 12 and paths[0] == "01_artwork_1/report.md" and paths[5] == "06_" + ("a_b_ ü_" * 12)[:50] + "/report.md"
    lines = [r.text for r in index.orderBy("place").collect()]
    assert lines[0].endswith("## Contents / 目录\n\n") and lines[2] == "2. [Work 1](./02_Work 1/report.md)\n"


def test_searches_count_cached_rows_in_their_limit(spark):
    wanted = spark.createDataFrame([(f"u{i}", i) for i in range(6)], "url string, place int")
    cache = spark.createDataFrame([("u1", "one"), ("u5", "five")], "url string, title string")
    done = '{"status": "completed", "data": {"title": "", "images": ["i"], "url": "other"}}'
    jobs = spark.createDataFrame([("u0", 200, '{"success": true}', done), ("u2", None, None, None), ("u3", 200, "no json", "x"), ("u4", 200, '{"success": true}', done)], "url string, code int, submitted string, status string")
    got = sorted((r.url, r.title, r.error, r.from_cache, r.to_cache) for r in answers.searched(wanted, cache, jobs, "place", limit=4).collect())
    assert got == [("other", "", "", False, True), ("u1", "one", "", True, False), ("u2", "[Error: Submit Failed]", "HTTP ", False, False), ("u3", "[Error: API Failed]", "no json", False, False)]


def test_stored_and_cached_works_of_odd_rows(spark):
    rows = [('{"url": "a", "type": "EXHIBITION"}',), (' {"url": "b", "year": 2001}',), ("[1]",), (None,), ("{",), ("",)]
    assert [(r.url, r.year, r.title) for r in answers.stored_works(spark.createDataFrame(rows, "json string")).collect() if r.url] == [("b", "2001", "")]
    rows = [("x.pkl", "u"), ("extract_x.pkl", "u"), ("x.txt", "u"), (None, "u"), ("y.pkl", " "), ("z.pkl", None)]
    assert answers.cached_works(spark.createDataFrame(rows, "entry string, url string")).count() == 2
