import json

from pyspark.sql import types as T

from tessera import schemas
from tessera.plans.pipeline import Plan, pages_to_visit, publishable, works_of_pages
from tessera.sources import readers, sinks
from tessera.streaming.changes import follow_snapshots

PAGE = """<html><head><title>t</title></head><body><div class="project_title">Name / 名字</div>
<span class="tags"><a href="http://w.example/filter/installation">installation</a> <a href="http://w.example/filter/2019">2019</a></span>
<div class="project_content">2019<br>Photo: Ann<br>acrylic, wood, paper<br>30 x 40 cm<br>4'30''<br>
This long sentence describes what the visitors of the room will find when they enter it, slowly.
<img src="/a.jpg" src_o="/big.jpg"><a href="https://vimeo.com/1">v</a></div></body></html>"""


def test_sitemap(spark, tmp_path):
    xml = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> http://w.example/a </loc><lastmod>2024-01-01</lastmod></url><url><loc>http://w.example/b</loc></url><url><loc>http://w.example/about</loc></url></urlset>'
    (tmp_path / "s.xml").write_text(xml)
    got = readers.read_sitemap(spark, str(tmp_path / "s.xml"))
    assert sorted(tuple(r) for r in got.select("url", "lastmod").collect()) == [("http://w.example/a", "2024-01-01"), ("http://w.example/about", ""), ("http://w.example/b", "")]
    assert pages_to_visit(got, None, Plan("http://w.example")).count() == 2
    assert pages_to_visit(got, got, Plan("http://w.example")).isEmpty()


def test_page_to_published_work(spark, tmp_path):
    pages = spark.createDataFrame([("http://w.example/name", PAGE), ("http://w.example/none", "<p>x"), ("http://w.example/null", None)], "url string, html string")
    works = works_of_pages(pages, Plan("http://w.example"))
    works.write.parquet(f"{tmp_path}/extracted")
    works = spark.read.parquet(f"{tmp_path}/extracted")
    row = works.first()
    assert works.count() == 1 and (row.title, row.title_cn, row.year, row.type, row.size, row.duration) == ("Name", "名字", "2019", "Installation", "30 x 40 cm", "4'30''")
    assert row.materials == "acrylic, wood, paper" and row.credits == "Photo: Ann" and row.video_link == "https://vimeo.com/1"
    assert row.images == ["http://w.example/big.jpg"] and "describes" in row.description_en
    out = publishable(works, readers.empty_works(spark).drop("_ordinal"))
    sinks.check_works(out)
    flat = publishable(works, readers.empty_works(spark)).select("_ordinal", *schemas.WORK.fieldNames())
    sinks.write_works_json(flat, f"file://{tmp_path}/works.json")
    assert json.loads((tmp_path / "works.json").read_text())[0]["title_cn"] == "名字"
    assert "名字" in (tmp_path / "works.json").read_text()
    sinks.write_portfolio(flat, f"file://{tmp_path}/works.md")
    text = (tmp_path / "works.md").read_text()
    assert "## 2019" in text and "### [Name](http://w.example/name) / 名字" in text
    lines = spark.createDataFrame(list(enumerate(text.split("\n"))), "line_no long, value string")
    assert [tuple(r) for r in readers.parse_markdown(lines).select("url", "year", "title", "title_cn").collect()] == [("http://w.example/name", "2019", "Name", "名字")]
    assert readers.read_works(spark, f"file://{tmp_path}/works.json").first().year == "2019"


def test_published_order_is_whole_numbers(spark, tmp_path):
    """New works first by URL, then old ones in their order; written by the sinks as they come out of the plan."""
    work = lambda url, year, i: {f: "" for f in schemas.WORK.fieldNames()} | {"url": url, "title": url, "year": year, "images": [], "high_res_images": [], "_ordinal": i}
    shape = T.StructType([*schemas.WORK.fields, T.StructField("_ordinal", T.LongType())])
    old = spark.createDataFrame([work(f"o{i}", str(2000 + i % 3), 50 - i) for i in range(40)] + [work("n3", "1999", 7)], shape)
    new = spark.createDataFrame([work(f"n{i}", "2005", None) for i in range(9, 0, -1)], shape)
    for fresh in (new.drop("_ordinal"), new):
        out = publishable(fresh, old)
        got = [(r.url, r["_ordinal"]) for r in out.orderBy("_ordinal").collect()]
        assert got == [(u, i) for i, u in enumerate([f"n{i}" for i in range(1, 10)] + [f"o{i}" for i in range(39, -1, -1)])]
    sinks.write_portfolio(out, f"file://{tmp_path}/works.md")
    sinks.write_works_json(out, f"file://{tmp_path}/works.json")
    entries = [x for x in (tmp_path / "works.md").read_text().split("\n") if x.startswith("#")]
    assert entries[:3] == ["# Portfolio", "## 2005", "### [n1](n1)"] and len(entries) == 1 + 4 + 49
    assert len(json.loads((tmp_path / "works.json").read_text())) == 49
    assert [tuple(r) for r in sinks.image_files(out).collect()] == []


def test_ranks_over_all_rows(spark):
    from pyspark.sql import functions as F

    from tessera.operators.sections import ranked

    df = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("k"), (F.col("id") % 3).cast("string").alias("a"))
    rows = ranked(df, [F.col("a"), F.col("k")], "place", ranges=9, sample=4).collect()
    assert [(r.a, r.k) for r in sorted(rows, key=lambda r: r.place)] == sorted((r.a, r.k) for r in rows) and sorted(r.place for r in rows) == list(range(3000))
    assert ranked(df.limit(0), [F.col("k")], "place").count() == 0


def test_provider_answers(spark):
    rows = [("a", '{"success": true, "data": {"extract": {"title": "T", "category": "Video"}}}'), ("b", '{"success": true, "data": {"json": {"title": "J", "type": "Print"}}}'), ("c", "broken")]
    got = {r.url: (r.success, r.title, r.type) for r in readers.parse_answers(spark.createDataFrame(rows, "url string, json string")).collect()}
    assert got == {"a": (True, "T", "Video"), "b": (True, "J", "Print"), "c": (False, "", "")}
    links = spark.createDataFrame([('{"links": ["http://b", {"url": "http://a"}, "http://b"]}',)], "json string")
    assert [r.url for r in readers.links_of_map(links).collect()] == ["http://a", "http://b"]


def test_stream_of_snapshots(spark, tmp_path):
    src, store, out, ck = (f"{tmp_path}/{x}" for x in ("src", "store", "out", "ck"))
    for i, rows in enumerate(([("a", "1"), ("b", "1")], [("a", "2"), ("b", "1"), ("c", "1")])):
        spark.createDataFrame(rows, schemas.SNAPSHOT).coalesce(1).write.mode("append").parquet(src)
        q = follow_snapshots(spark, src, "url string, lastmod string", store, out, ck)
        q.awaitTermination(120)
        got = sorted((r.url, r.change) for r in spark.read.parquet(f"{out}/batch={i}").collect())
        assert got == ([("a", "new"), ("b", "new")], [("a", "modified"), ("c", "new")])[i]


def test_years_of_headings_are_whole_numbers(spark):
    lines = spark.createDataFrame([(1, "## 10000"), (2, "### [A](http://w.example/a)"), (3, "## 2019-2020"), (4, "### [B](http://w.example/b)")], "line_no long, value string")
    assert sorted((r.url, r.year) for r in readers.parse_markdown(lines).collect()) == [("http://w.example/a", "10000"), ("http://w.example/b", "2019")]
