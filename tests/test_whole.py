"""Queries and operators that run over the whole of their input, by fixtures and brute force."""

import html
import re

from tessera import registry


def test_page_parts_has_every_page(spark, tmp_path):
    pages = [
        (1, "https://a.example/1", '<title>A &amp; B</title><a href="/x">x</a><a href="">none</a>'), (2, "https://a.example/2", "<title>&quot;C&quot; &amp D</title>"),
        (3, "https://a.example/3", '<title> plain </title><a href="/y">y</a>'), (4, "https://a.example/3", '<p>no title</p><a href="/y">y</a><a href="/z">z</a>'), (5, None, None),
    ]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    title = lambda h: html.unescape((re.findall("<title>(.*?)</title>", h) or [""])[0]).strip()
    expected = [(p, title(h or ""), len(re.findall('<a href="[^"]+"', h or ""))) for p, _, h in pages]
    got = registry.QUERIES["page_parts"](spark, str(tmp_path)).select("page_id", "title_raw", "n_links").collect()
    assert sorted(tuple(r) for r in got) == expected


def test_materials_by_position(spark):
    from tessera.operators.extract import extract_works
    from tessera.sources.html import parse_pages

    bodies = [
        ("Head<br>Sculpture<br>30 x 40 cm<br>bronze", "Sculpture", "bronze"),  # one material
        ("HEAD / 头<br>https://w.example/<br>Dimensions variable<br>2019<br>silicone<br>paper, ink, wood", "", "silicone"),  # the first by place
        ("Head<br>Video<br>This is the work with glass.<br>ink", "Video", "ink"),  # no sentences
        ("Head<br>ink<br>Video", "Video", "ink"),  # the block ends at the materials; the type line is found later
        ("Head<br>2019<br>a<br>b<br>c<br>d<br>bronze", "", ""),  # beyond the block: one material is not enough
        ("bronze, paper, oil<br>Installation<br>2020<br>acrylic, wood, paper", "Installation", "acrylic, wood, paper"),  # no title line: after the type line
        ("bronze, paper, oil<br>other", "", "bronze, paper, oil"),  # neither: any line
    ]
    page = '<div class="project_title">Head</div><div class="project_content">{}</div>'
    df = spark.createDataFrame([(str(i), page.format(b)) for i, (b, _, _) in enumerate(bodies)], "url string, html string")
    got = {r.url: (r.type, r.materials) for r in extract_works(parse_pages(df)).select("url", "type", "materials").collect()}
    assert got == {str(i): (t, m) for i, (_, t, m) in enumerate(bodies)}
