"""Pages that leave out end tags keep all of their text."""

import pytest

from tessera.llm import html_extract as h


def texts(page):
    return [t for n in h.parse(page) for _, t in n.texts]


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>T</title><meta charset=utf-8><body><p>Kept.</p>", "<head><title>T</title><link rel=x><p>Kept.</p>", "<head><title>T</title>\n Kept.",
        "<head><script>var a = '<head>';</script></head><body><p>Kept.</p>", "<head><script>if (a<b) c = \"'\";</script><style>a<b'{}</style></head><body><p>Kept.</p>",
        "<head><template><p>no</p></head><body><p>Kept.</p>", "<head><noframes>no</noframes></head><p>Kept.</p>", "<div><object><p>no</p></div><p>Kept.</p>", "<div><video><source src=x></div><p>Kept.</p>",
        "<ul><li><video src=x><li>Kept.</ul>", "<p><video src=x><p>Kept.", "<datalist><option>no<option>no</datalist><p>Kept.</p>", "<div><svg><svg/><title>no</title></svg><p>Kept.</p></div>",
        "<div><object><script>'</object>'</script>no</object><p>Kept.</p></div>", "<p>Kept.<script>if (a<b) c = \"'\";</script></p>",
    ],
)
def test_text_after_unclosed_elements(page):
    assert texts(page) == ["Kept."]


def test_skipped_elements_have_no_text():
    assert texts("<head><title>no</title><style>no</style></head><div><video><p>no</p></video><select><option>no<option>no</select><object><div>no</div></object></div>") == []


def test_end_tags_are_found_after_characters_that_lengthen_in_lower_case():
    page = "<p>" + "İ" * 30 + "</p><script>x</script><p>Kept.</p><p>Too.</p>"
    assert texts(page) == texts(page + " " * (1 << 16)) == ["İ" * 30, "Kept.", "Too."]


def test_quotes_count_after_equals_signs_only():
    assert texts("<p title=don't>Kept.</p><p title = 'a > b' x>Too.</p><p it's>And this.</p>") == ["Kept.", "Too.", "And this."]
    assert texts('<p title="never closed>Kept.</p>') == ["Kept."] and texts("<p>Kept.</p><a href=") == ["Kept."]


@pytest.mark.parametrize("unit", ['<a "', "<a ='", "<a =", "<!--", "<!", "<p x=\"'\">a", "<script>", "<svg><title>", "<option>", "<li>", "</div>", "<object>", "<div><video></section></video>", "<div></section>", "<td><p>"])
def test_a_megabyte_of_anything_takes_linear_time(unit):
    import time

    took = []
    for size in (125_000, 1_000_000):
        page = unit * (size // len(unit))
        began = time.process_time()
        h.parse(page)
        took.append(time.process_time() - began)
    assert took[1] < 20 * max(took[0], 0.02)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "u", "<p>One text. It goes on here.</p>", "x"), (1, "u", "<p>One text. It goes on here.</p>", "x"), (2, None, None, "y"), (None, "v", "", "z"), (3, "w", "<p>" + "A sentence of words, and more. " * 40_000 + "</p>", "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string").selectExpr("*", "'n' AS n_chars", "1 AS t", "2 AS id")


def test_pages_of_all_kinds(pages):
    model = h.default_model()
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    expected = sorted(((i, u, x, len(x)) for i, u, page in rows for x in [h.main_text(page or "", model)]), key=repr)
    assert sorted((tuple(r) for r in h.extract_text(pages).collect()), key=repr) == expected and max(n for *_, n in expected) == 31 * 40_000 - 1
    assert h.extract_text(pages.filter("page_id < 0")).count() == 0
