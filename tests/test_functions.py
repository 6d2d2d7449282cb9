from pyspark.sql import functions as F

from tessera.functions import normalize as N
from tessera.functions import predicates as P
from tessera.functions.text import slug, strip
from tessera.operators.repair import split_materials, split_type


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_strip_takes_what_a_pattern_of_white_space_takes(spark):
    """Each character of the basic plane, at both ends of a text and within it."""
    c = spark.createDataFrame([(chr(i),) for i in range(0x10000) if not 0xD800 <= i < 0xE000], "x string").selectExpr("concat(x, ' a', x, 'b', x, '\\n') AS c")
    assert c.filter(strip("c") != F.regexp_replace("c", r"(?U)^\s+|\s+$", "")).count() == 0


def test_strip_takes_all_white_space(spark):
    assert values(spark, [("　a\t\n",), (None,), ("",)], "c string", strip("c")) == [("a",), ("",), ("",)]


def test_normalize_year(spark):
    cases = {"April 26, 2024 — May 25, 2024": "2024", "September 2019": "2019", "2018 - 2022": "2018-2022", "2022, 2018": "2022-2018", "none": "none", "2018年": "2018年", "": "", "x12018": "x12018"}
    got = values(spark, [(k,) for k in cases], "c string", "c", N.normalize_year("c"))
    assert dict(got) == cases
    again = values(spark, [(v,) for v in cases.values()], "c string", "c", N.normalize_year("c"))
    assert all(a == b for a, b in again)


def test_normalize_type_follows_the_order_of_the_table(spark):
    cases = {
        "installation / 装置": ("Installation", ""),
        "Single channel video, color, projector, player": ("Video", "projector, player"),
        "Screen printing, chevron board, metal frame": ("Print", "chevron board, metal frame"),
        "videoinstallation": ("Video Installation", ""),
        "weaving": ("weaving", ""),
        "": ("", ""),
    }
    got = values(spark, [(k,) for k in cases], "c string", "c", N.normalize_type("c"))
    assert {k: tuple(v) for k, v in got} == cases


def test_titles(spark):
    cases = {("icon 2018 / 图标 2018", ""): ("icon 2018", "图标 2018"), ("404", "404 / 404"): ("404", "404"), ("bot / 观察者", "观察者 / 观察者"): ("bot", "观察者"), ("a / b", "c"): ("a / b", "c")}
    got = values(spark, list(cases), "a string, b string", "a", "b", N.clean_title("a", "b"))
    assert {(a, b): tuple(x) for a, b, x in got} == cases
    assert values(spark, [("video-installation x",)], "c string", N.title_case("c")) == [("Video-Installation X",)]
    assert values(spark, [("Vide / 空",), ("a / b",)], "c string", N.split_bilingual("c")) == [(("Vide", "空"),), (("a / b", ""),)]


def test_links(spark):
    base = "https://w.example"
    cases = {
        f"{base}/Title": True, f"{base}/": False, base: False, f"{base}/about": False, f"{base}/cv/": False, f"{base}/x/tag/y": False, "https://other.example/a": False,
        f"{base}/filter/installation": True, f"{base}/filter/video": False,
    }
    assert dict(values(spark, [(k,) for k in cases], "u string", "u", P.is_work_link("u", base))) == cases


def test_excluded_words_are_substrings(spark):
    cases = [("Exhibition", None, False), ("notebook", None, False), ("", "Talk", False), ("Installation", None, True), (None, None, True), ("展览", None, True)]
    assert values(spark, cases, "t string, c string, ok boolean", P.is_work("t", "c")) == [(x[2],) for x in cases]


def test_line_predicates(spark):
    assert values(spark, [("Photo: Ann",), ("acrylic, wood",), ("concept: " + "x" * 100,)], "c string", P.is_credits_line("c")) == [(True,), (False,), (False,)]
    assert values(spark, [("video installation / 视频装置",), ("Guard",), ("",)], "c string", P.is_type_name("c")) == [(True,), (False,), (False,)]
    assert values(spark, [("N/A",), ("-",), ("wood",)], "c string", P.is_empty_material("c")) == [(True,), (True,), (False,)]
    assert values(spark, [("21.02.2014 - 15.03.2014",), ("3 May",), ("4'30''",)], "c string", P.is_date_as_duration("c")) == [(True,), (True,), (False,)]


def test_title_and_slug(spark):
    rows = [("https://w.example/one-two-three", "Two, One!"), ("https://w.example/a-aa-aaa", "a, aa, aaa"), ("https://w.example/x-y", "空"), ("https://w.example/alpha", "beta")]
    assert values(spark, rows, "u string, t string", P.slug_matches_title("u", "t")) == [(True,), (True,), (False,), (False,)]
    assert values(spark, rows, "u string, t string", slug("u"))[0] == ("one-two-three",)


def test_split_fields(spark):
    rows = [("wood, video 43'', 30 x 40 cm",), ("Dimensions variable / 尺寸可变",), ("",), ("paper; ink, 10 min",)]
    got = [tuple(x[0]) for x in values(spark, rows, "c string", split_materials("c"))]
    assert got[0][1:] == ("30 x 40 cm", "43''") and got[1] == ("", "Dimensions variable / 尺寸可变", "") and got[2] == ("", "", "") and got[3] == ("paper; ink", "", "10 min")
    kinds = [tuple(x[0]) for x in values(spark, [("video, 12 minutes",), ("http://x",), ("installation 76cm × 30cm",), ("Photo: Ann",)], "c string", split_type("c"))]
    assert kinds[0] == ("video", "12 minutes", "") and kinds[1] == ("", "", "") and kinds[2] == ("installation", "", "76cm × 30cm") and kinds[3] == ("", "", "")


def test_udfs(spark):
    from difflib import SequenceMatcher

    from tessera.functions.udfs import is_title_cased, seq_ratio, url_join, with_similar, with_title_check

    df = spark.createDataFrame([("one ritual", "two rituals"), ("Same", "same!"), (None, "x")], "a string, b string")
    got = df.select(seq_ratio("a", "b"), is_title_cased("a"), url_join(F.lit("http://x.example/a/"), "b")).collect()
    assert abs(got[0][0] - SequenceMatcher(None, "one ritual", "two rituals").ratio()) < 1e-12 and got[2][0] is None
    assert got[1][1] is True and got[0][2] == "http://x.example/a/two rituals"
    assert {r.a: r.s for r in with_similar(df, "a", "b", "s").collect()} == {"one ritual": True, "Same": True, None: False}
    pages = spark.createDataFrame([("http://x.example/one-two", "One"), ("http://x.example/obj", "video installation"), ("http://x.example/alpha", "alphas")], "url string, title string")
    assert {r.title: r.ok for r in with_title_check(pages, "url", "title", "ok").collect()} == {"One": True, "video installation": False, "alphas": True}


def test_capitals_of_single_characters(spark):
    from tessera.functions.text import upper_each

    got = spark.createDataFrame([("straße ŉ ﬁ é",), ("",), (None,)], "t string").select(upper_each("t").alias("u")).collect()
    assert [r.u for r in got] == ["STRAẞE ŉ ﬁ É", "", ""]
