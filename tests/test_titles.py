"""The similarity join against comparing each title with each."""

import random
from difflib import SequenceMatcher

import pytest

from tessera.operators.similar import similar_pairs


def titles(n, seed):
    r = random.Random(seed)
    letters = "abcdefgh éß字-"
    out = ["", " ", None, "a", "ab", "ba", "aa", "aaaa", "aaab", "same title here", "same title here", "x" * 90, "x" * 89 + "y"]
    while len(out) < n:
        base = r.choice(out) if r.random() < 0.5 and out else ""
        text = list(base or "".join(r.choice(letters) for _ in range(r.randrange(1, 40))))
        for _ in range(r.randrange(3)):
            at = r.randrange(len(text) + 1)
            text[at : at + r.randrange(2)] = r.choice(letters) * r.randrange(2)
        out.append("".join(text))
    return out


@pytest.mark.parametrize("least", [0.7, 0.8, 0.9, 1.0])
def test_pairs_equal_all_pairs(spark, least):
    left, right = titles(110, 1), titles(120, 2)
    frame = lambda ts: spark.createDataFrame(list(enumerate(ts)), "k long, title string")
    got = {(r.left_id, r.right_id): r.ratio for r in similar_pairs(frame(left), frame(right), "k", "title", least).collect()}
    want = {(i, j): x for i, a in enumerate(left) for j, b in enumerate(right) if a and b and a.strip() and b.strip() for x in [SequenceMatcher(None, a, b).ratio()] if x >= least}
    assert got == want and len(want) > 10


def test_pairs_of_edge_rows(spark):
    df = spark.createDataFrame([(None, "one title"), (1, "one title"), (1, "one title"), (2, None), (3, "")], "k long, title string").selectExpr("*", "'x' AS id", "'y' AS t", "1 AS n", "2 AS n_")
    got = sorted(((r.left_id, r.right_id, r.ratio) for r in similar_pairs(df, df, "k", "title").distinct().collect()), key=repr)
    assert got == sorted([(a, b, 1.0) for a in (None, 1) for b in (None, 1)], key=repr)
    assert similar_pairs(df.limit(0), df, "k", "title").count() == 0
    with pytest.raises(ValueError):
        similar_pairs(df, df, "k", "title", 0.5)


def test_plan_has_no_product_of_rows(spark):
    df = spark.range(50).selectExpr("id AS k", "CAST(id AS string) AS title")
    plan = similar_pairs(df, df, "k", "title")._jdf.queryExecution().executedPlan().toString()
    # The only nested loops are with the one row of frequent grams.
    assert "CartesianProduct" not in plan


def test_copies_are_joined_once_and_dealt_out(spark, monkeypatch):
    from tessera.operators import similar

    monkeypatch.setattr(similar, "PART", 16)
    base = "A title that many pages have, with some words of its own"
    left = [(i, base if i % 3 else base + "!") for i in range(300)]
    df = spark.createDataFrame(left, "k long, title string").repartition(3)
    got = sorted((r.left_id, r.right_id) for r in similar_pairs(df, df, "k", "title").collect())
    assert got == [(i, j) for i in range(300) for j in range(300)]
    texts = df.selectExpr("title AS t").distinct()
    assert similar_pairs(df, df, "k", "title").filter("ratio < 1").count() == 2 * 100 * 200 and texts.count() == 2


def written(spark):
    """Rows and bytes that stages have written for later ones."""
    sc = spark.sparkContext
    none = sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
    return [sum(f(stages.apply(i)) for i in range(stages.size())) for f in (lambda s: s.shuffleWriteRecords(), lambda s: s.shuffleWriteBytes())]


def test_what_is_written_grows_with_the_texts(spark):
    """Texts of the same words in another order have nearly all grams in common, so all meet; they need not be written as pairs."""
    words = "alder birch cedar elder hazel larch maple olive rowan yew".split()

    def turned(n):
        r = random.Random(n)
        return list({" ".join(r.sample(words, len(words))): i for i in range(n)}.items())

    rows = []
    for n in (60, 240):
        df = spark.createDataFrame(turned(n), "title string, k long")
        before = written(spark)[0]
        got = {(r.left_id, r.right_id) for r in similar_pairs(df, df, "k", "title").collect()}
        rows.append(written(spark)[0] - before)
        assert got == {(i, j) for a, i in turned(n) for b, j in turned(n) if SequenceMatcher(None, a, b).ratio() >= 0.9}
    assert rows[1] < 6 * rows[0], rows


@pytest.mark.parametrize("least", [0.8, 0.9])
def test_long_titles_beside_short_ones(spark, least):
    """Some go along with their grams and some do not; pairs of both kinds are at the border."""
    r = random.Random(3)
    base = "".join(r.choice("abcdefghijklmnop é") for _ in range(230))
    left = [base[:n] for n in (170, 190, 199, 200, 201, 205, 230)]
    left += ["".join(r.choice("xyz") if r.random() < 0.1 else c for c in t) for t in left] + ["", None]
    frame = spark.createDataFrame(list(enumerate(left)), "k long, title string")
    got = {(x.left_id, x.right_id): x.ratio for x in similar_pairs(frame, frame, "k", "title", least).collect()}
    want = {(i, j): x for i, a in enumerate(left) for j, b in enumerate(left) if a and b for x in [SequenceMatcher(None, a, b).ratio()] if x >= least}
    assert got == want and len(want) > 30
