import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n, seed=1):
    import random

    r = random.Random(seed)
    return " ".join(f"{r.choice(WORDS)}{r.randrange(50)}" for _ in range(n))


def edge_rows():
    a = prose(80, 1)
    near = " ".join([*a.split()[:78], "other", "words"])
    return [
        (1, None, "en", None), (2, "", "en", "a"), (3, "tiny text", None, "b"), (4, a, "en", "a"), (5, near, "en", None), (6, a, "de", "b"), (7, prose(30_000, 2), "xx", "c"),
        (8, " \t\n ", "fr", "a"), (9, prose(60, 3), "en", "b"), (9, prose(60, 3), "en", "b"), (None, prose(70, 4), None, "a"), (10, "naïve " + prose(60, 5) + " \U0001f600", "en", "c"),
    ]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and very long texts, ties, a repeated row, a missing id, and columns whose names clash with inner ones."""
    clash = {c: f"'{c}'" for c in ("kept", "size", "digest", "key", "t", "n", "bucket", "marks", "component_id", "h", "rank", "id", "rep", "first", "own", "base", "far", "_t", "_w", "_base", "_far", "_left", "_common", "_lang", "_id", "_copies", "_copy", "_gone", "gone", "_gone_id", "_gone_digest", "_digest", "target", "taken", "start")}
    df = spark.createDataFrame(edge_rows(), "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", *[f"{v} AS `{k}`" for k, v in clash.items()])


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.filter("doc_id < 0")
