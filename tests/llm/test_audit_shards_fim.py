"""The filter audit, sharding and fill-in-the-middle against plain Python, on edge rows and on hypothesis' inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tessera.llm.filter_audit import Filters, RemovalPolynomial, audit_filters, audit_rows
from tessera.llm.fim import Fim, fill_in_middle, restored
from tessera.llm.sharding import Sharding, shard_records, write_shards

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# -- filter audit


def failed(i, text, smallest):
    words = WORD.findall(text)
    out = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text))
    return out + "D" * bool(re.search("[#$%&*|]", text)) + "E" * (i is not None and smallest.get(text, i) < i)


def plain_audit(docs, labels):
    """Every order applied to every document."""
    smallest, marks = {}, {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    for i, q, t in labels:
        g = marks.setdefault(i, [0, 0])
        g[0] |= q == 1
        g[1] |= t == 1
    out, total = {}, Counter()
    masks = [(p or "", failed(i, t or "", smallest), *(marks.get(i, (0, 0)) if i is not None else (0, 0))) for i, t, p in docs]
    for part in {m[0] for m in masks}:
        for order in map("".join, permutations("ABCDE")):
            left = [m for m in masks if m[0] == part]
            for step, own in enumerate(order, 1):
                gone = [m for m in left if own in m[1]]
                left = [m for m in left if own not in m[1]]
                fails = sum(own in m[1] for m in masks if m[0] == part)
                unique = sum(m[1] == own for m in masks if m[0] == part)
                out[part, order, step] = [len(left), len(gone), fails - len(gone), unique, sum(m[2] for m in gone), sum(m[3] for m in gone)]
                total[part, own] += len(gone)
    return {(*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited_docs(n=160, seed=5):
    r = random.Random(seed)
    kinds = ["plain words " * 3, "Many CAPITALS Here " * 90, "the cost is 5 $ and more ", " ".join(f"w{i}" for i in range(210)), " ".join(f"w{i}" for i in range(230)) + " #", "", None]
    docs = [(i, r.choice(kinds) if r.random() < 0.6 else " ".join(r.choice("ab AB $ c d e f g h".split()) + str(r.randrange(99)) for _ in range(r.randrange(400))), r.choice(["en", "de", None, ""])) for i in range(n)]
    docs += [docs[3], docs[3], (None, docs[3][1], "en"), (None, "alone without an id", "de"), (7, docs[7][1], "other part"), (2 * n, docs[7][1], "xx")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, n, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (10**6, 1, 1)]
    return docs, labels


def test_audit_equals_every_order_applied(spark):
    docs, labels = audited_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 AS mask", "'x' AS digest", "2 AS n", "0 AS good", "'p' AS part", "1 AS quality")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert set(rows_of(audit_filters(df, marks))) == plain_audit(docs, labels)


def test_audit_on_edge_rows_and_empty_tables(spark, edges, nothing):
    marks = spark.createDataFrame([(1, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    got = rows_of(audit_filters(edges, marks))
    assert set(got) == plain_audit([(r["doc_id"], r["text"], r["lang"]) for r in edges.collect()], [(1, 1, 1), (4, 1, 0)])
    assert rows_of(audit_filters(nothing, marks)) == []
    unlabelled = rows_of(audit_filters(edges, marks.limit(0)))
    assert len(unlabelled) == len(got) and all(r[7] == r[8] == 0 for r in unlabelled)


def test_removal_polynomial_against_marginals_in_all_orders():
    r = random.Random(1)
    for k in (1, 2, 3, 5):
        counts = {m: r.randrange(10**18) for m in range(1 << k) if r.random() < 0.8}
        f = RemovalPolynomial(counts, k)
        v = [sum(n for m, n in counts.items() if m & s) for s in range(1 << k)]
        assert [f.at(s) for s in range(1 << k)] == v
        orders = list(permutations(range(k)))
        for i in range(k):
            mean = Fraction(sum(v[s | 1 << i] - v[s] for o in orders for s in [sum(1 << j for j in o[: o.index(i)])]), len(orders))
            assert f.partial_integral(i) == mean
    whole = {m: (r.randrange(99), r.randrange(9), r.randrange(9)) for m in range(32)}
    rows = list(audit_rows("p", whole, "ABCDE"))
    assert len(rows) == 600 and len({r[1] for r in rows}) == 120
    # The five values of an order add up to all that is removed, 120 times.
    assert sum(r[9] for r in rows[:5]) == 120 * (sum(c[0] for c in whole.values()) - whole[0][0])


# -- sharding


def plain_shards(docs, shards):
    """All rows in one sorted list."""
    rows = sorted(((hashlib.sha256((t or "").encode()).digest(), i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs))
    total, at, out, slots = sum(r[3] for r in rows), 0, [], Counter()
    for _, has, i, size, crc in rows:
        shard = min(shards * (2 * at + size) // (2 * total), shards - 1)
        out.append((i if has else None, size, crc, shard, slots[shard]))
        slots[shard] += 1
        at += size
    return Counter(out)


SMALL = Sharding(shards=5, ranges=6, sample=4, max_rows=20)


@pytest.fixture(scope="module")
def copied():
    """A third of the rows is one text, one row is repeated 60 times, one text is longer than several shards' shares."""
    r = random.Random(9)
    docs = [(i, "copy of a page" if i % 3 == 0 else "x" * r.randrange(300)) for i in range(500)] + [(7, "repeated row")] * 60 + [(None, "copy of a page"), (None, None), (900, "long " * 40_000)]
    r.shuffle(docs)
    return docs


def test_shards_equal_one_sorted_list(spark, copied, edges, nothing):
    df = spark.createDataFrame(copied, "doc_id long, text string").repartition(7)
    assert Counter(rows_of(shard_records(df, SMALL))) == plain_shards(copied, 5)
    # Other samples and other ranges give the same shards.
    assert Counter(rows_of(shard_records(df, Sharding(shards=5, ranges=40, sample=8, max_rows=9, seed="other")))) == plain_shards(copied, 5)
    docs = [(r["doc_id"], r["text"]) for r in edges.collect()]
    assert Counter(rows_of(shard_records(edges))) == plain_shards(docs, 16)
    assert rows_of(shard_records(nothing)) == []


def test_shards_are_near_equal_and_slots_have_no_gaps(spark):
    r = random.Random(2)
    docs = [(i, "copy" * 30 if i % 3 else "y" * r.randrange(400)) for i in range(3000)]
    rows = rows_of(shard_records(spark.createDataFrame(docs, "doc_id long, text string"), Sharding(ranges=32, max_rows=200)))
    sizes, slots = Counter(), {}
    for _, size, _, shard, slot in rows:
        sizes[shard] += size
        slots.setdefault(shard, []).append(slot)
    share = sum(sizes.values()) / 16
    assert sorted(sizes) == list(range(16)) and all(abs(s - share) <= 401 for s in sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_by_other_keys_and_sizes(spark):
    df = spark.range(100).selectExpr("id AS doc_id", "CAST(id AS string) AS text", "id % 4 AS k", "CAST(0 AS long) AS nothing")
    rows = rows_of(shard_records(df, SMALL, key=F.col("k"), size=F.lit(1)))
    assert Counter(r[3] for r in rows) == Counter({i: 20 for i in range(5)})
    assert [r[0] for r in sorted(rows, key=lambda r: (r[3], r[4]))] == sorted(range(100), key=lambda i: (i % 4, i))
    assert len(rows_of(shard_records(df, SMALL, size=F.col("nothing")))) == 100


def test_shards_written_in_order(spark, copied, tmp_path):
    df = spark.createDataFrame(copied, "doc_id long, text string").withColumn("slot", F.lit("own"))
    write_shards(df, str(tmp_path / "out"), SMALL)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter(copied) and {r["slot"] for r in back.select("slot").distinct().collect()} == {"own"}
    want = plain_shards(copied, 5)
    assert Counter((r["doc_id"], r["shard"], r["slot_"]) for r in back.collect()) == Counter({(k[0], k[3], k[4]): n for k, n in want.items()})
    for file in (tmp_path / "out").glob("shard=*/part-*.parquet"):
        slots = [r[0] for r in spark.read.parquet(str(file)).select("slot_").collect()]
        assert slots == sorted(slots)


# -- fill in the middle


def plain_fim(i, text, fim=Fim()):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{fim.seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(s in text for s in fim.sentinels) or h[2] % 100 >= fim.percent:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < fim.spm_percent:
        return n, "spm", len(a), len(b), fim.suffix + c + fim.prefix + a + fim.middle + b
    return n, "psm", len(a), len(b), fim.prefix + a + fim.suffix + c + fim.middle + b


TEXTS = ["", None, "one", "one\n", "\n", "\n\n\n", "a\nb", "a\r\nb\r\n", "naïve \U0001f600\nsecond \U0001f600 line\nthird", "has <P> in it\nx", "ends with <\nS>\nP>", "<", "<S\n>", "  other\u0085breaks\n\x00nul", "word " * 100_000, "line\n" * 20_000, "$1 \\1 \\Q [a-z]* {}\n$0"]


@pytest.mark.parametrize("fim", [Fim(), Fim(seed=3, percent=50, spm_percent=0), Fim(percent=0), Fim(prefix="[pre].", suffix="(suf)$", middle="\\m|", spm_percent=100)])
def test_arranged_and_restored(spark, fim):
    docs = [(7 * k + j, t) for k in range(6) for j, t in enumerate(TEXTS)] + [(None, "no id\nat all\n"), (None, None), (1, "repeated\nrow"), (1, "repeated\nrow"), (-5, "negative\nid")]
    df = fill_in_middle(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'own' AS form", "1 AS n", "2 AS output"), fim)
    rows = df.select("doc_id", "text", "fim.*", restored(F.col("fim.output"), F.col("fim.form"), fim).alias("back"), F.col("form").alias("own")).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_fim(r["doc_id"], r["text"], fim)
        assert r["back"] == (r["text"] or "") and r["own"] == "own"


def test_arranged_edge_rows(spark, edges, nothing):
    rows = fill_in_middle(edges.withColumn("fim", F.lit("own"))).collect()
    assert all(r["fim"] == "own" and tuple(r["fim_"]) == plain_fim(r["doc_id"], r["text"]) for r in rows) and len(rows) == edges.count()
    assert fill_in_middle(nothing).count() == 0
