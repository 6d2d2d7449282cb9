"""Each operator on edge cases and empty tables, and against brute force, a round trip or held-out rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import edge_rows, prose


def by_id(df, *columns):
    return sorted(((r["doc_id"], *[r[c] for c in columns]) for r in df.collect()), key=repr)


def test_exact_dedup(edges, nothing):
    from tessera.llm.exact_dedup import drop_copies, exact_dedup

    rows = edge_rows()
    expected = []
    for i, t, *_ in rows:
        group = [r[0] for r in rows if (r[1] or "") == (t or "")]
        top = max((x for x in group if x is not None), default=None)
        expected.append((i, top, len(group), i == top, hashlib.sha256((t or "").encode()).hexdigest()))
    assert by_id(exact_dedup(edges, keep_largest=True), "keep_id", "group_size", "kept", "text_sha256") == sorted(expected, key=repr)
    assert exact_dedup(nothing).count() == 0
    kept = drop_copies(edges)
    assert kept.columns == edges.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 4, 5, 7, 8, 9, None, 10])
    clash = [c for c in edges.columns if c not in ("doc_id", "text", "lang", "source")]
    assert all(r[c] == c for r in kept.collect() for c in clash) and drop_copies(nothing).count() == 0


def test_digest_index(spark):
    from tessera.llm.exact_dedup import DigestIndex

    index = DigestIndex(spark, memtable=40, fan_in=2)
    r, want = random.Random(4), {}
    for _ in range(3):  # three batches, some memtables each
        rows = [(hashlib.sha256(str(r.randrange(60)).encode()).digest(), r.choice([None, *range(200)])) for _ in range(100)]
        index.flush(spark.createDataFrame(rows, "digest binary, id long").repartition(5), len(rows))
        for d, i in rows:
            want.setdefault(d, []).append(i)
    assert len(index.levels[0]) == 9
    least = {d: min((i for i in ids if i is not None), default=None) for d, ids in want.items()}
    some = sorted(want)[:3]
    found = index.lookup(some).collect()
    assert {bytes(x.digest) for x in found} == set(some) and sum(x.group_size for x in found) == sum(len(want[d]) for d in some)
    got = {bytes(x.digest): (x.keep_id, x.group_size, x.n_keep) for x in index.compact().collect()}
    assert got == {d: (least[d], len(ids), ids.count(least[d])) for d, ids in want.items()}
    assert [len(x) for x in index.levels] == [0, 0, 0, 0, 1]


def test_exact_dedup_goes_through_the_index(spark):
    """The query's own runs and merges: bounded memtables, runs merged fan_in at a time, most entries passed by the filters."""
    from tessera.llm.exact_dedup import DigestIndex, exact_dedup, memtable_rows

    r = random.Random(8)
    rows = [(i, f"text {r.randrange(4000) if i % 3 else 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = DigestIndex(spark, keep_largest=True, memtable=500, fan_in=3)
    got = exact_dedup(df, keep_largest=True, index=index).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    assert sorted((x.doc_id, x.keep_id, x.group_size, x.kept) for x in got) == sorted((i, max(groups[t]), len(groups[t]), i == max(groups[t])) for i, t in rows)
    assert [(x["level"], x["runs"]) for x in index.log] == [(0, 3), (0, 3), (1, 2)] and sum(map(len, index.levels)) == 1
    assert index.log[-1]["entries"] <= index.log[0]["entries"] + index.log[1]["entries"] and index.compact().count() == len(groups)
    # What passes a filter is in one run alone; of the rest most are in several, as a filter errs for one in sixteen.
    assert all(0.4 * x["entries"] < x["passed"] < x["entries"] for x in index.log)
    default = DigestIndex(spark, keep_largest=True, memtable=memtable_rows(len(rows)))
    exact_dedup(df, keep_largest=True, index=default)
    assert [x["runs"] for x in default.log] == [8] and [memtable_rows(n) for n in (0, 3, 10**8, 10**9)] == [1, 1, 4_000_000, 15_625_000]


def test_quality(edges, nothing):
    import re

    from tessera.llm.quality import keep_good, quality_rules

    def counts(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        many = Counter(win)
        covered = {i + k for i, x in enumerate(win) if many[x] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)

    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert by_id(quality_rules(edges), *columns) == sorted(((r[0], *counts(r[1])) for r in edge_rows()), key=repr)
    assert quality_rules(nothing).count() == 0 and keep_good(edges).columns == edges.columns
    good = {r.doc_id for r in quality_rules(edges).filter("kept").collect()}
    assert {r.doc_id for r in keep_good(edges).collect()} == good and all(r["_t"] == "_t" and r["base"] == "base" for r in keep_good(edges).collect()) and keep_good(nothing).count() == 0
    spark = edges.sparkSession
    r = random.Random(3)
    texts = [" ".join(r.choice("ab*c") for _ in range(r.randrange(12))) + r.choice(["", "\n", "\nx\nx"]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert by_id(quality_rules(df), *columns) == sorted(((i, *counts(t)) for i, t in enumerate(texts)), key=repr)


def test_near_duplicates(edges, nothing):
    from tessera.llm.near_dedup import drop_near_duplicates, near_duplicates

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {r[0]: shingles(r[1]) for r in edge_rows() if r[0] is not None}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    expected = [(r[0], len(shingles(r[1])), root.get(r[0]), r[0] is None or root[r[0]] == r[0]) for r in edge_rows()]
    assert by_id(near_duplicates(edges), "n_shingles", "component_id", "kept") == sorted(expected, key=repr)
    assert near_duplicates(nothing).count() == 0
    assert {r.doc_id for r in drop_near_duplicates(edges).collect()} == {1, 2, 3, 4, 7, 8, 9, 10, None}


def test_mixing(edges, nothing):
    from tessera.llm.mixing import Mix, mix_sources, mixed_documents

    rows = by_id(mix_sources(edges), "size", "source_size", "target", "taken")
    assert rows == by_id(mix_sources(edges.repartition(3)), "size", "source_size", "target", "taken")
    total = sum(r[1] for r in rows)
    source = {}
    for (_, size, source_size, target, taken) in rows:
        assert 0 <= taken <= 2 * size and target <= 2 * source_size
        source.setdefault((source_size, target), []).append(taken)
    assert abs(sum(t for _, t in source) - min(1.5 * total, 2 * total)) < 1e-6 * total
    for (_, target), taken in source.items():
        assert abs(sum(taken) - target) <= 1
    assert mix_sources(nothing).count() == 0
    slots = [(r["taken"], r["first_slot"]) for r in mix_sources(edges).collect()]
    assert all((t > 0) == (n is not None) for t, n in slots) and any(n == 0 for _, n in slots)
    mixed = mixed_documents(edges, Mix())
    assert mixed.columns == edges.columns and all(r["_id"] == "_id" and r["_copies"] == "_copies" for r in mixed.collect()) and mixed_documents(nothing).count() == 0


def test_slots_against_plain_python(spark):
    from tessera.llm.mixing import GOLDEN, Mix, mix_sources

    r, mix = random.Random(4), Mix(block=16)
    docs = [(i, prose(r.randrange(0, 90), i), r.choice("aab") if i % 7 else None) for i in range(150)]
    rows = mix_sources(spark.createDataFrame(docs, "doc_id long, text string, source string"), mix).collect()
    got = {x["doc_id"]: x for x in rows}
    names = ["a", "b", None]
    stream = {c: sorted((i for i, _, s in docs if s == c), key=lambda i: hashlib.md5(f"mix:{i}".encode()).hexdigest()) for c in names}
    size = {c: sum(got[i]["size"] for i in stream[c]) for c in names}
    want = {c: min(int(got[stream[c][0]]["target"]), 2 * size[c]) for c in names}
    blocks = {c: -(-size[c] // 16) for c in names}
    need = {c: want[c] // size[c] * blocks[c] + -(-(want[c] % size[c]) // 16) for c in names}
    total, used, taken, first = sum(need.values()), dict.fromkeys(names, 0), dict.fromkeys(got, 0), {}

    def take(c, n):
        epoch, block = divmod(used[c], blocks[c])
        used[c] += 1
        until, at = min(size[c], want[c] - epoch * size[c]), 0
        for i in stream[c]:
            words = min(at + got[i]["size"], block * 16 + 16, until) - max(at, block * 16)
            if words > 0:
                taken[i] += words
                first[i] = min(first.get(i, n), n)
            at += got[i]["size"]

    for n in range(total):
        x, lo = (n + 1) * GOLDEN % 1.0, 0
        for c in names:
            if lo / total <= x < (lo + need[c]) / total and used[c] < need[c]:
                take(c, n)
            lo += need[c]
    lo = 0
    for c in names:
        while used[c] < need[c]:
            take(c, total + lo + used[c])
        lo += need[c]
    assert {i: (x["taken"], x["first_slot"]) for i, x in got.items()} == {i: (taken[i], first.get(i)) for i in got}


def test_rows_without_ids_are_spread(spark):
    from tessera.llm.common import order_hash

    df = spark.range(500).selectExpr("CAST(NULL AS long) AS doc_id", "concat('text ', id) AS text")
    assert df.select(order_hash("mix", "doc_id", "text").alias("h")).distinct().count() == 500


def test_packing(edges, nothing):
    from tessera.llm.packing import Packing, best_boundaries, pack

    r = random.Random(1)
    for _ in range(20):
        sizes = sorted(r.choices(range(1, 40), k=25))
        tops = sorted(set(sizes))
        n, s = [sizes.count(t) for t in tops], [t * sizes.count(t) for t in tops]
        pad = lambda ends, sizes=sizes: sum(next(e for e in ends if e >= x) - x for x in sizes)
        from itertools import combinations

        best = min(pad([*c, tops[-1]]) for k in range(3) for c in combinations(tops[:-1], k))
        assert pad(best_boundaries(tops, n, s, 3)) == best
    rows = pack(edges, Packing(buckets=3, budget=200)).collect()
    assert len(rows) == len(edge_rows())
    batches = {}
    for x in rows:
        assert x.n_tokens <= x.bucket_len
        batches.setdefault((x.bucket, x.bucket_len, x.batch), []).append(x.slot)
    for (_, length, _), slots in batches.items():
        assert len(slots) == 1 or len(slots) * length <= 200
        assert sorted(slots) == list(range(len(slots)))
    assert pack(nothing).count() == 0


def test_html():
    from tessera.llm import html_extract as h
    from tessera.llm.html_training import labelled_pages

    model = h.default_model()
    page = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><div class="ad">Buy this now.</div><article><h1>A &amp; B</h1><p><b>One   two.<br><p>Three\n four is here. And more follows.</p></article><section class="comments"><p>I like it.</p></section><form><label>Mail</label><input></form><footer>&copy; x</footer>'
    assert h.main_text(page, model) == "A & B\nOne two.\nThree four is here. And more follows."
    assert h.main_text("", model) == "" and h.main_text("<", model) is not None and h.main_text("<div>" * 3000 + "x", model) is not None
    right = total = 0
    for p in labelled_pages(80, 1234):
        nodes, labels = h.parse(p), []
        for n in nodes:
            m = h.LABEL.search(n.attrs)
            labels.append(int(m[1]) if m else labels[n.parent] if n.parent >= 0 else 1)
            n.attrs = h.LABEL.sub("", n.attrs)
        for n, y, q in zip(nodes, labels, h.marginals(nodes, model), strict=True):
            right, total = right + (bool(n.texts) and (q >= 0.5) == bool(y)), total + bool(n.texts)
    assert right / total > 0.94


def test_marginals_equal_enumeration():
    import itertools
    import math

    from tessera.llm import html_extract as h

    model = h.default_model(40, 1)
    nodes = h.parse("<div><p>Some text here.</p><ul><li><a>x</a></li></ul></div><p class=ad>Ad.</p>")
    scores = [sum(model.odds.get(f, 0.0) for f in own) for own in h.features(nodes)]
    weight = [0.0] * len(nodes)
    total = 0.0
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        p = math.exp(sum(s for s, y in zip(scores, labels, strict=True) if y))
        for i, n in enumerate(nodes):
            if i:
                p *= model.pair(nodes, i)[labels[n.parent]][labels[i]]
        total += p
        weight = [w + p * y for w, y in zip(weight, labels, strict=True)]
    assert np.allclose([w / total for w in weight], h.marginals(nodes, model))


def test_token_store(edges, nothing):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from tessera.llm.token_store import MerkleStream, StoreFormat, digest, manifests, merkle_root, read_store, write_store

    fmt = StoreFormat(public.path("word_bpe_49k.json"), least=8, cut_bits=4, most=64)
    spark, tokenizer = edges.sparkSession, Tokenizer.from_file(fmt.tokenizer)
    folder = write_store(edges, fmt)
    at = 0
    got = sorted(read_store(spark, folder, fmt).collect(), key=lambda r: (r.start, r.n_tokens))
    for r, (i, t) in zip(got, sorted(((r[0], r[1]) for r in edge_rows()), key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.id, r.start, r.n_tokens, bytes(r.ids)) == (i, at, len(ids), ids.tobytes())
        assert zlib.crc32(bytes(r.ids)) == zlib.crc32(ids.tobytes())
        at += len(ids)
    assert manifests(spark, folder).agg(F.sum("n_tokens")).first()[0] == at
    packs = spark.read.parquet(f"{folder}/packs").filter("seq >= 0")
    assert packs.agg(F.sum(F.length("payload"))).first()[0] < 2 * at  # copies are stored once
    assert read_store(spark, write_store(nothing, fmt), fmt).count() == 0
    texts = [f"text number {i % 40} and some more" for i in range(120)]
    same = spark.createDataFrame([(i, t) for t in texts for i in (None, 7)], "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    folder = write_store(same, fmt)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = [(r.id, tokenizer.decode(np.frombuffer(r.ids, "<u4")[:-1].tolist())) for r in sorted(read_store(spark, folder, fmt).collect(), key=lambda r: r.start)]
    whole = lambda t: tokenizer.decode(tokenizer.encode(t, add_special_tokens=False).ids)
    assert sorted(back, key=repr) == sorted(((i, whole(t)) for t in texts for i in (None, 7)), key=repr)
    assert [i is None for i, _ in back] == [True] * 120 + [False] * 120
    assert spark.read.parquet(f"{folder}/packs").filter("seq >= 0 AND id IS NULL").select("segment").distinct().count() > 1
    for n in range(9):
        tree = MerkleStream()
        leaves = [digest(bytes([i])) for i in range(n)]
        for x in leaves:
            tree.add(x)
        assert tree.root() == merkle_root(leaves)


def test_suffix_dedup(edges, nothing):
    from tessera.llm.suffix_dedup import Repeats, decoded, front_code, merged, remove_repeats

    def brute(rows, n):
        seen, out = set(), []
        for i, t in rows:
            b = (t or "").encode()
            mark = bytearray(len(b))
            for q in range(len(b) - n + 1):
                w = b[q : q + n]
                if w in seen:
                    mark[q : q + n] = b"\1" * n
                seen.add(w)
            kept = bytes(c for c, m in zip(b, mark, strict=True) if not m)
            runs = sum(1 for j in range(len(b)) if mark[j] and (j == 0 or not mark[j - 1]))
            out.append((i, len(b), sum(mark), runs, hashlib.sha256(kept).hexdigest()))
        return sorted(out, key=repr)

    columns = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    ordered = sorted(((r[0], r[1]) for r in edge_rows()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    assert by_id(remove_repeats(edges), *columns) == brute(ordered, 100)
    assert remove_repeats(nothing).count() == 0
    r = random.Random(5)
    shared = [prose(30, k) for k in range(3)] + ["a" * 150, "ab" * 90]
    rows = [(i, " ".join(r.choice(shared)[r.randrange(40) :] if r.random() < 0.5 else prose(12, 100 + i) for _ in range(4))) for i in range(25)]
    df = edges.sparkSession.createDataFrame(rows, "doc_id long, text string")
    assert by_id(remove_repeats(df, Repeats(part=60, run=200, slice=400, together=3, most=120)), *columns) == brute(rows, 100)
    items = sorted((bytes(r.choices(b"ab", k=r.randrange(9))), i, 0) for i in range(300))
    runs = [front_code(items[k::7]) for k in range(7)]
    out = list(merged([decoded(x) for x in runs]))
    assert [x[1] for x in out] == [x[0] for x in items]
    for a, b in zip(out, out[1:], strict=False):
        assert b[0] == next((i for i, (x, y) in enumerate(zip(a[1], b[1], strict=False)) if x != y), min(len(a[1]), len(b[1])))


def test_warc(spark):
    from tessera.llm.common import fresh_path
    from tessera.llm.warc import read_records, warc_round_trip, write_warc

    page = "<p>" + "x" * 200
    rows = [(3, "http://a/ b\r\n", page), (1, None, page), (2, "u", ""), (4, "v", None), (5, "é", "short"), (6, "w", "short"), (None, "n", page), (3, "again", page)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    got = sorted((tuple(r) for r in warc_round_trip(pages).collect()), key=repr)
    expected = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and i != 1
        expected.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert got == sorted(expected, key=repr)
    index = write_warc(pages, fresh_path(spark, "warc"))
    some = read_records(index.filter("page_id = 1"), gap=0)
    assert [bytes(r.payload).decode() for r in some.collect()] == [page]
    assert warc_round_trip(pages.filter("page_id < 0")).count() == 0


def test_secrets(edges, nothing):
    from tessera.llm.secrets import FEATURES, Forest, feature_columns, labelled_findings, scan_secrets, train_forest

    spark, params = edges.sparkSession, Forest(labelled=1000, trees=8)
    trees = train_forest(spark, params)
    rows = spark.createDataFrame(labelled_findings(400, 99), "before string, candidate string, after string, label int")
    own = feature_columns(F.col("candidate"), F.col("before"), F.col("after"))
    rows = rows.withColumns({f"f_{f}": own[f].cast("double") for f in FEATURES})
    at = {f: F.col(f"f_{f}") for f in FEATURES}
    score = sum((t(at) for t in trees[1:]), trees[0](at)) / len(trees)
    assert rows.filter((score >= 0.5) == (F.col("label") == 1)).count() >= 380
    docs = [
        (1, 'set token = "0123456789abcdef0123456789abcdef01234567" now'), (2, "id 123e4567-e89b-12d3-a456-426614174000 ok"), (3, None), (4, "the password: Kq#vRt!pLz and more"),
        (5, "say password: required here"), (6, 'PASSPHRASE="hZkQwRtYpLmNbVcXsDfG"'), (7, "short pwd=abc1"),
    ]
    found = scan_secrets(spark.createDataFrame(docs, "doc_id long, text string"), params).select("doc_id", "is_secret").collect()
    assert sorted(map(tuple, found)) == [(1, True), (2, False), (4, True), (5, False), (6, True)]
    assert scan_secrets(nothing, params).count() == 0 and scan_secrets(edges, params).count() == 0


def test_secret_candidates_against_python(spark):
    """The candidates of whole texts, and secrets written in ways that the trainer has not."""
    import re

    from tessera.llm.secrets import CANDIDATE, CHARS, NAMES, candidates, scan_secrets

    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["word", "password:", "token", "= \"", "Secret =", "a/b/c123456789012345", "AbCdEfGhIjKlMnOpQrSt", "lowercaseonlyrunoftext", "kJ8#mQ2!x", "0123456789abcdef=="]) for _ in range(12))) for i in range(80)]
    name = re.compile(rf"(?:{NAMES})[\"']?\s{{0,2}}[:=]\s{{0,2}}[\"'`]?$", re.I)
    run = re.compile(rf"(?<![{CHARS}])(?:(?=[A-Za-z+/_\-]*[0-9])[{CHARS}]{{16,}}={{0,2}}|(?=[A-Z+/_\-]*[a-z][a-z+/_\-]*[A-Z])[{CHARS}]{{20,}}={{0,2}})")
    value = re.compile(r"[^\s\"'`,;<>:=][^\s\"'`,;<>]{7,}")

    def brute(t):
        out, at = [], 0
        while at < len(t):
            m = run.match(t, at) or (value.match(t, at) if at and t[at - 1] in " :=\"'`" and name.search(t[max(0, at - 40) : at]) else None)
            if m:
                out.append(m[0])
            at = m.end() if m else at + 1
        return out

    assert CANDIDATE
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id, x.ordinal, x.candidate) for x in candidates(df).collect())
    assert got == [(i, k, c) for i, t in rows for k, c in enumerate(brute(t))]
    hexa, alnum = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    forms = [lambda: f'"auth_token": "{pick(alnum, 32)}"', lambda: f"export API_KEY={pick(hexa, 40)}", lambda: f"mysql --password={pick(alnum + '!$%', 14)}", lambda: f"secret => '{pick(alnum, 40)}' token: {pick(alnum, 28)}"]
    docs = [(i, "Some text before. " + r.choice(forms)() + " and after.") for i in range(120)]
    hit = {x.doc_id for x in scan_secrets(spark.createDataFrame(docs, "doc_id long, text string")).filter("is_secret").collect()}
    assert len(hit) >= 0.9 * len(docs)
