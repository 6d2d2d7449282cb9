"""Removal of long byte strings that occurred before, by merge-sorting suffixes.

A place whose next length bytes also start at an earlier place is the start of a repeated string. Most suffixes cannot be,
so those that can are found first, by hashes, and then sorted and compared as bytes:

1. Anchors. Of the k-byte strings in each window of the match length the one with the least hash is the window's anchor;
   equal windows have equal anchors. Anchors whose hash occurs once in the corpus are done (hashes only travel).
2. Fragments. The windows of one anchor are a run of starts; with their bytes they make a fragment. A fragment with an
   earlier equal is a match with it. Firsts whose anchor has other fragments are compared window by window: the bytes of
   an anchor's fragments meet in one task, or, for an anchor with very many, the windows' hashes are dealt out.
3. Matches of neighbouring places with the same earlier copy are joined, so a copied document is one match however many
   fragments it has.
4. The suffixes at both ends of every match, cut to its length, are sorted: each task sorts its own into runs, front-codes
   them and deals them by splitters; runs of a range meet in a loser tree that carries common prefix lengths, so no known
   prefix is compared again. Where neighbours are equal, all but the earliest are removed; nothing else is.

Equal suffixes of a task are merged before they travel, so a string that is everywhere arrives once from each run. Texts
are dealt by key once and stay where they are (a bucketed table); later steps bring keys and places to them.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, doc_text


@dataclass(frozen=True)
class Repeats:
    """length: bytes of a string to remove; anchor: bytes of the strings that suffixes are found by. together: fragments of
    an anchor up to which they meet in one task. most: a sorted suffix is cut after so many bytes, the rest is another.
    part, part_bytes: suffixes, and their bytes, for a range of the sort; the splitters, of border bytes, come from a sample of
    sample suffixes for each."""

    length: int = 100
    anchor: int = 40
    seed: int = 13
    together: int = 4096
    most: int = 4096
    part: int = 200_000
    part_bytes: int = 128 << 20
    sample: int = 8
    border: int = 64
    slice: int = 1 << 21
    run: int = 200_000


# -- anchors --------------------------------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Hashes of the k bytes from each place on."""

    def __init__(self, k: int, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.base = int(rng.integers(1, 2**62)) * 2 + 1
        self.k = k

    def hashes(self, x: np.ndarray) -> np.ndarray:
        """By doubling; the last k - 1 places have none."""
        level, parts, done, size = self.table[x], [], 0, 1
        power = lambda e: np.uint64(pow(self.base, e, 1 << 64))
        total = None
        while True:
            if self.k & size:
                m = len(x) - self.k + 1
                piece = level[done : done + m]
                total = piece.copy() if total is None else total * power(size) + piece
                done += size
            if size * 2 > self.k:
                return _mixed(total)
            level = level[:-size] * power(size) + level[size:]
            size *= 2


class Anchors(Hasher):
    def __init__(self, params: Repeats):
        super().__init__(params.anchor, params.seed)
        self.w = params.length - params.anchor + 1

    def __call__(self, x: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """x: bytes; valid: starts of windows. For each run of starts with one anchor: hash, place, first and last start."""
        h = self.hashes(x)
        value, at, size = h, np.zeros(len(h), np.uint8), 1
        while size * 2 <= self.w:
            value, at = self._least(value, at, size)
            size *= 2
        if size < self.w:
            value, at = self._least(value, at, self.w - size)
        if not len(valid):
            empty = np.zeros(0, np.int64)
            return h[:0], empty, empty, empty
        place = valid + at[valid]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(valid) != 1) | (np.diff(place) != 0)]))
        last = np.concatenate([first[1:] - 1, [len(valid) - 1]])
        return h[place[first]], place[first], valid[first], valid[last]

    @staticmethod
    def _least(value: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """The lesser of each place and the one step on; the left of equal ones."""
        right = value[step:] < value[:-step]
        return np.where(right, value[step:], value[:-step]), np.where(right, at[step:] + np.uint8(step), at[:-step])


def _pieces(keys: list, texts: list[bytes], params: Repeats) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of many documents (or of a slice of a long one) with the starts of their windows, and each document's key, place in them and offset."""
    buffer, starts, own, offsets, size = [], [], [], [], 0

    def out():
        x = np.frombuffer(b"".join(buffer), np.uint8)
        begins = np.array(starts, np.int64)
        lengths = np.diff(np.concatenate([begins, [len(x)]]))
        counts = np.maximum(lengths - params.length + 1, 0)
        valid = np.repeat(begins - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        return x, valid, np.array(own, object), np.stack([begins, np.array(offsets, np.int64)])

    for key, text in zip(keys, texts, strict=True):
        for a in range(0, max(len(text) - params.length + 1, 0), params.slice):
            piece = text[a : a + params.slice + params.length - 1]
            buffer.append(piece)
            starts.append(size)
            own.append(key)
            offsets.append(a)
            size += len(piece)
            if size >= params.slice:
                yield out()
                buffer, starts, own, offsets, size = [], [], [], [], 0
    if buffer:
        yield out()


def _anchor_rows(docs: DataFrame, params: Repeats) -> DataFrame:
    """route, key, mark, known. mark packs the anchor's place and how far before it its windows start.

    An anchor that a batch has twice is known to repeat; all but its first there get routes of their own.
    """
    if params.length - params.anchor >= 64:
        raise ValueError("windows must start less than 64 bytes before their anchor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Anchors(params)
        for batch in batches:
            texts = [x.as_py() for x in batch.column(1).cast(pa.binary())]
            for x, valid, own, where in _pieces(batch.column(0).to_pylist(), texts, params):
                h, place, first, last = find(x, valid)
                doc = np.searchsorted(where[0], first, side="right") - 1
                key = own[doc].astype(np.int64)
                real = place - where[0][doc] + where[1][doc]
                mark = (real << 12) | ((place - first) << 6) | (place - last)
                order = np.argsort(h, kind="stable")
                same = np.concatenate([[False], h[order][1:] == h[order][:-1]])
                again, known = np.empty(len(h), bool), np.empty(len(h), bool)
                again[order] = same
                known[order] = same | np.concatenate([same[1:], [False]])
                route = np.where(again, _mixed(h ^ _mixed(key.view(np.uint64) * np.uint64(31) + real.astype(np.uint64))), h)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(route.view(np.int64)), pa.array(key), pa.array(mark), pa.array(known)], ["route", "key", "mark", "known"]
                )

    return docs.mapInArrow(run, "route long, key long, mark long, known boolean")


# -- fragments ------------------------------------------------------------------------------------------------------


FRAGMENT = "anchor long, fragment long, key long, lo long, hi long, of_key long, of_lo long"
MATCH = "key long, start long, n long, of_key long, of_start long"


def _fragment_rows(suspects: DataFrame, params: Repeats) -> DataFrame:
    """Hashes of anchor and fragment, key, lo, hi for each anchor of suspects (key, t, marks).

    Of equal fragments of a batch all but the first are matches with it (of_key, of_lo) at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        mine = xxhash.xxh3_64_intdigest
        for batch in batches:
            anchors, fragments, keys, los, his = [], [], [], [], []
            for key, text, marks in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                text, marks = text.as_py(), marks.values.to_numpy()
                places = marks >> 12
                own = list(zip(places.tolist(), (places - ((marks >> 6) & 63)).tolist(), (places - (marks & 63)).tolist(), strict=True))
                anchors += [mine(text[p : p + params.anchor]) for p, _, _ in own]
                fragments += [mine(text[lo : hi + params.length], 1) for _, lo, hi in own]
                keys.append(np.full(len(own), key, np.int64))
                los += [x[1] for x in own]
                his += [x[2] for x in own]
            if not anchors:
                continue
            anchor, fragment = np.array(anchors, np.uint64).view(np.int64), np.array(fragments, np.uint64).view(np.int64)
            key, lo, hi = np.concatenate(keys), np.array(los, np.int64), np.array(his, np.int64)
            order = np.lexsort((lo, key, fragment, anchor))
            anchor, fragment, key, lo, hi = anchor[order], fragment[order], key[order], lo[order], hi[order]
            again = np.concatenate([[False], (anchor[1:] == anchor[:-1]) & (fragment[1:] == fragment[:-1])])
            first = np.maximum.accumulate(np.where(again, 0, np.arange(len(again))))
            columns = [pa.array(c) for c in (anchor, fragment, key, lo, hi)] + [pa.array(c[first], mask=~again) for c in (key, lo)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in FRAGMENT.split(", ")])

    return suspects.mapInArrow(run, FRAGMENT)


def _cut(bounded: DataFrame, params: Repeats) -> DataFrame:
    """bounded: key, t, spans (anchor, m, lo, hi). anchor, m, key, lo, data: the bytes of each fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for key, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                text = text.as_py()
                for s in spans.as_py():
                    for column, value in zip(out, (s["anchor"], s["m"], key, s["lo"], text[s["lo"] : s["hi"] + params.length]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in out[:4]], pa.array(out[4], pa.binary())], ["anchor", "m", "key", "lo", "data"])

    return bounded.mapInArrow(run, "anchor long, m long, key long, lo long, data binary")


def _hashed_windows(keys: np.ndarray, los: np.ndarray, data: list[bytes], hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash, key and start of every window of the fragments."""
    sizes = np.array([len(x) for x in data], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    counts = sizes - hasher.k + 1
    inside = np.arange(counts.sum()) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    h = hasher.hashes(np.frombuffer(b"".join(data), np.uint8))
    return h[np.repeat(begins, counts) + inside], np.repeat(keys, counts), np.repeat(los, counts) + inside


def _joined(key: np.ndarray, start: np.ndarray, n: np.ndarray, of_key: np.ndarray, of_start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Matches, those that go on from one another (or overlap) with the same earlier copy as one. n: starts of a match."""
    shift = of_start - start
    order = np.lexsort((start, shift, of_key, key))
    key, start, n, of_key, shift = key[order], start[order], n[order], of_key[order], shift[order]
    fresh = np.ones(len(key), bool)
    if len(key) > 1:
        fresh[1:] = (key[1:] != key[:-1]) | (of_key[1:] != of_key[:-1]) | (shift[1:] != shift[:-1])
        # Ends of what comes before in the same line; lines are told apart by an offset that only grows.
        line = np.cumsum(fresh)
        far = np.int64(1) << np.int64(40)
        reach = np.maximum.accumulate(start + n + line * far)
        fresh[1:] |= start[1:] + line[1:] * far > reach[:-1]
        ends = reach - line * far
    else:
        ends = start + n
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:] - 1, [len(key) - 1]]) if len(first) else first
    return key[first], start[first], ends[last] - start[first], of_key[first], start[first] + shift[first]


def _match_batch(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in MATCH.split(", ")])


def _met(cut: DataFrame, params: Repeats) -> DataFrame:
    """Matches of windows of fragments of one anchor, which meet in one task: cut is dealt and sorted by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(params.length, params.seed + 1)

        def matches(table: pa.Table) -> pa.RecordBatch:
            h, key, start = _hashed_windows(table.column(2).to_numpy(), table.column(3).to_numpy(), table.column(4).to_pylist(), hasher)
            order = np.lexsort((start, key, h))
            h, key, start = h[order], key[order], start[order]
            again = np.concatenate([[False], h[1:] == h[:-1]])
            first = np.maximum.accumulate(np.where(again, 0, np.arange(len(again))))[again]
            return _match_batch(_joined(key[again], start[again], np.ones(again.sum(), np.int64), key[first], start[first]))

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            anchors = rest.column(0).to_numpy()
            if not len(anchors) or anchors[0] == anchors[-1]:
                continue
            whole = int(np.searchsorted(anchors, anchors[-1]))  # the last anchor may go on
            yield matches(rest.slice(0, whole))
            rest = rest.slice(whole)
        if rest is not None and rest.num_rows:
            yield matches(rest)

    return cut.mapInArrow(run, MATCH)


def _dealt(cut: DataFrame, params: Repeats) -> DataFrame:
    """Matches of windows of fragments whose anchor has very many: the windows' hashes are dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(params.length, params.seed + 1)
        for batch in batches:
            if batch.num_rows:
                h, key, start = _hashed_windows(batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4).to_pylist(), hasher)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(key), pa.array(start)], ["h", "key", "start"])

    windows = cut.mapInArrow(run, "h long, key long, start long")
    firsts = windows.groupBy("h").agg(F.min(F.struct("key", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("h", "first")
    again = windows.join(firsts, "h").filter((F.col("key") != F.col("first.key")) | (F.col("start") != F.col("first.start")))
    return again.select("key", "start", F.lit(1).cast("long").alias("n"), F.col("first.key").alias("of_key"), F.col("first.start").alias("of_start"))


def _ends(matches: DataFrame, params: Repeats) -> DataFrame:
    """key, start, n (bytes) of the strings at both ends of the matches of a document (key, matches), cut to most bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            if not len(lists.values):
                continue
            fields = [lists.values.field(i).to_numpy() for i in range(4)]
            sizes = np.diff(lists.offsets.to_numpy())
            key, start, n, of_key, of_start = _joined(np.repeat(batch.column(0).to_numpy(), sizes), *fields)
            n = n + params.length - 1
            pieces = -(-n // params.most)
            at = (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * params.most
            size = np.minimum(np.repeat(n, pieces) - at, params.most)
            columns = [np.concatenate([np.repeat(a, pieces) + d, np.repeat(b, pieces) + d]) for a, b, d in ((key, of_key, 0), (start, of_start, at))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, np.concatenate([size, size]))], ["key", "start", "n"])

    return matches.mapInArrow(run, "key long, start long, n long")


# -- sorted runs ----------------------------------------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Of two strings that are known to share known bytes."""
    m = min(len(a), len(b))
    x, y = a[known:m], b[known:m]
    if x == y:
        return m
    differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return known + (8 * len(x) - differ.bit_length()) // 8


def front_code(items: list[tuple[bytes, int, int]]) -> bytes:
    """A sorted run of (suffix, key, start): lengths, lengths shared with the one before, keys, starts, and what is not shared."""
    n, shared, tails, last = len(items), [], [], None
    for suffix, _, _ in items:
        k = 0 if last is None else common_prefix(last, suffix, 0)
        shared.append(k)
        tails.append(suffix[k:])
        last = suffix
    columns = [np.array(c, t).tobytes() for c, t in (([len(x[0]) for x in items], "<u4"), (shared, "<u4"), ([x[1] for x in items], "<i8"), ([x[2] for x in items], "<i8"))]
    return n.to_bytes(4, "little") + b"".join(columns) + b"".join(tails)


def decoded(blob: bytes) -> Iterator[tuple[int, bytes, int, int]]:
    """(bytes shared with the one before, suffix, key, start)"""
    n = int.from_bytes(blob[:4], "little")
    sizes, shared = np.frombuffer(blob, "<u4", n, 4).tolist(), np.frombuffer(blob, "<u4", n, 4 + 4 * n).tolist()
    keys, starts = np.frombuffer(blob, "<i8", n, 4 + 8 * n).tolist(), np.frombuffer(blob, "<i8", n, 4 + 16 * n).tolist()
    at, last = 4 + 24 * n, b""
    for size, k, key, start in zip(sizes, shared, keys, starts, strict=True):
        last = last[:k] + blob[at : at + size - k]
        at += size - k
        yield k, last, key, start


def merged(runs: list[Iterator[tuple[int, bytes, int, int]]]) -> Iterator[tuple[int, bytes, int, int]]:
    """The runs' items in order, each with the bytes it shares with the one before.

    A loser tree whose nodes hold a run and the prefix that its item shares with the last output. On the way up the item
    that shares more is the smaller; only equally long prefixes are compared, from their end on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    items: list = [next(r, None) for r in runs] + [None] * (k - len(runs))
    loser, loser_lcp = [0] * k, [-1] * k

    def play(a: int, la: int, b: int, lb: int) -> tuple[int, int, int, int]:
        """(winner, its prefix, loser, its prefix)"""
        if la > lb:
            return a, la, b, lb
        if lb > la:
            return b, lb, a, la
        if la < 0:
            return a, la, b, lb
        x, y = items[a][1], items[b][1]
        h = common_prefix(x, y, la)
        if h == len(x) or h < len(y) and x[h] < y[h]:
            return a, la, b, h
        return b, lb, a, h

    level, node = [(i, 0 if items[i] else -1) for i in range(k)], k
    while len(level) > 1:
        node //= 2
        up = []
        for j in range(0, len(level), 2):
            w, lw, loser[node + j // 2], loser_lcp[node + j // 2] = play(*level[j], *level[j + 1])
            up.append((w, lw))
        level = up
    top, lcp = level[0]
    while items[top] is not None:
        _, suffix, key, start = items[top]
        yield lcp, suffix, key, start
        items[top] = item = next(runs[top], None)
        lcp, node = (item[0] if item else -1), (top + k) // 2
        while node:
            top, lcp, loser[node], loser_lcp[node] = play(top, lcp, loser[node], loser_lcp[node])
            node //= 2


SORTED = "part int, key long, start long, n long, run binary"


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int, int]]:
    for batch in batches:
        for key, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
            text = text.as_py()
            for s in spans.as_py():
                yield text[s["start"] : s["start"] + s["n"]], key, s["start"]


def _splitters(bounded: DataFrame, total: int, size: int, params: Repeats) -> list[bytes]:
    """Borders of ranges of at most about params.part suffixes and params.part_bytes bytes. bounded: key, t, spans (start, n);
    total, size: suffixes and their bytes."""
    parts = max(-(-total // params.part), -(-size // params.part_bytes))
    if parts < 2:
        return []
    one_in = max(1, total // (parts * params.sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        some = [(s[: params.border], len(s)) for s, key, q in _suffixes(batches) if xxhash.xxh3_64_intdigest(f"{key}:{q}") % one_in == 0]
        columns = list(zip(*some)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64())], ["s", "n"])

    some = sorted((bytes(r[0]), r[1]) for r in bounded.mapInArrow(run, "s binary, n long").collect())
    if len(some) < parts:
        return []
    # A suffix weighs its part of a range's suffixes or of its bytes, whichever is more in all.
    weights = np.array([max(1 / params.part, n / params.part_bytes) for _, n in some])
    at = np.searchsorted(np.cumsum(weights), weights.sum() * np.arange(1, parts) / parts)
    return sorted({some[i][0] for i in at.tolist()})


def _runs(bounded: DataFrame, splitters: list[bytes], params: Repeats) -> DataFrame:
    """Front-coded runs (part, run), and the suffixes (part -1) that an equal one in their own run comes before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(items: list) -> pa.RecordBatch:
            items.sort()
            rows, keep_, last = [], [], None
            for item in items:
                if item[0] == last:
                    rows.append((-1, item[1], item[2], len(last), None))
                else:
                    keep_.append(item)
                    last = item[0]
            begin, names = 0, [x[0] for x in keep_]
            for part, border in enumerate([*splitters, None]):
                end = len(keep_) if border is None else bisect.bisect_left(names, border, begin)
                if end > begin:
                    rows.append((part, None, None, None, front_code(keep_[begin:end])))
                begin = end
            columns = list(zip(*rows, strict=True))
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in SORTED.split(", ")])

        items, size = [], 0
        for x in _suffixes(batches):
            items.append(x)
            size += len(x[0])
            if len(items) >= params.run or size >= 1 << 25:
                yield out(items)
                items, size = [], 0
        if items:
            yield out(items)

    return bounded.mapInArrow(run, SORTED)


def _repeated(runs: DataFrame, parts: int, params: Repeats) -> DataFrame:
    """key, start, n of suffixes with an earlier equal, from each range's merged runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def by_part() -> Iterator[list[bytes]]:
            """The runs of one range after another, so that a task holds one range at a time."""
            now, blobs = None, []
            for batch in batches:
                for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if part != now and blobs:
                        yield blobs
                        blobs = []
                    now = part
                    blobs.append(blob.as_py())
            if blobs:
                yield blobs

        for blobs in by_part():
            keys, starts, sizes, first, size = [], [], [], None, -1
            for lcp, suffix, key, start in merged([decoded(b) for b in blobs]):
                if lcp != size or len(suffix) != size:
                    first, size = (key, start), len(suffix)
                    continue
                gone = max(first, (key, start))
                first = min(first, (key, start))
                keys.append(gone[0])
                starts.append(gone[1])
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (keys, starts, sizes)], ["key", "start", "n"])

    return runs.select("part", "run").repartition(max(1, parts), "part").sortWithinPartitions("part").mapInArrow(run, "key long, start long, n long")


# -- the operator ---------------------------------------------------------------------------------------------------


def keyed(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """key, id, t: key is unique and grows with id. It is the id, or, where ids are missing or repeat, a row's place among all."""
    df = docs.select(F.col(id_col).cast("long").alias("id"), doc_text(text_col).alias("t"))
    ids = df.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 OR id IS NULL")
    if ids.isEmpty():
        return df.select(F.col("id").alias("key"), "id", "t")
    placed = df.orderBy(F.col("id").asc_nulls_last(), "t").withColumn("key", F.monotonically_increasing_id())
    return scratch.keep(placed.select("key", "id", "t"), "keyed")


def remove_repeats(docs: DataFrame, params: Repeats | None = None, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256; with_text: kept (bytes) too.

    A byte goes if it is in a string of params.length bytes that also starts earlier: in a document with a smaller id, or
    earlier in the same one. Texts are UTF-8; a null text is empty, and texts shorter than that keep all. Rows that
    share an id are separate documents, in the order of their texts; rows without an id come last. Other columns are
    ignored; an empty table gives an empty one.
    """
    params = params or Repeats()
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = keyed(docs, id_col, text_col, scratch)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    same = Window.partitionBy("route")
    anchors = _anchor_rows(texts.select("key", "t"), params).withColumn("n", F.count("*").over(same)).filter("known OR n > 1")
    marks = scratch.keep(anchors.groupBy("key").agg(F.collect_set("mark").alias("marks")), "marks", compression="zstd")
    scratch.release()
    joined = texts.repartition(buckets, "key").join(marks.hint("shuffle_hash"), "key", "left").select(
        "key", "id", F.octet_length("t").cast("long").alias("n_bytes"), F.when(F.col("marks").isNull(), F.sha2("t", 256)).alias("sha"), F.when(F.col("marks").isNotNull(), F.col("t")).alias("t"), "marks"
    )
    table = scratch.keep_bucketed(joined, "suspects", buckets, "key", compression="zstd")
    scratch.drop(marks)
    scratch.release()
    suspects = table.filter("marks IS NOT NULL")
    fragments = scratch.keep(_fragment_rows(suspects.select("key", "t", "marks"), params), "fragments", compression="zstd")
    ones = fragments.filter("of_key IS NULL").drop("of_key", "of_lo")
    firsts = scratch.keep(ones.groupBy("anchor", "fragment").agg(F.min(F.struct("key", "lo", "hi")).alias("first"), F.count("*").alias("n")), "firsts", compression="zstd")
    copies = firsts.filter("n > 1").select("anchor", "fragment", "first")
    whole = ones.join(copies, ["anchor", "fragment"]).filter((F.col("key") != F.col("first.key")) | (F.col("lo") != F.col("first.lo")))
    starts = (F.col("hi") - F.col("lo") + 1).alias("n")
    matches = scratch.keep(
        fragments.filter("of_key IS NOT NULL").select("key", F.col("lo").alias("start"), starts, "of_key", F.col("of_lo").alias("of_start"))
        .unionByName(whole.select("key", F.col("lo").alias("start"), starts, F.col("first.key").alias("of_key"), F.col("first.lo").alias("of_start"))),
        "matches", compression="zstd",
    )
    scratch.drop(fragments)
    mixed = firsts.groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1").select("anchor", "m")
    open_ = firsts.join(mixed, "anchor").select("anchor", "m", "first.*").groupBy("key").agg(F.collect_list(F.struct("anchor", "m", "lo", "hi")).alias("spans"))
    cut = scratch.keep(_cut(suspects.select("key", "t").join(open_.hint("shuffle_hash"), "key"), params), "cut", compression="zstd")
    scratch.drop(firsts)
    scratch.release()
    few = cut.filter(F.col("m") <= params.together).repartition("anchor").sortWithinPartitions("anchor")
    found = matches.unionByName(_met(few, params)).unionByName(_dealt(cut.filter(F.col("m") > params.together), params))
    of_doc = found.groupBy("key").agg(F.collect_list(F.struct("start", "n", "of_key", "of_start")).alias("matches"))
    ends = scratch.keep(_ends(of_doc, params).distinct(), "ends", compression="zstd")
    scratch.drop(matches, cut)
    scratch.release()
    total, size = ends.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if total:
        of_doc = scratch.keep(ends.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("spans")), "spans", compression="zstd")
        bounded = suspects.select("key", "t").join(of_doc.hint("shuffle_hash"), "key")
        splitters = _splitters(bounded, total, size, params)
        runs = scratch.keep(_runs(bounded, splitters, params), "runs", compression="zstd")
        gone = runs.filter("part < 0").select("key", "start", "n").unionByName(_repeated(runs.filter("part >= 0"), len(splitters) + 1, params))
        gone = gone.select("key", F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("b"))
        spans = scratch.keep(gone.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "gone", compression="zstd")
        scratch.drop(of_doc, runs)
    else:
        spans = spark.createDataFrame([], "key long, spans array<struct<a:long,b:long>>")
    scratch.drop(ends)
    scratch.release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, shas, bodies, lists = (batch.column(i) for i in range(5))
            out: tuple[list, ...] = ([], [], [], [])
            for sha, text, some in zip(shas.to_pylist(), bodies.cast(pa.binary()), lists, strict=True):
                text, some = text.as_py(), some.as_py()
                if some is None:
                    values = (0, 0, sha or hashlib.sha256(text).hexdigest(), text)
                else:
                    kept, at, gone, runs_, end = [], 0, 0, 0, -1
                    for a, b in sorted((s["a"], s["b"]) for s in some):
                        if a > end:
                            kept.append(text[at:a])
                            runs_ += 1
                            gone += b - a
                        elif b > end:
                            gone += b - end
                        end = max(end, b)
                        at = end
                    kept.append(text[at:])
                    body = b"".join(kept)
                    values = (gone, runs_, hashlib.sha256(body).hexdigest(), body)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            columns = [ids, sizes, pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(out[3], pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names)

    shape = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    source = table if not with_text else table.drop("t").join(texts.select("key", "t"), "key")
    return source.join(spans.hint("shuffle_hash"), "key", "left").select("id", "n_bytes", "sha", "t", "spans").mapInArrow(run, shape).withColumnRenamed("id", id_col)
