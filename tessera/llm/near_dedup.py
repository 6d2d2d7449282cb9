"""Near-duplicate documents by MinHash: one-permutation hashing with optimal densification, banded buckets, star-shaped
candidate edges, and an exact check of every link on full shingle sets.

Documents with equal shingle sets are one class, found by a 128-bit hash of the set; only classes are sketched further.
Members of a small bucket all meet. In a larger one each meets the centre of a star, so there are as many pairs as members:
the member with the most companions in all its buckets, a text that many others are copies of. Members of buckets that
then still hold several components are hashed anew with longer bands, which texts that only share a passage do not have in
common, and linked in the same way, by a second turn of stars as well, around centres out of the others. Links make components.
No step makes all pairs of a group unless NearDup.exact asks for it; without that, a link between two members of a large
bucket of which neither is a centre must be found in another bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, doc_text, unused


@dataclass(frozen=True)
class NearDup:
    """Links are of 100 * intersection >= percent * union. bands * rows is a power of two: the bins of the permutation.

    A pair at similarity 0.75 shares none of 32 bands of 4 rows in about 1 of 200,000 cases, and none of 64 bands of 8 in
    about 1 of 850 (at 0.8, 1 of 130,000). few: members of a bucket that all meet; turns: stars of larger buckets of the
    longer bands. exact: what still shares a bucket of the first bands without a link meets at last, pair by pair, so that no
    member of a bucket is left untested; its cost grows with the square of the members of open buckets.
    """

    shingle: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    seed: int = 7
    few: int = 16
    turns: int = 2
    fine_bands: int = 64
    fine_rows: int = 8
    exact: bool = False
    cell: int = 256


REHASH = np.uint64(0x9E3779B97F4A7C15)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct shingle hashes of UTF-8 texts. Words are hashed once while they stay in a bounded cache."""

    def __init__(self, params: NearDup, cache: int = 1 << 17):
        import xxhash

        self.k, self.limit, self.words = params.shingle, cache, {}
        self.hash, self.hash_all = xxhash.xxh3_64_intdigest, xxhash.xxh3_64_intdigest
        self.factors = np.random.default_rng(params.seed).integers(1, 2**63, params.shingle, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # bytes: lower-cases A-Z, splits at \x20 and \x09-\x0D
        n = len(words)
        if n < self.k:
            return np.array([self.hash_all(b"\n".join(words), n + 1)] if n else [], np.uint64)
        known = self.words
        if len(known) > self.limit:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.hash(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
        m = n - self.k + 1
        total = h[:m] * self.factors[0]
        for j in range(1, self.k):
            total += h[j : j + m] * self.factors[j]
        return np.unique(_mixed(total))


def set_digest(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


class Bands:
    """One-permutation MinHash: a shingle's leading bits are its bin, the least of a bin its value; an empty bin takes the
    value of the first filled bin in an order of its own (optimal densification). Bands hash rows bins each."""

    def __init__(self, params: NearDup):
        self.bits = (params.bands * params.rows).bit_length() - 1
        bins = 1 << self.bits
        if bins != params.bands * params.rows:
            raise ValueError("bands * rows must be a power of two")
        rng = np.random.default_rng(params.seed + 1)
        self.edges = np.arange(bins, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.order = np.stack([rng.permutation(bins) for _ in range(bins)], axis=1)  # attempt, bin
        self.factors = rng.integers(1, 2**63, params.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salts = rng.integers(1, 2**63, params.bands, dtype=np.uint64)
        self.shape = (params.bands, params.rows)
        self.shifts = np.arange(0, 64, 4, dtype=np.uint64)

    def __call__(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the bands, and four bits of each bin, 16 bins a number."""
        at = np.searchsorted(shingles, self.edges)
        inside = np.minimum(at, len(shingles) - 1)
        values = shingles[inside]
        filled = (at < len(shingles)) & (values >> np.uint64(64 - self.bits) == self.edges >> np.uint64(64 - self.bits))
        empty = np.flatnonzero(~filled)
        for order in self.order if len(empty) else ():
            source = order[empty]
            found = filled[source]
            values[empty[found]] = values[source[found]]
            empty = empty[~found]
            if not len(empty):
                break
        keys = _mixed((values.reshape(self.shape) * self.factors).sum(axis=1, dtype=np.uint64) + self.salts).view(np.int64)
        bits = ((_mixed(values) & np.uint64(15)).reshape(-1, 16) << self.shifts).sum(axis=1, dtype=np.uint64)
        return keys, bits.view(np.int64)


def sketch(docs: DataFrame, params: NearDup, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (set size), digest (of the set; null if empty), bands, bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, bands = Shingler(params), Bands(params)
        for batch in batches:
            sizes, digests, keys, bits = [], [], [], []
            for text in batch.column(1).cast(pa.binary()):
                s = shingler(text.as_py() or b"")
                sizes.append(len(s))
                digests.append(set_digest(s) if len(s) else None)
                k, b = bands(s) if len(s) else ([], [])
                keys.append(k)
                bits.append(b)
            longs = pa.list_(pa.int64())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, longs), pa.array(bits, longs)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "digest", "bands", "bits"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), doc_text(text_col).alias("t"))
    return narrow.mapInArrow(run, "id long, n long, digest binary, bands array<long>, bits array<long>")


def shingle_sets(texts: DataFrame, params: NearDup) -> DataFrame:
    """texts: t, digest, rep. rep and the sorted set as bytes, of the rows whose set has that digest; a row that is repeated comes again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(params)
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for text, digest, rep in zip(batch.column(0).cast(pa.binary()), batch.column(1), batch.column(2), strict=True):
                s = shingler(text.as_py() or b"")
                if len(s) and set_digest(s) == digest.as_py():
                    out[0].append(rep.as_py())
                    out[1].append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], ["rep", "shingles"])

    return texts.select("t", "digest", "rep").mapInArrow(run, "rep long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, params: NearDup) -> DataFrame:
    """pairs: a, b. Edges (u, v) of those that are similar on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for ra, sa, rb, sb in zip(*[batch.column(i) for i in range(4)], strict=True):
                a, b = np.frombuffer(sa.as_py(), np.uint64), np.frombuffer(sb.as_py(), np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                if 100 * common >= params.percent * (len(a) + len(b) - common):
                    u.append(ra.as_py())
                    v.append(rb.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "sa", "b", "sb")
    return both.mapInArrow(run, "u long, v long")


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node, root (the smallest node of its component) for all nodes of edges (u, v).

    Alternates large and small stars: each node's larger neighbours, then its smaller ones and itself, are tied to its
    smallest neighbour. The minimum is pre-aggregated, so a hub with any number of neighbours is a join's skew at most.
    Every round's edges are written to the shared folder, and stars are found when a round changes nothing.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    edge = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    current = scratch.keep(edges.filter("u <> v").select(*edge).distinct(), "edges")
    sign = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = sign(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        tied = least.select("u", F.col("m").alias("v"))
        last, current = current, scratch.keep(small.unionByName(tied).filter("u <> v").select(*edge).distinct(), "edges")
        scratch.drop(last)
        after = sign(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def plausible(params: NearDup, n: Column, m: Column, bits: Column, other: Column, deviations: int = 6) -> Column:
    """False only where a link is out of the question: the sizes n and m forbid it, or far too few bins agree.

    Bins are as good as independent samples of the union, about 128 * (1 - exp(-n / 128)) of them for a set of n; the
    agreeing share may fall six standard deviations short of the threshold, so small sets are never judged by their bins.
    """
    bins, least = params.bands * params.rows, params.percent / 100.0
    sizes = 100 * F.least(n, m) >= params.percent * F.greatest(n, m)
    samples = bins * (1 - F.exp(-F.least(n, m) / float(bins)))
    low = F.lit(least) - deviations * F.sqrt(F.lit(least * (1 - least)) / samples)
    differ = F.lit(0)
    for i in range(bins // 16):
        x = F.get(bits, F.lit(i)).bitwiseXOR(F.get(other, F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        differ = differ + F.bit_count(x)
    return sizes & (F.lit(bins) - differ >= low * bins)


class Linker:
    """Links classes round by round. Every round makes a bounded number of pairs for each member of a bucket."""

    def __init__(self, scratch: Scratch, sets: DataFrame, info: DataFrame, ties: DataFrame, params: NearDup):
        """sets: rep, shingles; info: node, n, bits; ties: edges known from the start."""
        self.scratch, self.sets, self.info, self.params = scratch, sets, info, params
        self.edges = scratch.keep(ties.select("u", "v"), "links")
        self.tested: DataFrame | None = None
        self._label()

    def _label(self) -> None:
        self.roots = self.scratch.keep(components(self.edges, self.scratch), "roots")

    def labelled(self, buckets: DataFrame) -> DataFrame:
        """buckets (bucket, node) that hold several components: bucket, node, hub, n, bits, root and size (of the bucket).

        hub: how many companions a node has in all its buckets. A text that many others are copies of has the most.
        """
        sizes = buckets.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
        members = buckets.join(sizes, "bucket")
        hubs = members.groupBy("node").agg(F.sum("size").alias("hub"))
        return self._open(members, hubs.join(self.info, "node"))

    def relabelled(self, members: DataFrame) -> DataFrame:
        """members with their new roots, of the buckets that are still open."""
        return self._open(members.drop("hub", "n", "bits", "root"), members.select("node", "hub", "n", "bits").distinct())

    def _open(self, members: DataFrame, nodes: DataFrame) -> DataFrame:
        own = nodes.join(self.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        members = self.scratch.keep(members.join(own, "node"), "members")
        split = members.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("bucket")
        return self.scratch.keep(members.join(split, "bucket"), "open")

    def _met(self, left: DataFrame, right: DataFrame, further: Column | None = None) -> DataFrame:
        """Pairs (a, b), a < b, of one bucket and different roots that can be similar; the condition is part of the join."""
        x = left.select("bucket", *[F.col(c).alias(c + "_x") for c in ("node", "n", "bits", "root")])
        y = right.select("bucket", *[F.col(c).alias(c + "_y") for c in ("node", "n", "bits", "root")])
        fits = (F.col("root_x") != F.col("root_y")) & plausible(self.params, F.col("n_x"), F.col("n_y"), F.col("bits_x"), F.col("bits_y"))
        met = x.join(y, "bucket").filter(fits if further is None else fits & further)
        return met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"))

    def all_pairs(self, members: DataFrame) -> DataFrame:
        """Of buckets of so few members that each meets a bounded number."""
        few = members.filter(F.col("size") <= self.params.few)
        return self._met(few, few, F.col("node_x") < F.col("node_y"))

    def star(self, members: DataFrame, turn: int) -> DataFrame:
        """Larger buckets: each member meets the centre. At first that is the greatest hub; later, one that is not of the greatest hub's component."""
        many = members.filter(F.col("size") > self.params.few)
        first = many.groupBy("bucket").agg(F.max(F.struct("hub", "node", "root")).alias("first"))
        if turn == 0:
            centres = first.select("bucket", F.col("first.node").alias("centre"))
        else:
            other = many.join(first, "bucket").filter("root <> first.root")
            rank = F.col("hub") if turn == 1 else F.xxhash64("node", F.lit(turn))
            centres = other.groupBy("bucket").agg(F.max(F.struct(rank.alias("rank"), "node")).alias("other")).select("bucket", F.col("other.node").alias("centre"))
        at = many.join(centres, "bucket").filter("node = centre")
        return self._met(many, at)

    def every_pair(self, members: DataFrame) -> DataFrame:
        """Of larger buckets, all that meet: members are dealt into parts of about cell, and each two parts meet by themselves."""
        many = members.filter(F.col("size") > self.params.few).withColumn("parts", F.ceil(F.col("size") / self.params.cell).cast("int"))
        dealt = many.withColumns({"part": F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), "other": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))})
        cell = lambda p, q: dealt.withColumn("bucket", F.struct("bucket", F.col(p).alias("p"), F.col(q).alias("q")))
        return self._met(cell("part", "other"), cell("other", "part"), F.col("node_x") < F.col("node_y"))

    def link(self, pairs: DataFrame) -> bool:
        """Confirms pairs on full sets and joins the components of those that are similar."""
        pairs = pairs.distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = self.scratch.keep(pairs, "pairs")
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        found = self.scratch.keep(confirmed(pairs, self.sets, self.params), "found")
        self.scratch.release()
        if found.isEmpty():
            return False
        self.edges = self.edges.unionByName(found)
        self._label()
        return True

    def work(self, buckets: DataFrame, turns: int) -> DataFrame:
        """Links what shares a bucket, by all pairs of small buckets and by turns of stars of larger ones; returns the
        larger buckets that were open before the last turn."""
        members = self.labelled(buckets)
        self.link(self.all_pairs(members).unionByName(self.star(members, 0)))
        members = members.filter(F.col("size") > self.params.few)
        for turn in range(1, turns):
            members = self.relabelled(members)
            if members.isEmpty():
                break
            self.link(self.star(members, turn))
        return members


def rehashed(sets: DataFrame, params: NearDup) -> DataFrame:
    """bucket, node: further, independent bands of the sets (rep, shingles), so long that only what is alike shares them."""
    fine = NearDup(shingle=params.shingle, percent=params.percent, bands=params.fine_bands, rows=params.fine_rows, seed=params.seed + 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(fine)
        for batch in batches:
            nodes, keys = [], []
            for rep, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                # Mixed anew: bins and least values have nothing to do with those of the first bands.
                nodes.append(np.full(fine.bands, rep, np.int64))
                keys.append(bands(np.sort(_mixed(np.frombuffer(data.as_py(), np.uint64) ^ REHASH)))[0])
            flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat(nodes)), pa.array(np.tile(np.arange(fine.bands, dtype=np.int32), len(nodes))), pa.array(flat(keys))], ["node", "band", "key"])

    return sets.select("rep", "shingles").mapInArrow(run, "node long, band int, key long").select(F.xxhash64("band", "key").alias("bucket"), "node").distinct()


def near_duplicates(docs: DataFrame, params: NearDup | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (smallest id reachable, itself included), kept.

    A text without words has no shingles and links with nothing; null counts as such. Rows that share an id are one
    document, linked with whatever any of their texts is. A row without an id is in no component and is kept. Other
    columns are ignored; an empty table gives an empty one.
    """
    params = params or NearDup()
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(sketch(docs, params, id_col, text_col), "sketches")
    filled = rows.filter("n > 0 AND id IS NOT NULL")
    first = F.first(F.struct("n", "bands", "bits"))
    classes = scratch.keep(filled.groupBy("digest").agg(F.min("id").alias("rep"), first.alias("s")).select("digest", "rep", "s.*"), "classes")
    # A class is known by its smallest id. Classes that share it stand for either: more candidates, no fewer.
    spread = classes.select("rep", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("bucket"), F.col("rep").alias("node"))
    spread = scratch.keep(spread, "spread")
    shared = spread.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1").select("bucket")
    buckets = scratch.keep(spread.join(shared, "bucket").distinct(), "buckets")
    scratch.drop(spread)
    involved = classes.join(buckets.select(F.col("node").alias("rep")).distinct(), "rep", "left_semi")
    info = scratch.keep(involved.select(F.col("rep").alias("node"), "digest", "n", "bits"), "info")
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), doc_text(text_col).alias("t"))
    sets = scratch.keep(shingle_sets(texts.join(info.select(F.col("node").alias("rep"), "digest"), "rep"), params), "sets")
    scratch.release()
    # Rows that share an id are one document: their classes are tied.
    all_ = filled.join(classes.select("digest", "rep"), "digest").groupBy("id").agg(F.min("rep").alias("u"), F.max("rep").alias("v"), F.collect_set("rep").alias("all"))
    ties = all_.filter("u <> v").select("u", F.explode("all").alias("v"))
    linker = Linker(scratch, sets, info.drop("digest"), ties, params)
    open_ = linker.relabelled(linker.work(buckets, 1))
    if not open_.isEmpty():
        fine = scratch.keep(rehashed(sets.join(open_.select(F.col("node").alias("rep")).distinct(), "rep", "left_semi"), params), "fine")
        linker.work(fine, params.turns)
        if params.exact:
            linker.link(linker.every_pair(linker.relabelled(open_)))
    scratch.drop(sets, buckets, info)
    of_class = classes.select("digest", "rep").join(linker.roots, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("root", "rep").alias("component_id"))
    out = rows.select("id", "n", "digest").join(of_class, F.when(F.col("id").isNotNull(), rows["digest"]) == of_class["digest"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, params: NearDup | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns, whatever they are called: one document of each component,
    rows without an id, and every row of an id that stays. Null and empty texts are like nothing and stay; very long ones are
    compared whole; an empty table gives an empty one."""
    gone = near_duplicates(docs, params, id_col, text_col).filter("NOT kept").select(F.col(id_col).alias(unused(docs, "gone"))).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(gone.columns[0]), "left_anti")
