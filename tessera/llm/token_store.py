"""A content-addressed store of token ids.

Each document's ids are cut into chunks where a rolling hash of the last ids says so; a chunk is known by its digest and
stored once, with the first document that has it. A document's recipe lists its chunks' digests, and its root is a Merkle
root over them; a segment's manifest holds the Merkle root over its documents. Reading puts every document together
again and fails where a root does not come out.

Files are written in ascending order of document id: one range of ids a task, running totals of ids within it.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import doc_text, fresh_path, keep


@dataclass(frozen=True)
class StoreFormat:
    """tokenizer: a file of the tokenizers library. end_id ends each document. Chunks have about 2**cut_bits ids, least
    at the least (but for a document's last) and most at the most."""

    tokenizer: str
    end_id: int = 2
    cut_bits: int = 8
    least: int = 64
    most: int = 2048
    seed: int = 11


DIGEST = 16


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle_root(digests: list[bytes]) -> bytes:
    """Of an empty list the digest of nothing; an odd digest rises by itself."""
    level = [digest(b"\x00" + d) for d in digests] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\x01" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class MerkleStream:
    """merkle_root of a stream, holding a digest for each level only: full subtrees are joined as they come."""

    def __init__(self):
        self.stack: list[tuple[int, bytes]] = []

    def add(self, d: bytes) -> None:
        height, node = 0, digest(b"\x00" + d)
        while self.stack and self.stack[-1][0] == height:
            node = digest(b"\x01" + self.stack.pop()[1] + node)
            height += 1
        self.stack.append((height, node))

    def root(self) -> bytes:
        if not self.stack:
            return merkle_root([])
        nodes = [n for _, n in self.stack]
        root = nodes.pop()
        while nodes:
            root = digest(b"\x01" + nodes.pop() + root)
        return root


def id_type(fmt: StoreFormat) -> str:
    """Two bytes an id where the vocabulary allows it."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(fmt.tokenizer).get_vocab_size(), fmt.end_id + 1) <= 1 << 16 else "<u4"


#: Normalizer and pre-tokenizer for which texts can be encoded word by word (below).
BY_WORDS = (
    ["NFC", "Replace", "Lowercase"],
    "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
)


class Encoder:
    """Ids of whole texts; texts come as Arrow strings.

    Any tokenizer encodes whole texts. One whose file has the rules of BY_WORDS joins nothing that its pattern parts; then
    texts are cut into pieces here, each piece of a slice is looked up once, and new pieces go to the tokenizer's model. Where a text has other characters than PLAIN's, whose
    normal form and classes are the same everywhere, or a special token's sign, its words that do are encoded whole. What
    has been looked up is kept, up to a bound.
    """

    #: ASCII, Latin letters and common punctuation; white space is ASCII's. Letters are left out whose small form is not
    #: one of these (capitals such as that of U+0259, and the dotted I, which becomes two characters).
    LATIN = "".join(c for c in map(chr, range(0xA1, 0x250)) if len(c.lower()) == 1 and ord(c.lower()) < 0x250)
    PLAIN = f"!-~{re.escape(LATIN)}\u2010-\u2027"
    LETTER, NUMBER = "a-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"

    def __init__(self, fmt: StoreFormat, dtype: str, cache: int = 500_000, slice: int = 1 << 23):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.limit, self.slice = Tokenizer.from_file(fmt.tokenizer), np.dtype(dtype), cache, slice
        self.end = np.array([fmt.end_id], self.dtype)
        self.known: dict[str, bytes] = {"": b""}
        rules = json.loads(self.tokenizer.to_str())
        self.by_words = self._by_words(rules)
        if self.by_words:
            self.signs = re.compile("|".join(re.escape(x["content"]) for x in rules["added_tokens"]) or "(?!)").search
            self.plain_text, self.plain_word = re.compile(f"[{self.PLAIN}\\t-\\r ]*").fullmatch, re.compile(f"[{self.PLAIN}]+").fullmatch
            # Runs of letters are what is left between the others.
            self.others = f"('s|'t|'re|'ve|'m|'ll|'d|[{self.NUMBER}]|[^{self.LETTER}{self.NUMBER}\\t-\\r ]+)"
            self.model = self.tokenizer.model
            # The signs that stand for bytes: printable ones for themselves, the others for those after U+00FF, in order.
            own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
            rest = [b for b in range(256) if b not in own]
            self.signs_of_bytes = {b: chr(256 + i) for i, b in enumerate(rest)}

    @staticmethod
    def _by_words(rules: dict) -> bool:
        normal, cuts, model = rules.get("normalizer") or {}, rules.get("pre_tokenizer") or {}, rules["model"]
        steps = normal.get("normalizers") or []
        parts = cuts.get("pretokenizers") or []
        return (
            [x["type"] for x in steps] == BY_WORDS[0] and steps[1].get("pattern") == {"Regex": "\\s+"} and steps[1].get("content") == " "
            and [x["type"] for x in parts] == ["Split", "ByteLevel"] and parts[0].get("pattern") == {"Regex": BY_WORDS[1]} and parts[0].get("behavior") == "Removed" and bool(parts[0].get("invert"))
            and not parts[1].get("use_regex") and not parts[1].get("add_prefix_space")
            and model.get("type") == "BPE" and bool(model.get("end_of_word_suffix")) and not model.get("continuing_subword_prefix") and not model.get("dropout") and not model.get("ignore_merges")
            and not rules.get("truncation") and not rules.get("padding")
            and all(x["content"] and not re.search(r"\s", x["content"]) and not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) for x in rules.get("added_tokens", []))
        )

    @classmethod
    def of_process(cls, fmt: StoreFormat, dtype: str) -> Encoder:
        """One for all tasks of a Python worker, so that what it has learnt is kept between them."""
        kept = sys.modules.setdefault("_tessera_worker", types.ModuleType("_tessera_worker")).__dict__
        key = ("encoder", fmt.tokenizer, fmt.end_id, dtype)
        if key not in kept:
            kept[key] = cls(fmt, dtype)
        return kept[key]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, texts: list[str]) -> pa.ListArray:
        """Each text's pieces; words that are encoded whole come as they are, after a sign that no piece has."""
        plain = [self.plain_text(t) is not None and not self.signs(t) for t in texts]
        parts = [t.lower() if ok else "" for t, ok in zip(texts, plain, strict=True)]
        cut = pc.replace_substring_regex(pa.array(parts, pa.large_string()), self.others, " \\1 ")
        if not all(plain):  # rare: their words go in between again
            out = cut.to_pylist()
            for i, ok in enumerate(plain):
                if not ok:
                    words = [w for w in re.split("[\t-\r ]+", texts[i]) if w]
                    own = [self.plain_word(w) is None or self.signs(w) is not None for w in words]
                    pieces = pc.replace_substring_regex(pa.array([w.lower() for w in words], pa.large_string()), self.others, " \\1 ").to_pylist()
                    out[i] = " ".join("\x01" + w if o else p for w, o, p in zip(words, own, pieces, strict=True))
            cut = pa.array(out, pa.large_string())
        return pc.ascii_split_whitespace(cut)

    def _learn(self, new: list[str]) -> None:
        words = [u for u in new if u[0] == "\x01"]
        self.known.update(zip(words, self._whole([w[1:] for w in words]), strict=True))
        ids: list[int] = []
        ends = [0]
        tokenize, signs = self.model.tokenize, self.signs_of_bytes
        pieces = [u for u in new if u[0] != "\x01"]
        for p in pieces:
            ids += [t.id for t in tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(signs))]
            ends.append(len(ids))
        data, width = np.array(ids, self.dtype).tobytes(), self.dtype.itemsize
        self.known.update((p, data[a * width : b * width]) for p, a, b in zip(pieces, ends[:-1], ends[1:], strict=True))

    def _slice(self, texts: list[str]) -> Iterator[np.ndarray]:
        if not self.by_words:
            for data in self._whole(texts):
                yield np.concatenate([np.frombuffer(data, self.dtype), self.end])
            return
        units = self._cut(texts)
        bounds = units.offsets.to_numpy() - units.offsets[0].as_py()
        coded = units.flatten().dictionary_encode()
        codes, vocabulary = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > self.limit:
            self.known = {"": b""}
        known = self.known
        self._learn([u for u in vocabulary if u not in known])
        found = [known[u] for u in vocabulary]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        table, at = np.frombuffer(b"".join(found), self.dtype), np.cumsum(sizes) - sizes
        lengths = sizes[codes]
        before = np.concatenate([[0], np.cumsum(lengths)])
        ids = table[np.repeat(at[codes] - before[:-1], lengths) + np.arange(before[-1])]
        ends = before[bounds].tolist()
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield np.concatenate([ids[a:b], self.end])

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text and the end id, slice by slice of so many bytes (one text at least)."""
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < len(texts):
            done = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, done + self.slice, side="right")))
            yield from self._slice(texts.slice(begin, end - begin).to_pylist())
            begin = end


class Cutter:
    """Ends of chunks. The hash at a place is of the 16 ids up to it, so equal passages are cut alike wherever they are."""

    def __init__(self, fmt: StoreFormat):
        self.gear = np.random.default_rng(fmt.seed).integers(0, 2**64, 1 << 16, dtype=np.uint64)
        self.fmt, self.shift = fmt, np.uint64(64 - fmt.cut_bits)

    def __call__(self, ids: np.ndarray) -> list[int]:
        n, fmt = len(ids), self.fmt
        if n <= fmt.least:
            return [n]
        h = self.gear[ids & 0xFFFF]
        for step in (1, 2, 4, 8):
            h[step:] += h[:-step] << np.uint64(step)
        ends, at = [], 0
        for cut in chain((np.flatnonzero(h >> self.shift == 0) + 1).tolist(), [n]):
            while cut - at > fmt.most:
                at += fmt.most
                ends.append(at)
            if cut - at >= fmt.least or cut == n:
                if cut > at:
                    ends.append(cut)
                    at = cut
        return ends


def cut_up(ids: np.ndarray, cutter: Cutter) -> tuple[list[bytes], list[int]]:
    """Chunks' bytes and lengths."""
    ends = cutter(ids)
    starts = [0, *ends[:-1]]
    return [ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], [b - a for a, b in zip(starts, ends, strict=True)]


PACK = "segment int, seq long, id long, n_tokens long, start_in_segment long, root binary, digests binary, lengths array<int>, foreign array<int>, lent array<int>, payload binary"


def _recipes(texts: DataFrame, fmt: StoreFormat, dtype: str) -> DataFrame:
    """id, root, digests, lengths and payload (all ids) for each row of texts (id, t)."""
    names = ["id", "root", "digests", "lengths", "payload"]
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, cutter = Encoder.of_process(fmt, dtype), Cutter(fmt)
        for batch in batches:
            out, size = [], 0
            for id_, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                parts, lengths = cut_up(ids, cutter)
                digests = [digest(c) for c in parts]
                out.append((id_, merkle_root(digests), digests, lengths, ids.tobytes()))
                size += ids.nbytes
                if size > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return texts.mapInArrow(run, "id long, root binary, digests array<binary>, lengths array<int>, payload binary")


def write_store(docs: DataFrame, fmt: StoreFormat, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encodes all documents and writes the store; returns its folder.

    A null text is empty: its ids are the end id alone. Rows without an id come first. Rows that repeat id and text store
    nothing more. Very long texts are encoded whole, slice by slice of a batch's bytes. An empty table gives a store without
    documents.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), doc_text(text_col).alias("t"))
    dtype = id_type(fmt)
    width = np.dtype(dtype).itemsize
    encoded = keep(_recipes(texts, fmt, dtype), "encoded", compression="zstd")
    # Which chunks are shared, and who owns them: digests alone travel.
    recipes = encoded.select("id", "root", "digests")
    chunks = recipes.select("id", "root", F.posexplode("digests").alias("idx", "digest"))
    owners = chunks.groupBy("digest").agg(F.min(F.struct("id", "root", "idx")).alias("owner"), F.count("*").alias("n")).filter("n > 1").select("digest", "owner")
    shared = chunks.join(owners, "digest")
    own = F.struct("id", "root", "idx").eqNullSafe(F.col("owner"))
    flags = shared.groupBy("id", "root").agg(
        F.sort_array(F.collect_set(F.when(~own, F.col("idx")))).alias("foreign"), F.sort_array(F.collect_set(F.when(own, F.col("idx")))).alias("lent")
    )
    # Flags meet their documents in the one sort by id, and packs are written from it.
    none = F.lit(None)
    both = flags.select(
        "id", F.lit(0).alias("kind"), "root", none.cast("binary").alias("digests"), none.cast("array<int>").alias("lengths"), none.cast("binary").alias("payload"), "foreign", "lent"
    ).unionByName(
        encoded.select(
            "id", F.lit(1).alias("kind"), "root", F.unhex(F.array_join(F.transform("digests", F.hex), "")).alias("digests"), "lengths", "payload",
            none.cast("array<int>").alias("foreign"), none.cast("array<int>").alias("lent"),
        )
    )
    # By id and text, so that many rows of one id, or without any, are no single task's; repeats of a text stay together.
    placed = both.repartitionByRange("id", "root").sortWithinPartitions("id", "root", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, segment, seq, start = MerkleStream(), TaskContext.get().partitionId(), 0, 0
        at, marked, seen = None, ([], []), False
        names = [x.split()[0] for x in PACK.split(", ")]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.list_(pa.int32())] * 3, pa.binary()]

        def rows(out: list) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            columns = [batch.column(i) for i in range(8)]
            out, size = [], 0
            for id_, kind, root, digests, lengths, payload, foreign, lent in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2].to_pylist(), *columns[3:], strict=True):
                if (id_, root) != at:
                    at, marked, seen = (id_, root), ([], []), False
                if kind == 0:
                    marked = (foreign.as_py(), lent.as_py())
                    continue
                lengths, data = lengths.as_py(), payload.as_py()
                foreign_, lent_ = (list(range(len(lengths))), []) if seen else marked
                seen = True
                n_tokens = len(data) // width
                if foreign_:
                    gone, parts, place = set(foreign_), [], 0
                    for i, n in enumerate(lengths):
                        if i not in gone:
                            parts.append(data[place : place + n * width])
                        place += n * width
                    data = b"".join(parts)
                out.append((segment, seq, id_, n_tokens, start, root, digests.as_py(), lengths, foreign_, lent_, data))
                tree.add(root)
                seq, start, size = seq + 1, start + n_tokens, size + len(data)
                if size > 1 << 24:
                    yield rows(out)
                    out, size = [], 0
            yield rows(out)
        if seq:  # the segment's manifest
            yield rows([(segment, -1, None, start, seq, tree.root(), b"", [], [], [], b"")])

    placed.mapInArrow(run, PACK).write.option("compression", "zstd").parquet(f"{folder}/packs")
    return folder


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """segment, n_docs, n_tokens, root, start (ids of all segments before)."""
    rows = spark.read.schema(PACK).parquet(f"{folder}/packs").filter("seq = -1").select("segment", F.col("start_in_segment").alias("n_docs"), "n_tokens", "root")
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_store(spark: SparkSession, folder: str, fmt: StoreFormat) -> DataFrame:
    """id, segment, seq, start, n_tokens and ids (little-endian unsigned 32-bit) of every document, put together and verified."""
    dtype = id_type(fmt)
    width = np.dtype(dtype).itemsize
    packs = spark.read.schema(PACK).parquet(f"{folder}/packs").filter("seq >= 0")
    shape = "segment int, seq long, id long, n_tokens long, start_in_segment long, root binary, digests binary, lengths array<int>, foreign array<int>, payload binary"
    columns = [x.split()[0] for x in shape.split(", ")]

    def lend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = [], []
            for digests, lengths, foreign, lent, payload in zip(*(batch.column(i) for i in range(5)), strict=True):
                digests, gone, want, payload, at = digests.as_py(), set(foreign.as_py()), set(lent.as_py()), payload.as_py(), 0
                for i, n in enumerate(lengths.as_py()):
                    if i not in gone:
                        if i in want:
                            keys.append(digests[i * DIGEST : (i + 1) * DIGEST])
                            values.append(payload[at : at + n * width])
                        at += n * width
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values, pa.binary())], ["digest", "chunk"])

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "segment", "seq", "start_in_segment", "n_tokens", "ids"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            out, size = [], 0
            for segment, seq, id_, n_tokens, start, root, digests, lengths, foreign, payload, got in zip(*(batch.column(i) for i in range(11)), strict=True):
                digests, payload, at = digests.as_py(), payload.as_py(), 0
                lent = {x["idx"]: x["chunk"] for x in got.as_py() or []}
                gone, parts = set(foreign.as_py()), []
                for i, n in enumerate(lengths.as_py()):
                    if i in gone:
                        parts.append(lent[i])
                    else:
                        parts.append(payload[at : at + n * width])
                        at += n * width
                    if digest(parts[-1]) != digests[i * DIGEST : (i + 1) * DIGEST]:
                        raise ValueError(f"document {id_}: chunk {i} does not have its digest")
                if merkle_root([digests[i : i + DIGEST] for i in range(0, len(digests), DIGEST)]) != root.as_py():
                    raise ValueError(f"document {id_}: the recipe does not have its root")
                ids = np.frombuffer(b"".join(parts), dtype)
                if len(ids) != n_tokens.as_py():
                    raise ValueError(f"document {id_}: ids are missing")
                out.append((id_.as_py(), segment.as_py(), seq.as_py(), start.as_py(), len(ids), ids.astype("<u4").tobytes()))
                size += 4 * len(ids)
                if size > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    chunks = packs.filter(F.size("lent") > 0).select("digests", "lengths", "foreign", "lent", "payload").mapInArrow(lend, "digest binary, chunk binary")
    needy = packs.filter(F.size("foreign") > 0)
    asked = needy.select("segment", "seq", "digests", F.explode("foreign").alias("idx"))
    asked = asked.select("segment", "seq", "idx", F.substring("digests", F.col("idx") * DIGEST + 1, F.lit(DIGEST)).alias("digest"))
    got = asked.join(chunks, "digest").groupBy("segment", "seq").agg(F.collect_list(F.struct("idx", "chunk")).alias("got"))
    alone = packs.filter(F.size("foreign") == 0).select(*columns, F.lit(None).cast("array<struct<idx:int,chunk:binary>>").alias("got"))
    rows = alone.unionByName(needy.select(columns).join(got, ["segment", "seq"]).select(*columns, "got"))
    read = rows.mapInArrow(join_up, "id long, segment int, seq long, start_in_segment long, n_tokens long, ids binary")
    starts = manifests(spark, folder).select("segment", F.col("start").alias("_start"))
    return read.join(starts, "segment").select("id", "segment", "seq", (F.col("start_in_segment") + F.col("_start")).alias("start"), "n_tokens", "ids")
