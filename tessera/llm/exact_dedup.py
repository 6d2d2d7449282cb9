"""Exact deduplication with a log-structured merge index of text digests.

Batches of rows go through memtables: each flush writes sorted runs, one for each memtable, cut into shards by the digest's
first digits so that a run is sorted across its files; every file carries the digests' Parquet Bloom filter and ranges, by
which a lookup of a few digests skips files and row groups. Compaction makes fan_in runs of a level into one of the next
until a single run is left. Each run has a filter (a bitmap over hashes of its digests): an entry that no other run's
filter of the group knows passes as it is; what is left of the runs, sorted by digest, is merged two and two by sort-merge
joins. An entry keeps, for its digest, the identifier that stays, the rows it stands for, and how many of them have that
identifier. Every hit - a row whose digest another row has - is then held against the bytes of the row that stays; digests
under which texts differ are grouped anew by the texts themselves.

All of it is DataFrame operations. Groups of any size are handled by partial aggregation and by joins that Spark can
split; no task or driver holds a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, delete, doc_text, fresh_path, hex_digits, unused

ENTRY = "digest binary, keep_id long, group_size long, n_keep long"


class DigestIndex:
    """Runs on disk by level: level 0 holds flushed memtables, higher ones compacted runs.

    keep_largest tells which identifier of equal digests stays: the largest or the smallest. memtable: rows of one, about;
    fan_in: runs that a merge makes into one. log: of each merge its level, runs, entries, and how many of these passed the
    filters by themselves.
    """

    #: Bits of a filter for each entry of its run, and of the bitmaps that Spark's bitmap functions make.
    BITS, BITMAP = 16, 32_768

    def __init__(self, spark: SparkSession, keep_largest: bool = False, memtable: int = 4_000_000, fan_in: int = 8):
        self.spark, self.keep_largest, self.memtable, self.fan_in = spark, keep_largest, memtable, fan_in
        self.levels: list[list[str]] = [[]]
        self.rows = 0
        self.log: list[dict[str, int]] = []

    def _write(self, entries: DataFrame, runs: int, rows: int) -> list[str]:
        """entries with their run's number: a folder for each run, sorted by shard and, within it, by digest."""
        digits = hex_digits(rows // 50_000)  # shards of some hundred thousand rows and up, about the square root as many
        sharded = entries.withColumn("shard", F.substring(F.lower(F.hex(F.substring("digest", 1, 4))), 1, digits))
        options = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": str(max(64, rows // (runs * 16**digits)))}
        path = fresh_path(self.spark, "runs")
        sharded.repartition("run", "shard").sortWithinPartitions("run", "shard", "digest").write.options(**options).partitionBy("run", "shard").parquet(path)
        return [f"{path}/run={i}" for i in range(runs)]

    def _read(self, paths: Sequence[str], number: int = 0) -> DataFrame:
        parts = [self.spark.read.schema(ENTRY + ", shard string").option("basePath", p).parquet(p) for p in paths if self._there(p)]
        if not parts:  # no partition of rows was dealt to that memtable
            return self.spark.createDataFrame([], ENTRY).withColumn("run", F.lit(number))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.drop("shard").withColumn("run", F.lit(number))

    def _there(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _counted(self, rows: DataFrame) -> DataFrame:
        """A memtable's rows (run, digest, id) as one entry for each digest."""
        each = rows.groupBy("run", "digest", "id").agg(F.count("*").alias("n"))
        stays, by = (F.max, F.max_by) if self.keep_largest else (F.min, F.min_by)
        # Rows without an id count for the group; if no row has one, they are those that stay.
        return each.groupBy("run", "digest").agg(stays("id").alias("keep_id"), F.sum("n").alias("group_size"), F.coalesce(by("n", "id"), F.sum("n")).alias("n_keep"))

    def _two(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """The entries of two runs, merged in the order of their digests."""
        old = {c: f"_{c}" for c in ("digest", "keep_id", "group_size", "n_keep")}
        joined = a.join(b.select(*[F.col(c).alias(o) for c, o in old.items()]).hint("merge"), F.col("digest") == F.col("_digest"), "full")
        keep = (F.greatest if self.keep_largest else F.least)("keep_id", "_keep_id")
        share = lambda k, n: F.when(F.col(k).eqNullSafe(keep), F.coalesce(n, F.lit(0))).otherwise(F.lit(0))
        total = F.coalesce("group_size", F.lit(0)) + F.coalesce("_group_size", F.lit(0))
        return joined.select(F.coalesce("digest", "_digest").alias("digest"), keep.alias("keep_id"), total.alias("group_size"), (share("keep_id", "n_keep") + share("_keep_id", "_n_keep")).alias("n_keep"))

    def _tested(self, entries: DataFrame, runs: int) -> DataFrame:
        """entries (run, digest, ...) with shared: the filter of another run may know the digest.

        Filters are rows of bitmaps; an entry meets those of its bucket, one for each run."""
        buckets = max(1, -(-self.BITS * self.rows // (runs * self.BITMAP)))
        hashed = F.xxhash64("digest")
        placed = entries.withColumns({"bucket": F.pmod(hashed, F.lit(buckets)), "bit": F.pmod(F.shiftright(hashed, 40), F.lit(self.BITMAP))})
        bitmaps = placed.groupBy("run", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
        filters = bitmaps.groupBy(F.col("bucket").alias("_bucket")).agg(F.collect_list(F.struct("run", "bits")).alias("filters"))
        byte = lambda bits: F.conv(F.hex(F.substring(bits, (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        knows = lambda f: (f["run"] != F.col("run")) & (F.getbit(byte(f["bits"]), F.col("bit") % 8) == 1)
        return placed.join(filters, F.col("bucket") == F.col("_bucket")).withColumn("shared", F.exists("filters", knows)).drop("bucket", "bit", "_bucket", "filters")

    def _merge(self, paths: Sequence[str], level: int) -> str:
        """A run with one entry for each digest of the runs, which go."""
        entries = self._read(paths[:1], 0)
        for i, path in enumerate(paths[1:], 1):
            entries = entries.unionByName(self._read([path], i))
        where = fresh_path(self.spark, "tested")
        self._tested(entries, len(paths)).write.partitionBy("shared", "run").parquet(where)
        tested = self.spark.read.schema(ENTRY + ", shared boolean, run int").parquet(where)
        counts = {r["shared"]: r["n"] for r in tested.groupBy("shared").agg(F.count("*").alias("n")).collect()}
        self.log.append({"level": level, "runs": len(paths), "entries": sum(counts.values()), "passed": counts.get(False, 0)})
        left = [tested.filter(F.col("shared") & (F.col("run") == i)).drop("shared", "run") for i in range(len(paths))]
        while len(left) > 1:
            left = [self._two(*left[i : i + 2]) if i + 1 < len(left) else left[i] for i in range(0, len(left), 2)]
        merged = tested.filter(~F.col("shared")).drop("shared", "run").unionByName(left[0])
        run = self._write(merged.withColumn("run", F.lit(0)), 1, self.rows)[0]
        delete(self.spark, where, *paths)
        return run

    def flush(self, rows: DataFrame, n: int) -> None:
        """rows: digest, id; n: how many, about. Rows are dealt to memtables by the partition that they arrive in."""
        tables = max(1, -(-n // self.memtable))
        dealt = rows.select((F.spark_partition_id() % tables).alias("run"), "digest", "id")
        self.levels[0] += self._write(self._counted(dealt), tables, n)
        self.rows += n

    def compact(self) -> DataFrame:
        """Merges level by level until one run holds all: digest, keep_id, group_size, n_keep."""
        while sum(map(len, self.levels)) > 1:
            level = next(i for i, runs in enumerate(self.levels) if runs)
            if len(self.levels[level]) == 1:  # alone: it waits for the next level's runs
                self._level(level + 1).extend(self.levels[level])
                self.levels[level] = []
                continue
            runs = self.levels[level]
            for group in (runs[i : i + self.fan_in] for i in range(0, len(runs), self.fan_in)):
                self._level(level + 1).append(self._merge(group, level) if len(group) > 1 else group[0])
            self.levels[level] = []
        last = [run for runs in self.levels for run in runs]
        return self._read(last).drop("run")

    def _level(self, i: int) -> list[str]:
        while len(self.levels) <= i:
            self.levels.append([])
        return self.levels[i]

    def lookup(self, digests: Sequence[bytes]) -> DataFrame:
        """The entries of a few digests in all runs: other shards are not read, and filters skip files without them."""
        paths = [run for runs in self.levels for run in runs if self._there(run)]
        out = self.spark.createDataFrame([], ENTRY)
        for p in paths:
            own = self.spark.read.schema(ENTRY + ", shard string").option("basePath", p).parquet(p)
            shards = F.lit(False)
            for d in digests:
                shards = shards | F.lit(bytes(d).hex()).startswith(F.col("shard"))
            out = out.unionByName(own.filter(shards & F.col("digest").isin([F.lit(bytearray(d)) for d in digests])).drop("shard"))
        return out


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def memtable_rows(n: int) -> int:
    """Rows of a memtable for n in all: at most 4,000,000 while 8 to 64 memtables hold them, else a 64th."""
    return max(1, -(-n // 64), min(4_000_000, -(-n // 8)))


def exact_dedup(
    docs: DataFrame, keep_largest: bool = False, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None
) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when all their bytes are; a null text is empty. Of equal texts the row with the smallest (or, with
    keep_largest, the largest) id stays. Rows without an id stay only if no row of their text has one. Rows that repeat
    both id and text are one document: each of them is returned, with the same values. An empty table gives an empty one.
    Other columns of docs are ignored. index: an empty one to use, else one with memtables of memtable_rows; keep_largest
    should be its own.
    """
    labelled = _labelled(docs, keep_largest, id_col, text_col, index)
    return labelled.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def _labelled(docs: DataFrame, keep_largest: bool, id_col: str, text_col: str, index: DigestIndex | None = None) -> DataFrame:
    """digest, id, keep_id, group_size, n_keep for each row."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), doc_text(text_col).alias("t"))
    rows = scratch.keep(texts.select(digest_of(F.col("t")).alias("digest"), "id"), "digests")
    n = rows.count()
    index = index or DigestIndex(docs.sparkSession, keep_largest, memtable_rows(n))
    # Dealt to at least as many partitions as there are memtables; rows of a text go to any of them.
    index.flush(rows.repartition(max(1, -(-n // index.memtable)) * 4), n)
    found = index.compact().filter("group_size > 1")
    # A row alone with its digest stays; only groups are looked up.
    groups = scratch.keep(found, "groups")
    one = F.lit(1).cast("long")
    labelled = rows.join(groups.withColumn("_hit", F.lit(True)), "digest", "left").select(
        "digest", "id", F.when(F.col("_hit"), F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"), F.coalesce("group_size", one).alias("group_size"), F.coalesce("n_keep", one).alias("n_keep")
    )
    # Byte verification: the texts of hits, each held against the text that stays.
    # One plan at every size: the texts are dealt by digest, so the disk needed grows in proportion.
    groups = groups.select("digest", "keep_id").hint("merge")
    hits = scratch.keep(texts.withColumn("digest", digest_of(F.col("t"))).join(groups, "digest"), "hits")
    scratch.release()
    stays = hits.filter(F.col("id").eqNullSafe(F.col("keep_id"))).select("digest", F.col("t").alias("kept_t"))
    # Where rows repeat the id that stays, one of their texts stands for all; min needs no sort of whole groups.
    stays = scratch.keep(stays.groupBy("digest").agg(F.min("kept_t").alias("kept_t")), "stays")
    # Written before it is made distinct: else a large group would have to stay in the task that its digest is dealt to.
    wrong = scratch.keep(hits.join(stays, "digest").filter(F.col("t") != F.col("kept_t")).select("digest"), "wrong").distinct()
    if wrong.isEmpty():
        scratch.drop(hits, stays)
        return labelled
    again = hits.join(wrong, "digest").select("digest", "t", "id")
    stays_id, by_id = (F.max("id"), F.max_by("rows", "id")) if keep_largest else (F.min("id"), F.min_by("rows", "id"))
    counted = again.groupBy("digest", "t", "id").agg(F.count("*").alias("rows"))
    groups = counted.groupBy("digest", "t").agg(stays_id.alias("keep_id"), F.sum("rows").alias("group_size"), F.coalesce(by_id, F.max("rows")).alias("n_keep"))
    collided = scratch.keep(again.join(groups, ["digest", "t"]).select("digest", "id", "keep_id", "group_size", "n_keep"), "collided")
    return labelled.join(wrong, "digest", "left_anti").unionByName(collided)


def drop_copies(docs: DataFrame, keep_largest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever they are called.

    A null text is empty; rows without an id stay only if no row of their text has one. Of rows that repeat id and text
    one stays, the least by its other columns, so reruns agree. An empty table gives an empty one.
    """
    labelled = _labelled(docs, keep_largest, id_col, text_col)
    id_, digest, own = (unused(docs, c) for c in ("_gone_id", "_gone_digest", "_digest"))
    # Not made distinct, which would tie a large group to the task that its digest is dealt to; an anti join needs no such thing.
    gone = labelled.filter(~F.col("id").eqNullSafe(F.col("keep_id"))).select(F.col("id").alias(id_), F.col("digest").alias(digest))
    kept = docs.withColumn(own, digest_of(doc_text(text_col)))
    kept = kept.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(digest)), "left_anti")
    if not labelled.filter(F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n_keep") > 1)).isEmpty():
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        by = F.to_json(row, {"ignoreNullFields": "false"})
        return kept.groupBy(F.col(id_col), F.col(own)).agg(F.min_by(row, by).alias("row")).select("row.*")
    return kept.drop(own)
