"""Packing into length buckets whose boundaries minimise padding, and batches of a token budget within each bucket.

The histogram of all lengths is exact and comes to the driver as Arrow columns. It has a row for each different length: of
documents with T tokens in all there are at most sqrt(2 T) of them, as that many different lengths add up to T. Dynamic
programming over it finds the boundaries with the least padding there is. Every document then gets its bucket by an
expression and its batch by a distributed rank.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import doc_text, keep, order_hash, running_total, word_count

@dataclass(frozen=True)
class Packing:
    """At most buckets lengths; a batch holds up to budget tokens, padding counted, and one document at least."""

    buckets: int = 16
    budget: int = 65_536
    seed: str = "pack"


def best_boundaries(tops: Sequence[int], counts: Sequence[int], sums: Sequence[int], buckets: int) -> list[int]:
    """Ends of at most buckets ranges of lengths (tops, ascending, with their documents and tokens) with the least padding in all.

    A range's padding is its documents times its longest length less its tokens. The best first length of a last range
    does not move back as the range's end moves on, so each layer is solved by halving.
    """
    m = len(tops)
    if m == 0:
        return []
    top = np.asarray(tops, float)
    c, s = np.concatenate([[0.0], np.cumsum(np.asarray(counts, float))]), np.concatenate([[0.0], np.cumsum(np.asarray(sums, float))])
    best = top * c[1:] - s[1:]
    choice = [np.zeros(m, int)]
    for _ in range(min(buckets, m) - 1):
        new, at = np.empty(m), np.zeros(m, int)
        prev = np.concatenate([[0.0], best])
        lo, hi, a, b = (np.array([x]) for x in (0, m - 1, 0, m - 1))
        while len(lo):  # all middles of one depth of the halving at once
            mid = (lo + hi) // 2
            n = np.minimum(b, mid) - a + 1
            begin = np.cumsum(n) - n
            i = np.repeat(a - begin, n) + np.arange(n.sum())
            end = np.repeat(mid, n)
            cost = prev[i] + top[end] * (c[end + 1] - c[i]) - (s[end + 1] - s[i])
            least = np.minimum.reduceat(cost, begin)
            first = np.minimum.reduceat(np.where(cost == np.repeat(least, n), i, m), begin)
            new[mid], at[mid] = least, first
            lo, hi, a, b = (np.concatenate(x) for x in ((lo, mid + 1), (mid - 1, hi), (a, first), (first, b)))
            lo, hi, a, b = (x[lo <= hi] for x in (lo, hi, a, b))
        choice.append(at)
        best = new
    ends, j = [], m - 1
    for at in reversed(choice):
        ends.append(int(tops[j]))
        j = int(at[j]) - 1
        if j < 0:
            break
    return ends[::-1]


def boundaries(sized: DataFrame, packing: Packing) -> list[int]:
    """From the histogram of size over all rows."""
    histogram = sized.groupBy("size").agg(F.count("*").alias("n")).orderBy("size").toArrow()
    tops, counts = (histogram.column(c).to_numpy() for c in ("size", "n"))
    return best_boundaries(tops, counts, tops * counts, packing.buckets)


def pack(docs: DataFrame, packing: Packing | None = None, size: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, bucket, bucket_len, batch (in its bucket), slot (in its batch).

    size: tokens of a row, else its words. A null text has none and goes to the shortest bucket. Documents of a bucket
    are batched in the order of a hash of their ids, or of their texts where they have none; repeated rows lie next to each other. A document longer than the
    budget, however long, is a batch. Other columns are ignored; an empty table gives an empty one.
    """
    packing = packing or Packing()
    size = word_count(doc_text(text_col)) if size is None else size
    sized = keep(docs.select(F.col(id_col).cast("long").alias("id"), size.cast("long").alias("size"), order_hash(packing.seed, id_col, text_col).alias("h")), "lengths")
    ends = boundaries(sized, packing)
    lengths = F.array(*[F.lit(int(x)).cast("long") for x in ends or [0]])
    bucket = F.size(F.filter(lengths, lambda x: x < F.col("size")))
    df = sized.withColumn("bucket", bucket).withColumn("bucket_len", F.get(lengths, F.col("bucket")))
    df = running_total(df.withColumn("one", F.lit(1).cast("long")), "bucket", "h", ["id", "size"], "one", "rank", sized.count())
    each = F.greatest(F.floor(F.lit(packing.budget) / F.greatest("bucket_len", F.lit(1))), F.lit(1))
    return df.select(
        F.col("id").alias(id_col), F.col("size").alias("n_tokens"), "bucket", "bucket_len", F.floor(F.col("rank") / each).alias("batch"), (F.col("rank") % each).alias("slot")
    )
