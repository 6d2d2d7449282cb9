"""Filter interaction audit: what each of several filters removes, in every order, and its Shapley value.

Spark reduces the documents to mask counts: for each part, how many documents fail which set of filters. From a part's
counts (at most 2^filters rows) its removal polynomial is formed,

    f(x) = sum over masks m of n(m) * (1 - product of (1 - x_i) for i in m),

the multilinear extension of "documents removed by a set of filters". Its value at a corner is what that set removes, so
an order's survivors are differences of corner values. A filter's Shapley value is the integral of the partial derivative
along the diagonal from 0 to 1, taken with exact rationals.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, doc_text
from tessera.llm.quality import let

AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
)


@dataclass(frozen=True)
class Filters:
    """A fails under min_words words; B where 100 * different words < min_distinct_percent * words; C where 100 * capitals
    A-Z > max_capital_percent * code points; D where any of symbols occurs; E where a smaller id has the same text."""

    min_words: int = 200
    min_distinct_percent: int = 50
    max_capital_percent: int = 3
    symbols: str = "#$%&*|"

    @property
    def names(self) -> str:
        return "ABCDE"


class RemovalPolynomial:
    """Coefficients of f by monomial: bit i of a monomial's number says that x_i is in it. Whole numbers of any size."""

    def __init__(self, counts: Mapping[int, int], filters: int):
        self.filters = filters
        above = [counts.get(m, 0) for m in range(1 << filters)]
        for i in range(filters):  # above[t]: documents whose mask holds all of t
            for t in range(1 << filters):
                if not t >> i & 1:
                    above[t] += above[t | 1 << i]
        self.coefficients = [0 if t == 0 else above[t] * (-1) ** (t.bit_count() + 1) for t in range(1 << filters)]
        # At a corner only monomials within it count.
        corners = list(self.coefficients)
        for i in range(filters):
            for s in range(1 << filters):
                if s >> i & 1:
                    corners[s] += corners[s ^ 1 << i]
        self.corners = corners

    def at(self, corner: int) -> int:
        """Documents that the filters of corner remove together."""
        return self.corners[corner]

    def partial_integral(self, i: int) -> Fraction:
        """The integral over t from 0 to 1 of the partial derivative by x_i at (t, ..., t): filter i's Shapley value.

        The derivative of a monomial with x_i in it is t to the power of its other variables' number."""
        return sum((Fraction(c, t.bit_count()) for t, c in enumerate(self.coefficients) if t >> i & 1), Fraction(0))


def audit_rows(part: str, counts: Mapping[int, Sequence[int]], names: str) -> Iterator[tuple]:
    """Rows of AUDIT for a part. counts: for each mask its documents, those labelled good, those labelled toxic."""
    k = len(names)
    total = sum(c[0] for c in counts.values())
    every, good, toxic = (RemovalPolynomial({m: c[j] for m, c in counts.items()}, k) for j in range(3))
    full = (1 << k) - 1
    shapley = [every.partial_integral(i) * factorial(k) for i in range(k)]
    assert all(s.denominator == 1 for s in shapley)
    for order in permutations(range(k)):
        name, before = "".join(names[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = every.at(after) - every.at(before)
            yield (
                part, name, step, total - every.at(after), removed, every.at(1 << i) - removed, every.at(full) - every.at(full ^ 1 << i),
                good.at(after) - good.at(before), toxic.at(after) - toxic.at(before), shapley[i].numerator,
            )
            before = after


def text_mask(text: Column, filters: Filters) -> Column:
    """Bits of the filters that look at one text: A 1, B 2, C 4, D 8."""

    def bit(failed: Column, value: int) -> Column:
        return F.when(failed, F.lit(value)).otherwise(F.lit(0))

    def of_words(words: Column) -> Column:
        few = F.size(words) < filters.min_words
        same = 100 * F.size(F.array_distinct(words)).cast("long") < filters.min_distinct_percent * F.size(words).cast("long")
        return bit(few, 1) + bit(same, 2)

    by_words = let(F.array_remove(F.split(text, SPACES), ""), of_words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    # Quoted, so that any symbol stands for itself in the class.
    symbols = text.rlike("[\\Q" + filters.symbols + "\\E]") if filters.symbols else F.lit(False)
    return by_words + bit(100 * capitals > filters.max_capital_percent * F.length(text).cast("long"), 4) + bit(symbols, 8)


def mask_counts(
    docs: DataFrame, labels: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """part, mask, n, good, toxic: at most 32 rows for each part.

    Texts are read once and leave as digests. Copies are counted by digest before any row is dealt by digest alone, so a
    group of copies of any size is one row for each part that it occurs in.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), doc_text(text_col).alias("t"))
    rows = texts.select("id", "part", F.sha2("t", 256).alias("digest"), text_mask(F.col("t"), filters).alias("mask"))
    # Rows without an id have no label; they are dealt by their texts instead of all to one task.
    key = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("none:"), F.col("digest")))
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long"))
    marks = labels.groupBy(F.col(id_col).cast("long").cast("string").alias("key")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    counted = rows.groupBy(key.alias("key"), "digest", "part", "id").agg(F.first("mask").alias("mask"), F.count("*").alias("n"))
    counted = counted.join(marks, "key", "left")
    value = lambda c: (F.col("n") * F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c)
    counted = counted.select("digest", "part", "id", "mask", F.struct(F.col("n"), value("good"), value("toxic")).alias("v"))
    # Of each text and part: all rows, those of the smallest id, those without an id.
    sums = lambda name, c: [F.sum(F.coalesce(c[f], F.lit(0))).cast("long").alias(f"{name}_{f}") for f in ("n", "good", "toxic")]
    by_text = counted.groupBy("digest", "part").agg(
        F.first("mask").alias("mask"), F.min("id").alias("first"), F.min_by("v", "id").alias("at_first"), *sums("all", F.col("v")), *sums("none", F.when(F.col("id").isNull(), F.col("v")))
    )
    # Rows of the text's smallest id, and rows without an id, have no smaller id with their text; all others fail E.
    by_text = by_text.withColumn("is_first", F.coalesce(F.col("first") == F.min("first").over(Window.partitionBy("digest")), F.lit(False)))

    def split(f: str) -> tuple[Column, Column]:
        passed = F.col(f"none_{f}") + F.when(F.col("is_first"), F.coalesce(F.col(f"at_first.{f}"), F.lit(0))).otherwise(F.lit(0))
        return passed, F.col(f"all_{f}") - passed

    halves = [split(f) for f in ("n", "good", "toxic")]
    both = F.array(
        *[F.struct((F.col("mask") + bit).alias("mask"), *[h[j].cast("long").alias(f) for h, f in zip(halves, ("n", "good", "toxic"))]) for j, bit in ((0, 0), (1, 16))]
    )
    out = by_text.select("part", F.inline(both)).filter("n > 0")
    return out.groupBy("part", "mask").agg(*[F.sum(f).alias(f) for f in ("n", "good", "toxic")])


def audit_filters(
    docs: DataFrame, labels: DataFrame, filters: Filters | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """Rows of AUDIT: for each part, each order of the filters and each step, zeros included.

    docs: whole texts; a null text is empty (and fails A), a null part is the empty string. Repeated rows are counted each
    by itself; they do not make each other fail E, which needs a smaller id, nor do rows without an id. labels: id, quality,
    toxic; a document without a label is neither good nor toxic, and of repeated labels any 1 counts. No documents: no rows.
    Other columns are ignored. Very long texts are single rows of Column expressions.
    """
    filters = filters or Filters()
    names = filters.names
    counts = mask_counts(docs, labels, filters, id_col, text_col, part_col)

    def rows(table: pa.Table) -> pa.Table:
        got = table.to_pydict()
        masks = {m: (n, g, t) for m, n, g, t in zip(got["mask"], got["n"], got["good"], got["toxic"])}
        out = list(zip(*audit_rows(got["part"][0], masks, names)))
        kinds = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 7
        return pa.table([pa.array(c, kind) for c, kind in zip(out, kinds)], names=[c.split()[0] for c in AUDIT.split(", ")])

    return counts.groupBy("part").applyInArrow(rows, AUDIT)
