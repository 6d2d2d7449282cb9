"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks of words.

Each source's documents, shuffled by a hash, form a stream that is cut into blocks of equally many words. The mix is a
sequence of slots: slot n belongs to the source in whose share of [0, 1) the golden-ratio point frac((n + 1) * phi) falls,
and the k-th slot of a source takes the k-th block of its stream, beginning again when the stream ends. So every stretch
of the mix holds the sources in proportion, and nothing depends on how rows are partitioned.

Streams and ranks are distributed running totals; no task holds a source. Each document's row names its first slot, the
place in the mix at which its words begin to be taken.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import doc_text, keep, order_hash, running_total, unused, word_count

GOLDEN = 0.6180339887498949
#: Cells that slots and the sources' shares of [0, 1) are matched by.
GRID = 4096


@dataclass(frozen=True)
class Mix:
    """Sources in code point order (null last) weigh weights, repeating. The mix is percent of all words; a source gives
    its words max_epochs times at most, and what it can't give is shared by the others by weight."""

    weights: Sequence[int] = (5, 2, 1)
    percent: int = 150
    max_epochs: int = 2
    block: int = 256
    seed: str = "mix"


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """sizes: source, source_size. Adds source_no, weight, target (a double) and want (its whole words).

    One row for each source: the windows run over that table alone. Capped sources come first by cap / weight; the
    first source whose share of the rest does not reach its cap ends them.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(int(w)) for w in mix.weights])
    df = sizes.withColumn("source_no", F.row_number().over(every) - 1)
    df = df.withColumn("weight", F.element_at(weights, (F.col("source_no") % len(mix.weights) + 1).cast("int")).cast("long"))
    df = df.withColumn("cap", F.col("source_size") * mix.max_epochs)
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "source_no")
    before, onward, all_ = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumns(
        {
            "place": F.row_number().over(order),
            "capped_words": F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "weight_left": F.sum("weight").over(onward),
            "goal": F.sum("source_size").over(all_) * F.lit(mix.percent / 100.0),
        }
    )
    df = df.withColumn("rest", F.col("goal") - F.col("capped_words"))
    ends = F.col("cap") * F.col("weight_left") >= F.col("rest") * F.col("weight")
    end = F.min(F.when(ends, F.struct("place", "rest", "weight_left"))).over(all_)
    df = df.withColumn("end", end)
    uncapped = F.col("place") >= F.col("end.place")
    target = F.when(uncapped, F.col("weight") * F.col("end.rest") / F.col("end.weight_left")).otherwise(F.col("cap").cast("double"))
    df = df.withColumn("target", target).withColumn("want", F.least(F.floor("target"), F.col("cap")).cast("long"))
    return df.select("source", "source_no", "source_size", "weight", "target", "want")


def schedule(sources: DataFrame, mix: Mix) -> DataFrame:
    """Slots of the mix: n, source_no, k (rank among the source's slots), epoch, block, until (words of the epoch that count)."""
    spark = sources.sparkSession
    b = F.lit(mix.block)
    size, want = F.col("source_size"), F.col("want")
    whole, part = F.coalesce(F.try_divide(want - want % size, size), F.lit(0)).cast("long"), F.coalesce(F.try_mod(want, size), F.lit(0))
    blocks = F.ceil(size / b)
    src = sources.withColumns({"blocks": blocks, "need": (whole * blocks + F.ceil(part / b)).cast("long")}).filter("need > 0")
    ordered = Window.orderBy("source_no")
    src = src.withColumns({"hi": F.sum("need").over(ordered), "slots": F.sum("need").over(Window.partitionBy())}).withColumn("before", F.col("hi") - F.col("need"))
    src = keep(src.withColumns({"lo": F.col("before") / F.col("slots"), "hi": F.col("hi") / F.col("slots")}), "shares")
    total = src.agg(F.max("slots")).first()[0] or 0
    cells = src.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * GRID), F.floor(F.col("hi") * GRID)))).select("cell", "lo", "hi", "source_no", "need")
    x = (F.col("n") + 1) * F.lit(GOLDEN)
    slots = spark.range(total).withColumnRenamed("id", "n").withColumn("x", x - F.floor(x)).withColumn("cell", F.floor(F.col("x") * GRID))
    slots = slots.join(cells, "cell").filter("x >= lo AND x < hi")
    if total:
        at = F.floor(F.col("n") / F.lit(float(total)) * F.lit(float(16**7)))
        slots = slots.withColumn("h", F.lpad(F.lower(F.hex(at)), 7, "0")).withColumn("one", F.lit(1).cast("long"))
        slots = running_total(slots.select("n", "source_no", "need", "h", "one"), "source_no", "h", ["n"], "one", "k", total).filter("k < need").select("n", "source_no", "k")
    else:
        slots = slots.select("n", "source_no", F.col("n").alias("k"))
    slots = keep(slots, "slots")
    # What rounding and discrepancy left out - a few slots of a source - comes last.
    got = slots.groupBy("source_no").agg(F.count("*").alias("got"))
    short = src.join(got, "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < need")
    tail = short.withColumn("k", F.explode(F.sequence(F.col("got"), F.col("need") - 1))).select((F.lit(total) + F.col("before") + F.col("k")).alias("n"), "source_no", "k")
    slots = slots.unionByName(tail).join(src.select("source_no", "blocks", "source_size", "want"), "source_no")
    epoch = F.floor(F.col("k") / F.col("blocks"))
    return slots.select(
        "n", "source_no", "k", epoch.alias("epoch"), (F.col("k") % F.col("blocks")).alias("block"), F.least("source_size", F.col("want") - epoch * F.col("source_size")).alias("until")
    )


def mix_sources(docs: DataFrame, mix: Mix | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of docs: doc_id, size (words), source_size, target (of its source), taken (words, repeats
    counted), first_slot (the earliest slot of the schedule that takes any; null where none does).

    A null text has no words and gives none. A null source is a source, the last. Rows that repeat an id are separate
    documents, next to each other in the stream; rows without one are ordered by their texts. Slots rise along the mix and
    have a few gaps at its end. Other columns are ignored; an empty table gives an empty one.
    """
    mix = mix or Mix()
    sized = keep(docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(doc_text(text_col)).alias("size"), order_hash(mix.seed, id_col, text_col).alias("h")), "sized")
    rows = sized.count()
    sources = keep(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), mix), "sources")
    numbered = sized.join(sources.select(F.col("source").alias("_s"), "source_no", "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source")
    placed = keep(running_total(keep(numbered, "numbered"), "source_no", "h", ["id", "size"], "size", "start", rows).drop("h"), "placed")
    b = F.lit(mix.block).cast("long")
    first, last = F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b)
    pieces = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    pieces = pieces.withColumns({"from": F.greatest("start", F.col("block") * b), "to": F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)})
    taken = (
        pieces.join(schedule(sources, mix).select("source_no", "block", "until", "n"), ["source_no", "block"])
        .withColumn("words", F.greatest(F.lit(0).cast("long"), F.least("to", "until") - F.col("from")))
        .groupBy("source_no", "start")
        .agg(F.sum("words").alias("taken"), F.min(F.when(F.col("words") > 0, F.col("n"))).alias("first_slot"))
    )
    out = placed.join(taken.withColumnRenamed("start", "_start").withColumnRenamed("source_no", "_no"), (F.col("source_no") == F.col("_no")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0), "left")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def mixed_documents(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """The documents of the mix with all their columns: each as many times as the mix takes its words, rounded half up.

    Rows that share an id are taken equally often: as often as the one taken most. A null or empty text has no words and is
    not taken; a document is taken whole, however long; an empty table gives an empty one.
    """
    mix = mix or Mix()
    id_, copies, copy = (unused(docs, c) for c in ("_id", "_copies", "_copy"))
    most = F.max(F.floor(F.coalesce(F.try_divide(F.col("taken").cast("double"), F.col("size").cast("double")), F.lit(0.0)) + 0.5)).cast("int")
    times = mix_sources(docs, mix).groupBy(F.col("doc_id").alias(id_)).agg(most.alias(copies)).filter(F.col(copies) > 0)
    out = docs.join(times, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])
