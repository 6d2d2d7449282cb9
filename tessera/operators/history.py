"""States of records as a fold over their ordered events.

An event maps states to states, and such maps compose in any grouping. So a record's events are cut by their order into
spans, each span becomes one map (for every state that a record could come in with: the state it leaves in, and how many
moves were not allowed), and the maps of neighbouring spans are composed level by level. No task holds a long history.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Moves of a proposed record: (state, event) to the next state. The empty state is that of a record without events.
RECORD_MOVES = {
    ("", "propose"): "needs_review", ("", "approve"): "ready_for_review", ("rejected", "propose"): "needs_review", ("failed", "propose"): "needs_review",
    ("needs_review", "accept"): "accepted", ("ready_for_review", "accept"): "accepted", ("needs_review", "reject"): "rejected", ("ready_for_review", "reject"): "rejected",
    ("accepted", "reject"): "rejected", ("accepted", "apply"): "applied", ("needs_review", "fail"): "failed", ("ready_for_review", "fail"): "failed", ("accepted", "fail"): "failed",
}


@dataclass(frozen=True)
class Machine:
    """moves: all that are allowed; an event without one leaves the state and counts as not allowed. start: the first state."""

    moves: Mapping[tuple[str, str], str] = field(default_factory=lambda: RECORD_MOVES)
    start: str = ""

    @property
    def states(self) -> list[str]:
        return sorted({self.start, *(s for s, _ in self.moves), *self.moves.values()})

    @property
    def events(self) -> list[str]:
        return sorted({e for _, e in self.moves})

    def event_number(self, event: Column) -> Column:
        """From 0; one more than all for an event of no move, or none."""
        return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(e) for e in self.events]), F.coalesce(event, F.lit(""))), F.lit(0)), F.lit(len(self.events) + 1)).cast("int") - 1

    def next(self, state: Column, event: Column) -> Column:
        """The number of the next state, or -1."""
        names = self.states
        table = [names.index(self.moves[s, e]) if (s, e) in self.moves else -1 for s in names for e in [*self.events, None]]
        return F.get(F.array(*[F.lit(x) for x in table]), state * (len(self.events) + 1) + event)


def fold_events(events: DataFrame, key: str, order: str, event: str, machine: Machine | None = None, bits: int = 10, levels: int = 3) -> DataFrame:
    """key, state, n_events, n_refused (moves that were not allowed) for each key with events.

    order: whole numbers, by which a key's events follow each other; equal ones go by their event. A null key is a key. A
    task sees at most about 2 ** bits events, or maps of events, of a key while orders span less than 2 ** (bits * (levels + 1)).
    """
    machine = machine or Machine()
    n = len(machine.states)

    def moved(maps: Column, e: Column) -> Column:
        def step(x: Column) -> Column:
            to = machine.next(x["to"], e)
            return F.struct(F.when(to >= 0, to).otherwise(x["to"]).alias("to"), (x["refused"] + F.when(to >= 0, 0).otherwise(1)).alias("refused"))

        return F.transform(maps, step)

    def composed(maps: Column, then: Column) -> Column:
        def step(x: Column) -> Column:
            y = F.get(then, x["to"])
            return F.struct(y["to"].alias("to"), (x["refused"] + y["refused"]).alias("refused"))

        return F.transform(maps, step)

    same = F.array(*[F.struct(F.lit(i).alias("to"), F.lit(0).cast("long").alias("refused")) for i in range(n)])
    own = events.select(F.col(key).alias("key"), F.col(order).cast("long").alias("at"), machine.event_number(F.col(event)).alias("e"))
    spans = own.groupBy("key", F.shiftright("at", bits).alias("span")).agg(F.array_sort(F.collect_list(F.struct("at", "e"))).alias("es"))
    maps = spans.select("key", "span", F.size("es").cast("long").alias("n"), F.aggregate("es", same, lambda acc, x: moved(acc, x["e"])).alias("maps"))
    for _ in range(levels):
        joined = maps.groupBy("key", F.shiftright("span", bits).alias("span")).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("span", "maps"))).alias("ms"))
        maps = joined.select("key", "span", "n", F.aggregate("ms", same, lambda acc, x: composed(acc, x["maps"])).alias("maps"))
    last = maps.groupBy("key").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("span", "maps"))).alias("ms"))
    whole = F.get(F.aggregate("ms", same, lambda acc, x: composed(acc, x["maps"])), F.lit(machine.states.index(machine.start)))
    out = last.withColumn("x", whole)
    return out.select(F.col("key").alias(key), F.get(F.array(*[F.lit(s) for s in machine.states]), F.col("x.to")).alias("state"), F.col("n").alias("n_events"), F.col("x.refused").alias("n_refused"))
