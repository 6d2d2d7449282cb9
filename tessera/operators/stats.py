"""Rollups: fill rates, facets, completeness, batch details and summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.normalize import type_facet
from tessera.functions.text import blank, count_chars, text
from tessera.operators.review import PENDING, list_records, prune_terminal


def fill_rates(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row: total, and for each field how many rows have it and their percentage (0 of no rows)."""
    n = F.count("*")
    columns = [n.alias("total")]
    for f in fields:
        has = F.count_if(~blank(F.col(f).cast("string")))
        columns += [has.alias(f"{f}_n"), F.coalesce(F.try_divide(has * F.lit(100.0), n), F.lit(0.0)).alias(f"{f}_pct")]
    return df.agg(*columns)


def facets(df: DataFrame, facet: Column, name: str = "facet") -> DataFrame:
    """Facets by falling count; names break ties."""
    return df.groupBy(facet.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)


def completeness(must: Sequence[Column], may: Sequence[Column]) -> Column:
    """Percent: a point for each of must, half for each of may."""
    points = sum((c.cast("double") for c in must), F.lit(0.0)) + sum((c.cast("double") * 0.5 for c in may), F.lit(0.0))
    return points * 100 / (len(must) + 0.5 * len(may))


def batch_rollup(records: DataFrame, batch: str, status: str, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per batch: total and, by name, records in any of the statuses. A status may count under several names."""
    return records.groupBy(batch).agg(F.count("*").alias("total"), *[F.count_if(F.col(status).isin(*s)).alias(n) for n, s in groups.items()])


def recent_batches(batches: DataFrame, rollup: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """The newest batches with their rollup; batches without records count none. Only the limited rows are joined."""
    newest = batches.orderBy(F.desc(key)).limit(limit)
    joined = newest.join(rollup, key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in rollup.columns if c != key})


def works_shown(works: DataFrame, labels: Mapping[str, str], facet: str | None = None, columns: Sequence[str] | None = None, order: str = "_ordinal", limit: int = 100) -> DataFrame:
    """The first works (the limit is the table's) of a facet, or of all, in the chosen columns under their labels. facet: as a
    choice shows it, with its count in brackets after it or without. Columns that the works lack are left out."""
    if facet is not None:
        works = works.filter(type_facet("type") == facet.rsplit(" (", 1)[0])
    chosen = [c for c in (columns if columns is not None else labels) if c in works.columns]
    return works.orderBy(order).limit(limit).select(*[F.col(c).alias(labels.get(c, c)) for c in chosen])


def pending_listed(batches: DataFrame, records: DataFrame, rollup: DataFrame, settings: Mapping[str, Column], most: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a review opens with: one row of settings, the newest batches with their rollup (finished ones left out), and the
    records of batches that are not finished and wait for someone, the newest first."""
    open_, kept = prune_terminal(batches, records)
    one = batches.sparkSession.range(1).select(*[c.alias(name) for name, c in settings.items()])
    return one, recent_batches(open_, rollup, "id", most), list_records(kept, PENDING)


def batch_status(rollup: DataFrame, current: Column, accepted: str = "accepted", terminal: Sequence[str] = ("completed", "failed")) -> Column:
    return F.when(current.isin(*terminal), current).when(F.col(accepted) > 0, "ready_to_apply").otherwise("reviewing")


def outcomes(df: DataFrame, outcome: str, values: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(outcome) == v).alias(v) for v in values], F.count("*").alias("total"))


def char_shares(c: Column | str) -> tuple[Column, Column]:
    """(share of letters, share of Chinese characters); 0 of no text."""
    n = F.length(text(c))
    share = lambda pattern: F.coalesce(F.try_divide(count_chars(c, pattern).cast("double"), n.cast("double")), F.lit(0.0))
    return share("[A-Za-z]"), share(r"[一-鿿]")
