"""A workspace of records over a baseline that goes on without it: manifests, and merges of three versions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import blank, strip

#: Fields of a baseline's manifest, and those of them that fall back to their default when blank.
MANIFEST = ("baseline_status", "baseline_source_url", "baseline_branch", "baseline_commit", "baseline_updated_at", "baseline_error")
NEVER_BLANK = ("baseline_source_url", "baseline_branch")
#: Records in these states wait for nobody.
SETTLED = ("applied", "rejected", "failed")


def manifest_state(defaults: Mapping[str, Column], existing: Mapping[str, Column], overrides: Mapping[str, Column]) -> dict[str, Column]:
    """Each field of a manifest: what overrides says, else what is there, else the default; without white space at its ends.
    An empty text is something said, but for the address and the branch."""
    out = {}
    for f in MANIFEST:
        said = [strip(m[f]) for m in (overrides, existing) if f in m]
        given = F.coalesce(*[F.when(m[f].isNotNull(), s) for m, s in zip([m for m in (overrides, existing) if f in m], said)], defaults[f])
        out[f] = F.when(blank(given), defaults[f]).otherwise(given) if f in NEVER_BLANK else given
    return out


def merge_three(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key, fields, change, conflicts: what becomes of every key of three versions whose keys do not repeat.

    A field that one side alone changed takes that side's value; if both changed it alike, that; if differently, ours stays
    and the field is among conflicts. A row that one side removed and the other left alone goes (is_gone, its fields as in
    the base); one that the other changed stays as changed, with 'row' among conflicts. change: unchanged, ours, theirs,
    both (alike, or in different fields) or conflict. The versions meet in two full joins on the key; none is broadcast by force.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(key).alias(f"_k{name}"), F.struct(*[F.col(f) for f in fields]).alias(name))

    met = side(base, "b").join(side(ours, "o"), F.col("_kb").eqNullSafe(F.col("_ko")), "full").withColumn("_k", F.when(F.col("b").isNotNull(), F.col("_kb")).otherwise(F.col("_ko")))
    met = met.join(side(theirs, "t"), F.col("_k").eqNullSafe(F.col("_kt")) & (F.col("b").isNotNull() | F.col("o").isNotNull()), "full")
    k = F.when(F.col("b").isNotNull() | F.col("o").isNotNull(), F.col("_k")).otherwise(F.col("_kt"))
    b, o, t = (F.col(x) for x in "bot")
    by_us, by_them, alike = ~o.eqNullSafe(b), ~t.eqNullSafe(b), o.eqNullSafe(t)
    lost = o.isNull() | t.isNull()  # on one side at least

    def value(f: str) -> Column:
        bf, of, tf = b[f], o[f], t[f]
        return F.when(o.isNull() & t.isNull(), bf).when(o.isNull(), tf).when(t.isNull(), of).when(b.isNotNull() & of.eqNullSafe(bf), tf).otherwise(of)

    differs = lambda f: ~o[f].eqNullSafe(t[f]) & (b.isNull() | (~o[f].eqNullSafe(b[f]) & ~t[f].eqNullSafe(b[f])))
    clashes = F.array_compact(F.array(*[F.when(differs(f), F.lit(f)) for f in fields]))
    conflicts = F.when(~(by_us & by_them) | alike, F.array().cast("array<string>")).when(lost, F.array(F.lit("row"))).otherwise(clashes)
    gone = b.isNotNull() & ((o.isNull() & ~by_them) | (t.isNull() & ~by_us) | (o.isNull() & t.isNull()))
    out = met.select(k.alias(key), *[F.when(gone, b[f]).otherwise(value(f)).alias(f) for f in fields], gone.alias("is_gone"), conflicts.alias("conflicts"), by_us.alias("_u"), by_them.alias("_t"))
    change = F.when(F.size("conflicts") > 0, "conflict").when(F.col("_u") & F.col("_t"), "both").when(F.col("_u"), "ours").when(F.col("_t"), "theirs").otherwise("unchanged")
    return out.withColumn("change", change).drop("_u", "_t")


def refreshed(base: DataFrame, workspace: DataFrame, remote: DataFrame, records: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """The workspace brought up to a remote version: merge_three with was_refused; while any record (status) waits for review
    the workspace stays as it is: rows that it lacks are gone, and change says 'refused' where something would have changed."""
    waiting = records.agg(F.coalesce(F.bool_or(~F.col("status").isin(*SETTLED)), F.lit(False)).alias("was_refused"))
    own = workspace.select(F.col(key).alias("_own"), F.struct(*[F.col(f) for f in fields]).alias("_as_is"))
    merged = merge_three(base, workspace, remote, key, fields).join(own, F.col(key).eqNullSafe(F.col("_own")), "left").crossJoin(waiting)  # one row
    refused = F.col("was_refused")
    here = F.col("_as_is").isNotNull()
    moved = F.col("change").isin("theirs", "both", "conflict")
    return merged.select(
        key, *[F.when(refused & here, F.col("_as_is")[f]).otherwise(F.col(f)).alias(f) for f in fields], F.when(refused, ~here).otherwise(F.col("is_gone")).alias("is_gone"),
        F.when(refused, F.array().cast("array<string>")).otherwise(F.col("conflicts")).alias("conflicts"), F.when(refused & moved, "refused").otherwise(F.col("change")).alias("change"), "was_refused",
    )
