"""Field-wise merges of records from several sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.normalize import clean_title, drop_placeholder, title_case
from tessera.functions.predicates import has_credit_marks, is_empty_material, names_other_work, reads_as_description
from tessera.functions.text import blank, collapse, slug_words, strip, text
from tessera.operators.changes import one_each
from tessera.operators.repair import type_as_title


def new_then_old(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """New rows and the old rows of other keys; adds is_new."""
    return new.withColumn("is_new", F.lit(True)).unionByName(old.join(new.select(key), key, "left_anti").withColumn("is_new", F.lit(False)), allowMissingColumns=True)


def _side(df: DataFrame, key: str, prefix: str) -> DataFrame:
    return df.select(F.col(key), *[F.col(c).alias(prefix + c) for c in df.columns if c != key])


def fill_only(base: DataFrame, update: DataFrame, key: str, fields: Sequence[str], order: str | None = None) -> DataFrame:
    """base with its blank fields filled from update; filled ones stay. Adds n_filled. Of several updates of a key the last
    by order counts (without one, the greatest by its fields)."""
    joined = base.join(_side(one_each(update, key, fields, order), key, "_u_"), key, "left")
    counts = sum(((blank(f) & ~blank(F.col("_u_" + f))).cast("int") for f in fields), F.lit(0))
    return joined.withColumns({"n_filled": counts} | {f: F.when(blank(f), text("_u_" + f)).otherwise(F.col(f)) for f in fields}).drop(*["_u_" + f for f in fields])


def overlay(base: DataFrame, update: DataFrame, key: str, fields: Sequence[str], longer: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """Filled fields of update win; arrays in longer win if they have more elements. Of several updates of a key the last by
    order counts (without one, the greatest by its fields)."""
    joined = base.join(_side(one_each(update, key, [*fields, *longer], order), key, "_u_"), key, "left")
    arrays = {f: F.when(F.coalesce(F.size("_u_" + f), F.lit(-1)) > F.coalesce(F.size(f), F.lit(-1)), F.col("_u_" + f)).otherwise(F.col(f)) for f in longer}
    return joined.withColumns({f: F.when(~blank("_u_" + f), F.col("_u_" + f)).otherwise(F.col(f)) for f in fields} | arrays).drop(*["_u_" + f for f in [*fields, *longer]])


def meaningful(c: Column | str) -> Column:
    return strip(c) != ""


def proposed_value(old: Column, new: Column) -> Column:
    """new, if it says something else than old by more than white space; else old."""
    return F.when(meaningful(old) & (collapse(old) == collapse(new)), old).when(meaningful(new), new).otherwise(old)


def upsert_proposed(existing: DataFrame, proposed: DataFrame, key: str, fields: Sequence[str], order: str | None = None) -> DataFrame:
    """All keys of both: proposed values win field by field. Adds is_update (the key existed) and is_proposed. Of several rows
    of a key on one side the last by order counts (without one, the greatest by its fields)."""
    here, there = one_each(existing, key, fields, order), one_each(proposed, key, fields, order)
    a, b = _side(here, key, "_e_").withColumn("_in_e", F.lit(True)), _side(there, key, "_p_").withColumn("_in_p", F.lit(True))
    joined = a.join(b, key, "full")
    values = [
        F.when(F.col("_in_p").isNull(), F.col("_e_" + f)).when(F.col("_in_e").isNull(), F.col("_p_" + f)).otherwise(proposed_value(F.col("_e_" + f), F.col("_p_" + f))).alias(f)
        for f in fields
    ]
    is_proposed = F.col("_in_p").isNotNull()
    return joined.select(key, *values, (is_proposed & F.col("_in_e").isNotNull()).alias("is_update"), is_proposed.alias("is_proposed"))


def fold_accepted(existing: DataFrame, records: DataFrame, key: str, order: str, fields: Sequence[str]) -> DataFrame:
    """upsert_proposed of the records of each key in ascending order: for each field the last meaningful value decides."""
    says = lambda f: F.max_by(F.when(meaningful(f), F.col(f)), F.when(meaningful(f), F.col(order)))
    return upsert_proposed(existing, records.groupBy(key).agg(*[says(f).alias(f) for f in fields]), key, fields)


def keyed_upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows replace those of the same keys."""
    return rows.unionByName(table.join(rows.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def merge_sources(base: Mapping[str, Column], llm: Mapping[str, Column]) -> dict[str, Column]:
    """A second source's fields over the first's: filled ones win, but no 'null' type, and no materials that are credits,
    placeholders or descriptions. Descriptions are always the base's."""
    out = {}
    for f in ("title", "title_cn", "year", "type", "materials", "size", "duration", "credits", "video_link"):
        ok = ~blank(llm[f])
        if f == "type":
            ok = ok & (F.lower(strip(llm[f])) != "null")
        if f == "materials":
            ok = ok & ~has_credit_marks(llm[f]) & ~is_empty_material(llm[f]) & ~reads_as_description(llm[f])
        out[f] = F.when(ok, llm[f]).otherwise(text(base[f]))
    for f in ("description_en", "description_cn"):
        out[f] = text(base[f])
    return out


def hybrid_merge(l1: Mapping[str, Column], l2: Mapping[str, Column], in_l1: Column, in_l2: Column, title_ok: Column, fits_url: Column, url: Column,
                 foreign: Mapping[str, Column] | None = None) -> dict[str, Column]:
    """Page fields (l1) and a provider's (l2) in one record.

    title_ok: the provider's title fits the URL or resembles the page's; fits_url: it fits the URL. A provider whose title
    is neither is believed for size and duration only. Its materials must be short and no credits, its descriptions must
    not introduce another work, and short ones that are credits join the credits, unless those hold them already. Titles
    come from the provider if they fit (or the page has none); without a page, a title that does not fit gives way to the
    slug. Year and type only fill. At last titles lose repeated halves, and a title that is a type gives way to the slug.
    source tells who spoke. foreign: for description_en and description_cn whether they introduce another work (with_other_work
    compares fuzzily), else names_other_work tells.
    """
    both = in_l1 & in_l2
    trusted = title_ok | blank(l2["title"])
    clean = {f: drop_placeholder(c) for f, c in l2.items()}
    out: dict[str, Column] = {}
    materials = ~blank(clean["materials"]) & ~has_credit_marks(clean["materials"]) & (F.length(clean["materials"]) <= 200)
    take = {f: both & (F.lit(True) if f in ("size", "duration") else trusted) & ~blank(clean[f]) for f in ("size", "duration", "credits")}
    take["materials"] = both & trusted & materials
    for f in ("materials", "size", "duration", "credits"):
        out[f] = F.when(take[f], clean[f]).otherwise(F.when(in_l1, text(l1[f])).otherwise(clean[f]))
    for f in ("description_en", "description_cn"):
        short = (F.length(clean[f]) < 100) & has_credit_marks(clean[f])
        moved = both & trusted & ~blank(clean[f]) & short
        fits = both & trusted & ~blank(clean[f]) & ~short & ~(foreign[f] if foreign else names_other_work(clean[f], l1["title"], url))
        had = out["credits"]
        new = moved & ~F.contains(F.lower(had), F.lower(clean[f]))
        both_credits = F.regexp_replace(F.concat(had, F.lit(". "), clean[f]), r"^[. ]+|[. ]+$", "")
        out["credits"] = F.when(new & blank(had), clean[f]).when(new, both_credits).otherwise(had)
        out[f] = F.when(fits, clean[f]).otherwise(F.when(in_l1, text(l1[f])).otherwise(clean[f]))
    for f in ("title", "title_cn"):
        use = both & ~blank(clean[f]) & ~blank(clean["title"]) & (title_ok | blank(l1["title"]))
        alone = F.when(~blank(clean[f]) & ~fits_url, title_case(slug_words(url))).otherwise(clean[f]) if f == "title" else clean[f]
        out[f] = F.when(use, clean[f]).otherwise(F.when(in_l1, text(l1[f])).otherwise(alone))
    for f in ("year", "type"):
        out[f] = F.when(in_l1 & ~blank(l1[f]), text(l1[f])).when(in_l2, clean[f]).otherwise(text(l1[f]))
    cleaned = clean_title(out["title"], out["title_cn"])
    final = type_as_title(cleaned["title"], out["type"], url)
    out |= {"title": final["title"], "title_cn": cleaned["title_cn"], "type": final["type"]}
    out["source"] = F.when(both, "hybrid_layer2").when(in_l1, "layer1_only").otherwise("schema_extract_v2")
    return out
