"""From changed pages to published works: one lazy plan, with an action at the sinks only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.predicates import is_work, is_work_link
from tessera.operators.changes import changed
from tessera.operators.dedup import clear_contamination, keep_first
from tessera.operators.extract import extract_works
from tessera.operators.lineage import cut
from tessera.operators.merge import hybrid_merge, new_then_old
from tessera.operators.sections import ranked
from tessera.sources.html import PageLayout, parse_pages


@dataclass(frozen=True)
class Plan:
    base: str
    layout: PageLayout = PageLayout()
    artist: tuple[str, ...] = ()


def pages_to_visit(sitemap: DataFrame, snapshot: DataFrame | None, plan: Plan) -> DataFrame:
    """Valid links, all of them or those that changed."""
    links = sitemap.filter(is_work_link("url", plan.base))
    return links if snapshot is None else changed(links, snapshot).drop("change")


def works_of_pages(pages: DataFrame, plan: Plan, provider: DataFrame | None = None) -> DataFrame:
    """Records of pages (url, html), completed by a provider's answers (url and fields), without exhibitions and the like."""
    local = extract_works(parse_pages(pages, plan.layout), plan.artist, plan.layout)
    if provider is None:
        return local.filter(is_work("type"))
    from tessera.functions.udfs import with_other_work, with_similar, with_title_check

    fields = [c for c in provider.columns if c != "url" and c in local.columns and c not in ("images", "high_res_images", "source")]
    right = with_title_check(provider.select("url", *fields), "url", "title", "_ok").select("url", "_ok", *[F.col(f).alias("_p_" + f) for f in fields])
    joined = local.withColumn("_l1", F.lit(True)).join(right.withColumn("_l2", F.lit(True)), "url", "full")
    joined = with_similar(joined, "title", "_p_title", "_like") if "title" in fields else joined.withColumn("_like", F.lit(False))
    told = [f for f in ("description_en", "description_cn") if f in fields]
    for f in told:
        joined = with_other_work(joined, "_p_" + f, "title", "url", "_other_" + f)
    flag = lambda c: F.coalesce(c, F.lit(False))
    foreign = {f: flag(F.col("_other_" + f)) if f in told else F.lit(False) for f in ("description_en", "description_cn")}
    l2 = {f: F.col("_p_" + f) if f in fields else F.lit("") for f in local.columns}
    merged = hybrid_merge({f: F.col(f) for f in local.columns}, l2, flag("_l1"), flag("_l2"), flag("_ok") | flag("_like"), flag("_ok"), F.col("url"), foreign)
    return joined.select("url", *[c.alias(f) for f, c in merged.items()], "images", "high_res_images").filter(is_work("type"))


def publishable(new: DataFrame, old: DataFrame) -> DataFrame:
    """New works before old ones, one for each URL, cleared of leaked values, with their places (_ordinal, from 0): new and
    old works by their own _ordinal where they have one, then by URL. Two checkpoints are written, as both the ranks and the
    clearing read their rows several times."""
    df = new_then_old(new, old, "url")
    own = F.col("_ordinal").cast("long") if "_ordinal" in df.columns else F.lit(0).cast("long")
    df = df.withColumn("_place", F.struct((~F.col("is_new")).alias("a"), F.coalesce(own, F.lit(0)).alias("b"), F.col("url").alias("c"))).drop("_ordinal")
    df = ranked(cut(keep_first(df, "url", ["_place"])), [F.col("_place")], "_ordinal").drop("_place")
    return clear_contamination(cut(df), "_ordinal")
