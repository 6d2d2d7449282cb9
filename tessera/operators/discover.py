"""Discovery of pages by their links, round after round until nothing new comes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.lineage import cut


def discovered(seeds: DataFrame, links: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """key, round: the seeds (round 0) and all that links (source, target) lead to, each with the round that finds it first.

    A round follows the links of the round before alone and drops what is known by an anti join; each round is written as
    a checkpoint, so the plan does not grow with the rounds and lost executors cost no earlier round. most: rounds to do at
    most, else until one finds nothing. Null keys lead nowhere and are not found.
    """
    named = seeds.select(F.col(key).alias("key")).filter("key IS NOT NULL").distinct()
    seen = front = cut(named.withColumn("round", F.lit(0)))
    edges = links.filter("source IS NOT NULL AND target IS NOT NULL").select("source", "target").distinct()
    number = 0
    while (most is None or number < most) and not front.isEmpty():
        number += 1
        found = front.join(edges, F.col("key") == F.col("source")).select(F.col("target").alias("key")).distinct()
        front = cut(found.join(seen.select("key"), "key", "left_anti").withColumn("round", F.lit(number)))
        seen = seen.unionByName(front)
        if number % 8 == 0:
            seen = cut(seen)
    return seen.withColumnRenamed("key", key)


def discovered_through(seeds: DataFrame, leads: DataFrame, lands: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """As discovered, where links go through something that many rows share, like a menu's word: leads (source, via) and lands
    (via, target). The pairs of sources and targets, which grow with the square of what shares a via, are never formed: each
    via is followed once, in the round that first reaches it. leads and lands are written once."""
    named = seeds.select(F.col(key).alias("key")).filter("key IS NOT NULL").distinct()
    leads = cut(leads.filter("source IS NOT NULL AND via IS NOT NULL").select("source", "via").distinct())
    lands = cut(lands.filter("via IS NOT NULL AND target IS NOT NULL").select("via", "target").distinct())
    seen = front = cut(named.withColumn("round", F.lit(0)))
    passed, number = leads.select("via").limit(0), 0
    while (most is None or number < most) and not front.isEmpty():
        number += 1
        reached = front.join(leads, F.col("key") == F.col("source")).select("via").distinct()
        new = cut(reached.join(passed, "via", "left_anti"))
        found = new.join(lands, "via").select(F.col("target").alias("key")).distinct()
        front = cut(found.join(seen.select("key"), "key", "left_anti").withColumn("round", F.lit(number)))
        passed, seen = passed.unionByName(new), seen.unionByName(front)
        if number % 8 == 0:
            passed, seen = cut(passed), cut(seen)
    return seen.withColumnRenamed("key", key)
