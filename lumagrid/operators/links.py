"""Graphs over tables: least reachable labels by star contraction, and places in rings by pointer doubling.

Both work on rows (group, ...), so that many images are done at once, take a number of rounds that grows with the
logarithm of the longest path, and write each round to the shared folder, so that lost executors repeat one round only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumagrid.sources.scratch import Rounds


def _large(links: DataFrame) -> DataFrame:
    """All larger neighbours of an id are linked with the least of its neighbours and itself."""
    both = links.unionByName(links.select("group", F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("group", "a").agg(F.least("a", F.min("b")).alias("m"))
    return both.join(least, ["group", "a"]).where("b > a").select("group", F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """All smaller neighbours of an id, and itself, are linked with the least of them."""
    least = links.groupBy("group", "a").agg(F.min("b").alias("m"))
    out = links.join(least, ["group", "a"]).select("group", F.col("b").alias("a"), F.col("m").alias("b"))
    return out.unionByName(least.select("group", "a", F.col("m").alias("b"))).where("a != b").distinct()


def contracted(links: DataFrame) -> DataFrame:
    """links (group, a, b): group, id, root for every id that has a link to another; root is the least id that links reach."""
    rounds = Rounds(links.sparkSession)
    own = rounds.written(links.where("a != b").select("group", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    while True:
        now = tuple(own.agg(F.count("*"), F.sum(F.xxhash64("group", "a", "b").cast("decimal(38,0)"))).first())
        if now == last or not now[0]:
            break
        last = now
        own = rounds.written(_small(_large(own)))
        rounds.forget()
    return own.select("group", F.col("a").alias("id"), F.col("b").alias("root")).unionByName(own.select("group", F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def ranked(pointers: DataFrame) -> DataFrame:
    """pointers (group, id, to), in which the ids of a group form rings: group, id, lead (the least id of its ring), hops (pointers from the id to it).

    Every id knows the least of the ids within so many hops, and how far it is; in a round it asks the id so many hops
    on for the same, which doubles its view. Nothing changes any more once the longest ring is seen.
    """
    rounds = Rounds(pointers.sparkSession)
    own = rounds.written(pointers.select("group", "id", "to", F.col("id").alias("lead"), F.lit(0).cast("long").alias("hops"), F.lit(True).alias("moved")))
    seen = 1
    while own.where("moved").limit(1).count():
        far = own.select("group", F.col("id").alias("to"), F.col("to").alias("far"), F.col("lead").alias("far_lead"), F.col("hops").alias("far_hops"))
        better = F.col("far_lead") < F.col("lead")
        step = own.join(far, ["group", "to"]).select("group", "id", F.col("far").alias("to"), F.least("lead", "far_lead").alias("lead"), F.when(better, F.col("far_hops") + seen).otherwise(F.col("hops")).alias("hops"), better.alias("moved"))
        own = rounds.written(step)
        rounds.forget()
        seen *= 2
    return own.select("group", "id", "lead", "hops")
