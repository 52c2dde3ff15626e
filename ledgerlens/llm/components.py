"""Connected components of a link table, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import hot_join, kept

#: rounds after which a run is given up (labels halve their distance in a round)
MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` (any two comparable ids) -> ``(id, root)``, root being the smallest id of
    the component; one row per id that has a link to another id.

    Alternates large-star and small-star rounds: every node ties its larger neighbours, then
    its smaller ones, to the smallest node it sees, until nothing changes.  A round is a
    partial minimum per node and one join, in which the links of hot nodes are not shuffled; each
    is cut from its lineage by a checkpoint.  Null
    ends and self links are left out; an empty table gives an empty one.
    """
    edges = kept(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .where("a is not null and b is not null and a <> b").distinct())
    for _ in range(MAX_ROUNDS):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = (hot_join(both.where("v > u"), low, "u", "n")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = (large.join(low.where("n > 1").drop("n"), "u")
                 .where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).distinct())
        after = kept(small)
        stars = after.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
        inner = stars.select(F.col("v").alias("u")).distinct().join(stars.select("u"), "u")
        if stars.where("n > 1").limit(1).count() == 0 and inner.limit(1).count() == 0:
            return after.select(F.col("u").alias("id"), F.col("v").alias("root")).union(
                after.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        edges = after
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
