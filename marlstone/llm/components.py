"""Connected components over a table of links, by alternating star contractions.

Large-star points every larger neighbour of a node at the node's smallest
neighbour; small-star does so for the smaller ones.  Alternated, they turn each
component into a star around its smallest node.  All rounds are joins and
aggregates with a map-side minimum; the driver only sees one count a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, release


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (two long columns a, b).

    The component is the smallest node reachable.  Direction, repeats and links
    to oneself don't matter; links with a null end are ignored; no links give an
    empty table.
    """
    links = links.select(F.col(links.columns[0]).cast("long").alias("a"), F.col(links.columns[1]).cast("long").alias("b"))
    stars = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large.filter("u <> v"), "stars")
        least = _least(large)
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        small = cut(small, "stars")
        # Stable when every node has one link and no centre has a link of its own.
        centres = small.select(F.col("v").alias("u")).distinct().join(small, "u", "left_semi").limit(1)
        settled = small.groupBy("u").count().filter("count > 1").limit(1).count() == 0 and centres.count() == 0
        release(stars, large)
        stars = small
        if settled:
            break
    members = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("node"), "component").distinct())
