"""Connected components of links, by alternating stars on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, staged


#: A node with over 1/SHARE of all links, and HUB of them, is a hub; there are at most 2 SHARE of these.
HUB, SHARE = 1000, 10_000


def _star(links: DataFrame, large: bool, count: int) -> DataFrame:
    """links (a, b), a > b.  Large: greater neighbours of each node go to its least neighbour; small: lesser ones do.

    Hubs are few, so their least neighbours are broadcast and their links stay where they are; those of others move.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    per = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    least = per.select("a", "m")
    if count > HUB:
        hubs = staged(per.where(F.col("n") > max(HUB, count // SHARE)).select("a", F.col("m").alias("h")), "hubs")
        marked = both.join(F.broadcast(hubs), "a", "left")
        found = marked.where("h is null").select("a", "b").join(least, "a").union(marked.where("h is not null").select("a", "b", "h"))
    else:
        found = both.join(least, "a")
    if large:
        out = found.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = found.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b); root is the component's least node.

    Every round leaves a table of at most as many rows as there were links; rounds grow with the logarithm of the longest
    chain.  Ends when a round changes nothing.
    """
    now = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    state = None
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state or new[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        state = new
        half = staged(_star(now, True, new[0]), "half")
        old, now = now, staged(_star(half, False, new[0]), "stars")
        dropped(old, half)
