"""Connected components of a link table, by alternating stars.

A large star hangs the greater neighbours of a node on the least one; a small
star does so with the lesser ones.  Both keep the components and never make
more links than they got, so a hub costs no more than its links.  The least
neighbour of a node is an aggregate, which combines before the shuffle, and
every round ends in a table in the shared folder.
"""

from pyspark.sql import DataFrame, functions as F

from jobloom.runtime import settle


def _hang(links: DataFrame, least: DataFrame) -> DataFrame:
    return links.join(least, "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _hang(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = _hang(down, least).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return hung.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(u, v)`` but the roots themselves; a root is its component's least node."""
    now = settle(links.filter("u <> v").select("u", "v").distinct(), "links")
    was = None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == was or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        was = state
        now = settle(_small_star(_large_star(now)), "links")
