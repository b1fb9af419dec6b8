"""Connected components of links by alternating star contractions, as joins.

No component is ever gathered: each round moves links, not nodes of a group, and
a node with very many links is split by adaptive execution, since every join here
has one row per key on its right side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import own_shuffle, stage

MAX_ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    """Joins each larger neighbour of a node to the least node beside it."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.filter("b > a").join(own_shuffle(least, "a"), "a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Joins a node and its smaller neighbours to the least of them; links run from high to low."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(own_shuffle(least, "a"), "a").filter("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(least.select("a", F.col("low").alias("b"))).distinct()


def _sum(links: DataFrame) -> tuple[int, int]:
    found = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return found.n, found.s


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that a link (a, b) names; component is the least node reachable.

    Each round is written to the shared folder, which cuts the lineage. Rounds
    end when the links no longer change, after about log2 of the longest chain.
    """
    links = stage(links.select("a", "b").filter("a <> b").distinct())
    before = _sum(links)
    for _ in range(MAX_ROUNDS):
        if before[0] == 0:
            break
        links = stage(_small_star(_large_star(links)))
        now = _sum(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
