"""Connected components of links by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillworks.llm import shared


def _large_star(links: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least node around it."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.crc32(F.concat_ws(",", "u", "v").cast("binary")))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of (u, v) with v < u: component is the least node reachable; itself only is left out.

    Each round writes its links to the shared folder and compares a count and two checksums with the round
    before. Sizes fall fast: the rounds needed grow with the logarithm of the longest chain.
    """
    now = shared.stored(links.select("u", "v"))
    state = _state(now)
    while state[0]:
        now = shared.stored(_small_star(_large_star(now)))
        after = _state(now)
        if after == state:
            break
        state = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
