"""Ranges of positions in streams: what was sent, what arrived, what arrived again, and what is missing.

Rows are half-open ranges (keys, start, stop); they may overlap, repeat and come in any order. The ends of all
ranges of a key are swept in order: between two neighbouring ends the number of ranges is constant. Sums and neighbours run
over blocks of positions, so one file with most of all ranges is many tasks. Keys must not be NULL; empty ranges and
ranges with a NULL end count for nothing.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillworks.operators.ordered import block_of, neighbour, running_sums

BLOCK_BITS = 24


def segments(ranges: DataFrame, keys: list[str], counts: dict[str, Column], start: str = "start", stop: str = "stop",
             block_bits: int = BLOCK_BITS) -> DataFrame:
    """(keys, start, stop, counts) of all pieces between neighbouring ends, uncovered ones between the first and the last end too.

    `counts` maps a new column to what a range adds to it over its length."""
    edge = lambda at, sign: F.struct(F.col(at).cast("bigint").alias("_at"), *[(c.cast("bigint") * sign).alias(n) for n, c in counts.items()])
    edges = ranges.filter(F.col(stop) > F.col(start)).select(*keys, F.inline(F.array(edge(start, 1), edge(stop, -1))))
    merged = edges.groupBy(*keys, "_at").agg(*[F.sum(n).alias(n) for n in counts])
    block = block_of("_at", block_bits)
    covered = running_sums(merged, keys, ["_at"], {f"_{n}": F.col(n) for n in counts}, block, inclusive=True)
    ahead = neighbour(covered, keys, ["_at"], {"_next": F.col("_at")}, block, ahead=True).filter("_next IS NOT NULL")
    return ahead.select(*keys, F.col("_at").alias("start"), F.col("_next").alias("stop"), *[F.col(f"_{n}").alias(n) for n in counts])


def joined(pieces: DataFrame, keys: list[str], wanted: Column, block_bits: int = BLOCK_BITS) -> DataFrame:
    """(keys, start, stop) of the longest runs of touching segments that are `wanted`.

    Between two of them lies a segment that is not, so the number of those before tells runs apart."""
    told = running_sums(pieces.withColumn("_wanted", wanted), keys, ["start"], {"_run": (~F.col("_wanted")).cast("bigint")}, block_of("start", block_bits))
    return told.filter("_wanted").groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_run")


def union(ranges: DataFrame, keys: list[str], start: str = "start", stop: str = "stop", block_bits: int = BLOCK_BITS) -> DataFrame:
    """(keys, start, stop): the ranges as few, disjoint, not touching ones."""
    return joined(segments(ranges, keys, {"n": F.lit(1)}, start, stop, block_bits), keys, F.col("n") > 0, block_bits)


def _both(sent: DataFrame, arrived: DataFrame, keys: list[str], block_bits: int) -> DataFrame:
    side = lambda df, s, a: df.select(*keys, "start", "stop", F.lit(s).alias("_s"), F.lit(a).alias("_a"))
    return segments(side(sent, 1, 0).unionByName(side(arrived, 0, 1)), keys, {"sent": F.col("_s"), "arrived": F.col("_a")}, block_bits=block_bits)


def missing(sent: DataFrame, arrived: DataFrame, keys: list[str], block_bits: int = BLOCK_BITS) -> DataFrame:
    """(keys, start, stop) of what was sent and did not arrive: to be acknowledged, or sent again."""
    return joined(_both(sent, arrived, keys, block_bits), keys, (F.col("sent") > 0) & (F.col("arrived") == 0), block_bits)


def repeated(arrived: DataFrame, keys: list[str], block_bits: int = BLOCK_BITS) -> DataFrame:
    """(keys, start, stop, deliveries) of what arrived more than once; `deliveries` is constant over a row."""
    pieces = segments(arrived, keys, {"deliveries": F.lit(1)}, block_bits=block_bits)
    return pieces.filter("deliveries > 1")


def accounts(sent: DataFrame, arrived: DataFrame, keys: list[str], block_bits: int = BLOCK_BITS) -> DataFrame:
    """(keys, sent, delivered, missing, repeated, unexpected) positions: `delivered` of those sent, once each; `repeated` as often
    as they came again; `unexpected` arrived without being sent."""
    n = F.col("stop") - F.col("start")
    total = lambda name, part: F.coalesce(F.sum(part), F.lit(0)).alias(name)
    is_sent, came = F.col("sent") > 0, F.col("arrived") > 0
    return _both(sent, arrived, keys, block_bits).groupBy(*keys).agg(
        total("sent", F.when(is_sent, n)), total("delivered", F.when(is_sent & came, n)), total("missing", F.when(is_sent & ~came, n)),
        total("repeated", F.when(came, (F.col("arrived") - 1) * n)), total("unexpected", F.when(~is_sent & came, n)))
