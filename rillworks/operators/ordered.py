"""Order-dependent logic that does not put a whole key into one task.

One file, session or relay may hold a large share of all rows, so a window over the key alone would
sort that share in a single task. Here each key is cut into blocks that follow the order: a window runs
inside (key, block), one small row per block is combined over the key, and the two are joined on
(key, block), which the rows are already partitioned by. There may be many blocks, so they are never
broadcast whatever size Spark takes them for.

`block` must not decrease along the order (blocks whose first order column overlaps fail the job), and
keys must not be NULL.
"""

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"
BLOCK_BITS = 16


def block_of(sequence: str | Column, bits: int = BLOCK_BITS) -> Column:
    """Block number of an integer sequence: at most 2**bits rows per block when it is unique per key."""
    return F.shiftright(F.col(sequence) if isinstance(sequence, str) else sequence, bits)


def time_block(time: str | Column, seconds: int) -> Column:
    """Block number of a time, for rows ordered by time."""
    return F.floor(F.unix_micros(time) / F.lit(seconds * 1_000_000)).cast("bigint")


def balanced_block(df: DataFrame, order: str, blocks: int) -> Column:
    """Block number of an orderable number or time by quantiles of `df`, so that blocks hold about as many rows whatever the
    spread: for timelines with bursts. Takes one pass over the column; the driver gets `blocks` numbers at most."""
    kind = df.schema[order].dataType
    number = F.unix_micros(F.col(order).cast("timestamp")) if kind.typeName().startswith("timestamp") else F.col(order).cast("bigint")
    shares = [i / blocks for i in range(1, blocks)]
    cuts = sorted(set(df.agg(F.percentile_approx(number, shares, 10 * blocks).alias("c")).first().c or [])) if shares else []
    # two levels, so that a row is compared with about 2 * sqrt(blocks) cuts
    width = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i:i + width] for i in range(0, len(cuts), width)]
    if not groups:
        return F.lit(0).cast("bigint")
    heads = F.array(*[F.lit(g[0]) for g in groups])
    inner = F.array(*[F.array(*[F.lit(c) for c in g]) for g in groups])
    below = lambda cut: F.size(F.filter(cut, lambda c: c <= number))
    group = below(heads)
    return F.when(group == 0, 0).otherwise((group - 1) * width + below(F.get(inner, group - 1))).cast("bigint")


# How two parts of a running value are combined; NULL stands for no value yet.
_COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
    "last": (lambda v: F.last(v, ignorenulls=True), F.coalesce),
    "first": (lambda v: F.first(v, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
}
_AT_END = {"last": F.max_by, "first": F.min_by}


def _total(kind: str, value: Column, order: list[str]) -> Column:
    """The value of a whole block; the last (first) one is that of the greatest (least) order that has one."""
    return _AT_END[kind](value, F.when(value.isNotNull(), F.struct(*order))) if kind in _AT_END else _COMBINE[kind][0](value)


def shuffle_partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions. Given as a number it is kept: what one task holds is not added up to fewer tasks."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _placed(df: DataFrame, part: list[str], block: Column) -> tuple[DataFrame, Column]:
    """Rows by (key, block), and a hash of all their columns (maps have none; with them the input is read twice).

    Rows and block totals both start from this one exchange. They share it only if both need the same columns of it,
    so each has a condition on the hash that always holds. Give rows without columns that aren't needed."""
    known = functools.reduce(Column.__and__, [F.col(c).isNotNull() for c in part])  # Spark would add it to one of the two
    placed = df.withColumn(BLOCK, block).filter(known).repartition(shuffle_partitions(df), *part)
    hashable = [f.name for f in placed.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return placed, F.xxhash64(*hashable)


def _whole(hashed: Column) -> Column:
    """Always true, which Spark doesn't know."""
    return hashed.bitwiseOR(F.lit(1)) != 0


def _bounds(order: list[str]) -> list[Column]:
    return [F.min(order[0]).alias("_low"), F.max(order[0]).alias("_high")]


def _checked_block(keys: list[str]) -> Column:
    """The block number, or an error where an earlier block reaches beyond this block's start."""
    earlier = F.max("_high").over(Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1))
    wrong = (earlier > F.col("_low")) | F.col("_sum").isNull()
    return F.when(wrong, F.raise_error(F.lit("blocks do not follow the order of the rows"))).otherwise(F.col(BLOCK))


def running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column]],
            block: Column, inclusive: bool = False) -> DataFrame:
    """Adds the sum, min, max, first or last non-NULL of each value over the rows before (or up to) the row, within the keys.

    `values` maps a new column to (kind, value)."""
    part = [*keys, BLOCK]
    tagged, hashed = _placed(df, part, block)
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    rows = tagged.select("*", *[_COMBINE[k][0](v).over(inside).alias(f"_in_{n}") for n, (k, v) in values.items()]).filter(_whole(hashed))
    totals = tagged.groupBy(*part).agg(F.bit_xor(hashed).alias("_sum"), *_bounds(order), *[_total(k, v, order).alias(f"_of_{n}") for n, (k, v) in values.items()])
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, _checked_block(keys).alias(BLOCK), *[_COMBINE[k][0](f"_of_{n}").over(before).alias(f"_at_{n}") for n, (k, _) in values.items()])
    return rows.join(starts.hint("merge"), part).select(
        *df.columns, *[_COMBINE[k][1](F.col(f"_in_{n}"), F.col(f"_at_{n}")).alias(n) for n, (k, _) in values.items()])


def running_sums(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column],
                 block: Column, inclusive: bool = False) -> DataFrame:
    """Adds running sums; 0 where there is no row before."""
    return running(df, keys, order, {n: ("sum", v) for n, v in values.items()}, block, inclusive)


def neighbour(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column],
              block: Column, ahead: bool = False) -> DataFrame:
    """Adds values of the previous (or next) row within the keys; NULL at the ends."""
    part = [*keys, BLOCK]
    shift, edge = (F.lead, F.min_by) if ahead else (F.lag, F.max_by)
    packed = F.struct(*[v.alias(n) for n, v in values.items()])
    tagged, hashed = _placed(df, part, block)
    rows = tagged.select("*", shift(packed).over(Window.partitionBy(*part).orderBy(*order)).alias("_near")).filter(_whole(hashed))
    edges = tagged.groupBy(*part).agg(F.bit_xor(hashed).alias("_sum"), *_bounds(order), edge(packed, F.struct(*order)).alias("_edge"))
    far = edges.select(*keys, _checked_block(keys).alias(BLOCK), shift("_edge").over(Window.partitionBy(*keys).orderBy(BLOCK)).alias("_far"))
    found = F.coalesce("_near", "_far")
    return rows.join(far.hint("merge"), part).select(*df.columns, *[found.getField(n).alias(n) for n in values])
