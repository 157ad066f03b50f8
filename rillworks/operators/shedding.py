"""Load shedding and session closing on buffer watermarks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillworks.model import FULL_SECONDS, HIGH_WATERMARK_BYTES, LOW_WATERMARK_BYTES
from rillworks.operators.ordered import block_of, running, running_sums


def shed_cumulative(rows: DataFrame, session: str, seq: str, size: Column, block: Column | None = None,
                    high: int = HIGH_WATERMARK_BYTES) -> DataFrame:
    """Adds `accepted`: dropped once the bytes accepted before exceed the mark.

    Nothing is accepted after the first drop, so the plain running sum decides."""
    summed = running_sums(rows, [session], [seq], {"_before": size}, block_of(seq) if block is None else block)
    return summed.withColumn("accepted", F.col("_before") <= high).drop("_before")


def session_close(rows: DataFrame, session: str, seq: str, time: str, dropped: Column,
                  seconds: int = FULL_SECONDS, block: Column | None = None) -> DataFrame:
    """Adds `closed`: true for rows after the drop that found the buffer full for more than `seconds`
    since the session's first drop, that is, when the drops before a row span more than that."""
    drop_time = F.when(dropped, F.col(time))
    spanned = running(rows, [session], [seq], {"_first": ("min", drop_time), "_last": ("max", drop_time)},
                      block_of(seq) if block is None else block)
    long = F.col("_last") - F.col("_first") > F.expr(f"INTERVAL {int(seconds)} SECONDS")
    return spanned.withColumn("closed", F.coalesce(long, F.lit(False))).drop("_first", "_last")


def quota_breaches(rows: DataFrame, key: str, time: str, size: Column, bytes_per_second: int = 102_400) -> DataFrame:
    """Seconds in which a key went over its byte quota."""
    sums = rows.groupBy(key, F.window(time, "1 second").alias("_w")).agg(F.sum(size).alias("bytes"))
    return sums.filter(F.col("bytes") > bytes_per_second).select(key, F.col("_w.start").alias("second_start"), "bytes")


def shed_hysteresis(rows: DataFrame, session: str, order: list[str], change: str, high: int = HIGH_WATERMARK_BYTES,
                    low: int = LOW_WATERMARK_BYTES, block: Column | None = None) -> DataFrame:
    """Adds `level`, the bytes a session holds before the row, and `accepted`: shed from above the high mark
    until below the low mark.

    `change` is what the row recorded: bytes of a message that was buffered (0 if it was not), or minus the
    bytes that were delivered; NULL counts as 0. The level is its running sum, and the mode is that of the
    last mark passed. `accepted` is NULL for deliveries."""
    block = block_of(order[0]) if block is None else block
    held = running_sums(rows, [session], order, {"level": F.coalesce(F.col(change), F.lit(0)).cast("bigint")}, block)
    passed = F.when(F.col("level") > high, True).when(F.col("level") < low, False)
    told = running(held, [session], order, {"_shedding": ("last", passed)}, block, inclusive=True)
    verdict = F.when(F.coalesce(F.col(change), F.lit(0)) >= 0, ~F.coalesce("_shedding", F.lit(False)))
    return told.withColumn("accepted", verdict).drop("_shedding")
