"""Columns that are computed once per row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a one-row generator.

    The optimizer merges adjacent projections and would repeat a costly expression (a JSON parse, a
    regex) at every use; it does not merge through a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
