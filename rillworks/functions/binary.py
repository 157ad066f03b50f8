"""Little-endian integers in binary columns, as built-in expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _swap(digits: Column, size: int) -> Column:
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])


def read_le(raw: Column, start: int, size: int) -> Column:
    """Unsigned integer of `size` bytes at byte `start`; DECIMAL(20,0) from 8 bytes, else BIGINT."""
    digits = _swap(F.hex(F.substring(raw, start + 1, size)), size)
    return F.conv(digits, 16, 10).cast("decimal(20,0)" if size == 8 else "bigint")


def write_le(value: Column, size: int) -> Column:
    """Unsigned integer column (up to DECIMAL(20,0)) as `size` little-endian bytes."""
    digits = F.conv(value.cast("string"), 10, 16)
    return F.unhex(_swap(F.lpad(digits, 2 * size, "0"), size))
