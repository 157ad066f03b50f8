"""ISO-8601 stamps."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: extended ISO form, date with optional time, fraction and zone.
ISO_PATTERN = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"([T ][0-9]{2}(:[0-9]{2}(:[0-9]{2}([.,][0-9]{1,6})?)?)?"
    r"(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
)


FULL_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"


def iso_instant(text: Column) -> Column:
    """Instant of an ISO stamp, NULL when malformed; stamps without zone are in the session zone.

    Most stamps are written in full; only the others have their left-out parts filled in."""
    filled = F.replace(text, F.lit(","), F.lit("."))
    for part in (r"^(.{10}[T ][0-9]{2})(?=$|Z|[+-])", r"^(.{10}[T ][0-9]{2}:[0-9]{2})(?=$|Z|[+-])"):
        filled = F.regexp_replace(filled, part, "$1:00")
    filled = F.regexp_replace(filled, r"(.{11}.*[+-][0-9]{2})([0-9]{2})$", "$1:$2")
    return F.when(text.rlike(FULL_PATTERN), F.try_to_timestamp(text)).when(
        text.rlike(ISO_PATTERN), F.try_to_timestamp(filled))
