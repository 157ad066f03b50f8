"""Strict JSON documents as VARIANT."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillworks.functions.once import once


def with_document(df: DataFrame, text: Column, out: str = "_doc") -> DataFrame:
    """Adds text as a VARIANT when it is exactly one JSON value, else NULL.

    The JSON parser ignores what follows the first value, so the text is parsed inside `[ ]`: trailing
    text breaks the array or shows up as a second element. Only text holding `]` can close the array
    early, and only then is it parsed a second time, inside an object.
    """
    parsed = once(df, _wrapped=F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))))
    element = F.try_variant_get("_wrapped", "$[0]", "variant")
    single = F.try_variant_get("_wrapped", "$[1]", "variant").isNull()
    closed = F.when(F.instr(text, "]") == 0, True).otherwise(
        F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    )
    return once(parsed, **{out: F.when(single & closed, element)}).drop("_wrapped")


def member(doc: Column, path: str, kind: str = "string") -> Column:
    """Member of the document, e.g. `.level`; NULL when absent or of another type."""
    return F.try_variant_get(doc, f"${path}", kind)


def has_member(doc: Column, name: str) -> Column:
    """True when the object has the key, even with a JSON null."""
    return member(doc, f".{name}", "variant").isNotNull()


def is_string(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def kind(doc: Column) -> Column:
    """OBJECT, ARRAY, STRING or OTHER (number, boolean, null)."""
    shape = F.schema_of_variant(doc)
    return (
        F.when(shape.startswith("OBJECT"), "OBJECT")
        .when(shape.startswith("ARRAY"), "ARRAY")
        .when(shape == "STRING", "STRING")
        .otherwise("OTHER")
    )
