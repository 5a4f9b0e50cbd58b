"""Payloads of models: JSON, wrapped in prose or not, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From the first opening to the last closing brace.
OUTERMOST = r"(?s)\{.*\}"


def is_object(raw: Column) -> Column:
    """Whether the text is one JSON object and nothing else.

    Spark's parser stops after the first value.  A text that parses both as the one
    element of an array and as the value of a field has nothing after that value.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))).isNotNull()
    in_field = F.try_parse_json(F.concat(F.lit('{"x":'), raw, F.lit("}"))).isNotNull()
    return F.coalesce(F.ltrim(raw).startswith("{") & in_array & in_field, F.lit(False))


def json_object(raw: Column) -> Column:
    """The payload's JSON text: all of it if it is an object, else its outermost braces if they are, else an empty object."""
    inner = F.regexp_extract(raw, OUTERMOST, 0)
    return F.when(is_object(raw), raw).when(is_object(inner), inner).otherwise(F.lit("{}"))


def loads(raw: Column, schema: str) -> Column:
    """The payload as a struct; fields that are missing or of another type are null."""
    return F.from_json(json_object(raw), schema, {"mode": "PERMISSIVE"})
