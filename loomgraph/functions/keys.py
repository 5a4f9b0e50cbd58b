"""Deterministic keys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sha(value: Column, n: int) -> Column:
    return F.substring(F.sha2(value, 256), 1, n)


def content_hash(text: Column) -> Column:
    return _sha(text, 32)


def chunk_id(doc_id: Column, text: Column, occurrence: Column) -> Column:
    """Key of a chunk: its document and content, and the number of a verbatim repeat; never its position."""
    suffix = F.when(occurrence > 0, F.concat(F.lit("::"), occurrence.cast("string"))).otherwise(F.lit(""))
    return F.concat(doc_id, F.lit("::"), _sha(text, 16), suffix)


def entity_key(name: Column, kind: Column) -> Column:
    flat = F.trim(F.regexp_replace(F.lower(name), r"(?U)\s+", " "))
    return _sha(F.concat(flat, F.lit("|"), F.lower(kind)), 24)


def relation_key(source: Column, target: Column, kind: Column) -> Column:
    return _sha(F.concat_ws("|", source, target, F.lower(kind)), 24)


def community_key(seed: Column) -> Column:
    return F.concat(F.lit("c-"), _sha(seed, 12))


def summary_hash(title: Column, summary: Column) -> Column:
    return _sha(F.concat(title, F.lit("\n"), summary), 32)


def extraction_key(version: str, model: str, text: Column) -> Column:
    return F.concat(F.lit("ex:"), _sha(F.concat(F.lit(f"{version}|{model}|"), text), 40))
