"""Chunking: paragraphs packed into pieces, as a column function and as a table function of SQL."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
PARAGRAPH = re.compile(r"\n\s*\n")
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _packed(units: Iterable[str], size: int, joiner: str, overlap: int = 0) -> Iterator[str]:
    """Units joined up to ``size`` characters; a longer unit is a piece; a piece begins with whole words of the last one's ``overlap`` characters."""
    held: list[str] = []
    length = 0
    for unit in units:
        if held and length + len(joiner) + len(unit) > size:
            piece = joiner.join(held)
            yield piece
            words = piece[-overlap:].partition(" ")[2] if overlap else ""
            unit = f"{words} {unit}".strip() if words else unit
            held, length = [], 0
        length += len(unit) + (len(joiner) if held else 0)
        held.append(unit)
    if held:
        yield joiner.join(held)


def pieces(text: str | None, size: int = 400, overlap: int = 0) -> Iterator[str]:
    """The chunks of one text, in time and memory linear in its length; none of null and of white space."""

    def units() -> Iterator[str]:
        for paragraph in map(str.strip, PARAGRAPH.split((text or "").strip())):
            if len(paragraph) > size:
                yield from _packed(SENTENCE.split(paragraph), size, " ")
            elif paragraph:
                yield paragraph

    return _packed(units(), size, "\n\n", overlap)


def pack(text: Column, size: int = 400, overlap: int = 0) -> Column:
    """Array of chunks: paragraphs packed up to ``size`` characters, oversized paragraphs by sentences first."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else list(pieces(t, size, overlap)))

    return packed(text)


@F.udtf(returnType="pos long, chunk string", useArrow=False)
class SplitChunks:
    """``split_chunks(text, size, overlap)``: a row for each chunk.

    By rows, since Arrow would hold the texts and the chunks of a batch of ten thousand documents at once.
    """

    def eval(self, text: str, size: int, overlap: int):
        yield from enumerate(pieces(text, size, overlap))


def register(spark: SparkSession) -> None:
    """Make ``split_chunks`` a table function of the session's SQL: ``FROM documents, LATERAL split_chunks(text, 400, 0)``."""
    spark.udtf.register("split_chunks", SplitChunks)
