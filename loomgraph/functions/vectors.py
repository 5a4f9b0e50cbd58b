"""Vector expressions, hashed embeddings and name similarity."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import LEGAL


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is empty, zero or of another length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0)
    return F.when(usable, dot(a, b) / norm).otherwise(F.lit(0.0))


def _place(token: str, dim: int) -> int:
    """Twice the place of a token, and one more where its sign is negative."""
    value = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")
    return 2 * (value % dim) + 1 - (value >> 63)


_gram_place = lru_cache(maxsize=1 << 16)(_place)


@lru_cache(maxsize=1 << 16)
def _places(word: str, dim: int) -> bytes:
    """The places of a word and of the 3-grams of the padded word; grams have a cache of their own, which rare words do not empty."""
    padded = f" {word} "
    return array("i", [_place(word, dim), *[_gram_place(padded[i : i + 3], dim) for i in range(len(word))]]).tobytes()


def embed_text(text: str | None, dim: int) -> np.ndarray:
    """Signed feature hashing of words and of the 3-grams of the padded words, of length 1."""
    found = b"".join([_places(word, dim) for word in re.findall(r"[a-z0-9]+", (text or "").lower())])
    n = np.bincount(np.frombuffer(found, np.intc), minlength=2 * dim).reshape(dim, 2)
    out = (n[:, 0] - n[:, 1]).astype(np.float32)
    norm = np.linalg.norm(out)
    return out / norm if norm else out


def hash_embedding(dim: int = 256):
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: embed_text(t, dim).tolist())

    return embed


#: Embeddings by name: a maker of a column function from the dimension.
EMBEDDINGS = {"hash": hash_embedding}

_LEGAL = re.compile(LEGAL.removeprefix("(?U)"))


@lru_cache(maxsize=1 << 16)
def plain_name(name: str) -> str:
    return " ".join(_LEGAL.sub(" ", re.sub(r"[^\w\s]", " ", name.lower())).split())


def name_score(a: str, b: str, floor: float = 0.0) -> float:
    """1 for equal plain names, 0.95 for an acronym, otherwise the matching-blocks ratio; 0 for an empty name, and where the ratio is seen to stay below ``floor``."""
    pair = plain_name(a or ""), plain_name(b or "")
    if "" in pair:
        return 0.0
    if pair[0] == pair[1]:
        return 1.0
    short = [p.replace(" ", "") for p in pair]
    initials = ["".join(w[0] for w in p.split()) for p in pair]
    if short[0] == initials[1] or short[1] == initials[0]:
        return 0.95
    # Matching blocks hold no more characters than the shorter name, nor than both have.
    size = len(pair[0]) + len(pair[1])
    if 2.0 * min(map(len, pair)) / size < floor or 2.0 * (Counter(pair[0]) & Counter(pair[1])).total() / size < floor:
        return 0.0
    return SequenceMatcher(None, *pair).ratio()


def name_similarity(floor: float = 0.0):
    """The score of two names; what is below ``floor`` may count as 0."""

    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([name_score(x, y, floor) for x, y in zip(a, b, strict=True)], dtype="float64")

    return score
