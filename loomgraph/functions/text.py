"""Text expressions: sentences, phrases, normal forms, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SPACE = r"[ \t\n\f\r]+"
PHRASE = r"\p{Lu}[\p{L}\p{N}_&\-]*(?: \p{Lu}[\p{L}\p{N}_&\-]*)*"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ABSTENTION = ("do not contain", "does not contain", "no information", "cannot answer")
LEGAL = r"(?U)\b(inc|incorporated|ltd|limited|llc|plc|corp|corporation|co|gmbh|sa|nv|ag|the)\b"

_CUT = "\x01"


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def sentences(text: Column) -> Column:
    """Array of sentences: cut at white space after ``.``, ``!`` or ``?``."""
    return F.split(F.regexp_replace(text, rf"([.!?]){SPACE}", f"$1{_CUT}"), _CUT)


def phrases(sentence: Column) -> Column:
    return F.regexp_extract_all(sentence, F.lit(PHRASE), F.lit(0))


def slug(uri: Column) -> Column:
    """Document id of a uri: its stem in lower case, other characters than a-z and 0-9 as ``-``, 64 at most."""
    base = F.element_at(F.split(uri, "/"), -1)
    stem = F.regexp_replace(base, r"^(.+)\.[^.]*$", "$1")
    made = F.substring(F.regexp_replace(F.regexp_replace(F.lower(stem), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, 64)
    return F.when(made != "", made).otherwise(F.substring(F.sha2(uri, 256), 1, 12))


def normal_name(name: Column) -> Column:
    """A name in lower case without punctuation and legal suffixes."""
    bare = F.regexp_replace(F.lower(name), r"(?U)[^\w\s]", " ")
    return flat(F.regexp_replace(bare, LEGAL, " "))


def normal_answer(text: Column) -> Column:
    """Lower case, without ASCII punctuation and the articles a, an, the."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), SPACE, " "))


def answer_tokens(text: Column) -> Column:
    return F.filter(F.split(normal_answer(text), " "), lambda t: t != "")


def word_set(text: Column) -> Column:
    """Distinct ``[a-z0-9_]`` words in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]+"), F.lit(0)))


def abstains(answer: Column) -> Column:
    low = F.lower(answer)
    hit = F.lit(False)
    for marker in ABSTENTION:
        hit = hit | low.contains(marker)
    return hit


def model_tokens(text: Column) -> Column:
    """Estimated tokens of a text: a quarter of its characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def relabel(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text
