"""Small tables with every awkward row, and plain versions of shared text rules."""

import random
import re

SPACE = "\x20\x09-\x0D"
WORD = re.compile(f"[^{SPACE}]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, copies int, coverage double, h long, n_words int"


def words(text):
    return WORD.findall(text or "")


def rows(texts, **fixed):
    """Rows of documents with further columns whose names clash with those of the operators."""
    out = []
    for i, t in enumerate(texts):
        d = {"doc_id": i, "text": t, "lang": "en", "source": "s1", "n_chars": len(t or ""), "size": 7, "copies": 3, "coverage": 0.5, "h": 1, "n_words": 2} | fixed
        out.append(d)
    return out


def frame(spark, data):
    names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
    return spark.createDataFrame([tuple(d[n] for n in names) for d in data], SCHEMA)


def prose(seed, n):
    rng = random.Random(seed)
    stems = "loom weft warp reed silk canal mill spool thread bobbin carder felt dyer sheep flax hemp yarn twill serge linen".split()
    return " ".join(rng.choice(stems) + rng.choice(["", "s", "ing", "ed", "er"]) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def awkward():
    """Null, empty, blank, short, long, repeated and odd texts; null ids, languages and sources; repeated rows."""
    base = prose(1, 120)
    near = base.split(" ")
    near[60] = "changed"
    texts = [None, "", " \n\t ", "one", "two words", base, base, " ".join(near), prose(2, 4000), "é 😀 ñandú " * 30, "line\nline\nline\n" * 20, prose(3, 60), prose(4, 80), "a" * 300, "x\x0b\x0cy"]
    data = rows(texts)
    data[3]["lang"] = data[3]["source"] = None
    data[9]["lang"], data[9]["source"] = "es", "é"
    data.append(dict(data[5]))  # a repeated row
    data.append(data[6] | {"doc_id": None})
    data.append(data[11] | {"doc_id": None, "source": None})
    return data
