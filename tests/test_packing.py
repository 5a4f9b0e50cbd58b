"""Chunking against a plain reading of its rule, as a column and as a table function."""

import random
import re
import time

from pyspark.sql import functions as F

from loomgraph.functions import packing


def plain(text, size, overlap):
    """The rule step by step, on whole strings."""
    units = []
    for p in re.split(r"\n\s*\n", text.strip()):
        p = p.strip()
        if len(p) <= size:
            units += [p] if p else []
            continue
        line = ""
        for s in re.split(r"(?<=[.!?])\s+", p):
            if line and len(line) + 1 + len(s) > size:
                units.append(line)
                line = ""
            line = s if not line else line + " " + s
        units.append(line)
    out, open_ = [], ""
    for u in units:
        if open_ and len(open_) + 2 + len(u) > size:
            out.append(open_)
            last = open_[len(open_) - min(overlap, len(open_)) :] if overlap else ""
            rest = last[last.index(" ") + 1 :] if " " in last else ""
            open_ = (rest + " " + u).strip() if rest else u
        else:
            open_ = u if not open_ else open_ + "\n\n" + u
    return out + ([open_] if open_ else [])


def texts(n):
    rng = random.Random(7)
    parts = ["Silk mill.", "A longer sentence about looms and canals! ", "\n\n", "\n \t\n", " ", "word ", "Weft? ", "é ß. ", "x" * 90, "\n"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_equals_the_plain_rule(spark):
    rows = [(i, t) for i, t in enumerate(texts(300))]
    df = spark.createDataFrame(rows, "i long, t string")
    for size, overlap in ((40, 0), (100, 0), (100, 30), (25, 200)):
        got = {r.i: r.c for r in df.select("i", packing.pack(F.col("t"), size, overlap).alias("c")).collect()}
        assert all(got[i] == plain(t, size, overlap) for i, t in rows)


def test_table_function_and_column_agree(spark):
    df = spark.createDataFrame([*enumerate(texts(50)), (90, None), (91, ""), (92, " \n ")], "i long, t string")
    packing.register(spark)
    made = spark.sql("SELECT i, pos, chunk FROM {df}, LATERAL split_chunks(t, 60, 10)", df=df).collect()
    want = df.select("i", F.posexplode(packing.pack(F.col("t"), 60, 10)).alias("pos", "chunk")).collect()
    assert sorted(map(tuple, made)) == sorted(map(tuple, want)) and not {90, 91, 92} & {r.i for r in made}
    assert df.filter("i >= 90").select(packing.pack(F.col("t")).alias("c")).orderBy("i").collect()[0].c in (None, [])


def test_long_text_is_linear():
    def seconds(n):
        text = "A sentence about looms. " * n
        began = time.perf_counter()
        assert sum(len(p) + 1 for p in packing.pieces(text, 400)) == len(text)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(400_000) < 40 * max(seconds(40_000), 0.01)  # ten times the text, 9.6 MB
