"""Quality rules: document counts and n-gram perplexity bands.

The language model is a modified Kneser-Ney model of characters.  Spark counts
the 4-grams of every document by language; the distinct 4-grams of a language
are bounded by its alphabet, not by the corpus.  Up to ``max_entries`` of them,
the smoothed model is broadcast as sorted hash arrays; beyond, the same
probabilities are computed by aggregates and meet the 4-grams of each document
in a join.  A document is rejected when its perplexity leaves the band of its
language, which follows the spread of the perplexities of that language.

Cases: a null or empty text has no words and fails the base rule; a null
language is a language of its own, apart from the empty one; repeated rows are
judged each; bounds of a band are inside it; a text of any length is scored
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from .textkit import HashArray, Words, apart_hash, blocks, buffers, mix, per_row, shingles
from .workers import tidy

ORDER = 4
WIDTH, LEAST = 6.0, 0.02  # of the bands, in quartile distances and in nats a character
BROADCAST_LANGUAGES = 10_000
MAX_ENTRIES = 8_000_000  # 4-grams of a broadcast model
_U = np.uint64
_PAD = 2
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars")


def _normal_table() -> np.ndarray:
    table = np.arange(0x10000, dtype=_U)
    table[65:91] += _U(32)
    table[48:58] = 48
    table[[9, 10, 11, 12, 13]] = 32
    return table


def _lang_key(name: str | None) -> str:
    return "" if name is None else f"={name}"


_NORMAL = _normal_table()


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-gram ending at each character, and the first character of each row.

    A-Z are lower-cased, digits are 0, white space is a space; characters beyond
    16 bits are spread over the 2,048 codes that are no characters.
    """
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    first = lead[off]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if points.size != first[-1]:  # broken UTF-8: one character a byte
        points, first = data.astype(np.uint32), off
    codes = _NORMAL[np.where(points < 0x10000, points, 0xD800 + points % 0x800)]
    doc = np.repeat(np.arange(first.size - 1), np.diff(first))
    at = np.arange(codes.size) + (ORDER - 1) * (doc + 1)
    padded = np.full(codes.size + (ORDER - 1) * (first.size - 1), _PAD, _U)
    padded[at] = codes
    key = padded[at]
    for i in range(1, ORDER):
        key |= padded[at - i] << _U(16 * i)
    return key, first


def _tally(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        ordered = np.sort(keys)
        edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if ordered.size else np.zeros(0, int)
        return ordered[edge], np.diff(np.append(edge, ordered.size))
    order = np.argsort(keys)
    ordered = keys[order]
    edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if ordered.size else np.zeros(0, int)
    return ordered[edge], np.add.reduceat(weights[order], edge) if edge.size else weights[:0]


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Rows of each language, in their order, under its key."""
    lang = np.array([_lang_key(x) for x in batch.column(batch.schema.get_field_index("lang")).to_pylist()], object)
    for name in dict.fromkeys(lang):
        yield name, batch.take(pa.array(np.flatnonzero(lang == name)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    waiting = 0

    def flush():
        for name, parts in held.items():
            keys, counts = _tally(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
            for i in range(0, keys.size, 100_000):
                part = keys[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([name] * part.size), pa.array(part.view(np.int64)), pa.array(counts[i : i + 100_000])], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for name, rows in _by_language(batch):
            for block in blocks(rows):
                key, _ = grams(*buffers(block.column(block.schema.get_field_index("text"))))
                if key.size:
                    parts = held.setdefault(name, [])
                    parts.append(_tally(key))
                    waiting += parts[-1][0].size
                    if len(parts) >= 8:
                        merged = _tally(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
                        waiting += merged[0].size - sum(k.size for k, _ in parts)
                        parts[:] = [merged]
        if waiting > 1_000_000:
            yield from flush()
            waiting = 0
    yield from flush()


def count_grams(docs: DataFrame) -> DataFrame:
    """Counts (lang, gram, n) of the character 4-grams of all documents."""
    counted = docs.select("lang", "text").mapInArrow(tidy(_count), "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class KneserNey:
    """Modified Kneser-Ney probabilities of packed character n-grams, in sorted hash arrays."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        level = {ORDER: (keys[order].astype(_U), counts[order].astype(np.int64))}
        for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct characters before it
            level[k] = _tally(level[k + 1][0] & _U((1 << (16 * k)) - 1))
        probability = np.zeros(0)
        floor = 1.0 / (level[1][0].size + 1)
        self.floor, self.tables, self.backoff = floor, {}, {}
        for k in range(1, ORDER + 1):
            key, count = level[k]
            discount = self.discounts(count)
            context = key >> _U(16)
            head = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if key.size else np.zeros(0, int)
            group = np.cumsum(np.isin(np.arange(key.size), head)) - 1
            total = np.bincount(group, count, head.size)
            taken = discount[np.minimum(count, 3)]
            gamma = np.bincount(group, taken, head.size) / np.maximum(total, 1)
            if k == 1:
                lower = np.full(key.size, floor)
            else:
                lower = probability[np.searchsorted(level[k - 1][0], key & _U((1 << (16 * (k - 1))) - 1))]
            probability = (count - taken) / total[group] + gamma[group] * lower if key.size else np.zeros(0)
            self.tables[k] = HashArray(mix(key), np.log(probability))
            self.backoff[k] = HashArray(mix(context[head]), np.log(np.maximum(gamma, 1e-300)))

    @staticmethod
    def discounts(count: np.ndarray) -> np.ndarray:
        """Discount of counts 0, 1, 2 and 3 or more."""
        n1, n2, n3, n4 = (max(int(np.sum(count == i)), 1) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        return np.array([0, *(min(max(d, 0.05), i - 0.05) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))])

    def log_prob(self, key: np.ndarray) -> np.ndarray:
        out = np.zeros(key.size)
        left = np.arange(key.size)
        for k in range(ORDER, 0, -1):
            part = key[left] & _U((1 << (16 * k)) - 1) if k < 4 else key[left]
            found = self.tables[k].find(mix(part))
            hit = found >= 0
            out[left[hit]] += self.tables[k].values[0][found[hit]]
            left, part = left[~hit], part[~hit]
            context = self.backoff[k].find(mix(part >> _U(16)))
            known = context >= 0
            out[left[known]] += self.backoff[k].values[0][context[known]]
            if not left.size:
                return out
        out[left] += np.log(self.floor)
        return out


def held(counted: DataFrame) -> dict[str, KneserNey]:
    """Model of each language of a bounded table of counts."""
    table = counted.toArrow()
    lang, gram, n = (table.column(c).combine_chunks() for c in ("lang", "gram", "n"))
    names, gram, n = lang.dictionary_encode(), gram.to_numpy().view(_U), n.to_numpy()
    code = names.indices.to_numpy(zero_copy_only=False)
    return {name: KneserNey(gram[code == i], n[code == i]) for i, name in enumerate(names.dictionary.to_pylist())}


def probabilities(counted: DataFrame) -> DataFrame:
    """(lang, gram, log_p) of the 4-grams of ``counted``: the model of ``KneserNey`` by aggregates and joins."""
    low = lambda k: F.col("gram").bitwiseAND(F.lit((1 << (16 * k)) - 1))
    level = {ORDER: counted}
    for k in range(ORDER - 1, 0, -1):
        level[k] = scratch.stage(level[k + 1].groupBy("lang", low(k).alias("gram")).agg(F.count("*").alias("n")), "level")
    p = None
    for k in range(1, ORDER + 1):
        n1, n2, n3, n4 = (F.greatest(F.count_if(F.col("n") == i), F.lit(1)) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        cut = [F.least(F.greatest(d, F.lit(0.05)), F.lit(i - 0.05)).alias(f"d{i}") for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
        taken = level[k].join(level[k].groupBy("lang").agg(F.count("*").alias("types"), *cut), "lang")
        taken = taken.select("lang", "gram", "n", "types", F.shiftrightunsigned("gram", 16).alias("context"), F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")).alias("d"))
        full = taken.join(taken.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("free")), ["lang", "context"])
        if p is None:
            full = full.withColumn("lower", 1 / (F.col("types") + 1))
        else:
            full = full.withColumn("tail", low(k - 1)).join(p.select("lang", F.col("gram").alias("tail"), F.col("p").alias("lower")), ["lang", "tail"])
        p = scratch.stage(full.select("lang", "gram", ((F.col("n") - F.col("d") + F.col("free") * F.col("lower")) / F.col("total")).alias("p")), "p")
    return p.select("lang", "gram", F.log("p").alias("log_p"))


def text_counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of the base rules for each row of a block."""
    words = Words(data, off)
    inside = np.zeros(data.size, bool)
    lead = (data & 0xC0) != 0x80
    space = np.concatenate(([0], np.cumsum((data <= 32) & ((data == 32) | ((data >= 9) & (data <= 13))))))
    chars = per_row(lead, off)
    row_of = lambda x: np.searchsorted(off, x, "right") - 1

    cut = np.zeros(data.size + 1, bool)
    full = off[:-1][np.diff(off) > 0]
    cut[full] = True
    newline = np.flatnonzero(data == 10)
    begin = np.union1d(full, newline + 1)
    begin = begin[begin < data.size]
    end = np.append(begin[1:], data.size)
    end = end - ((end > begin) & (data[np.maximum(end - 1, 0)] == 10)) if begin.size else end[:0]
    worded = (end - begin) > space[end] - space[begin]
    begin, end = begin[worded], end[worded]
    line_row = row_of(begin)
    line = mix(apart_hash(data, begin, end) + line_row.astype(_U))
    distinct = np.unique(line, return_index=True)[1]
    n_lines = np.bincount(line_row, minlength=off.size - 1)
    n_distinct = np.bincount(line_row[distinct], minlength=off.size - 1)

    window, at = shingles(words.hashes(), words.doc, 3)
    order = np.argsort(mine := mix(window + words.doc[at].astype(_U)))
    same = mine[order][1:] == mine[order][:-1]
    twice = np.zeros(at.size, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(words.start.size + 2, bool)
    for i in range(3):
        covered[at[twice] + i] = True
    del inside
    return {
        "n_words": words.count,
        "word_chars": chars - (space[off[1:]] - space[off[:-1]]),
        "n_symbols": per_row(_SYMBOL[data], off),
        "n_dup_lines": n_lines - n_distinct,
        "n_repeat_words": per_row(covered[:-2], words.first),
        "n_chars": chars,
    }


def _rows_of(docs: DataFrame, shared, extra: T.StructType, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with the counts of the base rules and, by the models ``shared``, the log perplexity a character.

    Without models the distinct 4-grams of each row and their counts stand in its place.
    """
    out = T.StructType([docs.schema[c] for c in keep] + list(extra))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = None if shared is None else shared.value
        for batch in batches:
            for name, rows in _by_language(batch):
                for block in blocks(rows):
                    data, off = buffers(block.column(block.schema.get_field_index("text")))
                    counts = text_counts(data, off)
                    key, first = grams(data, off)
                    n, row = np.diff(first), np.repeat(np.arange(first.size - 1), np.diff(first))
                    if models is not None:
                        score = -np.bincount(row, models[name].log_prob(key), first.size - 1) if key.size else np.zeros(first.size - 1)
                        last = [pa.array(score / np.maximum(n, 1), mask=n == 0)]
                    else:
                        order = np.lexsort((key, row))
                        edge = np.flatnonzero(np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (row[order][1:] != row[order][:-1])))) if key.size else np.zeros(0, int)
                        lists = pa.array(np.searchsorted(row[order][edge], np.arange(first.size)).astype(np.int32))
                        last = [pa.ListArray.from_arrays(lists, pa.StructArray.from_arrays([pa.array(key[order][edge].view(np.int64)), pa.array(np.diff(np.append(edge, key.size)))], ["gram", "m"]))]
                    columns = [block.column(block.schema.get_field_index(c)) for c in keep]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([name] * block.num_rows), *[pa.array(counts[c].astype(np.int64)) for c in NUMBERS], *last], out.names)

    return docs.mapInArrow(tidy(run), out)


def judge(docs: DataFrame, keep: list[str], names: dict[str, str], max_entries: int) -> DataFrame:
    """``keep`` columns of ``docs`` (lang, text, ...), and under the given names the language's key, the counts and the log perplexity a character (null without characters)."""
    counted = scratch.stage(count_grams(docs), "grams")
    rest = [T.StructField(names["lang"], T.StringType()), *[T.StructField(names[c], T.LongType()) for c in NUMBERS]]
    score = names["log_ppl"]
    if counted.count() <= max_entries:
        shared = scratch.share(docs.sparkSession, held(counted))
        rows = scratch.stage(_rows_of(docs, shared, T.StructType([*rest, T.StructField(score, T.DoubleType())]), keep), "rules")
        scratch.forget(shared)
        return rows
    listed = T.ArrayType(T.StructType([T.StructField("gram", T.LongType()), T.StructField("m", T.LongType())]))
    rows = _rows_of(docs, None, T.StructType([*rest, T.StructField(score, listed)]), keep)
    rows = scratch.stage(rows.withColumn("_rule_row", F.monotonically_increasing_id()), "rules")
    each = rows.select("_rule_row", F.col(f"`{names['lang']}`").alias("lang"), F.explode(F.col(f"`{score}`")).alias("g")).select("_rule_row", "lang", "g.*")
    sums = each.join(probabilities(counted), ["lang", "gram"]).groupBy("_rule_row").agg((-F.sum(F.col("m") * F.col("log_p")) / F.sum("m")).alias("_rule_ppl"))
    return rows.drop(score).join(sums, "_rule_row", "left").withColumnRenamed("_rule_ppl", score).drop("_rule_row")


def bands(counts: DataFrame, width: float = WIDTH, least: float = LEAST) -> DataFrame:
    """Band of the log perplexity of each language: its median, and on each side ``width``
    times the distance of the quartile of that side.  Texts of one perplexity, as copies
    are, count once; ``least`` is only for languages whose quartiles meet."""
    q = counts.filter(~F.col("base_failed")).select("lang", "log_ppl").distinct().groupBy("lang").agg(F.percentile_approx("log_ppl", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10000).alias("q"))
    side = lambda x: F.greatest(F.lit(width) * x, F.lit(least))
    return q.select("lang", (F.col("q")[1] - side(F.col("q")[1] - F.col("q")[0])).alias("lower"), (F.col("q")[1] + side(F.col("q")[2] - F.col("q")[1])).alias("upper"))


def _failed(n_words: str, n_repeat_words: str, min_words: int, max_repeat_percent: int) -> F.Column:
    return (F.col(n_words) < min_words) | (100 * F.col(n_repeat_words) > max_repeat_percent * F.col(n_words))


def _banded(rows: DataFrame, width: float, least: float) -> DataFrame:
    """``bands`` of (lang, log_ppl, base_failed), to be broadcast while languages are few."""
    band = scratch.stage(bands(rows, width, least), "bands")
    return F.broadcast(band) if band.count() <= BROADCAST_LANGUAGES else band


def quality_rules(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, width: float = WIDTH, least: float = LEAST, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """One row a document: counts, perplexity, band and ``kept``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    names = {c: c for c in ("lang", *NUMBERS, "log_ppl")}
    counts = judge(docs, ["doc_id"], names, max_entries)
    counts = counts.withColumn("base_failed", _failed("n_words", "n_repeat_words", min_words, max_repeat_percent))
    inside = F.coalesce(F.col("log_ppl").between(F.col("lower"), F.col("upper")), F.lit(True))
    found = counts.join(_banded(counts, width, least), "lang", "left").withColumn("kept", ~F.col("base_failed") & inside)
    return found.withColumn("lang", F.when(F.col("lang") != "", F.substring("lang", 2, 1 << 30)))


def passing(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, width: float = WIDTH, least: float = LEAST, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``quality_rules`` keeps; each text is scored once.

    Scored rows are staged, and no text is shuffled while languages are few.
    """
    names = {c: f"_rule_{c}" for c in ("lang", *NUMBERS, "log_ppl")}
    if taken := set(docs.columns) & set(names.values()):
        raise ValueError(f"columns {sorted(taken)} are reserved")
    rows = judge(docs, docs.columns, names, max_entries)
    rows = rows.withColumn("_rule_failed", _failed(names["n_words"], names["n_repeat_words"], min_words, max_repeat_percent))
    scores = rows.select(F.col(names["lang"]).alias("lang"), F.col(names["log_ppl"]).alias("log_ppl"), F.col("_rule_failed").alias("base_failed"))
    band = _banded(scores, width, least)
    inside = F.coalesce(F.col(names["log_ppl"]).between(F.col("b.lower"), F.col("b.upper")), F.lit(True))
    met = rows.alias("d").join(band.alias("b"), F.col(names["lang"]) == F.col("b.lang"), "left")
    return met.filter(~F.col("_rule_failed") & inside).select(*[F.col(f"d.`{c}`") for c in docs.columns])
