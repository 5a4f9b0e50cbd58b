"""Mixing sources to target weights by entropy balancing.

Every document has base rate 1.  Rates minimise the divergence from it (the sum
of ``r ln r - r``) under one token constraint a source, the words taken are its
target, and 0 to ``most`` copies of a document.  The convex dual has one
multiplier a source, and the solution is an exponential tilt by document,
``rate = min(most, exp(multiplier * size / mean size of the source))``: a source
that must grow repeats its long documents first, one that must shrink thins them
first, and short documents, which hardly matter to the constraint, stay near 1.
Newton steps solve the dual from sums over the table of sizes of each source;
a step that leaves the bracket of what is known to be too low and too high
halves the bracket instead.

Rates become copies by systematic rounding along the sizes of a source, then the
size whose copies come nearest to what is missing gives or takes them, ``repairs`` times.  Both
work on the counts of (source, size).  The documents of one source and size share
its copies as evenly as whole numbers allow, numbered within ``SLICES`` slices of
hash, so that neither a source nor a size is ordered in one task.  All sums are
whole numbers: reruns agree.

Cases: a null or empty text has size 0 and rate 1; a null source is a source of
its own, the last in order; a null ``doc_id`` is a row like any other; repeated
rows are mixed each; documents of one source and size are equal, and hashes of
their ids decide; a text of any length is counted whole and taken at most
``most`` times; an empty table gives an empty result.  Columns of other names
stay as they are; names beginning with ``_mix_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

ONE = 1 << 20  # a whole copy, in the units of rates
SLICES = 32
BROADCAST_SOURCES = 20_000
_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def n_words(text) -> F.Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, 0 for null."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), _WORD, "x")
    return F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")).cast("long")


def _key(source: str) -> F.Column:
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source)))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """(_mix_key, source_size, target) of each source of ``sizes`` (_mix_key, source_size)."""
    cycle = F.array(*[F.lit(w) for w in weights])
    rank = F.row_number().over(Window.orderBy("_mix_key")) - 1
    table = scratch.stage(sizes.withColumn("_mix_w", F.element_at(cycle, (rank % len(weights) + 1).cast("int")).cast("long")), "sources")
    total = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level, top = 0.0, F.col("source_size") * most
    while True:  # sources over their top leave what they can't take to the rest
        full = top < F.col("_mix_w") * F.lit(level)
        row = table.agg(F.sum(F.when(full, top)).alias("held"), F.sum(F.when(~full, F.col("_mix_w"))).alias("open")).first()
        held, weight = row.held or 0, row.open or 0
        if not weight or (total - held) / weight <= level:
            break
        level = (total - held) / weight
    target = F.when(full, top.cast("double")).otherwise(F.least(top.cast("double"), F.col("_mix_w") * F.lit(total - held) / F.lit(max(weight, 1))))
    return table.select("_mix_key", "source_size", target.alias("target"))


def _few(table: DataFrame) -> DataFrame:
    """``table``, of a row a source, to be broadcast while sources are few."""
    return F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table


def _rate(most: int) -> F.Column:
    """Rate of a size in whole units, from its source's multiplier."""
    tilt = F.exp(F.least(F.col("_mix_dual") * F.col("size") / F.col("_mix_mean"), F.lit(50.0)))
    free = F.least(F.floor(tilt * ONE + 0.5), F.lit(most * ONE))
    return F.when(F.col("_mix_state") == 0, free).when(F.col("_mix_state") > 0, most * ONE).otherwise(0).cast("long")


def balance(hist: DataFrame, sources: DataFrame, most: int = 2, tolerance: float = 1e-7, most_steps: int = 100) -> DataFrame:
    """(_mix_key, size, _mix_n, _mix_rate, source_size, target) of ``hist`` (_mix_key, size, _mix_n): Newton steps on the dual.

    A step costs one aggregate of ``hist``.
    """
    first = hist.groupBy("_mix_key").agg(F.sum("_mix_n").alias("n"), F.sum(F.col("_mix_n") * F.col("size").cast("decimal(38,0)") * F.col("size")).cast("double").alias("squares"))
    mean = F.col("source_size") / F.col("n")
    state = F.when((F.col("source_size") == 0) | (F.col("target") <= 0), -1).when(F.col("target") >= most * F.col("source_size") * (1 - 1e-9), 1).otherwise(0)
    guess = F.log(F.col("target") / F.col("source_size")) * F.col("source_size") * mean / F.col("squares")
    none = F.lit(None).cast("double")
    table = sources.join(first, "_mix_key").select("_mix_key", "source_size", "target", mean.alias("_mix_mean"), state.alias("_mix_state"), F.when(state == 0, guess).otherwise(0.0).alias("_mix_dual"), none.alias("_mix_low"), none.alias("_mix_high"))
    table = scratch.stage(table, "dual")
    whole = lambda c: c.cast("decimal(38,0)")
    for _ in range(most_steps):
        met = hist.join(_few(table), "_mix_key").filter("_mix_state = 0").withColumn("_mix_rate", _rate(most))
        words = whole(F.col("_mix_n")) * F.col("size") * F.col("_mix_rate")
        slope = F.when(F.col("_mix_rate") < most * ONE, words * F.col("size")).otherwise(whole(F.lit(0)))
        sums = met.groupBy("_mix_key").agg((F.sum(words).cast("double") / ONE).alias("_mix_g"), (F.sum(slope).cast("double") / ONE).alias("_mix_h"))
        now = scratch.stage(table.join(sums, "_mix_key", "left").withColumn("_mix_g", F.col("_mix_g") - F.col("target")), "steps")
        near = F.abs(F.col("_mix_g")) <= F.greatest(F.col("target") * tolerance, F.col("source_size") / ONE)
        if now.filter((F.col("_mix_state") == 0) & ~near).isEmpty():
            break
        dual, low, high = F.col("_mix_dual"), F.when(F.col("_mix_g") < 0, F.col("_mix_dual")).otherwise(F.col("_mix_low")), F.when(F.col("_mix_g") > 0, F.col("_mix_dual")).otherwise(F.col("_mix_high"))
        step = F.when(F.col("_mix_h") > 0, -F.col("_mix_g") * F.col("_mix_mean") / F.col("_mix_h"))
        aim = dual + F.greatest(F.least(F.coalesce(step, F.when(F.col("_mix_g") < 0, F.lit(8.0)).otherwise(-8.0)), F.lit(8.0)), F.lit(-8.0))
        outside = F.coalesce(aim <= low, F.lit(False)) | F.coalesce(aim >= high, F.lit(False))
        moved = now.select("_mix_key", "source_size", "target", "_mix_mean", "_mix_state", F.when((F.col("_mix_state") != 0) | near, dual).when(outside, F.coalesce((low + high) / 2, aim)).otherwise(aim).alias("_mix_dual"), low.alias("_mix_low"), high.alias("_mix_high"))
        table = scratch.stage(moved, "dual")
    else:
        raise RuntimeError("the dual did not settle")
    return hist.join(_few(table), "_mix_key").select("_mix_key", "size", "_mix_n", _rate(most).alias("_mix_rate"), "source_size", "target")


def _rounded(rated: DataFrame, most: int, repairs: int) -> DataFrame:
    """(_mix_key, size, _mix_n, _mix_copies, source_size, target): whole copies of each size of each source."""
    running = F.sum(F.col("_mix_n") * F.col("_mix_rate")).over(Window.partitionBy("_mix_key").orderBy("size")) + ONE // 2
    passed = F.shiftright(running, 20) - F.shiftright(running - F.col("_mix_n") * F.col("_mix_rate"), 20)
    fixed = F.when(F.col("_mix_rate") == most * ONE, F.col("_mix_n") * most).otherwise(F.least(passed, F.col("_mix_n") * most))
    rows = scratch.stage(rated.withColumn("_mix_copies", fixed), "rounded")
    for _ in range(repairs):
        total = rows.groupBy("_mix_key").agg((F.first("target") - F.sum(F.col("_mix_copies") * F.col("size"))).alias("_mix_miss"))
        missed = rows.join(_few(total), "_mix_key")
        lack = F.abs("_mix_miss")
        room = F.when(F.col("_mix_miss") > 0, most * F.col("_mix_n") - F.col("_mix_copies")).otherwise(F.col("_mix_copies"))
        few = F.least(room, F.floor(lack / F.col("size") + 0.5).cast("long"))
        left = F.abs(lack - few * F.col("size"))
        best = missed.filter((F.col("size") > 0) & (left < lack)).groupBy("_mix_key").agg(F.max_by(F.struct("size", (F.signum("_mix_miss").cast("long") * few).alias("_mix_step")), F.struct(-left, "size")).alias("b"))
        step = best.select("_mix_key", F.col("b.size").alias("_mix_at"), "b._mix_step")
        moved = rows.join(_few(step), "_mix_key", "left")
        more = F.when(F.col("size") == F.col("_mix_at"), F.col("_mix_step")).otherwise(0)
        rows = scratch.stage(moved.withColumn("_mix_copies", F.col("_mix_copies") + more).drop("_mix_at", "_mix_step"), "rounded")
    return rows


def mix(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, repairs: int = 3) -> DataFrame:
    """The columns of ``sizes`` (doc_id, source, size, ...) with source_size, target, copies (0 to ``most``) and taken words of each row."""
    keyed = sizes.withColumns({"_mix_key": _key("source"), "_mix_h": F.xxhash64(*sizes.columns)}).withColumn("_mix_slice", F.pmod("_mix_h", F.lit(SLICES)).cast("int"))
    cell = ["_mix_key", "size", "_mix_slice"]
    cells = scratch.stage(keyed.groupBy(*cell).agg(F.count("*").alias("_mix_n")), "cells")
    hist = scratch.stage(cells.groupBy("_mix_key", "size").agg(F.sum("_mix_n").alias("_mix_n")), "sizes")
    sources = targets(hist.groupBy("_mix_key").agg(F.sum(F.col("_mix_n") * F.col("size")).alias("source_size")), weights, share, most)
    rounded = _rounded(balance(hist, sources, most), most, repairs)
    before = F.coalesce(F.sum("_mix_n").over(Window.partitionBy("_mix_key", "size").orderBy("_mix_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = cells.withColumn("_mix_before", before).drop("_mix_n").join(rounded, ["_mix_key", "size"])
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy("_mix_h", "doc_id"))
    rows = keyed.withColumn("_mix_rank", rank).join(placed, cell).withColumn("_mix_j", (F.col("_mix_before") + F.col("_mix_rank")).cast("decimal(19,0)"))
    copies = F.expr("(_mix_j * _mix_copies) div _mix_n - ((_mix_j - 1) * _mix_copies) div _mix_n").cast("int")
    return rows.withColumn("copies", copies).select(*sizes.columns, "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as its copies say, with the columns of ``docs``.

    Rows are told apart by all their values; the copies of equal rows are as good as each other.
    """
    rows = docs.withColumn("_mix_row", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    order = Window.partitionBy("_mix_id", "_mix_row").orderBy("_mix_words")
    sizes = scratch.stage(rows.select("doc_id", "source", n_words(F.col("text")).alias("size"), "_mix_row"), "sizes")
    plan = mix(sizes, **options).select(F.col("doc_id").alias("_mix_id"), "_mix_row", F.col("copies").alias("_mix_words"))
    plan = plan.select(F.col("_mix_id").alias("_mix_id2"), F.col("_mix_row").alias("_mix_row2"), F.col("_mix_words").alias("_mix_copies"), F.row_number().over(order).alias("_mix_no2")).filter("_mix_copies > 0")
    same = Window.partitionBy("doc_id", "_mix_row").orderBy("source")
    numbered = rows.withColumn("_mix_no", F.row_number().over(same))
    joined = numbered.alias("d").join(plan, F.col("d.doc_id").eqNullSafe(F.col("_mix_id2")) & (F.col("_mix_row") == F.col("_mix_row2")) & (F.col("_mix_no") == F.col("_mix_no2")))
    return joined.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*[F.col(f"d.`{c}`") for c in docs.columns])


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) of all documents, written once."""
    return scratch.stage(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
