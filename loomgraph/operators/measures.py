"""Counts, rates, histograms and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys, text
from . import facts, versions


def _one(*frames: DataFrame) -> DataFrame:
    """One row of the columns of one-row frames."""
    keyed = [f.withColumn("_k", F.lit(1)) for f in frames]
    out = keyed[0]
    for f in keyed[1:]:
        out = out.join(f, "_k")
    return out.drop("_k")


def stats(docs: DataFrame, chunks: DataFrame, rel: DataFrame, costs: DataFrame) -> DataFrame:
    entities = facts.degrees(rel).agg(F.count("*").alias("entities"))
    relations = rel.agg(F.count("*").alias("relations"), F.count_if(F.col("support") == 1).alias("single"))
    return _one(docs.agg(F.count("*").alias("documents")), chunks.agg(F.count("*").alias("chunks")), entities, relations, costs.agg(F.round(F.sum("tokens"), 2).alias("tokens")))


def integrity(men: DataFrame, sup: DataFrame, live_chunks: DataFrame) -> DataFrame:
    """Counts of orphans, unsupported relations, ghost support rows and dangling relations; ok if there are none."""
    live = live_chunks.select("chunk_id").distinct()
    names = men.select("name").distinct()
    alive = men.join(live, "chunk_id", "left_semi").select("name").distinct()
    rel = sup.select("src", "dst").distinct()
    held = sup.join(live, "chunk_id", "left_semi").select("src", "dst").distinct()
    n = lambda df, c: df.agg(F.count("*").alias(c))
    counts = _one(
        n(names.join(alive, "name", "left_anti"), "orphans"),
        n(rel.join(held, ["src", "dst"], "left_anti"), "unsupported"),
        n(sup.join(live, "chunk_id", "left_anti"), "ghosts"),
        n(facts.dangling(rel, alive), "dangling"),
    )
    return counts.withColumn("ok", F.col("orphans") + F.col("unsupported") + F.col("ghosts") + F.col("dangling") == 0)


def staleness(communities: DataFrame) -> DataFrame:
    """Dirty communities, their share and the greatest age."""
    return communities.agg(
        F.count_if("dirty").alias("dirty"),
        F.count("*").alias("total"),
        F.coalesce(F.round(F.try_divide(F.count_if("dirty"), F.count("*")), 4), F.lit(0.0)).alias("fraction"),
        F.max(F.when(F.col("dirty"), F.col("age"))).cast("long").alias("max_age"),
    )


def cost_by_operation(costs: DataFrame, price: float = 5.0) -> DataFrame:
    return costs.groupBy("operation").agg(F.count("*").alias("calls"), F.round(F.sum("tokens"), 2).alias("tokens"), F.round(F.sum("tokens") * price / 1e6, 6).alias("usd"), F.count_if("cache_hit").alias("cache_hits"))


def unit_histogram(values: DataFrame, buckets: int) -> DataFrame:
    """Counts of ``x`` in equal buckets of [0, 1], clamped."""
    bucket = F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor(F.col("x") * buckets)))
    return values.groupBy(bucket.cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def cumulative_histogram(values: DataFrame, edges: list[float]) -> DataFrame:
    """(le, n): rows of at most each edge, in one pass."""
    row = values.agg(*[F.count_if(F.col("x") <= e).alias(f"n{i}") for i, e in enumerate(edges)])
    pairs = F.array(*[F.struct(F.lit(e).alias("le"), F.col(f"n{i}").alias("n")) for i, e in enumerate(edges)])
    return row.select(F.explode(pairs).alias("b")).select("b.le", "b.n")


def bucket_counts(rows: DataFrame, by: list[str], value: str, edges: list[float]) -> DataFrame:
    """(by…, le, n): rows of each group of at most each edge, the last edge being infinite, in one pass."""
    every = [*edges, float("inf")]
    counted = rows.groupBy(*by).agg(*[F.count_if(F.col(value) <= e).alias(f"_n{i}") for i, e in enumerate(edges)], F.count(value).alias(f"_n{len(edges)}"))
    pairs = F.array(*[F.struct(F.lit(e).alias("le"), F.col(f"_n{i}").alias("n")) for i, e in enumerate(every)])
    return counted.select(*by, F.explode(pairs).alias("_b")).select(*by, "_b.le", "_b.n")


def bucket_quantiles(buckets: DataFrame, by: list[str], quantiles: list[float]) -> DataFrame:
    """(by…, q, x): quantiles of cumulative buckets (by…, le, n), straight lines inside a bucket.

    The first bucket starts at 0, or is a point where its edge is not above 0; what
    lies in the infinite bucket counts as the edge before it; an empty histogram has none.
    """
    order = Window.partitionBy(*by).orderBy("le")
    under, start, total = F.lag("n").over(order), F.lag("le").over(order), F.max("n").over(Window.partitionBy(*by))
    placed = buckets.withColumns({"_under": under, "_start": start, "_total": total}).filter("_total > 0")
    each = placed.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles]))).withColumn("_rank", F.col("q") * F.col("_total"))
    held = each.filter((F.col("n") >= F.col("_rank")) & (F.col("_under").isNull() | (F.col("_under") < F.col("_rank"))))
    low = F.coalesce("_start", F.least(F.lit(0.0), F.col("le")))
    inside = F.coalesce(F.try_divide(F.col("_rank") - F.coalesce("_under", F.lit(0)), F.col("n") - F.coalesce("_under", F.lit(0))), F.lit(0.0))
    point = F.col("_start").isNull() & (F.col("le") <= 0)
    x = F.when(F.col("le") == float("inf"), F.col("_start")).when(point, F.col("le")).otherwise(low + (F.col("le") - low) * inside)
    return held.select(*by, "q", x.alias("x"))


def increase(samples: DataFrame, by: list[str], width: str) -> DataFrame:
    """(by…, start, increase): growth of counters (by…, ts, value) in each window; a fall is a reset to 0."""
    before = F.lag("value").over(Window.partitionBy(*by).orderBy("ts", "value"))
    step = F.when(before.isNull(), 0.0).when(F.col("value") >= before, F.col("value") - before).otherwise(F.col("value"))
    grown = samples.withColumn("_step", step)
    return grown.groupBy(*by, F.window("ts", width).start.alias("start")).agg(F.sum("_step").alias("increase"))


def rate(rows: DataFrame, width: str, seconds: float) -> DataFrame:
    return rows.groupBy(F.window("ts", width).start.alias("start"), "operation").agg(F.count("*").alias("n"), F.round(F.count("*") / seconds, 6).alias("rate"))


def late(rows: DataFrame, key: str, delay: str) -> DataFrame:
    """``late``: older than the delay behind the newest row of the key that arrived before."""
    before = Window.partitionBy(key).orderBy("arrival", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    newest = F.coalesce(F.max("ts").over(before), F.col("ts"))
    return rows.withColumn("late", F.col("ts") < newest - F.expr(f"INTERVAL {delay}"))


def share(rows: DataFrame, hit: Column, name: str, total: str) -> DataFrame:
    return rows.agg(F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 4).alias(name), F.count("*").alias(total))


def size_stats(sizes: DataFrame) -> DataFrame:
    return sizes.agg(F.count("*").alias("communities"), F.round(F.avg("n"), 2).alias("mean_size"), F.max("n").alias("max_size"))


def scaling_ratio(docs: DataFrame, names: list[tuple[str, str]], copies: list[int], edit) -> DataFrame:
    """(copies, chunks, build_tokens, update_tokens, ratio) of extracting corpora of relabelled copies of ``docs`` (doc_id, text).

    A build pays for each distinct sentence once.  The update edits the longest
    document by ``edit`` and pays for the sentences that the corpus lacks.  Sentences
    travel as their hashes, of the length of a content key, not as texts.
    """
    cut_up = lambda df, *c: df.select(*c, F.explode(text.sentences(F.col("text"))).alias("s")).filter("s <> ''").select(*c, F.unhex(keys.content_hash(F.col("s"))).alias("s"), text.model_tokens(F.col("s")).alias("tokens"))
    first = cut_up(versions.scale(docs, max(copies), names), F.col("copy")).groupBy("s").agg(F.min("copy").alias("c0"), F.max("tokens").alias("tokens"))
    sizes = F.array(*[F.lit(n).cast("long") for n in copies])
    edited = cut_up(docs.orderBy(F.desc(F.coalesce(F.length("text"), F.lit(0))), "doc_id").limit(1).select(edit(F.col("text")).alias("text"))).distinct()
    # The sentences of one document are few; of those that a corpus has, nothing is paid.
    met = first.join(F.broadcast(edited.select("s", F.lit(True).alias("hit"))), "s", "left")
    built = met.groupBy("c0").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.sum(F.when(F.col("hit"), F.col("tokens")).otherwise(0)).alias("known"))
    built = built.select(F.explode(F.filter(sizes, lambda k: k > F.col("c0"))).alias("copies"), "n", "t", "known").groupBy("copies").agg(F.sum("n").alias("chunks"), F.sum("t").alias("build_tokens"), F.sum("known").alias("known"))
    spent = F.col("every") - F.col("known")
    paid = built.crossJoin(F.broadcast(edited.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("every"))))
    return paid.select("copies", "chunks", "build_tokens", spent.alias("update_tokens"), F.round(F.try_divide("build_tokens", F.when(spent > 0, spent)), 2).alias("ratio"))


def exposition(stats: DataFrame, stale: DataFrame, costs: DataFrame, prefix: str = "loomgraph_") -> DataFrame:
    """(metric, operation, value, line): a gauge for each column of the one-row frames, counters by operation of the cost rows."""
    rows = lambda pairs: F.explode(F.array(*[F.struct(F.lit(prefix + n).alias("metric"), c.cast("double").alias("value")) for n, c in pairs])).alias("m")
    none = F.lit(None).cast("string").alias("operation")
    gauges = [df.select(none, rows([(lead + c, F.col(c)) for c in df.columns])) for lead, df in (("index_", stats), ("communities_", stale))]
    sums = costs.groupBy("operation").agg(F.count("*").alias("calls"), F.count_if("cache_hit").alias("hits"), F.sum("tokens_in").alias("i"), F.sum("tokens_out").alias("o"), F.round(F.sum("usd"), 6).alias("usd"))
    counters = sums.select("operation", rows([("calls_total", F.col("calls")), ("cache_hits_total", F.col("hits")), ("tokens_in_total", F.col("i")), ("tokens_out_total", F.col("o")), ("usd_total", F.col("usd"))]))
    every = gauges[0].unionByName(gauges[1]).unionByName(counters).select("m.metric", "operation", "m.value").filter("value is not null")
    label = F.when(F.col("operation").isNull(), "").otherwise(F.concat(F.lit('{operation="'), F.replace(F.replace("operation", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"}')))
    return every.withColumn("line", F.concat("metric", label, F.lit(" "), F.col("value").cast("string")))
