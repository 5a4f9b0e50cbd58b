"""The index: documents, chunks, facts, communities and answers, kept correct under change.

Every change is set-at-a-time: content-addressed chunks are compared by a full
outer join, deletion is an anti-join on chunk ids, and extraction runs for new
chunk texts only.  A commit writes the next snapshot version.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import wraps

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys, packing, rules, text, vectors
from ..operators import facts, graph, measures, placement, ranking, resolver, versions
from ..shipping import ship
from ..sources.shared import cut
from ..sources.snapshots import Conflict, Snapshots


@dataclass
class Settings:
    # The defaults.
    chunk_size: int = 400
    chunk_overlap: int = 0
    tau_sim: float = 0.86
    tau_name: float = 0.90
    candidates: int = 20
    dirty_batch: int = 8
    max_community: int = 8
    summary_entities: int = 20
    top_entities: int = 8
    top_communities: int = 3
    max_hops: int = 1
    max_context: int = 6000
    resolution: float = 1.0
    dim: int = 256
    price_in: float = 5.0
    price_out: float = 25.0
    price_embed: float = 0.02
    model: str = "rules"
    embedding: str = "hash"
    clustering: str = "louvain"
    version: str = "v1"


#: What stands for an entity in its vector.
ENTITY_TEXT = ("name", "description")

#: The bounds of what a question may ask for.
BOUNDS = {"top_entities": (1, 50), "top_communities": (0, 20), "max_hops": (0, 3)}
MODES = ("dual", "local", "global")


class Refused(ValueError):
    """A change that would lose provenance; nothing of it is committed."""


@dataclass
class Receipt:
    """What one batch of changes did."""

    noops: int = 0
    chunks_added: int = 0
    chunks_removed: int = 0
    chunks_kept: int = 0
    relations_expired: int = 0
    relations_weakened: int = 0
    entities_removed: int = 0
    entities_added: int = 0
    dirtied: list[str] = field(default_factory=list)


def _views(mention: DataFrame, support: DataFrame, identity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) derived from the facts."""
    longest = lambda: F.max_by("description", F.struct(F.length("description"), -F.col("seq")))
    rel = support.groupBy("relation_id", "source_id", "target_id", "kind").agg(F.countDistinct("chunk_id").alias("support"), F.max("weight").alias("weight"), longest().alias("description"))
    ends = rel.select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("entity_id"))
    degree = ends.groupBy("entity_id").agg(F.count("*").alias("degree"))
    ent = mention.groupBy("entity_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("mentions"), longest().alias("description"))
    return ent.join(identity, "entity_id").join(degree, "entity_id", "left").fillna(0, ["degree"]), rel


def _one_version(f):
    """A method that reads one version throughout; its commit fails if another writer has gone on from there."""

    @wraps(f)
    def run(self, *args, **kwargs):
        self.state.begin()
        try:
            return f(self, *args, **kwargs)
        finally:
            self.state.end()

    return run


class Engine:
    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None, model=None):
        self.spark, self.settings, self.state = ship(spark), settings or Settings(), Snapshots(spark, root)
        self._extract, self._embed = model or rules.MODELS[self.settings.model], vectors.EMBEDDINGS[self.settings.embedding](self.settings.dim)

    # ------------------------------------------------------------ reading
    def table(self, name: str) -> DataFrame:
        return self.state.read(name)

    def entities(self) -> DataFrame:
        ent, _ = _views(self.table("mention"), self.table("support"), self.table("identity"))
        return ent.join(self.table("membership"), "entity_id", "left")

    def relations(self) -> DataFrame:
        return _views(self.table("mention"), self.table("support"), self.table("identity"))[1]

    def document(self, doc_id: str) -> DataFrame:
        return self.table("documents").filter(F.col("doc_id") == doc_id)

    def document_by_hash(self, content: str) -> DataFrame:
        """The active document of this content with the smallest id."""
        same = F.col("content_hash") == keys.content_hash(F.lit(content))
        return self.table("documents").filter(same & (F.col("status") == "active")).orderBy("doc_id").limit(1)

    def chunks_of(self, doc_id: str) -> DataFrame:
        return self.table("chunks").filter(F.col("doc_id") == doc_id).orderBy("pos", "chunk_id")

    def entities_of(self, chunk_id: str) -> DataFrame:
        """The entities that a chunk mentions."""
        return self.entities().join(self.table("mention").filter(F.col("chunk_id") == chunk_id).select("entity_id").distinct(), "entity_id", "left_semi").orderBy("entity_id")

    def relations_of(self, entity_id: str) -> DataFrame:
        """The relations that have an entity at either end."""
        return self.relations().filter((F.col("source_id") == entity_id) | (F.col("target_id") == entity_id)).orderBy("relation_id")

    def documents(self, status: str | None = None) -> DataFrame:
        docs = self.table("documents")
        docs = docs if status is None else docs.filter(F.col("status") == status)
        n = self.table("chunks").groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
        return docs.join(n, "doc_id", "left").fillna(0, ["n_chunks"]).orderBy("doc_id")

    def stats(self) -> DataFrame:
        one = lambda df, c: df.agg(F.count("*").alias(c)).withColumn("_k", F.lit(1))
        out = one(self.table("documents").filter("status = 'active'"), "documents")
        for df, c in ((self.table("chunks"), "chunks"), (self.table("mention").select("entity_id").distinct(), "entities"), (self.relations(), "relations"), (self.table("communities"), "communities"), (self.table("communities").filter("dirty"), "dirty")):
            out = out.join(one(df, c), "_k")
        costs = self.table("costs").agg(F.coalesce(F.sum(F.col("tokens_in") + F.col("tokens_out")), F.lit(0)).alias("tokens"), F.coalesce(F.round(F.sum("usd"), 6), F.lit(0.0)).alias("usd")).withColumn("_k", F.lit(1))
        return out.join(costs, "_k").drop("_k")

    def staleness(self) -> DataFrame:
        return measures.staleness(self.table("communities").withColumn("age", F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("dirty_since")))

    def integrity(self) -> DataFrame:
        men = self.table("mention").select(F.col("entity_id").alias("name"), "chunk_id")
        sup = self.table("support").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "chunk_id")
        return measures.integrity(men, sup, self.table("chunks"))

    def costs(self) -> DataFrame:
        c = self.table("costs")
        return c.groupBy("operation").agg(F.count("*").alias("calls"), F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("tokens"), F.round(F.sum("usd"), 6).alias("usd"), F.count_if("cache_hit").alias("cache_hits"))

    def metrics(self) -> DataFrame:
        """(metric, operation, value, line): counters of the cost rows and gauges of the index, in the text form that monitoring reads."""
        return measures.exposition(self.stats(), self.staleness(), self.table("costs"))

    def resolutions(self, limit: int = 200) -> DataFrame:
        return self.table("resolutions").orderBy(F.desc("seq"), "chunk_id", "candidate", "type").limit(limit)

    def graph(self, limit: int = 300) -> DataFrame:
        rel = self.relations().select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "support")
        return graph.projection(rel, self.entities().select(F.col("entity_id").alias("name"), "degree"), limit)

    def communities(self) -> DataFrame:
        """Communities with their members and how many of them the summary does not cover; dirty ones first."""
        now = self.table("membership").groupBy("comm").agg(F.array_sort(F.collect_set("entity_id")).alias("members"))
        rows = self.table("communities").join(now, "comm", "left").withColumn("members", F.coalesce("members", F.array().cast("array<string>")))
        moved = F.array_union(F.array_except("members", "summarized"), F.array_except("summarized", "members"))
        return rows.withColumn("drifted", moved).orderBy(F.desc("dirty"), "title", "comm")

    # ------------------------------------------------------------ change
    def _chunked(self, docs: DataFrame) -> DataFrame:
        """(chunk_id, doc_id, text, pos, content_hash) of (doc_id, content)."""
        cfg = self.settings
        cut_up = docs.select("doc_id", F.posexplode(packing.pack(F.col("content"), cfg.chunk_size, cfg.chunk_overlap)).alias("pos", "text"))
        occ = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("pos")) - 1
        return cut_up.select(keys.chunk_id(F.col("doc_id"), F.col("text"), occ).alias("chunk_id"), "doc_id", "text", F.col("pos").cast("long").alias("pos"), keys.content_hash(F.col("text")).alias("content_hash"))

    def dry_run(self, changes: DataFrame) -> DataFrame:
        """(chunk_id, change) that adds and updates would make."""
        docs = versions.latest(changes).filter("op <> 'delete'").select("doc_id", "content")
        old = self.table("chunks").join(docs.select("doc_id"), "doc_id", "left_semi")
        return facts.diff_chunks(old, self._chunked(docs))

    def _extracted(self, added: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(chunks with extraction, new cache rows, cost rows); the model sees each unknown text once."""
        cfg = self.settings
        keyed = added.withColumn("cache_key", keys.extraction_key(cfg.version, cfg.model, F.col("text")))
        known = self.table("cache")
        misses = keyed.join(known, "cache_key", "left_anti").select("cache_key", "text").dropDuplicates(["cache_key"])
        fresh = cut(misses.select("cache_key", F.to_json(self._extract(F.col("text"))).alias("extraction")))
        full = keyed.join(known.unionByName(fresh), "cache_key").withColumn("x", F.from_json("extraction", rules.EXTRACTION))
        paid = keyed.join(fresh.select("cache_key"), "cache_key", "left_semi").groupBy("cache_key").agg(F.min("chunk_id").alias("payer"))
        hit = ~F.col("chunk_id").eqNullSafe(F.col("payer"))
        cost = full.join(paid, "cache_key", "left").select(text.model_tokens(F.col("text")).alias("tokens_in"), text.model_tokens(F.col("extraction")).alias("tokens_out"), hit.alias("cache_hit"), "doc_id")
        return full, fresh, cost

    def _resolved(self, found: DataFrame, identity: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(entity_id, target, similarity, name_score) merges of new entities into known or earlier ones."""
        cfg = self.settings
        new = found.join(identity.select("entity_id"), "entity_id", "left_anti")
        merges = resolver.matches(new, identity, cfg.tau_sim, cfg.tau_name, cfg.candidates)
        return new, merges

    @_one_version
    def apply(self, changes: DataFrame) -> Receipt:
        """Apply a feed (seq, op, doc_id, uri, content): the last change of each document counts."""
        cfg, receipt = self.settings, Receipt()
        judged = cut(versions.mark_noops(versions.latest(changes), self.table("documents")))
        receipt.noops = judged.filter("noop").count()
        live = judged.filter("not noop")
        if live.isEmpty():
            return receipt
        puts, drops = live.filter("op <> 'delete'"), live.filter("op = 'delete'")

        old = self.table("chunks")
        old_of = old.join(live.select("doc_id"), "doc_id", "left_semi")
        new = cut(self._chunked(puts.select("doc_id", "content")))
        diff = cut(facts.diff_chunks(old_of, new))
        counts = {r.change: r.n for r in diff.groupBy("change").agg(F.count("*").alias("n")).collect()}
        receipt.chunks_added, receipt.chunks_removed = counts.get("added", 0), counts.get("removed", 0)
        receipt.chunks_kept = counts.get("kept", 0) + counts.get("moved", 0)
        removed = diff.filter("change = 'removed'").select("chunk_id")
        added = cut(new.join(diff.filter("change = 'added'"), "chunk_id", "left_semi").withColumn("embedding", self._embed("text")))

        mention, support, identity = self.table("mention"), self.table("support"), self.table("identity")
        lost = mention.join(removed, "chunk_id", "left_semi").select("entity_id")
        mention_left, support_left = mention.join(removed, "chunk_id", "left_anti"), support.join(removed, "chunk_id", "left_anti")

        extracted, fresh, cost = self._extracted(added)
        top_seq = (mention.agg(F.max("seq")).first()[0] or 0) + 1
        raw = extracted.select("chunk_id", "doc_id", "pos", F.posexplode("x.entities").alias("at", "e"))
        found_all = raw.select("chunk_id", keys.entity_key(F.col("e.name"), F.col("e.type")).alias("entity_id"), F.lower("e.name").alias("low"), F.col("e.name").alias("name"), F.col("e.type").alias("type"), F.col("e.description").alias("description"), F.struct("doc_id", "pos", "at").alias("o"))
        found_all = cut(found_all)
        found = found_all.groupBy("entity_id").agg(*[F.min_by(c, "o").alias(c) for c in ("name", "type", "description")], F.min("o")["doc_id"].alias("doc_id"))
        found = cut(found.withColumn("embedding", self._embed(F.concat_ws(". ", *ENTITY_TEXT))))
        fresh_entities, merges = self._resolved(found, identity)
        target = F.coalesce("target", "entity_id")
        placed = cut(found_all.join(merges.select("entity_id", "target"), "entity_id", "left").withColumn("final", target))

        seq = F.lit(top_seq) + F.xxhash64("chunk_id", "final").bitwiseAND(F.lit((1 << 40) - 1))
        new_mentions = placed.groupBy("final", "chunk_id").agg(F.min_by("description", "o").alias("description")).select(F.col("final").alias("entity_id"), "chunk_id", "description", seq.alias("seq"))
        ends = placed.select("chunk_id", "low", "final").dropDuplicates(["chunk_id", "low"])
        stated = extracted.select("chunk_id", F.posexplode("x.relations").alias("at", "r"))
        joined = stated.withColumn("low", F.lower("r.source")).join(ends.withColumnRenamed("final", "source_id"), ["chunk_id", "low"]).withColumn("low", F.lower("r.target")).join(ends.withColumnRenamed("final", "target_id"), ["chunk_id", "low"]).filter("source_id <> target_id")
        new_support = joined.select(keys.relation_key(F.col("source_id"), F.col("target_id"), F.col("r.kind")).alias("relation_id"), "source_id", "target_id", F.col("r.kind").alias("kind"), "chunk_id", F.col("r.description").alias("description"), F.lit(1.0).alias("weight"), (F.lit(top_seq) + F.col("at")).alias("seq"))
        new_support = new_support.dropDuplicates(["relation_id", "chunk_id"])

        mention_now = cut(mention_left.unionByName(new_mentions))
        alive = mention_now.select("entity_id").distinct()
        support_now = support_left.unionByName(new_support)
        for end in ("source_id", "target_id"):
            support_now = support_now.join(alive.withColumnRenamed("entity_id", end), end, "left_semi")
        support_now = cut(support_now)
        created = fresh_entities.join(merges.select("entity_id"), "entity_id", "left_anti")
        surface = placed.filter("final <> entity_id").groupBy(F.col("final").alias("entity_id")).agg(F.collect_set("name").alias("more"))
        identity_now = identity.join(alive, "entity_id", "left_semi").unionByName(created.select("entity_id", "name", "type", "embedding", F.array().cast("array<string>").alias("aliases")))
        identity_now = cut(identity_now.join(surface, "entity_id", "left").withColumn("aliases", F.array_sort(F.array_union("aliases", F.coalesce("more", F.array().cast("array<string>"))))).drop("more"))

        before = support.groupBy("relation_id").agg(F.countDistinct("chunk_id").alias("b"))
        after = support_now.groupBy("relation_id").agg(F.countDistinct("chunk_id").alias("a"))
        fate = before.join(after, "relation_id", "left").agg(F.count_if(F.col("a").isNull()).alias("gone"), F.count_if(F.col("a") < F.col("b")).alias("weaker")).first()
        receipt.relations_expired, receipt.relations_weakened = fate.gone, fate.weaker
        receipt.entities_removed = mention.select("entity_id").distinct().join(alive, "entity_id", "left_anti").count()
        receipt.entities_added = alive.join(mention.select("entity_id").distinct(), "entity_id", "left_anti").count()

        # Placement of entities without a community, then the communities that this batch touched.
        membership = cut(self.table("membership").join(alive, "entity_id", "left_semi"))
        homeless = alive.join(membership, "entity_id", "left_anti").withColumnRenamed("entity_id", "name")
        _, rel = _views(mention_now, support_now, identity_now)
        both = facts.both_ways(rel.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "support", "weight"))
        joined_now = placement.place_all(homeless, cut(both), cut(membership.withColumnRenamed("entity_id", "name")), cfg.max_community)
        touched = cut(lost.union(new_mentions.select("entity_id")).distinct())
        old_home = self.table("membership")
        membership_now = cut(membership.unionByName(joined_now.select(F.col("name").alias("entity_id"), "comm")))
        dirtied = old_home.unionByName(membership_now).join(touched, "entity_id", "left_semi").select("comm").distinct()
        communities = self._marked(membership_now, identity_now, dirtied)
        was = {r.comm for r in self.table("communities").filter("dirty").select("comm").collect()}
        receipt.dirtied = sorted(r.comm for r in communities.filter("dirty").select("comm").collect() if r.comm not in was)

        stamp = F.current_timestamp()
        docs = self.table("documents")
        bumped = puts.join(docs.select("doc_id", F.col("version").alias("v"), F.col("ingested_at").alias("first")), "doc_id", "left")
        put_rows = bumped.select("doc_id", F.coalesce("uri", F.concat("doc_id", F.lit(".md"))).alias("uri"), keys.content_hash(F.col("content")).alias("content_hash"), (F.coalesce("v", F.lit(0)) + 1).cast("long").alias("version"), F.lit("active").alias("status"), F.col("content").alias("text"), F.coalesce("first", stamp).alias("ingested_at"), stamp.alias("updated_at"))
        gone = docs.join(drops.select("doc_id"), "doc_id", "left_semi").withColumns({"status": F.lit("deleted"), "text": F.lit(""), "updated_at": stamp})
        placed_new = new.select("chunk_id", F.col("pos").alias("p"))
        kept = old.join(removed, "chunk_id", "left_anti").join(placed_new, "chunk_id", "left").withColumn("pos", F.coalesce("p", "pos")).drop("p")
        decisions = self._decisions(placed, merges, identity)
        embedded = added.select("doc_id", "text").unionByName(found.select("doc_id", F.concat_ws(". ", *ENTITY_TEXT).alias("text")))
        self.state.commit(
            {
                "documents": versions.replace_rows(docs, put_rows.unionByName(gone), ["doc_id"]),
                "chunks": kept.unionByName(added.select(*kept.columns)),
                "identity": identity_now,
                "mention": mention_now,
                "support": support_now,
                "membership": membership_now,
                "communities": communities,
            },
            added={"cache": fresh, "resolutions": decisions, "costs": self._priced(cost, "extract").unionByName(self._embedded(embedded, "doc_id"))},
        )
        return receipt

    def _priced(self, cost: DataFrame, operation: str) -> DataFrame:
        """Cost rows of (tokens_in, tokens_out, cache_hit, …): a hit costs nothing, embeddings have a price of their own."""
        cfg = self.settings
        price_in, price_out = (cfg.price_embed, 0.0) if operation == "embed" else (cfg.price_in, cfg.price_out)
        usd = F.when(F.col("cache_hit"), 0.0).otherwise((F.col("tokens_in") * price_in + F.col("tokens_out") * price_out) / 1e6)
        blank = [F.lit(None).cast("string").alias(c) for c in ("doc_id", "comm") if c not in cost.columns]
        zero = lambda c: F.when(F.col("cache_hit"), F.lit(0)).otherwise(F.col(c)).cast("long").alias(c)
        return cost.select("*", *blank).select(F.lit(self.state.version() + 1).cast("long").alias("seq"), F.lit(operation).alias("operation"), zero("tokens_in"), zero("tokens_out"), usd.alias("usd"), "cache_hit", "doc_id", "comm")

    def _embedded(self, texts: DataFrame, by: str) -> DataFrame:
        """Cost rows of embedding ``texts`` (``by``, text), one for each document or community."""
        each = texts.groupBy(by).agg(F.sum(text.model_tokens(F.col("text"))).alias("tokens_in"))
        return self._priced(each.withColumns({"tokens_out": F.lit(0), "cache_hit": F.lit(False)}), "embed")

    def _charge(self, answers: DataFrame) -> None:
        """Commit the cost of ``answers`` (question, answer, context); other writers may go first."""
        answered = answers.select(text.model_tokens(F.concat_ws("\n", "question", "context")).alias("tokens_in"), text.model_tokens(F.col("answer")).alias("tokens_out"), F.lit(False).alias("cache_hit"))
        asked = answers.select(F.lit(None).cast("string").alias("doc_id"), F.col("question").alias("text"))
        for _ in range(20):
            try:
                self.state.commit({}, added={"costs": self._priced(answered, "answer").unionByName(self._embedded(asked, "doc_id"))})
                return
            except Conflict:
                continue
        raise Conflict("other writers went first 20 times")

    def _decisions(self, placed: DataFrame, merges: DataFrame, identity: DataFrame) -> DataFrame:
        known = identity.select("entity_id", F.lit(True).alias("known"))
        first = placed.join(known, "entity_id", "left").join(merges.drop("target"), "entity_id", "left")
        rank = F.row_number().over(Window.partitionBy("entity_id").orderBy("o"))
        rows = first.withColumn("rank", rank)
        exact = F.col("known").isNotNull() | (F.col("rank") > 1)
        fuzzy = F.col("similarity").isNotNull()
        decision = F.when(exact | fuzzy, "merge").otherwise("create")
        reason = F.when(exact & ~fuzzy, "same key").when(fuzzy, "cosine and name over both thresholds").otherwise("no candidate over both thresholds")
        return rows.select(F.lit(self.state.version() + 1).cast("long").alias("seq"), F.col("name").alias("candidate"), "type", decision.alias("decision"), F.when(exact | fuzzy, F.col("final")).alias("matched"), F.coalesce("similarity", F.when(exact, 1.0).otherwise(0.0)).alias("similarity"), F.coalesce("name_score", F.when(exact, 1.0).otherwise(0.0)).alias("name_score"), reason.alias("reason"), "chunk_id")

    def _marked(self, membership: DataFrame, identity: DataFrame, dirtied: DataFrame) -> DataFrame:
        """Communities that have members: known ones, and new ones titled by their smallest entity; touched ones dirty."""
        live = membership.join(identity.select("entity_id", "name"), "entity_id").groupBy("comm").agg(F.min_by("name", "entity_id").alias("first"), F.array_sort(F.collect_set("entity_id")).alias("members"))
        none = F.array().cast("array<string>")
        joined = live.join(self.table("communities"), "comm", "left").join(dirtied.withColumn("hit", F.lit(True)), "comm", "left")
        newly = F.col("hit").isNotNull() | F.col("dirty").isNull()
        rows = joined.select("comm", F.coalesce("level", F.lit(0)).cast("long").alias("level"), F.coalesce("title", "first").alias("title"), F.coalesce("summary", F.lit("")).alias("summary"), "summary_hash", (F.coalesce("dirty", F.lit(False)) | newly).alias("dirty"), F.coalesce("dirty_seq", F.lit(0)).cast("long").alias("dirty_seq"), F.when(F.coalesce("dirty", F.lit(False)), F.col("dirty_since")).when(newly, F.current_timestamp()).alias("dirty_since"), F.coalesce("summarized", none).alias("summarized"), "embedding")
        return cut(graph.mark_dirty(cut(rows), F.col("dirty"), "comm"))

    # ------------------------------------------------------------ single entities
    @_one_version
    def detach(self, pairs: DataFrame) -> int:
        """Take back the mentions (entity_id, chunk_id); entities may be left without any until ``remove_entities``."""
        gone = cut(self.table("mention").join(pairs.select("entity_id", "chunk_id").distinct(), ["entity_id", "chunk_id"], "left_semi"))
        if gone.isEmpty():
            return 0
        self._changed(gone.select("entity_id"), {"mention": self.table("mention").join(gone.select("entity_id", "chunk_id"), ["entity_id", "chunk_id"], "left_anti")})
        return gone.count()

    def orphans(self) -> DataFrame:
        """Entities that no chunk mentions."""
        return self.table("identity").join(self.table("mention"), "entity_id", "left_anti")

    @_one_version
    def update_entities(self, changes: DataFrame) -> int:
        """Other names and types (entity_id, name, type) of known entities; null leaves a field.

        Unknown ids are passed over; of several rows of one id the greatest value of a field counts.
        """
        wanted = changes.groupBy("entity_id").agg(F.max("name").alias("n"), F.max("type").alias("t")).filter("n is not null or t is not null")
        known = cut(wanted.join(self.table("identity").select("entity_id"), "entity_id", "left_semi"))
        if known.isEmpty():
            return 0
        rows = self.table("identity").join(known, "entity_id", "left").withColumns({"name": F.coalesce("n", "name"), "type": F.coalesce("t", "type")}).drop("n", "t")
        self._changed(known.select("entity_id"), {"identity": rows})
        return known.count()

    @_one_version
    def remove_entities(self, ids: DataFrame) -> int:
        """Remove entities (entity_id) with their relations; ``Refused``, and nothing removed, if a chunk still mentions one.

        The check is a part of the rows that the commit writes, so a bad change fails before its version exists.
        """
        known = cut(ids.select("entity_id").distinct().join(self.table("identity").select("entity_id"), "entity_id", "left_semi"))
        if known.isEmpty():
            return 0
        identity, support = self.table("identity"), self.table("support")
        held = self.table("mention").join(known, "entity_id", "left_semi").groupBy("entity_id").agg(F.count("*").alias("n"))
        complaint = F.raise_error(F.concat(F.lit("entity "), "entity_id", F.lit(" is still mentioned by "), "n", F.lit(" chunks")))
        refused = held.select(complaint.cast("string").alias("entity_id"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in identity.schema if f.name != "entity_id"])
        for end in ("source_id", "target_id"):
            support = support.join(known.withColumnRenamed("entity_id", end), end, "left_anti")
        tables = {"identity": identity.join(known, "entity_id", "left_anti").unionByName(refused), "support": support}
        try:
            self._changed(known, tables, self.table("membership").join(known, "entity_id", "left_anti"))
        except PySparkException as e:
            if "is still mentioned by" not in str(e):
                raise
            raise Refused(str(e).split("\n")[0]) from e
        return known.count()

    def _changed(self, entities: DataFrame, tables: dict[str, DataFrame], membership: DataFrame | None = None) -> None:
        """Commit ``tables`` and mark the communities of ``entities`` dirty."""
        touched = self.table("membership").join(entities.distinct(), "entity_id", "left_semi").select("comm").distinct()
        tables = tables | ({} if membership is None else {"membership": membership})
        names = self.table("identity")
        self.state.commit(tables | {"communities": self._marked(self.table("membership") if membership is None else membership, names, touched)})

    def recompute(self, limit: int | None = None) -> int:
        """Summaries of the oldest dirty communities: the batch size by default, 0 for none; returns how many."""
        limit = self.settings.dirty_batch if limit is None else limit
        if limit == 0:
            return 0
        return self._summarise(graph.dirty_batch(self.table("communities"), limit))

    def drain(self, max_batches: int | None = None) -> int:
        """Summaries of all dirty communities, or of as many batches; returns how many."""
        limit = None if max_batches is None else max_batches * self.settings.dirty_batch
        return 0 if limit == 0 else self._summarise(graph.dirty_batch(self.table("communities"), limit))

    @_one_version
    def _summarise(self, batch: DataFrame) -> int:
        cfg = self.settings
        batch = cut(batch.select("comm"))
        if batch.isEmpty():
            return 0
        members = self.entities().join(batch, "comm", "left_semi")
        order = F.row_number().over(Window.partitionBy("comm").orderBy(F.desc("degree"), "name", "entity_id"))
        kept = cut(members.withColumn("rank", order).filter(F.col("rank") <= cfg.summary_entities))
        line = F.concat(F.col("name"), F.lit(" ("), F.col("type"), F.lit(")"), F.when(F.col("description") != "", F.concat(F.lit(": "), F.substring("description", 1, 160))).otherwise(""))
        ents = kept.groupBy("comm").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"]).alias("entities"))
        ends = kept.select("entity_id", "name", "comm")
        inner = self.relations().join(ends.withColumnsRenamed({"entity_id": "source_id", "name": "a"}), "source_id").join(ends.withColumnsRenamed({"entity_id": "target_id", "name": "b"}), ["target_id", "comm"])
        rels = inner.groupBy("comm").agg(F.transform(F.array_sort(F.collect_list(F.struct("relation_id", F.concat("a", F.lit(" --"), "kind", F.lit("--> "), "b").alias("line")))), lambda s: s["line"]).alias("relations"))
        every = members.groupBy("comm").agg(F.array_sort(F.collect_set("entity_id")).alias("covered"))

        made = ents.join(rels, "comm", "left").join(every, "comm").withColumn("s", rules.summarise(F.col("entities"), F.col("relations")))
        made = cut(made.select("comm", "covered", F.col("s.title").alias("t"), F.col("s.summary").alias("y"), F.concat_ws("\n", "entities", "relations").alias("prompt")).withColumn("vec", self._embed(F.concat_ws("\n", "t", "y"))))
        base = self.table("communities").join(made, "comm", "left")
        done = F.col("t").isNotNull()
        pick = lambda new, old: F.when(done, new).otherwise(F.col(old)).alias(old)
        rows = base.select("comm", "level", pick(F.col("t"), "title"), pick(F.col("y"), "summary"), pick(keys.summary_hash(F.col("t"), F.col("y")), "summary_hash"), pick(F.lit(False), "dirty"), pick(F.lit(0).cast("long"), "dirty_seq"), pick(F.lit(None).cast("timestamp"), "dirty_since"), pick(F.col("covered"), "summarized"), pick(F.col("vec"), "embedding"))
        cost = made.select("comm", text.model_tokens(F.col("prompt")).alias("tokens_in"), text.model_tokens(F.col("y")).alias("tokens_out"), F.lit(False).alias("cache_hit"))
        n = made.count()
        vectors_cost = self._embedded(made.select("comm", F.concat_ws("\n", "t", "y").alias("text")), "comm")
        self.state.commit({"communities": rows}, added={"costs": self._priced(cost, "summarise").unionByName(vectors_cost)})
        return n

    @_one_version
    def compact(self) -> dict[str, int]:
        """Cluster all entities again and keep the identity of communities that overlap most."""
        rel = self.relations()
        weight = F.when(F.col("weight") * F.col("support") == 0, 1.0).otherwise(F.col("weight") * F.col("support"))
        edges = rel.select(F.col("source_id").alias("u"), F.col("target_id").alias("v"), weight.alias("w"))
        old = self.table("membership")
        clusters = graph.CLUSTERINGS[self.settings.clustering](edges, self.settings.resolution).withColumnsRenamed({"node": "name", "community": "new"})
        alone = self.table("mention").select(F.col("entity_id").alias("name")).distinct().join(clusters.select("name"), "name", "left_anti")
        clusters = cut(clusters.unionByName(alone.withColumn("new", F.col("name"))))
        matrix = graph.overlap(old.select(F.col("entity_id").alias("name"), F.col("comm").alias("old")), clusters)
        matched = graph.match_communities(matrix)
        comm = F.coalesce("old", keys.community_key(F.concat(F.lit("compact:"), F.col("new"))))
        membership = cut(clusters.join(matched, "new", "left").select(F.col("name").alias("entity_id"), comm.alias("comm")))
        moved = membership.join(old.withColumnRenamed("comm", "was"), "entity_id", "left").filter("was is null or was <> comm").count()
        now = membership.groupBy("comm").agg(F.array_sort(F.collect_set("entity_id")).alias("members"))
        changed = now.join(self.table("communities").select("comm", "summarized"), "comm", "left").filter("summarized is null or members <> summarized").select("comm")
        rows = self._marked(membership, self.table("identity"), changed)
        before, after = self.table("communities").count(), rows.count()
        self.state.commit({"membership": membership, "communities": rows})
        return {"before": before, "after": after, "moved": moved}

    # ------------------------------------------------------------ questions
    def query(self, questions: DataFrame, mode: str = "dual", metered: bool = True, **limits: int) -> DataFrame:
        """(question, answer, citations, stale_communities, context) of each question, all in one plan.

        ``limits`` are ``top_entities``, ``top_communities`` and ``max_hops`` within ``BOUNDS``,
        by default those of the settings; others, and other modes, raise ``ValueError``.
        What the answers cost is committed, unless not ``metered``.
        """
        if mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        for name, value in limits.items():
            low, high = BOUNDS.get(name, (0, -1))
            if not isinstance(value, int) or not low <= value <= high:
                raise ValueError(f"{name}: {value!r} is not within {BOUNDS}")
        answers = cut(self._answered(questions, mode, replace(self.settings, **limits)))
        if metered and not answers.isEmpty():
            self._charge(answers)
        return answers

    @_one_version
    def _answered(self, questions: DataFrame, mode: str, cfg: Settings) -> DataFrame:
        asked = cut(questions.select("question").distinct().withColumn("qe", self._embed("question")))
        ask = asked.select(F.col("question").alias("q"), "qe")
        lines = []
        stale = None
        if mode in ("dual", "global"):
            com = self.table("communities").filter("summary <> ''")
            top = ranking.top_k(ask, com.select(F.col("comm").alias("vec_id"), "embedding"), cfg.top_communities, others_only=False)
            hit = top.join(com.select(F.col("comm").alias("vec_id"), "title", "summary", "dirty"), "vec_id")
            stale = hit.groupBy("q").agg(F.count_if("dirty").alias("stale"))
            shown = F.concat(F.lit("- "), F.col("title"), F.when(F.col("dirty"), " [STALE]").otherwise(""), F.lit(": "), text.flat(F.col("summary")))
            lines.append(hit.select("q", F.lit(0).alias("section"), F.col("rn"), shown.alias("line"), F.lit(None).cast("string").alias("chunk_id")))
        if mode in ("dual", "local"):
            ent = cut(self.entities().select("entity_id", "name", "type", "description", "mentions", "embedding"))
            rel = cut(self.relations())
            seeds = ranking.top_k(ask, ent.select(F.col("entity_id").alias("vec_id"), "embedding"), cfg.top_entities, others_only=False)
            near = facts.both_ways(rel.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "support", "kind", "relation_id"))
            known = seeds.select("q", F.col("vec_id").alias("name"), "score", F.lit(0).alias("hop"))
            for hop in range(1, cfg.max_hops + 1):
                gain = F.col("score") * (0.5**hop) * F.least(F.lit(1.0), F.col("support") / 2)
                reached = near.join(known.filter(F.col("hop") == hop - 1), "name").groupBy("q", F.col("other").alias("name")).agg(F.max(gain).alias("score")).withColumn("hop", F.lit(hop))
                known = known.unionByName(reached).groupBy("q", "name").agg(F.max("score").alias("score"), F.min("hop").alias("hop"))
            order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("score", 5)), "name"))
            got = cut(known.withColumn("rank", order).filter(F.col("rank") <= 2 * cfg.top_entities).withColumnRenamed("name", "entity_id").join(ent.drop("embedding"), "entity_id"))
            names = ent.select(F.col("entity_id").alias("other"), F.col("name").alias("other_name"))
            edges = near.withColumnRenamed("name", "entity_id").join(names, "other").groupBy("entity_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("relation_id", F.concat("kind", F.lit(" -> "), "other_name").alias("s")))), lambda s: s["s"]), 1, 6).alias("edges"))
            shown = F.concat(F.lit("- "), F.col("name"), F.lit(" ("), F.col("type"), F.lit("): "), text.flat(F.col("description")), F.when(F.size("edges") > 0, F.concat(F.lit(" [relations: "), F.array_join("edges", "; "), F.lit("]"))).otherwise(""))
            listed = got.join(edges, "entity_id", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<string>")))
            lines.append(listed.select("q", F.lit(1).alias("section"), F.col("rank").cast("long").alias("rn"), shown.alias("line"), F.lit(None).cast("string").alias("chunk_id")))
            cited = got.select("q", F.explode("mentions").alias("chunk_id"), F.greatest("score", F.lit(0.0)).alias("score")).groupBy("q", "chunk_id").agg(F.count("*").alias("hits"), F.sum("score").alias("weight"))
            place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("hits"), F.desc("weight"), "chunk_id"))
            passages = cited.withColumn("rn", place.cast("long")).join(self.table("chunks").select("chunk_id", "text"), "chunk_id")
            lines.append(passages.select("q", F.lit(2).alias("section"), "rn", F.concat(F.lit("- ["), "chunk_id", F.lit("] "), text.flat(F.col("text"))).alias("line"), "chunk_id"))
        every = lines[0]
        for more in lines[1:]:
            every = every.unionByName(more)
        kept = cut(ranking.within_budget(every, "q", ["section", "rn"], cfg.max_context))
        docs = kept.filter("chunk_id is not null").join(self.table("chunks").select("chunk_id", "doc_id"), "chunk_id", "left").groupBy("q", F.coalesce("doc_id", "chunk_id").alias("doc")).agg(F.min("rn").alias("rn"))
        citations = docs.groupBy("q").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rn", "doc"))), lambda s: s["doc"]), 1, 10).alias("citations"))
        context = kept.groupBy("q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "rn", "line"))), lambda s: s["line"]), "\n").alias("context"))

        out = asked.select(F.col("question").alias("q")).join(context, "q", "left").join(citations, "q", "left")
        if stale is not None:
            out = out.join(stale, "q", "left")
        else:
            out = out.withColumn("stale", F.lit(0).cast("long"))
        return out.select(F.col("q").alias("question"), rules.answer(F.col("q"), F.col("context")).alias("answer"), "citations", F.coalesce("stale", F.lit(0)).alias("stale_communities"), "context")

    # ------------------------------------------------------------ reset
    def clear_index(self) -> None:
        """Empty everything but the meter and the extraction cache."""
        self.state.clear(keep=("costs", "cache"))

    def reset(self) -> None:
        self.state.clear()
