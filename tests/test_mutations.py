"""Costs of every call, bounds of questions, and changes of single entities that are refused or dirty communities."""

import pytest
from pyspark.sql import functions as F

from loomgraph.plans.engine import Engine, Refused
from loomgraph.streaming import feed

DOCS = [
    (1, "add", "mill", None, "Ada Byron leads Silk Mill Group. Silk Mill Group acquired Loom Works in spring."),
    (2, "add", "copy", None, "Ada Byron leads Silk Mill Group. Silk Mill Group acquired Loom Works in spring."),
    (3, "add", "canal", None, "Canal Traders is based in Port Weft."),
]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("index")))
    e.apply(spark.createDataFrame(DOCS, feed.FEED))
    e.drain()
    return e


def tokens(text):
    return max(1, len(text) // 4)


def test_costs_of_every_call(spark, engine):
    rows = engine.table("costs").collect()
    paid = [r for r in rows if r.operation == "extract" and not r.cache_hit]
    # The two documents of one text: paid once, the other is a hit.
    assert sum(r.tokens_in for r in paid) == tokens(DOCS[0][4]) + tokens(DOCS[2][4])
    assert [(r.tokens_in, r.usd) for r in rows if r.operation == "extract" and r.cache_hit] == [(0, 0.0)]
    embedded = [r for r in rows if r.operation == "embed"]
    found = engine.table("identity").select("name").count()
    assert found and {r.doc_id for r in embedded} == {"mill", "copy", "canal", None}
    assert all(r.usd == pytest.approx(r.tokens_in * engine.settings.price_embed / 1e6) for r in embedded)

    before = engine.table("costs").count()
    asked = spark.createDataFrame([("Who leads Silk Mill Group?",)], "question string")
    said = engine.query(asked).first()
    new = {r.operation: r for r in engine.table("costs").filter(F.col("seq") == engine.state.version()).collect()}
    assert engine.table("costs").count() == before + 2
    assert new["embed"].tokens_in == tokens(said.question)
    assert (new["answer"].tokens_in, new["answer"].tokens_out) == (tokens(f"{said.question}\n{said.context}"), tokens(said.answer))
    engine.query(asked, metered=False)
    engine.query(asked.limit(0))
    assert engine.table("costs").count() == before + 2

    # Counters are the sums of the rows; lines read as name, label, value.
    lines = {(r.metric, r.operation): r for r in engine.metrics().collect()}
    total = engine.table("costs").filter("operation = 'embed'").agg(F.sum("tokens_in")).first()[0]
    assert lines[("loomgraph_tokens_in_total", "embed")].value == total
    assert lines[("loomgraph_index_documents", None)].line == "loomgraph_index_documents 3.0"
    assert lines[("loomgraph_calls_total", "answer")].line == 'loomgraph_calls_total{operation="answer"} 1.0'


def test_bounds_of_questions(spark, engine):
    asked = spark.createDataFrame([("Who?",)], "question string")
    for bad in ({"top_entities": 0}, {"top_entities": 51}, {"top_communities": 21}, {"max_hops": 4}, {"max_hops": -1}, {"other": 1}, {"mode": "wide"}):
        with pytest.raises(ValueError):
            engine.query(asked, **bad)
    assert engine.query(asked, metered=False, top_entities=1, top_communities=0, max_hops=0).first().stale_communities == 0


def test_an_entity_with_mentions_is_not_removed(spark, engine):
    traders = engine.table("identity").filter("name = 'Canal Traders'").select("entity_id")
    version, rows = engine.state.version(), engine.table("identity").count()
    with pytest.raises(Refused, match="is still mentioned by 1 chunks"):
        engine.remove_entities(traders)
    assert engine.state.version() == version and engine.table("identity").count() == rows

    # Without mentions it goes, with its relations, and its community is dirty.
    assert engine.staleness().first().dirty == 0
    assert engine.detach(engine.table("mention").join(traders, "entity_id", "left_semi")) == 1
    assert engine.orphans().count() == 1 and engine.staleness().first().dirty == 1
    assert engine.remove_entities(traders) == 1
    assert engine.table("identity").filter("name = 'Canal Traders'").isEmpty() and engine.orphans().isEmpty() and engine.relations().filter("kind = 'based_in'").isEmpty()
    assert engine.remove_entities(spark.createDataFrame([("nobody",), (None,)], "entity_id string")) == 0
    assert engine.detach(engine.table("mention").limit(0)) == 0


def test_other_names(spark, engine):
    engine.drain()
    key = engine.table("identity").filter("name = 'Ada Byron'").first().entity_id
    changes = spark.createDataFrame([(key, "Ada Lovelace", None), (key, None, None), ("nobody", "X", "y")], "entity_id string, name string, type string")
    assert engine.update_entities(changes) == 1
    row = engine.table("identity").filter(F.col("entity_id") == key).first()
    assert row.name == "Ada Lovelace" and row.type and engine.staleness().first().dirty == 1
    assert engine.update_entities(changes.limit(0)) == 0
