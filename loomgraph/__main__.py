"""Command line: python -m loomgraph --root PATH VERB …"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.engine import Engine
from .sources.corpus import load_corpus
from .streaming.feed import FEED


def main(args: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="loomgraph")
    top.add_argument("--root", required=True, help="folder of the index snapshots")
    verbs = top.add_subparsers(dest="verb", required=True)
    verbs.add_parser("ingest").add_argument("folder")
    verbs.add_parser("query").add_argument("question", nargs="+")
    churn = verbs.add_parser("churn")
    churn.add_argument("op", choices=("add", "update", "delete"))
    churn.add_argument("doc_id")
    churn.add_argument("--text")
    recompute = verbs.add_parser("recompute")
    recompute.add_argument("--limit", type=int)
    for name in ("stats", "staleness", "integrity", "costs", "resolutions", "documents", "communities", "compact", "drain", "clear", "reset"):
        verbs.add_parser(name)
    said = top.parse_args(args)

    spark = SparkSession.builder.appName("loomgraph").getOrCreate()
    engine = Engine(spark, said.root)
    if said.verb == "ingest":
        print(engine.apply(load_corpus(spark, said.folder)))
    elif said.verb == "churn":
        print(engine.apply(spark.createDataFrame([(0, said.op, said.doc_id, None, said.text)], FEED)))
    elif said.verb == "query":
        engine.query(spark.createDataFrame([(" ".join(said.question),)], "question string")).drop("context").show(truncate=False)
    elif said.verb == "recompute":
        print(engine.recompute(said.limit))
    elif said.verb in ("compact", "drain"):
        print(getattr(engine, said.verb)())
    elif said.verb in ("clear", "reset"):
        engine.clear_index() if said.verb == "clear" else engine.reset()
    else:
        getattr(engine, said.verb)().show(50, truncate=60)


if __name__ == "__main__":
    main()
