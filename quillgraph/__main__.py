"""Command line: evaluate a question file, build a graph from a folder of texts, ask it a question."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.scalar import document_id
from .operators import evaluation as E
from .operators.build import build_graph
from .operators.graph import valid_edges
from .operators.harness import evaluate, metrics_table, scorecard
from .operators.retrieval import retrieve
from .schemas import SUBSETS, Settings
from .session import cut, local_session
from .sources.files import read_corpus, read_qa


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillgraph", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("evaluate", help="scores of a question file (JSON array or lines)")
    e.add_argument("questions")
    e.add_argument("--subset", choices=sorted(SUBSETS), default="small")
    e.add_argument("--limit", type=int)
    b = sub.add_parser("build", help="nodes and edges of a folder of *.md files, as parquet")
    b.add_argument("corpus")
    b.add_argument("out")
    a = sub.add_parser("ask", help="the answer to a question from a folder of *.md files")
    a.add_argument("corpus")
    a.add_argument("question")
    return p


def _built(spark: SparkSession, corpus: str, settings: Settings):
    files = read_corpus(spark, corpus)
    docs = cut(files.select(document_id(F.lit(settings.bucket), "name").alias("document_id"), "text", "ingest_order"))
    b = build_graph(docs)
    nodes = cut(b.nodes)
    return nodes, cut(valid_edges(b.edges, nodes)), cut(b.sentences)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    """Runs a command and prints what it says."""
    args, settings = parser().parse_args(argv), Settings()
    spark = spark or SparkSession.getActiveSession() or local_session(app="quillgraph")
    if args.command == "evaluate":
        run = evaluate(cut(E.subset(read_qa(spark, args.questions), args.subset, args.limit)), settings)
        said = metrics_table(run.means, run.documents.count(), subset=args.subset).first()["report"]
    else:
        nodes, edges, sentences = _built(spark, args.corpus, settings)
        if args.command == "build":
            nodes.write.mode("overwrite").parquet(f"{args.out}/nodes")
            edges.write.mode("overwrite").parquet(f"{args.out}/edges")
            said = f"nodes: {nodes.count()}\nedges: {edges.count()}"
        else:
            q = spark.createDataFrame([("q", args.question)], "qid string, question string")
            r = retrieve(q, nodes, nodes, edges, sentences, settings)
            said = scorecard(r.answers, r.ranked, r.subgraph_edges, r.sentences).first()["card"]
    print(said)
    return said


if __name__ == "__main__":
    main()
