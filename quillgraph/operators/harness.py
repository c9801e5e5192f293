"""The evaluation harness: ingest the context of the questions once, answer them from that graph, score answers and evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import document_id, object_key_slug
from ..schemas import Settings
from ..session import cut
from . import evaluation as E
from .build import build_graph
from .graph import valid_edges
from .retrieval import retrieve

METRICS = ("em", "token_f1", "sf_precision", "sf_recall", "sf_f1")


def corpus_of(qa: DataFrame, bucket: str) -> DataFrame:
    """(document_id, bucket, object_key, title, text, ingest_order) of the context paragraphs, each object key once.

    The first paragraph of a key, in the order of question ids and places, gives text and title; its
    sentences are joined by blanks. ``ingest_order`` is that pair, which sorts as the paragraphs do.
    Null ids, titles and paragraphs are left out; null sentences are skipped.
    """
    rows = qa.where("id IS NOT NULL").select("id", F.posexplode("context").alias("p", "c")).where("c.title IS NOT NULL")
    keyed = rows.select(F.struct("id", "p").alias("ingest_order"), object_key_slug("c.title").alias("object_key"), F.col("c.title").alias("title"), F.array_join(F.coalesce("c.sentences", F.array().cast("array<string>")), " ").alias("text"))
    first = keyed.groupBy("object_key").agg(F.min_by(F.struct("ingest_order", "title", "text"), "ingest_order").alias("f"))
    return first.select(document_id(F.lit(bucket), "object_key").alias("document_id"), F.lit(bucket).alias("bucket"), "object_key", "f.title", "f.text", "f.ingest_order")


def sentence_facts(found: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, title, idx) of retrieved sentences (qid, document_id, sentence_index), by the title of their document; others are skipped."""
    titles = documents.select("document_id", "title").distinct()
    return found.join(titles, "document_id").select(F.col("qid").alias("id"), "title", F.col("sentence_index").alias("idx"))


@dataclass(frozen=True)
class Evaluated:
    """What a run gives: the corpus, its graph, a row per question, and the means."""

    documents: DataFrame
    nodes: DataFrame
    edges: DataFrame
    scores: DataFrame
    means: DataFrame


def score_answers(qa: DataFrame, answers: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, prediction, em, token_f1, sf_precision, sf_recall, sf_f1) for every question (id, answer, answer_aliases, supporting_facts)."""
    gold = qa.select("id", F.explode("supporting_facts").alias("f")).select("id", "f.title", "f.idx")
    p = qa.select("id", E.golds().alias("_g")).join(answers.select(F.col("qid").alias("id"), F.col("answer").alias("prediction")), "id", "left")
    scored = p.select("id", "prediction", *[F.coalesce(f(F.col("prediction"), F.col("_g")), F.lit(0.0)).alias(name) for name, f in (("em", E.exact_match), ("token_f1", E.token_f1))])
    sf = E.supporting_facts(facts, gold)
    return scored.join(sf, "id", "left").select("id", "prediction", "em", "token_f1", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in METRICS[2:]])


def evaluate(qa: DataFrame, settings: Settings = Settings()) -> Evaluated:
    """Documents, graph, scores and means of an evaluation set, offline: heuristic mentions, linking by name, co-occurrence edges."""
    documents = cut(corpus_of(qa, settings.bucket))
    built = build_graph(documents)
    nodes, sentences = cut(built.nodes), cut(built.sentences)
    edges = cut(valid_edges(built.edges, nodes))
    r = retrieve(qa.select(F.col("id").alias("qid"), "question"), nodes, nodes, edges, sentences, settings)
    scores = cut(score_answers(qa, r.answers, sentence_facts(r.sentences, documents)))
    return Evaluated(documents, nodes, edges, scores, E.mean_metrics(scores, list(METRICS)))


def metrics_table(means: DataFrame, documents: int, calls: int = 0, subset: str = "full") -> DataFrame:
    """One row (report) with the means as lines of text; no scores give zeros."""
    one = means.agg(F.coalesce(F.max("questions"), F.lit(0)).alias("questions"), *[F.coalesce(F.max(m), F.lit(0.0)).alias(m) for m in METRICS])
    line = lambda name, c: F.concat(F.lit(name + ": "), c)
    head = [line("subset", F.lit(subset)), line("questions", F.col("questions").cast("string")), line("documents", F.lit(str(documents))), line("calls", F.lit(str(calls)))]
    return one.select(F.concat_ws("\n", *head, *[line(m, F.format_string("%.4f", F.col(m))) for m in METRICS]).alias("report"))


def scorecard(answers: DataFrame, ranked: DataFrame, edges: DataFrame, sentences: DataFrame, k: int = 5) -> DataFrame:
    """(qid, card): per question the answer, its ``k`` best nodes, the number of edges, and its sentences with their place, as lines of text."""
    top = ranked.where(F.col("rank") <= k).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name", "score"))), lambda x: F.format_string("%d. %s %.4f", x["rank"], x["name"], x["score"])).alias("_n"))
    n = edges.groupBy("qid").agg(F.count(F.lit(1)).alias("_e"))
    s = sentences.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "document_id", "sentence_index"))), lambda x: F.format_string("%s#%d", x["document_id"], x["sentence_index"])).alias("_s"))
    none = F.array().cast("array<string>")
    body = F.concat_ws("\n", F.concat(F.lit("answer: "), F.coalesce("answer", F.lit("(none)"))), F.coalesce("_n", none), F.concat(F.lit("edges: "), F.coalesce("_e", F.lit(0)).cast("string")), F.coalesce("_s", none))
    return answers.select("qid", "answer").join(top, "qid", "left").join(n, "qid", "left").join(s, "qid", "left").select("qid", body.alias("card"))
