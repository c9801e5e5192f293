"""Ranking and retrieval for a batch of questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import cosine, node_score, normalize_name
from ..schemas import Settings
from ..session import cut
from .graph import induced_edges, khop
from .knn import scan_knn
from .linking import sparse_rows


def rank_nodes(reached: DataFrame, seed_scores: DataFrame, nodes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(qid, canonical_id, name, type, score, rank): w_seed x best seed score + w_prox / (1 + depth); ties to the smaller id."""
    best = seed_scores.groupBy("qid", "canonical_id").agg(F.max("score").alias("_seed"))
    n = nodes.select("canonical_id", "name", "type")
    scored = reached.join(best, ["qid", "canonical_id"], "left").join(n, "canonical_id").withColumn("score", node_score("_seed", "depth", settings.rank_weight_seed, settings.rank_weight_proximity))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "canonical_id")
    return scored.select("qid", "canonical_id", "name", "type", "score", F.row_number().over(w).alias("rank"))


def select_answer(questions: DataFrame, ranked: DataFrame, expected_type: Column | None = None) -> DataFrame:
    """(qid, canonical_id, answer): the best node of the expected type, or of any; null where there is none."""
    ok = ranked if expected_type is None else ranked.where(F.col("type") == expected_type)
    first = ok.groupBy("qid").agg(F.min_by(F.struct("canonical_id", "name"), "rank").alias("_a"))
    return questions.select("qid").join(first, "qid", "left").select("qid", F.col("_a.canonical_id").alias("canonical_id"), F.col("_a.name").alias("answer"))


def rank_sentences(queries: DataFrame, sentences: DataFrame, k: int) -> DataFrame:
    """Re-rank (qid, document_id, sentence_index, vector) rows by cosine to the question's vector."""
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "document_id", "sentence_index")
    s = sentences.join(queries.select("qid", F.col("vector").alias("_q")), "qid").where("vector IS NOT NULL").withColumn("score", cosine("vector", "_q"))
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_q")


def endpoints(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, first, second): the two nodes (qid, canonical_id, name) that share most words with the question, in question order."""
    q = questions.select("qid", F.split(normalize_name("question"), " ").alias("_q"))
    n = nodes.select("qid", "canonical_id", "name", F.array_distinct(F.split(normalize_name("name"), " ")).alias("_w")).distinct()
    met = n.join(q, "qid").withColumn("_o", F.size(F.array_intersect("_w", "_q"))).where("_o > 0")
    w = Window.partitionBy("qid").orderBy(F.col("_o").desc(), "name", "canonical_id")
    top = met.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    at = F.array_min(F.filter(F.transform("_w", lambda x: F.array_position("_q", x)), lambda p: p > 0))
    pair = top.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("p"), "_r", "canonical_id"))), lambda x: x["canonical_id"]).alias("_e"))
    return pair.select("qid", F.try_element_at("_e", F.lit(1)).alias("first"), F.try_element_at("_e", F.lit(2)).alias("second"))


@dataclass(frozen=True)
class Retrieved:
    """The lazy tables of one batch."""

    seeds: DataFrame
    sentences: DataFrame
    edges: DataFrame
    subgraph_nodes: DataFrame
    subgraph_edges: DataFrame
    ranked: DataFrame
    answers: DataFrame


def retrieve(questions: DataFrame, entities: DataFrame, nodes: DataFrame, edges: DataFrame, sentences: DataFrame, settings: Settings = Settings()) -> Retrieved:
    """Seeds, supporting sentences, subgraph, ranking and answer of every question (qid, question).

    ``entities`` (canonical_id, name) are embedded by name, ``sentences`` by text. ``edges`` must
    have valid ends.
    """
    d = settings.embed_dim
    q = cut(sparse_rows(questions, ["qid"], "question", d))
    e = sparse_rows(entities.select("canonical_id", "name").distinct(), ["canonical_id"], "name", d)
    seeds = cut(scan_knn(q, e, settings.seed_top_k_entities, ["canonical_id"], d))
    s = sparse_rows(sentences.select("document_id", "sentence_index", "text"), ["document_id", "sentence_index"], "text", d)
    top = cut(scan_knn(q, s, settings.seed_top_k_sentences, ["document_id", "sentence_index"], d))
    edges = cut(edges)
    reached = cut(khop(seeds, edges, nodes, settings.khop_depth))
    ranked = rank_nodes(reached, seeds, nodes, settings)
    return Retrieved(seeds, top, edges, reached, induced_edges(reached, edges), ranked, select_answer(questions, ranked))
