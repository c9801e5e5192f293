"""Stages that a model answers, composed: prompt, cache, port, checked JSON, relational post-processing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import map_predicates
from ..schemas import COREF_JSON, TRIPLE_JSON
from ..session import cut
from . import models as M
from .graph import document_nodes, validated_triples


@dataclass(frozen=True)
class Answered:
    """What a stage gives, the cache after it, and what could not be used: (document_id, error)."""

    rows: DataFrame
    cache: DataFrame
    dropped: DataFrame


def _answers(prompts: DataFrame, cache: DataFrame, port: M.Port, model: str, schema: str, retries: int) -> tuple[DataFrame, DataFrame]:
    """Prompts with ``value``, and the cache that has their valid answers; the port is called once per distinct missing prompt."""
    keyed = M.keyed(prompts, model)
    fresh = cut(M.call_port(M.misses(keyed, cache), port, {schema.split()[0]}, retries))
    grown = cache.select("cache_key", "text").unionByName(fresh.where("text IS NOT NULL").select("cache_key", "text"))
    said = keyed.join(grown, "cache_key", "left").join(fresh.select("cache_key", "error"), "cache_key", "left")
    return M.parsed(said, "text", schema), grown


def model_clusters(documents: DataFrame, mentions: DataFrame, cache: DataFrame, port: M.Port, model: str = "model", retries: int = 2) -> Answered:
    """(document_id, cluster_idx, canonical, members) that a model finds among the mentions of each document."""
    said, grown = _answers(M.coref_prompts(documents, mentions), cache, port, model, COREF_JSON, retries)
    rows = said.select("document_id", F.posexplode("value.clusters").alias("cluster_idx", "c")).select("document_id", "cluster_idx", "c.canonical", "c.members")
    return Answered(rows.where("canonical IS NOT NULL"), grown, said.where("value IS NULL").select("document_id", F.coalesce("error", F.lit("no JSON of the schema")).alias("error")))


def model_edges(documents: DataFrame, links: DataFrame, sentences: DataFrame, cache: DataFrame, port: M.Port, model: str = "model", retries: int = 2) -> Answered:
    """Edges that a model states between the ids of each document.

    Only triples whose ends are the document's own ids and whose sentence exists are kept; the predicate
    is mapped to the closed set, what does not map keeps its wording beside the fallback; date and
    confidence are carried. An answer that is no JSON of the schema is asked for again, then dropped.
    """
    said, grown = _answers(M.triple_prompts(documents, document_nodes(links)), cache, port, model, TRIPLE_JSON, retries)
    stated = said.select("document_id", F.explode("value.triples").alias("t")).select("document_id", "t.*")
    mapped = map_predicates(stated.withColumnRenamed("predicate", "_said"), "_said").drop("_said")
    edges = validated_triples(mapped, links, sentences).select(
        "subject_id", "predicate", "object_id", "date", F.col("document_id").alias("source_doc_id"), F.col("sentence_index").cast("int").alias("sentence_index"), "source_sentence", "raw_predicate", "confidence", "char_start", "char_end"
    )
    return Answered(edges, grown, said.where("value IS NULL").select("document_id", F.coalesce("error", F.lit("no JSON of the schema")).alias("error")))


def synthesis(questions: DataFrame, ranked: DataFrame, edges: DataFrame, sentences: DataFrame, cache: DataFrame, port: M.Port, model: str = "model") -> tuple[DataFrame, DataFrame]:
    """((qid, prose), new cache): prose from the evidence for questions with ``synthesize``; null for others and where the model fails."""
    prompts = M.keyed(M.synthesis_prompts(questions, ranked, edges, sentences), model)
    said, grown = M.complete(prompts, cache, port)
    return questions.select("qid").join(said.select("qid", F.trim("text").alias("prose")), "qid", "left"), grown
