"""The graph from documents: sentences, mentions, links, nodes and co-occurrence edges in one composition."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import heuristic_mentions, heuristic_sentences
from . import graph as G
from . import linking as L


@dataclass(frozen=True)
class Built:
    """The lazy tables of a set of documents."""

    sentences: DataFrame
    mentions: DataFrame
    links: DataFrame
    nodes: DataFrame
    edges: DataFrame


def build_graph(documents: DataFrame) -> Built:
    """All stages over (document_id, text, ingest_order), one row per document_id.

    The offline chain: heuristic sentences and mentions, exact-key linking, co-occurrence edges. An
    id depends on type and name alone, so documents that are built in different batches agree on it.
    """
    sentences, mentions = heuristic_sentences(documents), heuristic_mentions(documents)
    m = mentions.join(documents.select("document_id", "ingest_order"), "document_id")
    links = L.link_set_mode(m.select("document_id", "ingest_order", F.col("mention_idx").alias("entity_ord"), F.col("text").alias("surface"), "type"))
    return Built(sentences, mentions, links, G.graph_nodes(links, documents), G.cooccurrence_edges(links, sentences))
