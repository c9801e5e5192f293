"""The stores of ingestion as keyed tables: entities, nodes, documents, and the graph checkpoint of a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as T
from ..functions.scalar import normalize_name
from ..sources.files import KeyedTable
from .graph import latest, valid_edges

ENTITY_RECORD = "canonical_id string, name string, normalized_name string, type string, aliases array<string>, aliases_normalized array<string>, vector array<double>, seq bigint"
NODE_RECORD = "canonical_id string, name string, type string, aliases array<string>, seq bigint"
#: Edges are kept with their document, as one row, so that writing a document again replaces its edges.
EDGE_RECORD = "source_doc_id string, seq bigint, edges array<struct<subject_id:string,predicate:string,object_id:string,date:string,sentence_index:int,source_sentence:string,raw_predicate:string,confidence:double,char_start:int,char_end:int>>"
DOCUMENT_RECORD = T.DOCUMENTS


def entity_records(entities: DataFrame, seq: str) -> DataFrame:
    """Entities (canonical_id, name, type, aliases, vector, seq) as they are stored: last write per id, with normalised names for blocking.

    Null aliases become an empty list and null ones in it are dropped; a null vector stays null, so
    nearest neighbours skip the entity. A null id is no record.
    """
    e = latest(entities.where("canonical_id IS NOT NULL").select("canonical_id", "name", "type", "aliases", "vector", F.col(seq).cast("bigint").alias("seq")), ["canonical_id"], ["seq", "name", "type"])
    aliases = F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a.isNotNull())
    return e.select("canonical_id", "name", normalize_name("name").alias("normalized_name"), "type", aliases.alias("aliases"), F.transform(aliases, lambda a: normalize_name(a)).alias("aliases_normalized"), "vector", "seq")


def blocked(records: DataFrame, mentions: DataFrame) -> DataFrame:
    """(surface, type, canonical_id): stored entities of a mention's type of which the name or an alias has the mention's key."""
    keys = records.select("canonical_id", F.col("type").alias("_t"), F.explode(F.array_distinct(F.concat(F.array("normalized_name"), "aliases_normalized"))).alias("_k"))
    m = mentions.select("surface", "type").distinct().withColumn("_n", normalize_name("surface"))
    return m.join(keys, (m["type"] == keys["_t"]) & (m["_n"] == keys["_k"])).select("surface", "type", "canonical_id")


def node_records(links: DataFrame, documents: DataFrame) -> DataFrame:
    """(canonical_id, name, type, aliases, seq): the node as the last document wrote it, with that document's other spellings as aliases, in order.

    Dates are no nodes. A spelling with the key of the name or of an earlier alias is none.
    """
    ok = links.where("canonical_id IS NOT NULL AND document_id IS NOT NULL AND entity_type <> 'DATE' AND mention_text IS NOT NULL").join(documents.groupBy("document_id").agg(F.max("ingest_order").alias("seq")), "document_id")
    per = ok.groupBy("document_id", "canonical_id", "seq").agg(F.array_sort(F.collect_set(F.struct("entity_ord", "mention_text", "entity_type"))).alias("_x"))
    last = latest(per, ["canonical_id"], ["seq", "document_id"])
    # First spelling per key: the key's first place in the list of keys is its own.
    keys = F.transform("_x", lambda x: normalize_name(x["mention_text"]))
    firsts = F.filter(F.transform("_x", lambda x, i: F.struct(x["mention_text"].alias("t"), (F.array_position(F.col("_k"), F.element_at("_k", i + 1)) == i + 1).alias("f"), i.alias("i"))), lambda x: x["f"] & (x["i"] > 0) & (normalize_name(x["t"]) != ""))
    return last.withColumn("_k", keys).select("canonical_id", F.col("_x")[0]["mention_text"].alias("name"), F.col("_x")[0]["entity_type"].alias("type"), F.transform(firsts, lambda x: x["t"]).alias("aliases"), F.col("seq").cast("bigint").alias("seq"))


def get_documents(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """Every asked document_id once with its latest row, nulls where there is none."""
    asked = keys.select("document_id").where("document_id IS NOT NULL").distinct()
    return asked.join(latest(documents.join(asked, "document_id", "left_semi"), ["document_id"], ["ingest_order"]), "document_id", "left")


class GraphStore:
    """Nodes and edges as keyed tables under a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.nodes = KeyedTable(spark, f"{path}/nodes", ["canonical_id"], NODE_RECORD, "seq")
        self.documents = KeyedTable(spark, f"{path}/edges", ["source_doc_id"], EDGE_RECORD, "seq")

    def checkpoint(self, documents: DataFrame, nodes: DataFrame, edges: DataFrame, batch: int) -> None:
        """Write a micro-batch: its nodes overwrite, its documents' edges go and the new ones come; nodes stay.

        ``documents`` (document_id, ingest_order) are those built in the batch, also without edges. Only
        edges of the closed predicate set between nodes are kept. Under the batch's number a replay
        gives the same tables.
        """
        self.nodes.upsert(nodes, batch)
        known = self.nodes.read().select("canonical_id")
        cols = [c for c in ("subject_id", "predicate", "object_id", "date", "sentence_index", "source_sentence", "raw_predicate", "confidence", "char_start", "char_end")]
        per = valid_edges(edges, known).groupBy("source_doc_id").agg(F.collect_list(F.struct(*cols)).alias("edges"))
        done = documents.groupBy(F.col("document_id").alias("source_doc_id")).agg(F.max("ingest_order").cast("bigint").alias("seq"))
        self.documents.upsert(done.join(per, "source_doc_id", "left"), batch)

    def edges(self) -> DataFrame:
        return self.documents.read().select("source_doc_id", F.explode("edges").alias("e")).select("e.subject_id", "e.predicate", "e.object_id", "e.date", "source_doc_id", "e.sentence_index", "e.source_sentence", "e.raw_predicate", "e.confidence", "e.char_start", "e.char_end")


def create_tables(spark: SparkSession, path: str) -> dict[str, KeyedTable]:
    """The keyed tables of a deployment under a folder, empty where they do not exist; calling it again changes nothing."""
    tables = {
        "documents": KeyedTable(spark, f"{path}/documents", ["document_id"], DOCUMENT_RECORD, "ingest_order"),
        "entities": KeyedTable(spark, f"{path}/entities", ["canonical_id"], ENTITY_RECORD, "seq"),
        "nodes": KeyedTable(spark, f"{path}/nodes", ["canonical_id"], NODE_RECORD, "seq"),
        "edges": KeyedTable(spark, f"{path}/edges", ["source_doc_id"], EDGE_RECORD, "seq"),
    }
    for t in tables.values():
        if not t.parts():
            t.upsert(spark.createDataFrame([], t.schema))
    return tables


def unique(df: DataFrame, key: list[str]) -> DataFrame:
    """(key…, rows) of keys that are null or stand more than once: what a uniqueness constraint would refuse."""
    null = F.lit(False)
    for c in key:
        null = null | F.col(c).isNull()
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where(null | (F.col("rows") > 1))
