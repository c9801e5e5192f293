"""Queries pN_... of the training-data problems, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from .cooccurrence import item_pairs
from .leaks import context_sentences, leaked
from .names import same_names, same_pairs
from .packing import containers, packing_certificate, token_counts
from .sentences import sentence_units
from .spam import page_scores
from .vectors import entity_vectors, neighbours, sentence_vectors

P5_SUPPORT, P5_LIFT = 5, 7.3


def _six(name: str) -> Column:
    """Six decimals by plain double arithmetic, which SQL engines agree on."""
    return (F.floor(F.col(name) * 1e6 + 0.5) / 1e6).alias(name)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of ids linked in at least 5 common documents with lift 7.3 or more."""
    return item_pairs(table(spark, sf_dir, "links"), "document_id", "canonical_id", P5_SUPPORT, P5_LIFT).select("id_a", "id_b")


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of linked ids with counts, lift and conviction."""
    df = item_pairs(table(spark, sf_dir, "links"), "document_id", "canonical_id")
    return df.select("id_a", "id_b", "n_ab", "n_a", "n_b", "n_records", _six("lift"), _six("conviction"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence units of every document as half-open code-point offsets."""
    return sentence_units(table(spark, sf_dir, "documents")).select("doc_id", "char_start", "char_end")


def p1_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the position of the unit in its text, and the text of the unit."""
    docs = table(spark, sf_dir, "documents")
    cut_out = F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    return sentence_units(docs).join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "sentence_index", "char_start", "char_end", cut_out.alias("text"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of entity records, and of an unresolved mention and a record, that mean the same person or organisation."""
    return same_pairs(same_names(table(spark, sf_dir, "entities"), table(spark, sf_dir, "links")))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every person and organisation record and unresolved mention with the class it belongs to."""
    return same_names(table(spark, sf_dir, "entities"), table(spark, sf_dir, "links"))


def _near(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    ents = neighbours(entity_vectors(table(spark, sf_dir, "entities")), **kw)
    sents = neighbours(sentence_vectors(table(spark, sf_dir, "document_records")), **kw)
    return ents.withColumn("collection", F.lit("entities")).unionByName(sents.withColumn("collection", F.lit("sentences")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors of which one has the other among its 5 most similar, with cosine 0.85 or more."""
    return _near(spark, sf_dir).select(F.least("key", "neighbour").alias("key_a"), F.greatest("key", "neighbour").alias("key_b")).distinct()


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar others of every vector, ranked, with their cosines, however low these are."""
    return _near(spark, sf_dir, min_cosine=None).select("collection", "key", "neighbour", "rank", _six("cosine"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of 2,048 tokens of every text, and of every piece of a text above that."""
    return containers(token_counts(table(spark, sf_dir, "documents")))


def p6_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, against the lower bound over all items, and the partitions that the bound certifies."""
    df = packing_certificate(cut(p6_containers(spark, sf_dir)))
    return df.select("items", "containers", "tokens", "lower_bound", "gap", _six("filled"), "rounds", "partitions", "certified")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a context sentence, with the items it belongs to."""
    return leaked(table(spark, sf_dir, "documents"), "doc_id", "text", context_sentences(table(spark, sf_dir, "qa")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of whose characters more than half are repeated keywords, link lists or product tags."""
    return page_scores(table(spark, sf_dir, "documents")).where("is_spam").select("doc_id")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters and spam characters of every document with text."""
    return page_scores(table(spark, sf_dir, "documents"))


QUERIES = {"p1_found": p1_found, "p1_sentences": p1_sentences, "p2_found": p2_found, "p2_classes": p2_classes, "p4_found": p4_found, "p4_neighbours": p4_neighbours, "p5_found": p5_found, "p5_pairs": p5_pairs, "p6_containers": p6_containers, "p6_certificate": p6_certificate, "p7_found": p7_found, "p8_found": p8_found, "p8_scores": p8_scores}

_P5 = """
WITH b AS (SELECT DISTINCT document_id AS r, canonical_id AS i FROM links WHERE document_id IS NOT NULL AND canonical_id IS NOT NULL),
c AS (SELECT i, count(*) AS n FROM b GROUP BY i),
t AS (SELECT count(DISTINCT r) AS n FROM b),
p AS (SELECT x.i AS id_a, y.i AS id_b, count(*) AS n_ab FROM b x JOIN b y ON x.r = y.r AND x.i < y.i GROUP BY 1, 2),
s AS (SELECT p.*, ca.n AS n_a, cb.n AS n_b, t.n AS n_records FROM p JOIN c ca ON ca.i = id_a JOIN c cb ON cb.i = id_b CROSS JOIN t)
"""

ORACLE = {
    "p5_found": _P5 + f"SELECT id_a, id_b FROM s WHERE n_ab >= {P5_SUPPORT} AND n_ab * n_records >= {P5_LIFT}::DOUBLE * (n_a * n_b)",
    "p5_pairs": _P5
    + """SELECT id_a, id_b, n_ab, n_a, n_b, n_records, floor(n_ab * n_records / (n_a * n_b) * 1e6 + 0.5) / 1e6 AS lift,
    CASE WHEN n_ab < n_a THEN floor((n_records - n_b) * n_a / (n_records * (n_a - n_ab)) * 1e6 + 0.5) / 1e6 END AS conviction FROM s""",
}
