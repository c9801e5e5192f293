"""Heuristic sentences and mentions with exact code-point offsets, without a UDF.

A pattern that tiles a text completely gives pieces whose lengths add up to offsets, so a running
length over the pieces of one row replaces a match position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import LEADING_WORDS

SENTENCE_TILE = r"[^.!?]+[.!?]?|[.!?]"
_WORD = r"[A-Z][A-Za-z0-9]*(?:['\-][A-Za-z0-9]+)*"
MENTION_TILE = rf"(?U){_WORD}(?:[\s\p{{Z}}]+{_WORD})*|[^A-Z]+"
_LEADING = r"(?iU)^((" + "|".join(LEADING_WORDS) + r")([\s\p{Z}]+|$))+"
_LEFT, _RIGHT = r"(?U)^[\s\p{Z}]+", r"(?U)[\s\p{Z}]+$"


def tiles(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """(document_id, _p, _t, _s): one row per tile with its place and start, a running length over the document's tiles."""
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    rows = df.select("document_id", F.posexplode(found).alias("_p", "_t"))
    w = Window.partitionBy("document_id").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_s", F.coalesce(F.sum(F.length("_t")).over(w), F.lit(0)).cast("int"))


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, _LEFT, ""), _RIGHT, "")


def heuristic_sentences(docs: DataFrame) -> DataFrame:
    """(document_id, sentence_index, text, char_start, char_end) of documents (document_id, text).

    Null and blank texts have none. A document_id must be unique.
    """
    rows = tiles(docs.where("text IS NOT NULL"), "text", SENTENCE_TILE).where(~F.col("_t").isin(".", "!", "?"))
    left = F.length("_t") - F.length(F.regexp_replace("_t", _LEFT, ""))
    kept = rows.select("document_id", "_p", strip(F.col("_t")).alias("text"), (F.col("_s") + left).alias("char_start")).where("text <> ''")
    order = Window.partitionBy("document_id").orderBy("_p")
    return kept.select("document_id", (F.row_number().over(order) - 1).alias("sentence_index"), "text", F.col("char_start").cast("int"), (F.col("char_start") + F.length("text")).cast("int").alias("char_end"))


def heuristic_mentions(docs: DataFrame) -> DataFrame:
    """(document_id, mention_idx, text, type, char_start, char_end): capitalised spans without leading small words."""
    rows = tiles(docs.where("text IS NOT NULL"), "text", MENTION_TILE).where(F.col("_t").rlike("^[A-Z]"))
    rest = F.regexp_replace("_t", _LEADING, "")
    kept = rows.select("document_id", "_p", strip(rest).alias("text"), (F.col("_s") + F.length("_t") - F.length(rest)).alias("char_start")).where("text <> ''")
    order = Window.partitionBy("document_id").orderBy("_p")
    return kept.select("document_id", (F.row_number().over(order) - 1).alias("mention_idx"), "text", F.lit("ORG").alias("type"), F.col("char_start").cast("int"), (F.col("char_start") + F.length("text")).cast("int").alias("char_end"))
