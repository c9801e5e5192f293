"""Ports to optional models: prompts, response cache, validated JSON, embedder and recogniser.

A port is a function of a batch of strings. The engine calls it only for distinct prompts that the
cache table does not hold, and keeps only answers that parse.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import cache_key, extract_json
from ..schemas import FALLBACK_PREDICATE, PREDICATES

Port = Callable[[list[str]], list[str]]


def listing(items: Column) -> Column:
    """Items as lines with a dash, or one line that says there are none."""
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(F.lit("- (none)"))


def coref_prompts(documents: DataFrame, mentions: DataFrame) -> DataFrame:
    """(document_id, prompt) that asks for the clusters of a document's mentions."""
    m = mentions.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("mention_idx", "text", "type"))), lambda x: F.concat(x["text"], F.lit(" ("), x["type"], F.lit(")"))).alias("_m"))
    body = F.concat(
        F.lit("Cluster the mentions of one document that name the same thing, pronouns included. Use forms of the text as they stand.\n\nText:\n"),
        F.coalesce("text", F.lit("")), F.lit("\n\nMentions:\n"), listing(F.coalesce("_m", F.array().cast("array<string>"))),
    )
    return documents.select("document_id", "text").join(m, "document_id", "left").select("document_id", body.alias("prompt"))


def triple_prompts(documents: DataFrame, entities: DataFrame) -> DataFrame:
    """(document_id, prompt) that asks for triples between a document's own ids; documents without any get no prompt."""
    e = entities.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("canonical_id", "name", "type"))), lambda x: F.concat(x["canonical_id"], F.lit(": "), x["name"], F.lit(" ("), x["type"], F.lit(")"))).alias("_e"))
    wanted = ", ".join(p for p in PREDICATES if p != FALLBACK_PREDICATE)
    body = F.concat(
        F.lit(f"State the relations of one document as triples of the ids below. Predicates: {wanted}; {FALLBACK_PREDICATE} if none fits. Give the number of the sentence, from 0, and a date as a field.\n\nText:\n"),
        F.coalesce("text", F.lit("")), F.lit("\n\nIds:\n"), listing(F.col("_e")),
    )
    return documents.select("document_id", "text").join(e, "document_id").select("document_id", body.alias("prompt"))


def synthesis_prompts(questions: DataFrame, ranked: DataFrame, edges: DataFrame, sentences: DataFrame) -> DataFrame:
    """(qid, prompt) for prose that may use only the evidence; only for questions that ask for it."""
    names = ranked.select("qid", "canonical_id", "name")
    n = ranked.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name", "type", "canonical_id"))), lambda x: F.concat(x["name"], F.lit(" ("), x["type"], F.lit(") ["), x["canonical_id"], F.lit("]"))).alias("_n"))
    s_name, o_name = names.select("qid", F.col("canonical_id").alias("subject_id"), F.col("name").alias("_s")), names.select("qid", F.col("canonical_id").alias("object_id"), F.col("name").alias("_o"))
    line = F.concat(F.coalesce("_s", "subject_id"), F.lit(" --"), F.col("predicate"), F.lit("--> "), F.coalesce("_o", "object_id"), F.when(F.col("date").isNotNull(), F.concat(F.lit(", date="), "date")).otherwise(F.lit("")), F.lit(" (from "), F.col("source_doc_id"), F.lit(", sentence "), F.col("sentence_index").cast("string"), F.lit(")"))
    e = edges.join(s_name, ["qid", "subject_id"], "left").join(o_name, ["qid", "object_id"], "left").groupBy("qid").agg(F.array_sort(F.collect_set(line)).alias("_e"))
    s = sentences.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text", "document_id", "sentence_index"))), lambda x: F.concat(F.lit('"'), x["text"], F.lit('" (from '), x["document_id"], F.lit(")"))).alias("_t"))
    none = F.array().cast("array<string>")
    body = F.concat(F.lit("Answer from the evidence alone; say so if it does not answer.\n\nQuestion:\n"), F.col("question"), F.lit("\n\nEntities:\n"), listing(F.coalesce("_n", none)), F.lit("\n\nRelations:\n"), listing(F.coalesce("_e", none)), F.lit("\n\nSentences:\n"), listing(F.coalesce("_t", none)))
    return questions.where("synthesize").join(n, "qid", "left").join(e, "qid", "left").join(s, "qid", "left").select("qid", body.alias("prompt"))


def keyed(prompts: DataFrame, model: str, params_json: str = "{}") -> DataFrame:
    return prompts.withColumn("cache_key", cache_key(F.lit(model), F.col("prompt"), F.lit(params_json)))


def misses(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct (cache_key, prompt) that the cache does not hold."""
    return prompts.select("cache_key", "prompt").distinct().join(cache.select("cache_key"), "cache_key", "left_anti")


def call_port(missing: DataFrame, port: Port, fields: set[str] | None = None, retries: int = 2) -> DataFrame:
    """(cache_key, text, calls, error): the port's answers. With ``fields``, an answer that is no JSON object with them is asked for again, ``retries`` times at most, and then dropped (text null)."""
    keys = fields

    def valid(text: str) -> bool:
        import json

        if keys is None:
            return True
        lo, hi = text.find("{"), text.rfind("}")
        try:
            got = json.loads(text[lo : hi + 1] if 0 <= lo < hi else text)
        except ValueError:
            return False
        return isinstance(got, dict) and keys <= set(got)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            open_ = list(zip(df["cache_key"].tolist(), df["prompt"].tolist()))
            for attempt in range(retries + 1):
                if not open_:
                    break
                try:
                    answers = port([p for _, p in open_])
                except Exception as e:  # a failing provider drops its documents, not the job
                    rows += [(k, None, attempt + 1, f"{type(e).__name__}: {e}") for k, _ in open_]
                    open_ = []
                    break
                again = []
                for (k, p), a in zip(open_, answers):
                    rows.append((k, a, attempt + 1, None)) if valid(a) else again.append((k, p))
                open_ = again
            rows += [(k, None, retries + 1, "invalid answer") for k, _ in open_]
            yield pd.DataFrame(rows, columns=["cache_key", "text", "calls", "error"], dtype=object).astype({"calls": "int32"})

    return missing.mapInPandas(run, "cache_key string, text string, calls int, error string")


def complete(prompts: DataFrame, cache: DataFrame, port: Port, fields: set[str] | None = None, retries: int = 2) -> tuple[DataFrame, DataFrame]:
    """(answers, new cache): every prompt with its text, cached or fresh; only valid fresh answers enter the cache."""
    fresh = call_port(misses(prompts, cache), port, fields, retries)
    grown = cache.select("cache_key", "text").unionByName(fresh.where("text IS NOT NULL").select("cache_key", "text"))
    return prompts.join(grown, "cache_key", "left"), grown


def parsed(df: DataFrame, text: str, schema: str) -> DataFrame:
    """Adds ``value``: the answer by the schema, null where it is no valid JSON of it."""
    value = F.from_json(extract_json(text), schema)
    first = schema.split()[0]
    return df.withColumn("value", F.when(value[first].isNotNull(), value))


def embedder(port: Callable[[list[str]], list[list[float]]], dim: int):
    """An Arrow UDF from text to a dense vector of fixed width."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        got = port(texts.fillna("").tolist()) if len(texts) else []
        if any(len(v) != dim for v in got):
            raise ValueError(f"the embedder must give {dim} numbers")
        return pd.Series([[float(x) for x in v] for v in got], dtype=object)

    return embed


def recognizer(port: Callable[[list[str]], list[dict]]):
    """A ``mapInPandas`` function from (document_id, text) to mentions with their label."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for d, found in zip(df["document_id"].tolist(), port(df["text"].fillna("").tolist())):
                rows += [(d, k, m["text"], m["label"], m["start"], m["end"]) for k, m in enumerate(found)]
            yield pd.DataFrame(rows, columns=["document_id", "mention_idx", "text", "label", "char_start", "char_end"], dtype=object).astype({"mention_idx": "int32", "char_start": "int32", "char_end": "int32"})

    return run
