"""Entity linking: document entities, mention context, exact-key linking as a set operation, and the ordered fold."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalar import digest_bucket, digest_sign, mint_id, normalize_name
from ..session import cut
from .fold import STATE


def doc_entities(mentions: DataFrame, clusters: DataFrame) -> DataFrame:
    """(document_id, entity_ord, surface, type, spans): clusters first, then mentions that no cluster covers.

    A cluster takes each mention of its document whose text is its canonical form or a member. Its
    type is that of the first mention that equals the canonical form, else of the first it takes;
    a cluster that takes none is dropped.
    """
    texts = clusters.select("document_id", "cluster_idx", "canonical", F.explode(F.array_distinct(F.concat(F.array("canonical"), F.coalesce("members", F.array().cast("array<string>"))))).alias("text"))
    hit = texts.join(mentions, ["document_id", "text"])
    order = F.struct((F.col("text") != F.col("canonical")).alias("other"), F.col("mention_idx"))
    grouped = hit.groupBy("document_id", "cluster_idx", "canonical").agg(
        F.min_by("type", order).alias("type"),
        F.transform(F.array_sort(F.collect_set(F.struct("mention_idx", "char_start", "char_end"))), lambda x: F.struct(x["char_start"].alias("s"), x["char_end"].alias("e"))).alias("spans"),
    )
    by_cluster = grouped.select("document_id", F.lit(0).alias("_k"), F.col("cluster_idx").alias("_o"), F.col("canonical").alias("surface"), "type", "spans")
    free = mentions.join(hit.select("document_id", "mention_idx").distinct(), ["document_id", "mention_idx"], "left_anti")
    alone = free.select("document_id", F.lit(1).alias("_k"), F.col("mention_idx").alias("_o"), F.col("text").alias("surface"), "type", F.array(F.struct(F.col("char_start").alias("s"), F.col("char_end").alias("e"))).alias("spans"))
    w = Window.partitionBy("document_id").orderBy("_k", "_o")
    return by_cluster.unionByName(alone).select("document_id", (F.row_number().over(w) - 1).alias("entity_ord"), "surface", "type", "spans")


def mention_context(entities: DataFrame, sentences: DataFrame) -> DataFrame:
    """(document_id, entity_ord, context): the surface and the sentences in which its spans begin, in span order.

    The range condition stays a residual of the equi-join on the document, so both sides are only
    hashed by document.
    """
    spans = entities.select("document_id", "entity_ord", "surface", F.posexplode_outer("spans").alias("_p", "_x"))
    s = sentences.select("document_id", F.col("text").alias("_t"), F.col("char_start").alias("_a"), F.col("char_end").alias("_b"), F.col("sentence_index").alias("_i"))
    met = spans.join(s, (spans["document_id"] == s["document_id"]) & (F.col("_x.s") >= F.col("_a")) & (F.col("_x.s") < F.col("_b")), "left").drop(s["document_id"])
    first = met.groupBy("document_id", "entity_ord", "surface", "_i").agg(F.min("_p").alias("_p"), F.first("_t").alias("_t"))
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("_i").isNotNull(), F.struct("_p", "_i", "_t")))), lambda x: x["_t"])
    return first.groupBy("document_id", "entity_ord").agg(F.array_join(F.concat(F.array(F.first("surface")), parts), " ").alias("context"))


def link_set_mode(entities: DataFrame) -> DataFrame:
    """Exact-key linking of (document_id, ingest_order, entity_ord, surface, type) rows.

    With fuzzy candidates off, linking is a set operation: the id is a function of type and
    normalised name, the first row in (ingest_order, entity_ord) order seeds the entity and is new.
    Returns links with ``canonical_id``, ``is_new`` and the seed's name.
    """
    keyed = entities.withColumn("_norm", normalize_name("surface"))
    first = keyed.groupBy("type", "_norm").agg(F.min_by(F.struct("document_id", "entity_ord", "surface"), F.struct("ingest_order", "document_id", "entity_ord")).alias("_seed"))
    return keyed.join(first, ["type", "_norm"]).select(
        "document_id",
        "entity_ord",
        F.col("surface").alias("mention_text"),
        mint_id("type", "_norm").alias("canonical_id"),
        F.col("type").alias("entity_type"),
        ((F.col("document_id") == F.col("_seed.document_id")) & (F.col("entity_ord") == F.col("_seed.entity_ord"))).alias("is_new"),
        F.col("_seed.surface").alias("seed_name"),
    )


def block_candidates(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Each mention (…, surface, type) with the records of its type of which a name or alias has the same key, and the winner: the least id."""
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    keys = entities.select("canonical_id", F.col("type").alias("_type"), F.explode(names).alias("_n")).where("_n IS NOT NULL").select("canonical_id", "_type", normalize_name("_n").alias("_key")).distinct()
    best = keys.groupBy("_type", "_key").agg(F.min("canonical_id").alias("winner"), F.count(F.lit(1)).alias("candidates"))
    m = mentions.withColumn("_norm", normalize_name("surface"))
    return m.join(best, (m["type"] == best["_type"]) & (m["_norm"] == best["_key"])).drop("_type", "_key", "_norm")


#: Tokens up to which a vector is built inside its row; longer texts go through a shuffle by bucket.
IN_ROW_TOKENS = 256


def sparse_rows(df: DataFrame, key: list[str], text: str, dim: int) -> DataFrame:
    """Feature-hash vectors, one row per text: (key…, buckets, weights, norm2), signed token counts per bucket.

    A key stands for one row. A text without words is hashed whole (an empty one as NUL). Buckets
    that cancel out leave no entry; a vector that cancels out entirely gets weight 1 at its text's
    length modulo the width. Null texts have no vector. Short texts need no shuffle.
    """
    norm = normalize_name(text)
    toks = F.when(norm == "", F.array(F.when(F.col(text) == "", F.lit("\0")).otherwise(F.col(text)))).otherwise(F.split(norm, " "))
    rows = df.where(F.col(text).isNotNull()).select(*key, F.length(text).alias("_len"), toks.alias("_t"))
    short = rows.where(F.size("_t") <= IN_ROW_TOKENS).select(*key, "_len", F.transform("_t", lambda t: F.sha2(t, 256)).alias("_h"))
    signed = F.transform("_h", lambda h: F.struct(digest_bucket(h, dim).alias("b"), digest_sign(h).alias("s")))
    summed = F.transform(F.array_distinct(F.transform("_s", lambda x: x["b"])), lambda b: F.struct(b.alias("bucket"), F.aggregate(F.filter("_s", lambda x: x["b"] == b), F.lit(0), lambda acc, x: acc + x["s"]).alias("w")))
    inside = short.select(*key, "_len", signed.alias("_s")).select(*key, "_len", F.filter(summed, lambda x: x["w"] != 0).alias("_v"))
    long = rows.where(F.size("_t") > IN_ROW_TOKENS).select(*key, "_len", F.explode("_t").alias("_t")).withColumn("_h", F.sha2("_t", 256))
    w = long.select(*key, "_len", digest_bucket("_h", dim).alias("bucket"), digest_sign("_h").alias("_s")).groupBy(*key, "_len", "bucket").agg(F.sum("_s").cast("int").alias("w"))
    outside = w.groupBy(*key, "_len").agg(F.collect_list(F.when(F.col("w") != 0, F.struct("bucket", "w"))).alias("_v"))
    whole = inside.unionByName(outside).select(*key, F.when(F.size("_v") == 0, F.array(F.struct((F.col("_len") % dim).cast("int").alias("bucket"), F.lit(1).alias("w")))).otherwise(F.col("_v")).alias("_v"))
    return whole.select(*key, F.transform("_v", lambda x: x["bucket"]).alias("buckets"), F.transform("_v", lambda x: x["w"]).alias("weights"), F.aggregate("_v", F.lit(0).cast("bigint"), lambda acc, x: acc + x["w"] * x["w"]).alias("norm2"))


def sparse_vectors(df: DataFrame, key: list[str], text: str, dim: int) -> DataFrame:
    """The same as (key…, bucket, w, norm2) rows."""
    return sparse_rows(df, key, text, dim).select(*key, "norm2", F.explode(F.arrays_zip(F.col("buckets").alias("bucket"), F.col("weights").alias("w"))).alias("_x")).select(*key, F.col("_x.bucket").alias("bucket"), F.col("_x.w").alias("w"), "norm2")


LINKED = "document_id string, entity_ord int, mention_text string, canonical_id string, entity_type string, score double, is_new boolean"


@dataclass(frozen=True)
class Folded:
    """Links of a batch, and the keys that it adds to the state."""

    links: DataFrame
    added: DataFrame


def fold_batch(entities: DataFrame, state: DataFrame | None = None, threshold: float = 0.82, top_k: int = 5, dim: int = 384, tie_margin: float = 0.0, tie_break=None) -> Folded:
    """Ordered linking with fuzzy candidates of (document_id, ingest_order, entity_ord, surface, type, context) rows, after those of ``state``.

    The order (ingest_order, document_id, entity_ord) matters and state never crosses a type. The
    first row of a key, the type with the normalised name, takes the most similar entity of its type if
    that reaches the threshold (``tie_break(surface, name, context)`` may decide within the margin),
    else makes a new one; every later row of the key follows it. So only the first rows of keys that
    the state does not hold are folded in order, each type on its own; all others find their entity by
    a join, and their score in parallel. ``state`` has a row per key (``fold.STATE``), so a batch that is
    replayed finds its own keys and gives the same links. ``top_k`` 0 switches fuzzy candidates off.

    Null surfaces and contexts are taken as empty; an empty batch gives no rows.
    """
    spark = entities.sparkSession
    rows = entities.select("document_id", F.col("ingest_order").cast("bigint").alias("ingest_order"), F.col("entity_ord").cast("int").alias("entity_ord"), F.coalesce("surface", F.lit("")).alias("surface"), "type", F.coalesce("context", F.lit("")).alias("context"))
    keyed = rows.withColumn("key", normalize_name("surface"))
    first = keyed.groupBy("type", "key").agg(F.min(F.struct("ingest_order", "document_id", "entity_ord", "surface", "context")).alias("_f")).select("type", "key", "_f.*")
    held = spark.createDataFrame([], STATE) if state is None else state.select(*StructType.fromDDL(STATE).names)
    unseen = first.join(held.select("type", "key"), ["type", "key"], "left_anti")

    def fold(g: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        from .fold import fold_keys

        return fold_keys(g, old, threshold, top_k, dim, tie_margin, tie_break)

    added = cut(unseen.groupBy("type").cogroup(held.groupBy("type")).applyInPandas(fold, STATE))
    known = held.unionByName(added)
    seeds = known.where("is_new").select("canonical_id", F.col("type").alias("_t"), F.col("context").alias("seed_context"))
    target = known.select("type", "key", "canonical_id", F.col("document_id").alias("_d"), F.col("entity_ord").alias("_o"), F.col("score").alias("_s"), F.col("is_new").alias("_n"))
    target = target.join(seeds, (target["type"] == seeds["_t"]) & (target["canonical_id"] == seeds["canonical_id"])).drop("_t", seeds["canonical_id"])
    met = keyed.join(target, ["type", "key"])
    opens = (F.col("document_id").eqNullSafe(F.col("_d"))) & (F.col("entity_ord").eqNullSafe(F.col("_o")))
    asked = met.select("document_id", "entity_ord", F.col("surface").alias("mention_text"), "canonical_id", F.col("type").alias("entity_type"), F.when(opens, F.col("_s")).alias("_s"), (opens & F.col("_n")).alias("is_new"), F.when(~opens, F.col("context")).alias("context"), F.when(~opens, F.col("seed_context")).alias("seed_context"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .fold import hashed, similarity

        for df in batches:
            sims = [s if c is None else float(similarity(hashed(c, dim), hashed(x, dim))) for s, c, x in zip(df["_s"], df["context"], df["seed_context"])]
            yield df.assign(score=pd.Series(sims, index=df.index, dtype="float64"))[["document_id", "entity_ord", "mention_text", "canonical_id", "entity_type", "score", "is_new"]]

    return Folded(asked.mapInPandas(score, LINKED), added)


def link_fold(entities: DataFrame, threshold: float = 0.82, top_k: int = 5, dim: int = 384, tie_margin: float = 0.0, tie_break=None) -> DataFrame:
    """The links of ``fold_batch`` without a state before it."""
    return fold_batch(entities, None, threshold, top_k, dim, tie_margin, tie_break).links


def folded_entities(state: DataFrame) -> DataFrame:
    """(canonical_id, name, type, aliases): the name as first written, and one spelling for every other key that came to it, in order."""
    seed = state.where("is_new").select("type", "canonical_id", F.col("surface").alias("name"), F.col("key").alias("_k"))
    more = state.where("NOT is_new AND key <> ''").groupBy("type", "canonical_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "surface", "key"))), lambda x: x["surface"]).alias("aliases"))
    return seed.join(more, ["type", "canonical_id"], "left").select("canonical_id", "name", "type", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
