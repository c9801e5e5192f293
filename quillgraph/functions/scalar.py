"""Scalar functions as Catalyst expressions: names, answers, predicates, ids, vectors, JSON."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FALLBACK_PREDICATE, LABEL_TYPES, PREDICATE_PHRASES, PREDICATES


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_name(c: Column | str) -> Column:
    """Blocking key of a name: case folded, punctuation to single blanks, trimmed."""
    folded = F.replace(F.replace(F.replace(F.lower(_col(c)), F.lit("ß"), F.lit("ss")), F.lit("ſ"), F.lit("s")), F.lit("ς"), F.lit("σ"))
    words = F.regexp_replace(folded, r"[^\p{L}\p{N}_\s\p{Z}]+", " ")
    return F.trim(F.regexp_replace(words, r"[\s\p{Z}]+", " "))


def normalize_answer(c: Column | str) -> Column:
    """Answer key: lower case, ASCII punctuation deleted, articles dropped, blanks collapsed."""
    bare = F.translate(F.lower(_col(c)), string.punctuation, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"[\s\p{Z}]+", " "))


def normalize_predicate(c: Column | str) -> Column:
    """Predicate key: lower case, everything but ASCII letters and digits to single blanks."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), r"[^0-9a-z]+", " "))


def predicate_table(spark: SparkSession) -> DataFrame:
    """(phrase, mapped): every known phrase and the predicate it maps to. A fixed table of some sixty rows."""
    rows = {p.lower().replace("_", " "): p for p in PREDICATES}
    rows.update({x: p for p, xs in PREDICATE_PHRASES.items() for x in xs})
    return spark.createDataFrame(sorted(rows.items()), "phrase string, mapped string")


def map_predicates(df: DataFrame, raw: str) -> DataFrame:
    """Adds ``predicate`` and ``raw_predicate``: the mapped predicate with no raw phrase, or the fallback with it."""
    known = F.broadcast(predicate_table(df.sparkSession))
    hit = df.withColumn("_phrase", normalize_predicate(raw)).join(known, F.col("_phrase") == known["phrase"], "left")
    return hit.select(
        *[c for c in df.columns if c not in ("predicate", "raw_predicate")],
        F.coalesce("mapped", F.lit(FALLBACK_PREDICATE)).alias("predicate"),
        F.when(F.col("mapped").isNull(), F.col(raw)).alias("raw_predicate"),
    )


def curated_type(label: Column | str) -> Column:
    """Curated type of a recogniser's label, null where it is dropped."""
    c = _col(label)
    out = F.lit(None).cast("string")
    for name, typ in LABEL_TYPES.items():
        out = F.when(c == name, typ).otherwise(out)
    return out


def document_id(bucket: Column | str, key: Column | str) -> Column:
    return F.sha2(F.concat(_col(bucket), F.lit("/"), _col(key)), 256)


def mint_id(typ: Column | str, norm: Column | str) -> Column:
    """Canonical id of a type and normalised name."""
    return F.concat(F.lit("e-"), F.substring(F.sha2(F.concat(F.lit("el:"), _col(typ), F.lit(":"), _col(norm)), 256), 1, 16))


def cache_key(model: Column | str, prompt: Column | str, params_json: Column | str) -> Column:
    """Key of a model response: model, prompt and sorted parameters, NUL separated."""
    return F.sha2(F.concat(_col(model), F.lit("\0"), _col(prompt), F.lit("\0"), _col(params_json)), 256)


def decode_text(content: Column | str) -> Column:
    """Bytes as UTF-8; each undecodable part becomes U+FFFD."""
    return F.make_valid_utf8(_col(content).cast("string"))


def object_key_slug(title: Column | str) -> Column:
    """Object key of a title."""
    bare = F.regexp_replace(_col(title), r"[^\p{L}\p{N}_.\-]+", "_")
    return F.concat(F.coalesce(F.nullif(F.regexp_replace(bare, r"^_+|_+$", ""), F.lit("")), F.lit("untitled")), F.lit(".txt"))


def digest_bucket(digest: Column | str, dim: int) -> Column:
    """Bucket of a token by its SHA-256 in hex: the first eight bytes, big endian, modulo the width, by halves of 32 bits."""
    half = lambda at: F.conv(F.substring(_col(digest), at, 8), 16, 10).cast("bigint")
    return ((half(1) * F.lit(2**32 % dim) + half(9)) % dim).cast("int")


def digest_sign(digest: Column | str) -> Column:
    """+1 where the ninth byte of the digest is even, else -1: its last hex digit tells."""
    return F.when(F.substring(_col(digest), 18, 1).isin(*"02468ace"), 1).otherwise(-1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two dense vectors; 0 where either has no length."""
    x, y = _col(a), _col(b)
    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(x, y) / norms)


def score_to_cosine(score: Column | str) -> Column:
    """Cosine of a store score that was shifted into [0, 1]."""
    return 2 * _col(score) - 1


def proximity(hop: Column | str) -> Column:
    return F.coalesce(1.0 / (1.0 + _col(hop)), F.lit(0.0))


def node_score(seed: Column | str, hop: Column | str, w_seed: float, w_prox: float) -> Column:
    return F.lit(w_seed) * F.coalesce(_col(seed), F.lit(0.0)) + F.lit(w_prox) * proximity(hop)


def extract_json(c: Column | str) -> Column:
    """The outermost {...} of a model's answer, without fences and prose; else the trimmed text."""
    found = F.regexp_extract(_col(c), r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise(F.trim(_col(c)))
