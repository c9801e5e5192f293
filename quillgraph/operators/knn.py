"""Nearest neighbours: sparse feature-hash vectors by an inverted index, dense vectors in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import parts

BLOCK = 2048


#: Shares into which the rows of a bucket are dealt, so that a frequent word's bucket is no single task.
SHARES = 16


def sparse_knn(queries: DataFrame, rows: DataFrame, k: int, order: list[Column], key: list[str], shares: int = SHARES) -> DataFrame:
    """(qid, key…, score, rank): the k rows of greatest positive cosine per question.

    Both sides are (…, bucket, w, norm2) rows with whole-numbered weights, so the equi-join on the
    bucket sums exactly in any order; a row that shares no bucket has no positive cosine. The rows of
    a bucket are dealt to ``shares`` by their key, and the questions, the stated side, go to each.
    ``order`` breaks ties.
    """
    q = queries.select("qid", F.col("bucket").alias("_b"), F.col("w").alias("_w"), F.col("norm2").alias("_n"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("_g"))
    dealt = rows.withColumn("_h", F.pmod(F.xxhash64(*key), F.lit(shares)).cast("int"))
    met = dealt.join(q, (dealt["bucket"] == q["_b"]) & (dealt["_h"] == q["_g"]))
    dots = met.groupBy("qid", *key).agg(F.sum(F.col("w") * F.col("_w")).alias("_dot"), F.max("norm2").alias("_n1"), F.max("_n").alias("_n2")).where("_dot > 0")
    scored = dots.select("qid", *key, (F.col("_dot") / F.sqrt((F.col("_n1") * F.col("_n2")).cast("double"))).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), *order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Questions that one pass over the rows scores together.
QUESTION_BLOCK = 1024


def scan_knn(questions: DataFrame, rows: DataFrame, k: int, key: list[str], dim: int) -> DataFrame:
    """(qid, key…, score, rank): as ``sparse_knn``, for a stated batch of questions against very many rows.

    Both sides are (…, buckets, weights, norm2) rows. The questions go to the executors in blocks of
    ``QUESTION_BLOCK``, one narrow pass over the rows per block; a batch of rows leaves at most k rows
    per question, ties to the smaller key, so no pair is ever shuffled. Whole numbers keep the dot
    products exact.
    """
    schema = rows.schema
    names = ", ".join(f"{c} {schema[c].dataType.simpleString()}" for c in key)
    qid = questions.schema["qid"].dataType.simpleString()
    arrow = to_arrow_schema(StructType.fromDDL(f"qid {qid}, {names}, score double"))
    batch = questions.select("qid", "buckets", "weights", "norm2").collect()  # the stated batch
    out = None
    for lo in range(0, max(len(batch), 1), QUESTION_BLOCK):
        part = batch[lo : lo + QUESTION_BLOCK]
        ids = [r["qid"] for r in part]
        qm = np.zeros((dim, len(part)), np.float32)
        for j, r in enumerate(part):
            qm[r["buckets"], j] = r["weights"]
        qn = np.array([r["norm2"] for r in part], np.float64)

        def score(batches: Iterator[pa.RecordBatch], ids=ids, qm=qm, qn=qn) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 2048):
                    piece = b.slice(at, 2048)
                    if not ids or not piece.num_rows:
                        continue
                    lens = np.asarray(pa.compute.list_value_length(piece.column("buckets")))
                    m = np.zeros((piece.num_rows, dim), np.float32)
                    m[np.repeat(np.arange(piece.num_rows), lens), np.asarray(piece.column("buckets").flatten())] = np.asarray(piece.column("weights").flatten())
                    dots = (m @ qm).astype(np.float64).T
                    sim = dots / np.sqrt(np.asarray(piece.column("norm2"), np.float64)[None, :] * qn[:, None])
                    keep = sim > 0
                    if piece.num_rows > k:
                        keep &= sim >= np.partition(sim, piece.num_rows - k, axis=1)[:, piece.num_rows - k, None]
                    for j in np.flatnonzero(keep.sum(1) > k):  # ties at the k-th place: the smaller keys stay
                        best = np.flatnonzero(keep[j])
                        keys = [piece.column(c).take(pa.array(best)).to_pylist() for c in key]
                        order = sorted(range(len(best)), key=lambda i: (-sim[j, best[i]], *(c[i] for c in keys)))
                        keep[j, best[order[k:]]] = False
                    q_at, r_at = np.nonzero(keep)
                    if len(q_at):
                        taken = [piece.column(c).take(pa.array(r_at)).cast(arrow.field(c).type) for c in key]
                        yield pa.RecordBatch.from_arrays([pa.array(ids, arrow.field("qid").type).take(pa.array(q_at)), *taken, pa.array(sim[q_at, r_at])], names=arrow.names)

        got = rows.select(*key, "buckets", "weights", "norm2").mapInArrow(score, f"qid {qid}, {names}, score double")
        out = got if out is None else out.unionByName(got)
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), *key)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dense_knn(queries: DataFrame, rows: DataFrame, k: int, same_group: bool = False) -> DataFrame:
    """(qid, key, score, rank): the k rows of greatest cosine per query, ties to the smaller key.

    Exact, for a stated query set against all rows. Queries (qid, v[, grp]) and rows (key, v[, grp])
    are packed into blocks; the blocks of rows are dealt to groups, each of which the queries' blocks
    visit. Each meeting of blocks is one matrix product that leaves k rows per query, so the
    intermediate is k per query and row block, never per pair. A query does not find itself.
    With ``same_group`` only rows of the query's group count. Null and all-zero vectors are left out.
    """
    spark = rows.sparkSession

    def blocks(df: DataFrame, key: str, name: str) -> DataFrame:
        grp = F.col("grp") if same_group else F.lit("")
        ok = df.where(F.col("v").isNotNull() & F.exists("v", lambda x: x != 0)).select(F.col(key).alias("i"), F.transform("v", lambda x: x.cast("double")).alias("v"), grp.cast("string").alias("g"))
        n = ok.count()
        return ok.groupBy(F.pmod(F.xxhash64("i"), F.lit(max(1, -(-n // BLOCK)))).alias(f"{name}_block")).agg(F.collect_list(F.struct("i", "g", "v")).alias(name))

    q, r = blocks(queries, "qid", "q"), blocks(rows, "key", "r")
    id_q, id_r = queries.schema["qid"].dataType.simpleString(), rows.schema["key"].dataType.simpleString()

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for qs, rs in zip(df["q"], df["r"]):
                qi, ri = [x["i"] for x in qs], np.array([x["i"] for x in rs], object)
                qm, rm = np.array([x["v"] for x in qs], float), np.array([x["v"] for x in rs], float)
                sim = (qm @ rm.T) / (np.linalg.norm(qm, axis=1)[:, None] * np.linalg.norm(rm, axis=1)[None, :])
                if same_group:
                    sim = np.where(np.array([x["g"] for x in qs], object)[:, None] == np.array([x["g"] for x in rs], object)[None, :], sim, -2.0)
                out = []
                for a, row in zip(qi, sim):
                    row = np.where(ri == a, -2.0, row)
                    far = np.partition(-row, min(k, len(row) - 1))[min(k, len(row) - 1)]
                    for j in np.flatnonzero(-row <= far + 1e-9):
                        if row[j] > -1.5:
                            out.append((a, ri[j], float(row[j])))
                yield pd.DataFrame(out, columns=["qid", "key", "score"]).astype(object).astype({"score": "float64"})

    groups = parts(spark)
    visits = q.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    met = visits.join(r.withColumn("_g", F.pmod("r_block", F.lit(groups)).cast("int")), "_g").select("q", "r").mapInPandas(meet, f"qid {id_q}, key {id_r}, score double")
    # Equal to the ninth decimal is equal: sums of products round differently by block.
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "key")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
