"""Answer and evidence metrics, subsets, and their mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import normalize_answer
from ..schemas import SUBSETS


def golds(answer: str = "answer", aliases: str = "answer_aliases") -> Column:
    return F.filter(F.concat(F.array(F.col(answer)), F.coalesce(F.col(aliases), F.array().cast("array<string>"))), lambda g: g.isNotNull())


def exact_match(prediction: Column, gold: Column) -> Column:
    """1.0 where any gold answer equals the prediction by answer key, else 0.0."""
    return F.when(F.coalesce(F.exists(gold, lambda g: normalize_answer(g) == normalize_answer(prediction)), F.lit(False)), 1.0).otherwise(0.0)


def _words(c: Column) -> Column:
    key = normalize_answer(c)
    return F.when(key == "", F.array().cast("array<string>")).otherwise(F.split(key, " "))


def _overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two short word lists."""
    count = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, w: s + F.least(count(a, w), count(b, w)))


def token_f1_one(prediction: Column, gold: Column) -> Column:
    p, g = _words(prediction), _words(gold)
    same = _overlap(p, g).cast("double")
    f1 = F.when(same == 0, 0.0).otherwise(2 * (same / F.size(p)) * (same / F.size(g)) / (same / F.size(p) + same / F.size(g)))
    return F.when((F.size(p) == 0) & (F.size(g) == 0), 1.0).when((F.size(p) == 0) | (F.size(g) == 0), 0.0).otherwise(f1)


def token_f1(prediction: Column, gold: Column) -> Column:
    """Greatest token F1 over the gold answers; 0 without any."""
    return F.coalesce(F.array_max(F.transform(gold, lambda g: token_f1_one(prediction, g))), F.lit(0.0))


def supporting_facts(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(id, sf_precision, sf_recall, sf_f1) over the sets of (id, title, idx); an empty side gives 0."""
    p, g = predicted.select("id", "title", "idx").distinct(), gold.select("id", "title", "idx").distinct()
    both = p.withColumn("p", F.lit(1)).join(g.withColumn("g", F.lit(1)), ["id", "title", "idx"], "full")
    n = both.groupBy("id").agg(F.sum(F.when(F.col("p").isNotNull() & F.col("g").isNotNull(), 1).otherwise(0)).alias("hit"), F.count("p").alias("np"), F.count("g").alias("ng"))
    prec, rec = F.when(F.col("np") > 0, F.col("hit") / F.col("np")).otherwise(0.0), F.when(F.col("ng") > 0, F.col("hit") / F.col("ng")).otherwise(0.0)
    return n.select("id", prec.alias("sf_precision"), rec.alias("sf_recall")).withColumn("sf_f1", F.when(F.col("sf_precision") + F.col("sf_recall") > 0, 2 * F.col("sf_precision") * F.col("sf_recall") / (F.col("sf_precision") + F.col("sf_recall"))).otherwise(0.0))


def mean_metrics(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """One row with the mean of each metric, a missing one counting 0; no row without scores."""
    agg = scores.agg(F.count(F.lit(1)).alias("questions"), *[F.avg(F.coalesce(F.col(m), F.lit(0.0))).alias(m) for m in metrics])
    return agg.where("questions > 0")


def subset(qa: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """Named prefix of the questions in id order; an unknown name raises KeyError."""
    n = SUBSETS[name]
    n = limit if n is None else n if limit is None else min(n, limit)
    ordered = qa.orderBy("id")
    return ordered if n is None else ordered.limit(n)
