"""Items that occur together, counted by basket collapsing.

1. Baskets: the sorted distinct items of each record.
2. Collapsing: identical baskets become one basket with a weight.
3. Each pair of a distinct basket is enumerated once, with the basket's weight.
4. Weights are summed per pair (with map-side combine) and scored.

Exact pruning before any basket is built, for given floors of support and lift:
an item in fewer than ``min_support`` baskets is in no pair of that support, and since
n_ab <= min(n_a, n_b), lift <= N / max(n_a, n_b), so an item in more than N / min_lift baskets
is in no pair of that lift. Both only remove pairs that the floors remove anyway; the second
takes out just the items that occur nearly everywhere, which are the hot ones.

Enumeration streams: an item is exploded with its position, then the tail of its basket, so no
array of all pairs of a basket ever exists. Baskets longer than ``long_basket`` are cut into blocks
of that length first, and every two blocks of a basket are a row of their own that any task may
enumerate: a basket of b items sends b * b / long_basket ids, not b * b.

Defined results: null records and null items count nowhere; repeated rows count once; an empty
table gives no rows; a record with one item has no pair but counts in N; ids are compared as they
stand, in byte order; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

LONG_BASKET = 256


def baskets(df: DataFrame, record: str, item: str) -> DataFrame:
    """Distinct (_r, _i) rows with both set."""
    return df.select(F.col(record).alias("_r"), F.col(item).alias("_i")).where("_r IS NOT NULL AND _i IS NOT NULL").distinct()


def _block_pairs(weighed: DataFrame, size: int) -> DataFrame:
    """(_w, _x, _y, _same): every two blocks of a long basket, and every block with itself, dealt to tasks."""
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size("_b") / size).cast("int") - 1), lambda k: F.slice("_b", k * size + 1, F.lit(size)))
    first = weighed.select("_w", blocks.alias("_k")).select("_w", "_k", F.posexplode("_k").alias("_i", "_x"))
    both = first.select("_w", "_i", "_x", F.posexplode(F.slice("_k", F.col("_i") + 1, F.size("_k"))).alias("_j", "_y"))
    return both.select("_w", "_x", "_y", (F.col("_j") == 0).alias("_same")).repartition(F.xxhash64(F.col("_x")[0], F.col("_y")[0]))


def _enumerated(rows: DataFrame) -> DataFrame:
    """(_a, _z, _w): the pairs of each row, a block with itself giving each pair once."""
    heads = rows.select("_w", "_x", "_y", "_same", F.posexplode("_x").alias("_p", "_a"))
    return heads.select("_a", "_w", F.explode(F.when(F.col("_same"), F.slice("_x", F.col("_p") + 2, F.size("_x"))).otherwise(F.col("_y"))).alias("_z"))


def item_pairs(df: DataFrame, record: str, item: str, min_support: int = 1, min_lift: float = 0.0, long_basket: int = LONG_BASKET) -> DataFrame:
    """(id_a, id_b, n_ab, n_a, n_b, n_records, lift, conviction) with id_a < id_b.

    ``lift`` is n_ab * N / (n_a * n_b). ``conviction`` is that of id_a -> id_b,
    (1 - n_b/N) / (1 - n_ab/n_a), null where every record of id_a holds id_b.
    """
    rows = cut(baskets(df, record, item))
    n = rows.select("_r").distinct().count()
    counts = cut(rows.groupBy("_i").agg(F.count(F.lit(1)).alias("_n")))
    wanted = counts.where(F.col("_n") >= min_support)
    if min_lift > 0:
        wanted = wanted.where(F.col("_n") * F.lit(float(min_lift)) <= F.lit(float(n)))
    kept = rows.join(wanted.select("_i"), "_i", "left_semi")
    sets = kept.groupBy("_r").agg(F.array_sort(F.collect_list("_i")).alias("_b")).where(F.size("_b") > 1)
    weighed = sets.groupBy("_b").agg(F.count(F.lit(1)).alias("_w"))
    short = weighed.where(F.size("_b") <= long_basket).select("_w", F.col("_b").alias("_x"), F.col("_b").alias("_y"), F.lit(True).alias("_same"))
    pairs = _enumerated(short.unionByName(_block_pairs(weighed.where(F.size("_b") > long_basket), long_basket)))
    summed = pairs.groupBy(F.col("_a").alias("id_a"), F.col("_z").alias("id_b")).agg(F.sum("_w").alias("n_ab")).where(F.col("n_ab") >= min_support)
    total = F.lit(n).cast("long")
    scored = (
        summed.join(wanted.select(F.col("_i").alias("id_a"), F.col("_n").alias("n_a")), "id_a")
        .join(wanted.select(F.col("_i").alias("id_b"), F.col("_n").alias("n_b")), "id_b")
        .withColumn("n_records", total)
        .withColumn("lift", F.col("n_ab") * total / (F.col("n_a") * F.col("n_b")))
        .withColumn("conviction", F.when(F.col("n_ab") < F.col("n_a"), (total - F.col("n_b")) * F.col("n_a") / (total * (F.col("n_a") - F.col("n_ab")))))
    )
    if min_lift > 0:
        # Whole numbers on the left: no rounding decides.
        scored = scored.where(F.col("n_ab") * total >= F.lit(float(min_lift)) * (F.col("n_a") * F.col("n_b")))
    return scored.select("id_a", "id_b", "n_ab", "n_a", "n_b", "n_records", "lift", "conviction")
