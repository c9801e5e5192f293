"""Per-key results over tables in which a handful of keys hold most rows.

Everything here is built from mergeable counts: each map task reduces its rows to partial
counts before the shuffle, so a key with a third of all rows arrives at its reducer as at most
one row per map task and cell. No operator gathers the values of a key.

* ``key_rows`` turns a table and its key columns into (node_id, end_role, ...) rows.
* ``hot_keys`` selects the keys above a share of all rows by refining histograms over key hashes.
* ``key_profile`` gives row count, distinct partners and most frequent predicate per key.
* ``key_quantiles`` gives exact per-key quantiles by refining histograms over values.

Defined results: null is no key and gives no row; an empty table gives no row; repeated rows
count as often as they stand; ties of the most frequent predicate go to the smallest in byte
order; columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Bits of the key hash that each refinement round resolves.
HASH_DIGIT_BITS = 12
#: Cells into which a refinement round cuts the open interval of a key.
VALUE_CELLS = 64
#: Keys with at least 1/HOT_KEYS of all values, so HOT_KEYS at most, have their intervals sent to the executors.
HOT_KEYS = 256


def key_rows(df: DataFrame, subject: str = "subject_id", obj: str = "object_id", *carry: Column) -> DataFrame:
    """One row per non-null end: node_id, end_role, partner and the carried columns. Narrow, no shuffle."""
    ends = F.explode(
        F.array(
            F.struct(F.col(subject).alias("node_id"), F.lit("subject").alias("end_role"), F.col(obj).alias("partner")),
            F.struct(F.col(obj).alias("node_id"), F.lit("object").alias("end_role"), F.col(subject).alias("partner")),
        )
    )
    return df.select(ends.alias("_end"), *carry).select("_end.*", *[c for c in _names(df, carry)]).where("node_id IS NOT NULL")


def _names(df: DataFrame, cols: Sequence[Column]) -> list[str]:
    return df.limit(0).select(*cols).columns if cols else []


def hot_keys(keys: DataFrame, total: int, share: float, key: str = "node_id", role: str = "end_role") -> DataFrame:
    """Keys with at least ``share`` of ``total`` rows: (role, key, n_rows).

    Distributed exact selection. Each round counts rows per prefix of the key's hash, 12 bits
    longer than the round before, inside the prefixes that still hold enough rows: a prefix below
    the bound holds no hot key. At most 1/share prefixes per role survive a round, so the filter
    sent to the executors has a proven bound, and each map task emits at most
    4096 x survivors counts. After two rounds the survivors' keys are counted themselves.
    """
    if total <= 0:
        return keys.groupBy(role, key).agg(F.count(F.lit(1)).alias("n_rows")).where(F.lit(False))
    need = share * total
    h = F.xxhash64(F.col(key))
    left = keys.select(role, key)
    for r in (1, 2):
        prefix = F.shiftrightunsigned(h, 64 - r * HASH_DIGIT_BITS)
        kept = left.groupBy(role, prefix.alias("_p")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= need).select(role, "_p")
        rows = kept.collect()  # at most 2 / share rows
        cond = F.lit(False)
        for end in sorted({x[0] for x in rows}):
            cond = cond | ((F.col(role) == end) & prefix.isin([x[1] for x in rows if x[0] == end]))
        left = left.where(cond)
    return left.groupBy(role, key).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= need)


def key_profile(keys: DataFrame, total: int, share: float, predicate: str = "predicate") -> DataFrame:
    """(node_id, end_role, n_rows, n_partners, top_predicate, top_predicate_rows, is_hot) for every key.

    Counts collapse in three steps, (key, partner, predicate) -> (key, predicate) / (key, partner)
    -> key. The finest level spreads a hot key over its partners; the coarser ones start from it.
    A null partner is no partner; a null predicate is none.
    """
    fine = keys.groupBy("node_id", "end_role", "partner", predicate).agg(F.count(F.lit(1)).alias("_n"))
    # One row per key and predicate or partner, in one pass: grouping-set rows tagged by kind.
    both = fine.select(
        "node_id",
        "end_role",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("kind"), F.col(predicate).alias("v"), F.col("_n").alias("n")),
                F.struct(F.lit(1).alias("kind"), F.col("partner").alias("v"), F.lit(0).cast("long").alias("n")),
            )
        ).alias("x"),
    ).select("node_id", "end_role", "x.*")
    mid = both.groupBy("node_id", "end_role", "kind", "v").agg(F.sum("n").alias("n"))
    # max of (n, reversed order of v): ties of n go to the smallest predicate, found by a second min.
    is_pred = (F.col("kind") == 0) & F.col("v").isNotNull()
    top = F.min(F.when(is_pred, F.struct((-F.col("n")).alias("n"), F.col("v").alias("v"))))
    out = mid.groupBy("node_id", "end_role").agg(
        F.sum("n").alias("n_rows"),
        F.count(F.when((F.col("kind") == 1) & F.col("v").isNotNull(), 1)).alias("n_partners"),
        top.alias("_top"),
    )
    return out.select(
        "node_id",
        "end_role",
        "n_rows",
        "n_partners",
        F.col("_top.v").alias("top_predicate"),
        (-F.col("_top.n")).alias("top_predicate_rows"),
        (F.col("n_rows") >= F.lit(share * total)).alias("is_hot"),
    )


def key_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], cells: int = VALUE_CELLS, max_rounds: int = 80) -> DataFrame:
    """Exact quantiles per key: (*keys, q, n, value), the value of rank ceil(q * n), 1 at least.

    Distributed exact selection: the state of a (key, q) is an interval [lo, hi] of values and the
    rank sought inside it. A round cuts every open interval into ``cells`` cells, counts rows per
    cell with the least and greatest value seen there (all mergeable), and keeps the cell that
    holds the rank; its observed ends are the next interval. An interval whose ends are equal is
    resolved. Equal rows of (key, value) are collapsed into counts first. NaN and null are no values.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    base = cut(df.select(*keys, (v + F.lit(0.0)).alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v") & _all_set(keys)).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")))
    q = F.explode(F.array(*[F.lit(float(x)) for x in qs]))
    state = (
        base.groupBy(*keys)
        .agg(F.sum("_n").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        .select(*keys, "n", "_lo", "_hi", q.alias("q"))
        .withColumn("_rank", F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n"))).cast("long"))
    )
    total = state.select(*keys, "n").distinct().agg(F.sum("n")).first()[0] or 0
    done = None
    for _ in range(max_rounds):
        state = cut(state)
        closed = state.where("_lo = _hi").select(*keys, "q", "n", F.col("_lo").alias("value"))
        done = closed if done is None else done.unionByName(closed)
        open_ = state.where("_lo < _hi")
        if open_.isEmpty():
            return done
        # Intervals of one key are carried together, so that the large side joins once per key.
        nests = open_.groupBy(*keys).agg(F.collect_list(F.struct("q", "n", "_lo", "_hi", "_rank")).alias("_s"))  # at most len(qs) entries
        # The values of a hot key stay where they are: its intervals come to them.
        hot = nests.where(F.element_at("_s", 1)["n"] * HOT_KEYS >= total)
        cold = base.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(nests.where(F.element_at("_s", 1)["n"] * HOT_KEYS < total), keys)
        hit = (
            base.join(F.broadcast(hot), keys)
            .unionByName(cold)
            .select(*keys, "_v", "_n", F.explode("_s").alias("_i"))
            .where(F.col("_v").between(F.col("_i._lo"), F.col("_i._hi")))
            .select(*keys, "_v", "_n", "_i.*")
        )
        # Cells relative to the interval; the top value gets a cell of its own, so every round shrinks the interval.
        width = (F.col("_hi") / cells) - (F.col("_lo") / cells)
        cell = F.when(F.col("_v") == F.col("_hi"), F.lit(cells + 1)).when(F.col("_v") == F.col("_lo"), F.lit(-1)).when(width > 0, F.least(F.lit(cells - 1), F.floor((F.col("_v") - F.col("_lo")) / width).cast("int"))).otherwise(F.lit(0))
        counted = hit.groupBy(*keys, "q", "n", "_rank", cell.alias("_c")).agg(F.sum("_n").alias("_m"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        # At most cells + 2 rows per (key, q): the running sum over them is bounded.
        state = (
            counted.groupBy(*keys, "q", "n", "_rank")
            .agg(F.array_sort(F.collect_list(F.struct("_c", "_m", "_lo", "_hi"))).alias("_h"))
            .withColumn(
                "_x",
                F.expr(
                    "aggregate(_h, named_struct('seen', 0L, 'lo', CAST(NULL AS DOUBLE), 'hi', CAST(NULL AS DOUBLE), 'before', 0L), "
                    "(a, x) -> IF(a.lo IS NOT NULL, a, IF(a.seen + x._m >= _rank, "
                    "named_struct('seen', a.seen + x._m, 'lo', x._lo, 'hi', x._hi, 'before', a.seen), "
                    "named_struct('seen', a.seen + x._m, 'lo', a.lo, 'hi', a.hi, 'before', a.before))))"
                ),
            )
            .select(*keys, "n", F.col("_x.lo").alias("_lo"), F.col("_x.hi").alias("_hi"), "q", (F.col("_rank") - F.col("_x.before")).alias("_rank"))
        )
    raise RuntimeError("quantile intervals did not close")  # pragma: no cover - every round removes the ends of an interval


def _all_set(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond
