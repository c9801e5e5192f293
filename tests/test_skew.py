import random
from collections import Counter

from pyspark.sql import functions as F

from quillgraph.operators import skew

EDGE = "subject_id string, object_id string, predicate string, confidence double"


def edges(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        o = "hot" if i % 3 == 0 else f"o{rng.randrange(200)}"  # a third of all rows
        rows.append((f"s{rng.randrange(50)}" if i % 11 else None, o, rng.choice(["A", "B", "C", None]), rng.choice([None, 0.5, float("nan"), rng.random()])))
    return rows, spark.createDataFrame(rows, EDGE)


def test_hot_keys(spark):
    rows, df = edges(spark)
    keys = skew.key_rows(df)
    want = {(k, "object", n) for k, n in Counter(r[1] for r in rows).items() if n >= 60} | {(k, "subject", n) for k, n in Counter(r[0] for r in rows if r[0]).items() if n >= 60}
    got = {(r.node_id, r.end_role, r.n_rows) for r in skew.hot_keys(keys, len(rows), 0.02).collect()}
    assert got == want and ("hot", "object", 1000) in got
    assert skew.hot_keys(keys.limit(0), 0, 0.02).count() == 0
    assert skew.hot_keys(keys, 10 * len(rows), 0.9).count() == 0


def test_profile(spark):
    rows, df = edges(spark)
    got = {(r.node_id, r.end_role): r for r in skew.key_profile(skew.key_rows(df, "subject_id", "object_id", F.col("predicate")), len(rows), 0.02).collect()}
    hot = [r for r in rows if r[1] == "hot"]
    r = got["hot", "object"]
    c = Counter(x[2] for x in hot if x[2])
    assert (r.n_rows, r.n_partners, r.is_hot) == (len(hot), len({x[0] for x in hot if x[0]}), True)
    assert (r.top_predicate, r.top_predicate_rows) == min(c.items(), key=lambda e: (-e[1], e[0]))
    one = spark.createDataFrame([("a", "b", None, None), ("a", "b", None, None)], EDGE)
    p = {(r.node_id, r.end_role): r for r in skew.key_profile(skew.key_rows(one, "subject_id", "object_id", F.col("predicate")), 2, 0.5).collect()}
    assert p["a", "subject"].n_rows == 2 and p["a", "subject"].n_partners == 1 and p["a", "subject"].top_predicate is None
    assert skew.key_profile(skew.key_rows(df.limit(0), "subject_id", "object_id", F.col("predicate")), 0, 0.02).count() == 0


def test_quantiles_exact(spark):
    import math

    rows, df = edges(spark)
    more = [("x", "y", "A", v) for v in [1e-300, 1e300, -1e300, 0.1, 0.1 + 1e-15, 0.1, -0.0, 0.0, float("inf")]]
    rows, df = rows + more, df.unionByName(spark.createDataFrame(more, EDGE))
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.object_id, r.q): (r.n, r.value) for r in skew.key_quantiles(df, ["object_id"], "confidence", qs, cells=8).collect()}
    by = {}
    for _, o, _, v in rows:
        if v is not None and not math.isnan(v):
            by.setdefault(o, []).append(v)
    for o, vs in by.items():
        vs.sort()
        for q in qs:
            assert got[o, q] == (len(vs), vs[max(1, math.ceil(q * len(vs))) - 1])
    assert len(got) == len(by) * len(qs)
    assert skew.key_quantiles(df.limit(0), ["object_id"], "confidence", qs).count() == 0
