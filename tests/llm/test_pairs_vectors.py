import gc
import itertools
import math
import random
import threading
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from quillgraph.llm import cooccurrence as C
from quillgraph.llm import vectors as V

LNK = "document_id string, canonical_id string, id_a string, n int"


def pairs(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], LNK)
    return {(r.id_a, r.id_b): r for r in C.item_pairs(df, "document_id", "canonical_id", **kw).collect()}


@pytest.mark.parametrize("long_basket", [256, 3])
def test_item_pairs(spark, long_basket):
    rng = random.Random(4)
    items = [f"i{k}" for k in range(12)]
    rows = [(f"d{d}", i) for d in range(60) for i in ["hot", *rng.sample(items, rng.randrange(0, 7))]]
    rows += rows[:40] + [(None, "i1"), ("d1", None)]
    sets = {}
    for d, i in rows:
        if d and i:
            sets.setdefault(d, set()).add(i)
    n = Counter(i for s in sets.values() for i in s)
    both = Counter(p for s in sets.values() for p in itertools.combinations(sorted(s), 2))
    got = pairs(spark, rows, long_basket=long_basket)
    assert {k: r.n_ab for k, r in got.items()} == dict(both)
    for (a, b), r in got.items():
        assert (r.n_a, r.n_b, r.n_records) == (n[a], n[b], 60)
        assert math.isclose(r.lift, both[a, b] * 60 / (n[a] * n[b]))
        if both[a, b] < n[a]:
            assert math.isclose(r.conviction, (1 - n[b] / 60) / (1 - both[a, b] / n[a]))
        else:
            assert r.conviction is None
    few = pairs(spark, rows, min_support=5, min_lift=1.2, long_basket=long_basket)
    assert set(few) == {p for p in both if both[p] >= 5 and both[p] * 60 / (n[p[0]] * n[p[1]]) >= 1.2}


def test_item_pairs_edges(spark):
    assert pairs(spark, []) == {}
    assert pairs(spark, [("d", "a")]) == {}
    big = pairs(spark, [("d", f"i{k:03}") for k in range(300)], long_basket=100)
    assert len(big) == 300 * 299 // 2


def make(spark, vecs):
    return spark.createDataFrame([(k, [float(x) for x in v] if v is not None else None, 1) for k, v in vecs], "key string, v array<double>, id int")


def brute(vecs, k, floor):
    ok = sorted((a, np.array(v, float)) for a, v in vecs if v is not None and len(v) == 64 and np.isfinite(v).all() and np.any(v))
    out = {}
    for a, x in ok:
        s = sorted((-round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 12), b) for b, y in ok if b != a)
        out[a] = [b for c, b in s[:k] if -c >= floor]
    return {a: b for a, b in out.items() if b}


def cluster(rng, n, groups, noise=0.06):
    centres = rng.standard_normal((groups, 64))
    return [(f"k{i:05}", (centres[i % groups] + noise * 8 * rng.standard_normal(64) * rng.uniform(0.2, 1)) * rng.uniform(0.5, 20)) for i in range(n)]


@pytest.mark.parametrize("bucket_rows", [20_000, 40])
def test_neighbours_recall(spark, bucket_rows):
    vecs = cluster(np.random.default_rng(5), 1200, 200)
    want = {(a, b) for a, bs in brute(vecs, 5, 0.85).items() for b in bs}
    got = {(r.key, r.neighbour) for r in V.neighbours(make(spark, vecs), bucket_rows=bucket_rows).collect()}
    assert len(want) > 2000 and len(want & got) >= 0.95 * len(want) and len(want & got) >= 0.95 * len(got)


@pytest.mark.parametrize("block", [8192, 100, 7])
def test_neighbours_without_floor_are_exact(spark, monkeypatch, block):
    monkeypatch.setattr(V, "EXACT_ROWS", block)
    rng = np.random.default_rng(8)
    vecs = cluster(rng, 150 if block == 7 else 700, 300) + [(f"same{i}", np.ones(64)) for i in range(8)] + [("z", np.zeros(64)), ("n", None)]
    got = {}
    for r in V.neighbours(make(spark, vecs), min_cosine=None).orderBy("key", "rank").collect():
        got.setdefault(r.key, []).append(r.neighbour)
    assert got == brute(vecs, 5, -2) and {len(x) for x in got.values()} == {5}


def test_neighbours_copies_ties_and_junk(spark):
    rng = np.random.default_rng(6)
    a, b = rng.standard_normal(64), rng.standard_normal(64)
    vecs = [(f"a{i:02}", a) for i in range(12)] + [("b0", b), ("b1", b * 3), ("z", np.zeros(64)), ("n", None), ("w", np.ones(3)), ("x", np.full(64, np.nan)), ("far", rng.standard_normal(64)), ("a00", a)]
    got = {}
    for r in V.neighbours(make(spark, vecs)).orderBy("key", "rank").collect():
        got.setdefault(r.key, []).append(r.neighbour)
    assert got["b0"] == ["b1"] and got["b1"] == ["b0"] and "far" not in got and not {"z", "n", "w", "x"} & set(got)
    assert got["a11"] == ["a00", "a01", "a02", "a03", "a04"] and got["a05"][:5] == ["a00", "a01", "a02", "a03", "a04"]
    assert V.neighbours(make(spark, [])).count() == 0


def test_probe_order():
    rng = np.random.default_rng(1)
    u = rng.standard_normal((50, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    k = V.bucket_keys(u, 8, 1.5, 3, 8, 7)
    assert k.shape == (3, 8, 50) and (V.bucket_keys(u, 8, 1.5, 3, 1, 7)[:, 0] == k[:, 0]).all()
    assert all(len(set(k[t, :, i])) == 8 for t in range(3) for i in range(50))
    assert abs(V.unpack(V.pack(u)) - u).max() < 0.005


def test_shapes_of_larger_collections_keep_recall():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 64))
    y = x / np.linalg.norm(x, axis=1)[:, None]
    # Partners at cosines from 0.85 to 0.97.
    z = rng.standard_normal((1500, 64))
    z -= (z * y).sum(1)[:, None] * y
    z /= np.linalg.norm(z, axis=1)[:, None]
    c = rng.uniform(0.85, 0.97, 1500)[:, None]
    w = c * y + np.sqrt(1 - c * c) * z
    for n in (10**5, 10**6, 3 * 10**6, 10**7, 3 * 10**7, 10**8, 3 * 10**8, 10**9, 10**12):
        m, tables, probes = V.shape_for(n)
        a, b = V.bucket_keys(y, m, 1.5, tables, probes, 7), V.bucket_keys(w, m, 1.5, tables, probes, 7)
        hit = (a == b[:, :1]).any((0, 1)) | (b == a[:, :1]).any((0, 1))
        assert hit.mean() >= 0.8, (n, hit.mean())
    assert V.shape_for(10**12) == V.SHAPES[-1]


def on_disk(dirs):
    total = 0
    for d in dirs:
        for p in Path(d).rglob("*"):
            try:
                total += p.stat().st_size if p.is_file() else 0
            except OSError:
                pass
    return total


def test_neighbours_bound_their_disk(spark, monkeypatch):
    """Visits of the probes are many times the vectors; a slice of them at a time is on disk, and slices change nothing."""
    vecs = cluster(np.random.default_rng(9), 12_000, 4000)
    vecs = make(spark, [(k, np.rint(v * 64) / 64) for k, v in vecs] + [("copy", np.rint(vecs[0][1] * 64) / 64)]).repartition(4).cache()
    vecs.count()
    whole = {(r.key, r.neighbour, r.cosine, r.rank) for r in V.neighbours(vecs, tables=3).collect()}
    monkeypatch.setattr(V, "SLICE_BYTES", 3e6)
    monkeypatch.setattr(V, "SLICE_BYTES_EACH", 90)
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())
    dirs = [d.getPath() for d in dirs]
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(2)
    before, peak, over = on_disk(dirs), [0], threading.Event()

    def watch():
        while not over.wait(0.05):
            peak[0] = max(peak[0], on_disk(dirs))

    t = threading.Thread(target=watch)
    t.start()
    got = {(r.key, r.neighbour, r.cosine, r.rank) for r in V.neighbours(vecs, tables=3).collect()}
    over.set()
    t.join()
    assert len(got) > 20_000 and got == whole
    assert peak[0] - before < 12e6, (before, peak)  # all visits at once: 27 MB


def test_squeezed_vectors_are_the_same():
    rng = np.random.default_rng(2)
    for v in (rng.standard_normal((50, 64)), np.rint(rng.standard_normal((3000, 64)) * 8) / 8, np.full((1, 64), -0.5), np.zeros((0, 64))):
        assert (V.unsqueeze(V.squeeze(v), 64) == v).all()
    assert len(V.squeeze(np.rint(rng.standard_normal((3000, 64)) * 8) / 8)) < 3000 * 70
