"""Exact radius joins of short strings under Levenshtein distance by metric-space partitioning.

The radius r(x) of a string depends on its length (``radius_of``), and a pair may be as far apart
as the shorter of the two allows. Levenshtein distance is a true metric, so the triangle inequality
bounds where partners can be. Every string is at home in the cell of its nearest pivot; R(q) is the
greatest distance from a pivot q to a string at home there. If y is at home in q and d(x, y) <= r(x),
then d(x, q) <= r(x) + R(q). So a string is sent home and to every cell with that property, and the
pair is found in the home cell of its smaller string, once.

Strings compare within a block only (a column of the caller). Pivots are chosen per block so that
they are more than ``PIVOT_GAP`` apart and every string they are chosen from is that near to one:
each spelling of a name falls to the same pivot, other names lie far beyond r + R, and cells hold few
strings. They are chosen from at most ``PIVOT_SAMPLE`` strings of a block, those of least hash: a
bounded, documented sample on which only the speed depends; R(q) is taken over all strings.

Distances are Myers' bit-vectors over whole columns of pairs. Before that, pairs are sorted out by a
bound: an edit takes one letter away and adds one, so what one string has of letters beyond the other
is never more than their distance. Both ways are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, parts

PIVOT_SAMPLE = 16_384
#: Pivots of a block are farther apart than this.
PIVOT_GAP = 4
#: Strings of a block that one task places.
CHUNK_ROWS = 4096
#: Pairs that are measured together.
PAIRS = 200_000


def objects(**cols) -> pd.DataFrame:
    """A frame whose lists are plain object columns, which convert to single Arrow arrays."""
    return pd.DataFrame({k: v if isinstance(v, np.ndarray) else pd.Series(v, dtype=object) for k, v in cols.items()})


def encode(strings: list[str]) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """Strings as a padded matrix of symbol codes, with lengths and the code of each symbol."""
    table: dict[str, int] = {}
    lens = np.array([len(s) for s in strings], np.int32)
    out = np.zeros((len(strings), max(1, int(lens.max(initial=1)))), np.int32)
    for i, s in enumerate(strings):
        for j, c in enumerate(s):
            out[i, j] = table.setdefault(c, len(table) + 1)
    return out, lens, table


def distances(p: str, codes: np.ndarray, lens: np.ndarray, table: dict[str, int]) -> np.ndarray:
    """Levenshtein distance of ``p`` to each encoded string."""
    m = len(p)
    if m == 0:
        return lens.astype(np.int32)
    if m > 63:
        return _distances_long(p, codes, lens, table)
    peq = np.zeros(len(table) + 2, np.uint64)
    for i, c in enumerate(p):
        peq[table.get(c, len(table) + 1)] |= np.uint64(1 << i)
    one, top = np.uint64(1), np.uint64(m - 1)
    pv = np.full(len(lens), (1 << m) - 1, np.uint64)
    mv = np.zeros(len(lens), np.uint64)
    score = np.full(len(lens), m, np.int32)
    for j in range(int(lens.max(initial=0))):
        live = lens > j
        eq = peq[codes[:, j]]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        score += np.where(live, ((ph >> top) & one).astype(np.int32) - ((mh >> top) & one).astype(np.int32), 0)
        ph = (ph << one) | one
        mh = mh << one
        pv = mh | ~(xv | ph)
        mv = ph & xv
    return score


def _distances_long(p: str, codes: np.ndarray, lens: np.ndarray, table: dict[str, int]) -> np.ndarray:
    """The same by rows of the dynamic programme, for patterns beyond a machine word."""
    pc = np.array([table.get(c, -1) for c in p])
    out = np.empty(len(lens), np.int32)
    steps = np.arange(len(pc) + 1)
    for k, n in enumerate(lens):
        row = steps.copy()
        for j in range(n):
            new = np.minimum(row[1:] + 1, row[:-1] + (pc != codes[k, j]))
            new = np.concatenate(([row[0] + 1], new))
            row = np.minimum.accumulate(new - steps) + steps
        out[k] = row[-1]
    return out


def radius_of(length: int) -> int:
    """Edits allowed between two strings of which the shorter has this length."""
    return 3 if length >= 11 else 2 if length >= 7 else 1 if length >= 4 else 0


MAX_RADIUS = 3
_RADIUS = np.array([radius_of(n) for n in range(12)], np.int32)


def radii(lens: np.ndarray) -> np.ndarray:
    return _RADIUS[np.minimum(lens, len(_RADIUS) - 1)]


class Strings:
    """Strings with what the join needs of them: codes, lengths, and two bits of the counts of each letter class."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        self.codes, self.lens, self.table = encode(strings)
        # Up to two of each of 31 classes of symbols, in unary, as 62 bits.
        self.bits = np.zeros(len(strings), np.uint64)
        n, width = self.codes.shape
        symbol = np.zeros(len(self.table) + 1, np.int64)
        for c, i in self.table.items():
            symbol[i] = ord(c) % 31
        once, twice = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for j in range(width):
            bit = np.where(self.lens > j, np.uint64(1) << symbol[self.codes[:, j]].astype(np.uint64), np.uint64(0))
            twice |= once & bit
            once |= bit
        self.bits = once | (twice << np.uint64(31))
        self.peq: np.ndarray | None = None

    def at_most(self, a: np.ndarray, b: np.ndarray, other: Strings | None = None) -> np.ndarray:
        """A lower bound of the distance of the a-th string to the b-th (of ``other``)."""
        other = other or self
        x, y = self.bits[a], other.bits[b]
        return np.maximum(np.bitwise_count(x & ~y), np.bitwise_count(y & ~x)).astype(np.int32)


def pair_distances(xs: Strings, a: np.ndarray, ys: Strings, b: np.ndarray) -> np.ndarray:
    """Levenshtein distance of each pair (a-th of xs, b-th of ys), all pairs at once."""
    out = np.empty(len(a), np.int32)
    for lo in range(0, len(a), PAIRS):
        out[lo : lo + PAIRS] = _pair_distances(xs, a[lo : lo + PAIRS], ys, b[lo : lo + PAIRS])
    return out


def _pair_distances(xs: Strings, a: np.ndarray, ys: Strings, b: np.ndarray) -> np.ndarray:
    m, n = xs.lens[a], ys.lens[b]
    long = (m > 63) | (m == 0)
    out = np.where(m == 0, n, 0).astype(np.int32)
    for i in np.flatnonzero(m > 63):
        k = int(b[i])
        out[i] = _distances_long(xs.strings[int(a[i])], ys.codes[k : k + 1], ys.lens[k : k + 1], ys.table)[0]
    ok = np.flatnonzero(~long)
    if not len(ok):
        return out
    a, b, m, n = a[ok], b[ok], m[ok], n[ok]
    if xs.peq is None:
        # Places of each symbol in each string, by the codes of xs; the last column is for symbols it lacks.
        xs.peq = np.zeros((len(xs.strings), len(xs.table) + 2), np.uint64)
        rows = np.arange(len(xs.strings))
        for j in range(min(63, xs.codes.shape[1])):
            live = rows[xs.lens > j]
            xs.peq[live, xs.codes[live, j]] |= np.uint64(1 << j)
    if ys is not xs:
        to = np.full(len(ys.table) + 1, len(xs.table) + 1, np.int64)
        for c, i in ys.table.items():
            to[i] = xs.table.get(c, len(xs.table) + 1)
    one, top = np.uint64(1), (m - 1).astype(np.uint64)
    pv = (one << m.astype(np.uint64)) - one
    mv = np.zeros(len(a), np.uint64)
    score = m.astype(np.int32)
    for j in range(int(n.max(initial=0))):
        live = n > j
        c = ys.codes[b, j]
        eq = xs.peq[a, c if ys is xs else to[c]]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        score += np.where(live, ((ph >> top) & one).astype(np.int32) - ((mh >> top) & one).astype(np.int32), 0)
        ph = (ph << one) | one
        mh = mh << one
        pv = mh | ~(xv | ph)
        mv = ph & xv
    out[ok] = score
    return out


def near_pairs(xs: Strings, ys: Strings, most: np.ndarray, block: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, d): every pair of xs and ys with d <= most[b]; in strips, so that no matrix of all pairs exists."""
    found = []
    step = max(1, block // max(1, len(ys.strings)))
    for lo in range(0, len(xs.strings), step):
        x, y = xs.bits[lo : lo + step, None], ys.bits[None, :]
        far = np.abs(xs.lens[lo : lo + step, None] - ys.lens[None, :]) > most[None, :]
        far |= np.bitwise_count(x & ~y) > most[None, :]
        far |= np.bitwise_count(y & ~x) > most[None, :]
        a, b = np.nonzero(~far)
        a += lo
        d = pair_distances(xs, a, ys, b)
        ok = d <= most[b]
        found.append((a[ok], b[ok], d[ok]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.int32)
    return tuple(np.concatenate(x) for x in zip(*found))


def choose_pivots(strings: list[str], gap: int = PIVOT_GAP) -> list[str]:
    """Strings more than ``gap`` apart, such that every string is within it of one: the first, then the first that is far from all before."""
    strings = sorted(set(strings), key=lambda x: (len(x), x))
    xs = Strings(strings)
    a, b, _ = near_pairs(xs, xs, np.full(len(strings), gap))
    starts = np.searchsorted(a, np.arange(len(strings) + 1))  # a ascends
    free = np.ones(len(strings), bool)
    chosen = []
    for i in range(len(strings)):
        if free[i]:
            chosen.append(strings[i])
            free[b[starts[i] : starts[i + 1]]] = False
    return chosen


def _home(strings: list[str], pivots: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each string, the first of equals, and its distance."""
    xs, ps = Strings(strings), Strings(pivots)
    cell, dist = np.full(len(strings), -1, np.int64), np.full(len(strings), 1 << 20, np.int32)
    open_ = np.arange(len(strings))
    reach = PIVOT_GAP
    while len(open_):  # twice as far until every string has met a pivot
        some = xs if len(open_) == len(strings) else Strings([strings[i] for i in open_])
        a, b, d = near_pairs(some, ps, np.full(len(pivots), reach))
        order = np.lexsort((b, d, a))
        a, b, d = a[order], b[order], d[order]
        first = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool)
        cell[open_[a[first]]], dist[open_[a[first]]] = b[first], d[first]
        open_ = open_[cell[open_] < 0]
        reach *= 2
    return cell, dist


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (block, cell) -> pairs within their radius, from the home cell of the smaller string; many cells at a time."""
    held: list[pd.DataFrame] = []
    size = 0

    def work(df: pd.DataFrame) -> pd.DataFrame:
        strings, home = df["s"].tolist(), df["home"].to_numpy(bool)
        key = pd.factorize(pd.MultiIndex.from_arrays([df["block"], df["cell"]]))[0]
        xs = Strings(strings)
        most = radii(xs.lens)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        end = np.repeat(starts[1:], np.diff(starts))
        left, right, dist = [], [], []
        width = end - np.arange(len(strings)) - 1  # later rows of the same cell
        total = np.concatenate([[0], np.cumsum(width)])
        lo = 0
        while lo < len(strings):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + 4 * PAIRS, side="right")) - 1)
            n = width[lo:hi]
            a = np.repeat(np.arange(lo, hi), n)
            b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + a + 1
            limit = np.minimum(most[a], most[b])
            ok = (home[a] | home[b]) & (np.abs(xs.lens[a] - xs.lens[b]) <= limit)
            a, b, limit = a[ok], b[ok], limit[ok]
            ok = xs.at_most(a, b) <= limit
            a, b, limit = a[ok], b[ok], limit[ok]
            d = pair_distances(xs, a, xs, b)
            ok = d <= limit
            left.append(a[ok]), right.append(b[ok]), dist.append(d[ok])
            lo = hi
        blocks = df["block"].tolist()
        out = ([], [], [], [])
        for i, j, x in zip(np.concatenate(left).tolist(), np.concatenate(right).tolist(), np.concatenate(dist).tolist()):
            lo, hi = (i, j) if strings[i] < strings[j] else (j, i)
            if home[lo]:
                for col, v in zip(out, (blocks[lo], strings[lo], strings[hi], x)):
                    col.append(v)
        return objects(block=out[0], a=out[1], b=out[2], d=np.array(out[3], np.int32))

    for df in batches:
        if not len(df):
            continue
        held.append(df)
        size += len(df)
        if size < 20_000:
            continue
        whole = pd.concat(held, ignore_index=True)
        # The last cell may go on in the next batch.
        last = (whole["block"] == whole["block"].iloc[-1]) & (whole["cell"] == whole["cell"].iloc[-1])
        if not last.all():
            yield work(whole[~last])
        held = [whole[last]]
        size = len(held[0])
    if held and size:
        yield work(pd.concat(held, ignore_index=True))


def placed(strings: DataFrame, chunk_rows: int = CHUNK_ROWS, pivot_sample: int = PIVOT_SAMPLE) -> DataFrame:
    """(block, s) distinct rows -> (block, cell, s, home): each string in its home cell and in every cell that may hold a partner's home."""
    spark = strings.sparkSession
    n = parts(spark)
    strings = cut(strings.select("block", "s").where("block IS NOT NULL AND s IS NOT NULL AND s <> ''"))
    sizes = strings.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    # Few strings of least hash per block: a top-k that never gathers the block.
    sample = strings.select("block", "s", F.expr("row_number() OVER (PARTITION BY block ORDER BY xxhash64(s), s)").alias("r")).where(F.col("r") <= pivot_sample)
    pivots = cut(sample.groupBy("block").applyInPandas(lambda key, g: objects(block=[key[0]] * len(p := choose_pivots(g["s"].tolist())), cell=np.arange(len(p), dtype=np.int32), p=p), "block string, cell int, p string"))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / chunk_rows)).cast("int")
    dealt = sizes.select("block", chunks.alias("chunks"))
    rows = strings.join(dealt, "block").select("block", F.pmod(F.xxhash64("s"), F.col("chunks")).cast("int").alias("chunk"), "s")
    per_chunk = lambda df: df.join(dealt, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    def find_home(key, g: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("cell")
        cell, d = _home(g["s"].tolist(), p["p"].tolist())
        return objects(block=[key[0]] * len(g), s=g["s"].tolist(), cell=p["cell"].to_numpy(np.int32)[cell], d=d)

    at_home = cut(rows.groupBy("block", "chunk").cogroup(per_chunk(pivots).groupBy("block", "chunk")).applyInPandas(find_home, "block string, s string, cell int, d int"))
    reach = at_home.groupBy("block", "cell").agg(F.max("d").cast("int").alias("reach"))

    def send(key, g: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        strings, cells = g["s"].tolist(), g["cell"].to_numpy(np.int32)
        p = p.sort_values("cell")
        xs = Strings(strings)
        own = radii(xs.lens)
        a, b, d = near_pairs(xs, Strings(p["p"].tolist()), p["reach"].to_numpy(np.int32) + int(own.max(initial=0)))
        ok = d <= own[a] + p["reach"].to_numpy(np.int32)[b]
        to = p["cell"].to_numpy(np.int32)[b]
        ok &= to != cells[a]
        return objects(
            block=[key[0]] * (len(strings) + int(ok.sum())), cell=np.concatenate([cells, to[ok]]).astype(np.int32), s=strings + [strings[i] for i in a[ok]], home=np.concatenate([np.ones(len(strings), bool), np.zeros(int(ok.sum()), bool)])
        )

    homes = at_home.join(dealt, "block").select("block", F.pmod(F.xxhash64("s"), F.col("chunks")).cast("int").alias("chunk"), "s", "cell")
    reached = per_chunk(pivots.join(reach, ["block", "cell"]))
    return homes.groupBy("block", "chunk").cogroup(reached.groupBy("block", "chunk")).applyInPandas(send, "block string, cell int, s string, home boolean").repartition(n, "block", "cell")


def radius_pairs(strings: DataFrame, chunk_rows: int = CHUNK_ROWS, pivot_sample: int = PIVOT_SAMPLE) -> DataFrame:
    """(block, s) distinct rows -> (block, a, b, d): every pair a < b of a block within ``radius_of``.

    Null or empty strings have no partner. An empty input gives no rows.
    """
    return placed(strings, chunk_rows, pivot_sample).sortWithinPartitions("block", "cell").mapInPandas(_cells, "block string, a string, b string, d int")


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(a, b) undirected edges -> (node, comp): the least node of each connected component.

    Min-label propagation with pointer jumping: each round takes the least label of the
    neighbours, then the label of the label, so rounds grow with the logarithm of the diameter
    on chains. Every round is checkpointed in the shared folder. Labels that do not settle raise an error.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    label = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")).select(F.col("a").alias("node"), "l"))
    for _ in range(max_rounds):
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("l").alias("m"))
        low = label.join(near, label.node == near.a, "left").select("node", F.least("l", "m").alias("l"), F.col("l").alias("old"))
        jump = low.alias("x").join(low.select(F.col("node").alias("jn"), F.col("l").alias("jl")).alias("y"), F.col("x.l") == F.col("y.jn"), "left")
        new = cut(jump.select("node", F.least("l", F.coalesce("jl", "l")).alias("l"), "old"))
        still = new.where("l <> old").isEmpty()
        label = new.select("node", "l")
        if still:
            return label.withColumnRenamed("l", "comp")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
