"""Filling fixed-capacity containers by bound-certified repacking.

Sizes are token counts of a public tokenizer. A text above the capacity is cut into pieces of
exactly one capacity and a rest; every other text stays whole.

1. Items are dealt to partitions of about ``PART_ITEMS`` items by a hash of their key, and each
   partition is packed by best-fit decreasing.
2. Dual-feasible-function bounds certify each partition: it closes the greatest number k of its
   fullest containers for which the bound of the items in them is k, so that no packing whatever puts
   these items into fewer. A partition whose count meets its bound closes all its containers, but for
   one that is not nearly full; one with a gap keeps open those beyond what the bound certifies.
3. The items of open containers are exchanged: pooled over all partitions, dealt anew to far fewer
   partitions, and packed again.
4. Rounds end when the count of a round meets the dual-feasible bound of all its items, or one
   partition holds the whole pool.

A round moves only the items of open containers, so the rounds after the first handle a small and
falling share. No partition ever holds more than its dealt share; nothing is gathered at the driver
but counts, and the number of items of each size, of which there are at most ``capacity``.

Defined results: null, empty and all-blank texts that give no token need no container and give no
row; repeated rows of one doc_id count once; equal sizes are taken in key order, so a rerun gives
the same containers; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, once_per, spread
from .metricjoin import objects

CAPACITY = 2048
PART_ITEMS = 4096
#: Later rounds deal the pool to this many times fewer partitions.
FEWER = 16
#: A container filled to this share is nearly full and not worth an exchange.
NEARLY = 0.995
#: Folder of the public tokenizers' files.
TOKENIZER = os.environ.get("QUILL_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(table: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, table.splitlines())}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of every text with at least one character that is not blank.

    The tokenizer's file (below 1 MB) is read here, once, and broadcast, so executors need none.
    """
    typ = docs.schema["doc_id"].dataType.simpleString()
    with open(tokenizer, "rb") as f:
        table = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(table.value)
        for df in batches:
            yield objects(doc_id=df["doc_id"].tolist(), tokens=np.array([len(enc.encode_ordinary(t)) for t in df["text"]], np.int64))

    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text").where(F.col("text").rlike(r"(?U)\S"))
    return spread(once_per(rows, "doc_id")).mapInPandas(run, f"doc_id {typ}, tokens bigint")


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers that any packing of the sizes needs, by dual feasible functions.

    The greatest of: the sum bound; for every threshold the bound that rounds large items up and
    drops small ones (Martello and Toth's L2 as a dual feasible function); and the step functions
    u_k of Fekete and Schepers for k up to 50.
    """
    return histogram_bound(np.bincount(sizes, minlength=capacity + 1).astype(np.int64), capacity)


def histogram_bound(hist: np.ndarray, capacity: int) -> int:
    """The same from the number of items of each size."""
    size = np.arange(capacity + 1, dtype=np.int64)
    n, s = np.concatenate([[0], np.cumsum(hist)]), np.concatenate([[0], np.cumsum(hist * size)])
    half = capacity // 2
    best = -(-int(s[-1]) // capacity)
    for a in range(half + 1):
        big = n[capacity + 1] - n[capacity - a + 1]
        mid_n, mid_s = n[capacity - a + 1] - n[half + 1], s[capacity - a + 1] - s[half + 1]
        low = s[half + 1] - s[a]
        best = max(best, int(big + mid_n + max(0, -(-(low - (mid_n * capacity - mid_s)) // capacity))))
    for k in range(1, 51):
        up = (k + 1) * size
        u = np.where(up % capacity == 0, size * k, (up // capacity) * capacity)  # k times u_k
        best = max(best, -(-int((hist * u).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item: items in falling size go to the fullest container with room."""
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(sizes), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, opened = 0, 0  # bit r: some container has r left
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                mask &= ~(1 << room)
        else:
            b, room = opened, capacity
            opened += 1
        out[i] = b
        rest = room - size
        if rest:
            with_room[rest].append(b)
            mask |= 1 << rest
    return out


def certified(sizes: np.ndarray, box: np.ndarray, fill: np.ndarray, capacity: int) -> np.ndarray:
    """The fullest containers, as many as a dual-feasible bound shows to be needed for the items in them.

    The sum bound shows it as long as the empty space adds up to less than one container; beyond
    that the greatest of the bounds is asked, first for all containers, then by halving.
    """
    order = np.argsort(-fill, kind="stable")
    place = np.empty(len(fill), np.int64)
    place[order] = np.arange(len(fill))
    shows = lambda k: lower_bound(sizes[place[box] < k], capacity) >= k
    low = int(np.searchsorted(np.cumsum(capacity - fill[order]), capacity, side="left"))
    if low < len(fill):
        if shows(len(fill)):
            low = len(fill)
        high = len(fill)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if shows(mid) else (low, mid)
    return order[:low]


def _pack(capacity: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["doc_id", "piece"], kind="stable")
        sizes = g["tokens"].to_numpy(np.int64)
        box = best_fit_decreasing(sizes, capacity)
        fill = np.bincount(box, weights=sizes).astype(np.int64)
        kept = certified(sizes, box, fill, capacity)
        if len(kept) and fill[kept[-1]] < NEARLY * capacity:
            kept = kept[:-1]  # the emptiest may yet take items of other partitions
        closed = np.zeros(len(fill), bool)
        closed[kept] = True
        n = len(g)
        return objects(
            doc_id=g["doc_id"].tolist(), piece=g["piece"].to_numpy(np.int32), tokens=sizes, part=g["part"].to_numpy(np.int64), box=box, fill=fill[box], closed=closed[box],
            n_closed=np.full(n, len(kept), np.int64), closed_bound=np.full(n, lower_bound(sizes[closed[box]], capacity), np.int64), boxes=np.full(n, len(fill), np.int64), bound=np.full(n, lower_bound(sizes, capacity), np.int64),
        )

    return run


def containers(sizes: DataFrame, capacity: int = CAPACITY, part_items: int = PART_ITEMS, max_rounds: int = 12) -> DataFrame:
    """(doc_id, tokens) -> (doc_id, piece, tokens, container, fill, round, part_boxes, part_bound).

    ``piece`` is 0 for whole texts and for the first piece of a cut one. ``part_boxes`` containers
    were closed in this partition and round, and no packing of their items needs fewer than ``part_bound``.
    """
    typ = sizes.schema["doc_id"].dataType.simpleString()
    n_full = F.floor(F.col("tokens") / capacity).cast("int")
    rest = F.col("tokens") - n_full * capacity
    cuts = F.concat(F.array_repeat(F.lit(capacity).cast("bigint"), n_full), F.when(rest > 0, F.array(rest.cast("bigint"))).otherwise(F.array().cast("array<bigint>")))
    items = cut(sizes.where("tokens > 0").select("doc_id", F.posexplode(cuts).alias("piece", "tokens")))
    full = items.where(F.col("tokens") == capacity).select("doc_id", "piece", "tokens", F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("container"), F.lit(capacity).cast("bigint").alias("fill"), F.lit(0).alias("round"), F.lit(1).cast("bigint").alias("part_boxes"), F.lit(1).cast("bigint").alias("part_bound"))
    pool = items.where(F.col("tokens") < capacity).select("doc_id", "piece", "tokens")
    n = pool.count()
    done = full
    n_parts = max(1, -(-n // part_items))
    schema = f"doc_id {typ}, piece int, tokens bigint, part bigint, box bigint, fill bigint, closed boolean, n_closed bigint, closed_bound bigint, boxes bigint, bound bigint"
    for r in range(1, max_rounds + 1):
        if n == 0:
            break
        dealt = pool.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", F.lit(r)), F.lit(n_parts)))
        packed = cut(dealt.groupBy("part").applyInPandas(_pack(capacity), schema))
        last = n_parts == 1 or r == max_rounds
        if not last:
            # The bound of all items of the round: partitions that meet it together have nothing to gain.
            hist = np.zeros(capacity + 1, np.int64)
            for row in packed.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect():  # a row per size, at most ``capacity``
                hist[row["tokens"]] = row["n"]
            used = packed.select("part", "boxes").distinct().agg(F.sum("boxes")).first()[0]
            last = used <= histogram_bound(hist, capacity)
        closed = F.lit(True) if last else F.col("closed")
        boxes, bound = (F.col(x if last else y) for x, y in (("boxes", "n_closed"), ("bound", "closed_bound")))
        done = done.unionByName(
            packed.where(closed).select("doc_id", "piece", "tokens", F.concat_ws("-", F.lit(r), "part", "box").alias("container"), "fill", F.lit(r).alias("round"), boxes.alias("part_boxes"), bound.alias("part_bound"))
        )
        if last:
            break
        pool = packed.where(~closed).select("doc_id", "piece", "tokens")
        n = pool.count()
        n_parts = max(1, min(-(-n_parts // FEWER), -(-n // part_items)))
    return done


def packing_certificate(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: items, containers, tokens, the dual-feasible lower bound over all items, the gap, the share filled, rounds, and
    of the partitions that closed containers (one per round and partition) how many there are and how many are certified.

    The bound over all items needs only the number of items per size, which has at most
    ``capacity`` rows however many items there are.
    """
    hist = packed.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"))

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = np.zeros(capacity + 1, np.int64)
        for df in batches:
            np.add.at(h, df["tokens"].to_numpy(np.int64), df["n"].to_numpy(np.int64))
        yield pd.DataFrame({"lower_bound": np.array([histogram_bound(h, capacity)], np.int64)})

    low = hist.coalesce(1).mapInPandas(bound, "lower_bound bigint")
    tot = packed.agg(F.count(F.lit(1)).alias("items"), F.count_distinct("container").alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    parts_ = packed.where("round > 0").select("round", F.split("container", "-")[1].alias("part"), "part_boxes", "part_bound").distinct()
    seen = parts_.agg(F.coalesce(F.max("round"), F.lit(0)).alias("rounds"), F.count(F.lit(1)).alias("partitions"), F.count_if(F.col("part_boxes") <= F.col("part_bound")).alias("certified"))
    tot = tot.withColumn("_k", F.lit(1)).join(seen.withColumn("_k", F.lit(1)), "_k").drop("_k")
    both = tot.withColumn("_k", F.lit(1)).join(low.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return both.withColumn("gap", F.col("containers") - F.col("lower_bound")).withColumn("filled", F.col("tokens") / (F.greatest("containers", F.lit(1)) * capacity))
