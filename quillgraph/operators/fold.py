"""The sequential part of linking: unseen keys of one entity type, one after the other, against the entities so far.

Only the first row of a key needs the order: it merges into the nearest entity or makes a new one,
and all later rows of the key follow it. Keys are taken in blocks; a block meets the entities before
it in one matrix product, and its own in another, so only the choice itself is sequential.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import numpy as np
import pandas as pd

_NOT_WORD = re.compile(r"[^\w\s]+")
#: Keys that meet the entities before them together.
BLOCK = 512
#: Products of 4-byte numbers are within this of the exact cosines.
NEARLY = 1e-5

STATE = "type string, key string, canonical_id string, surface string, context string, score double, is_new boolean, document_id string, entity_ord int, place bigint"


def name_key(s: str) -> str:
    return " ".join(_NOT_WORD.sub(" ", s.casefold()).split())


@lru_cache(maxsize=200_000)
def _token(tok: str, dim: int) -> tuple[int, float]:
    d = hashlib.sha256(tok.encode()).digest()
    return int.from_bytes(d[:8], "big") % dim, -1.0 if d[8] % 2 else 1.0


def hashed(text: str, dim: int) -> dict[int, float]:
    """Unit feature-hash vector of a text, sparse."""
    vec: dict[int, float] = {}
    for tok in name_key(text).split() or [text or "\0"]:
        b, w = _token(tok, dim)
        vec[b] = vec.get(b, 0.0) + w
    length = math.sqrt(sum(w * w for w in vec.values()))
    if not length:
        return {len(text) % dim: 1.0}
    return {b: w / length for b, w in vec.items() if w}


def similarity(a: dict[int, float], b: dict[int, float]) -> float:
    return sum(w * b.get(k, 0.0) for k, w in a.items())


def _dense(vectors: list[dict[int, float]], dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim), np.float32)
    for i, v in enumerate(vectors):
        out[i, list(v)] = list(v.values())
    return out


class Store:
    """Entities of one type in the order in which they were made."""

    def __init__(self, dim: int):
        self.dim, self.keys, self.names = dim, {}, {}
        self.ids: list[str] = []
        self.vectors: list[dict[int, float]] = []
        self.rows = np.zeros((1024, dim), np.float32)

    def add(self, cid: str, name: str, vector: dict[int, float]) -> None:
        n = len(self.ids)
        if n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[n, list(vector)] = list(vector.values())
        self.ids.append(cid), self.vectors.append(vector)
        self.names[cid] = name

    def best(self, vector: dict[int, float], sims: np.ndarray) -> tuple[int, float] | None:
        """(place, cosine) of the nearest entity that shares a bucket, the earliest of equals; ``sims`` are near the cosines of all."""
        n = len(sims)
        if not n or not vector:
            return None
        top = float(sims.max())
        if top > NEARLY:
            some = np.flatnonzero(sims >= top - NEARLY)
        else:
            some = np.flatnonzero((self.rows[:n][:, list(vector)] != 0).any(1))
            if not len(some):
                return None
            some = some[sims[some] >= sims[some].max() - NEARLY]
        exact = [(similarity(vector, self.vectors[i]), -i) for i in some.tolist()]
        score, place = max(exact)
        return -place, score


def fold_keys(g: pd.DataFrame, state: pd.DataFrame, threshold: float, top_k: int, dim: int, tie_margin: float, tie_break) -> pd.DataFrame:
    """First rows of unseen keys of one type, and the state before them -> the state rows that they add."""
    store = Store(dim)
    state = state.sort_values("place", kind="stable")
    for cid, surface, context, new in zip(state["canonical_id"], state["surface"], state["context"], state["is_new"]):
        if new:
            store.add(cid, surface, hashed(context, dim))
    at = int(state["place"].max()) + 1 if len(state) else 0
    g = g.sort_values(["ingest_order", "document_id", "entity_ord"], kind="stable", na_position="first")
    out = []
    rows = list(zip(g["type"], g["key"], g["surface"], g["context"], g["document_id"], g["entity_ord"]))
    for lo in range(0, len(rows), BLOCK):
        block = rows[lo : lo + BLOCK]
        vectors = [hashed(r[3], dim) for r in block]
        dense = _dense(vectors, dim)
        before = len(store.ids)
        sims = store.rows[:before] @ dense.T
        own = dense @ dense.T
        made: list[int] = []
        for j, (typ, key, surface, context, doc, ord_) in enumerate(block):
            near = store.best(vectors[j], np.concatenate([sims[:, j], own[made, j]])) if top_k else None
            cid, score = (store.ids[near[0]], near[1]) if near else (None, 0.0)
            merge = cid is not None and score >= threshold
            if tie_break and cid is not None and abs(score - threshold) <= tie_margin:
                merge = str(tie_break(surface, store.names[cid], context)).strip().lower().startswith("y")
            if not merge:
                cid = "e-" + hashlib.sha256(f"el:{typ}:{key}".encode()).hexdigest()[:16]
                if cid in store.names:
                    tail = ",".join(f"{vectors[j].get(b, 0.0):.6f}" for b in range(dim))
                    cid = "e-" + hashlib.sha256(f"el:{typ}:{key}|{hashlib.sha256(tail.encode()).hexdigest()[:8]}".encode()).hexdigest()[:16]
                store.add(cid, surface, vectors[j])
                made.append(j)
            out.append((typ, key, cid, surface, context, float(score), not merge, doc, ord_, at + len(out)))
    cols = ["type", "key", "canonical_id", "surface", "context", "score", "is_new", "document_id", "entity_ord", "place"]
    return pd.DataFrame(out, columns=cols).astype({"entity_ord": "int32", "score": "float64", "is_new": "bool", "place": "int64"})
