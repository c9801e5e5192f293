"""Evaluation passages inside a corpus: SimHash windows, multi-index Hamming blocks, exact verification.

A passage of at least ``MIN_WORDS`` consecutive words of an evaluation sentence, of which at most
one in ``EDIT_EVERY`` is replaced, dropped or added, always keeps a run of ``WINDOW`` words intact
(12 words with 2 edits leave 10 words in 3 runs; longer passages keep longer ones). So the windows
are of that size, and the method is lossless for every passage asked for:

1. Fingerprints: a 64-bit SimHash per window of the evaluation sentences and of the whole corpus
   text, over its words weighted by rarity among the evaluation sentences.
2. Candidates: 64 bits in RADIUS + 1 blocks; two fingerprints within RADIUS bits agree on a block,
   so looking each block up finds all of them.
3. Each candidate's windows are compared exactly as weighted word sets; the survivors of a document
   and sentence name a region of the text.
4. A region is decided by exact word alignment (edit distance over all spans of the sentence).

The windows have 4 words and not the size of an item, because two edits in 12 words move a 64-bit
SimHash by about 12 bits; blocks for that radius would be of four or five bits and select nothing.
Of windows that are intact, the fingerprints are equal: radius 3 adds candidates, no passages.

The evaluation set is stated data. It is read in blocks of about ``BLOCK_WORDS`` words, one pass over
the corpus per block; what a block finds is written before the next one is read, so driver and
executors hold one block, whatever the size of the set.

Words are compared without case, accents (umlauts also spelled out), punctuation and mark-up.
Defined results: null, empty and blank texts hold nothing; null items, paragraphs and sentences are
skipped; sentences below 12 words have no passage; repeated rows give one row; other columns are
ignored; an empty corpus or evaluation set gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from .metricjoin import objects

MIN_WORDS = 12
EDIT_EVERY = 6
WINDOW = 4
RADIUS = 3
BLOCK_WORDS = 2_000_000
#: Corpus words that a task works off together.
WORK_WORDS = 40_000
#: Weighted share of words that two candidate windows must have in common.
SHINGLE_SHARE = 0.7

_MARKUP = re.compile(r"<[/!?a-zA-Z][^<>]*>|&(?:[a-zA-Z]{2,8}|#\d{1,6});|\[\d{1,4}\]|\]\([^()\s]+\)|[\u00ad\u200b-\u200f\u2060\ufeff]")
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐‑]\s*\n?\s*(?=[^\W\d_])")
_ACCENT = re.compile("[\u0300-\u036f\u0483-\u0489\u0591-\u05bd\u0610-\u061a\u064b-\u065f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
_WORD = re.compile(r"[^\W_]+")
_SPELLED = re.compile("ae|oe|ue")


def _first(m: re.Match) -> str:
    return m[0][0]


def words(text: str) -> list[str]:
    """Comparable words of a text."""
    t = _HYPHEN.sub("", _MARKUP.sub(lambda m: "" if m[0][0] in "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff" else " ", text))
    t = unicodedata.normalize("NFKD", t.casefold())
    t = _ACCENT.sub("", t) if not t.isascii() else t
    t = re.sub(r"(?<=\w)['’](?=\w)", "", t).replace("ø", "o").replace("æ", "a").replace("œ", "o")
    return _WORD.findall(_SPELLED.sub(_first, t))


class Index:
    """The evaluation sentences of one block: words, fingerprints, and a table per Hamming block."""

    def __init__(self, sentences: list[tuple[list[str], list[str]]]):
        self.items = [i for _, i in sentences]
        self.ids: dict[str, int] = {}
        seen: dict[str, int] = {}
        for ws, _ in sentences:
            for w in ws:
                seen[w] = seen.get(w, 0) + 1
        self.weight_of = {w: 1.0 / (1.0 + np.log1p(n)) for w, n in seen.items()}
        self.sent = [np.array([self.word(w) for w in ws], np.int64) for ws, _ in sentences]
        self.known = len(self.ids)
        self.vectors = np.stack([self._vector(w) for w in self.ids]).astype(np.float32) if self.ids else np.zeros((0, 64), np.float32)
        self.weights = np.array([self.weight_of[w] for w in self.ids], np.float32)
        at = [(s, j) for s, ids in enumerate(self.sent) for j in range(len(ids) - WINDOW + 1)]
        self.at = np.array(at, np.int64).reshape(-1, 2)
        self.prints = np.concatenate([self.fingerprints(ids, self.vectors) for ids in self.sent]) if self.sent else np.zeros(0, np.uint64)
        self.wins = np.concatenate([np.lib.stride_tricks.sliding_window_view(ids, WINDOW) for ids in self.sent]) if self.sent else np.zeros((0, WINDOW), np.int64)
        bits = 64 // (RADIUS + 1)
        self.tables = []
        for b in range(RADIUS + 1):
            part = ((self.prints >> np.uint64(b * bits)) & np.uint64((1 << bits) - 1)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            self.tables.append((b * bits, np.searchsorted(part[order], np.arange((1 << bits) + 1)), order))

    def word(self, w: str) -> int:
        return self.ids.setdefault(w, len(self.ids))

    def _vector(self, w: str) -> np.ndarray:
        bits = np.unpackbits(np.frombuffer(xxhash.xxh64_digest(w), np.uint8)).astype(np.float32)
        return (2 * bits - 1) * np.float32(self.weight_of.get(w, 1.0))

    @staticmethod
    def fingerprints(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        n = len(ids) - WINDOW + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        v = vectors[ids]
        s = sum(v[k : k + n] for k in range(1, WINDOW)) + v[:n]
        return np.packbits(s > 0, axis=1, bitorder="little").view(np.uint64).ravel()

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(corpus window, evaluation window) pairs within RADIUS bits."""
        left, right = [], []
        for shift, starts, order in self.tables:
            part = ((prints >> np.uint64(shift)) & np.uint64(len(starts) - 2)).astype(np.int64)
            lo, n = starts[part], starts[part + 1] - starts[part]
            a = np.repeat(np.arange(len(prints)), n)
            first = np.repeat(lo - (np.cumsum(n) - n), n)
            b = order[first + np.arange(len(a))]
            ok = np.bitwise_count(prints[a] ^ self.prints[b]) <= RADIUS
            left.append(a[ok]), right.append(b[ok])
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.concatenate(left) * max(1, len(self.prints)) + np.concatenate(right))
        return both // max(1, len(self.prints)), both % max(1, len(self.prints))


def holds(sent: np.ndarray, region: np.ndarray) -> bool:
    """Whether the region holds a span of the sentence, 12 words or more, with one edit in six words at most.

    The span's first and last words stand in the region as they are: a borrowing of fewer words is
    not made longer by calling its neighbours edits.
    """
    n, far = len(sent), 1 << 20
    starts = np.arange(n - MIN_WORDS + 1)
    if not len(starts) or not len(region):
        return False
    steps = np.arange(len(region) + 1)
    row = np.full((len(starts), len(region) + 1), far, np.int32)
    row[:, 1:][sent[starts][:, None] == region[None, :]] = 0  # spans begin at a word in place
    row = np.minimum.accumulate(row - steps, axis=1) + steps
    for length in range(2, n + 1):
        live = starts + length <= n
        w = sent[np.minimum(starts + length - 1, n - 1)]
        same = w[:, None] == region[None, :]
        if length >= MIN_WORDS:
            best = np.where(same, row[:, :-1], far).min(1)
            if (live & (best <= length // EDIT_EVERY)).any():
                return True
        new = row + 1
        np.minimum(new[:, 1:], row[:, :-1] + ~same, out=new[:, 1:])
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return False


def enough(sent: np.ndarray, ids: np.ndarray, first: int, end: int, low: int, high: int) -> bool:
    """Whether a span of 12 words or more could have edits few enough, for candidates on the diagonals low to high.

    A word of the sentence that stands in place does so within as many words of the candidate's
    diagonal as there are edits. Counting places that have their word there bounds the edits from
    below, so no passage is lost.
    """
    n = len(sent)
    slack = n // EDIT_EVERY
    at = np.arange(n)[:, None] + np.arange(low - slack, high + slack + 1)[None, :]
    there = ((ids[np.clip(at, first, end - 1)] == sent[:, None]) & (at >= first) & (at < end)).any(1)
    missing = np.concatenate([[0], np.cumsum(~there)])
    length = np.arange(n + 1)[None, :] - np.arange(n + 1)[:, None]
    return bool(((missing[None, :] - missing[:, None] <= length // EDIT_EVERY) & (length >= MIN_WORDS)).any())


def _found_in(texts: list[list[str]], index: Index) -> list[set[int]]:
    """Per text, the sentences of the index of which its words hold a passage. Texts are worked off together."""
    extra: dict[str, int] = {}
    flat: list[int] = []
    for ws in texts:
        for w in ws:
            i = index.ids.get(w)
            if i is None:
                i = extra.get(w)
                if i is None:
                    i = extra[w] = index.known + len(extra)
            flat.append(i)
    ids = np.array(flat, np.int64)
    ends = np.cumsum([len(ws) for ws in texts])
    doc_of = np.repeat(np.arange(len(texts)), [len(ws) for ws in texts])
    found: list[set[int]] = [set() for _ in texts]
    if len(ids) < WINDOW:
        return found
    digests = np.frombuffer(b"".join(xxhash.xxh64_digest(w) for w in extra), np.uint8).reshape(-1, 8)
    vectors = np.concatenate([index.vectors, 2 * np.unpackbits(digests, axis=1).astype(np.float32) - 1])
    a, b = index.candidates(index.fingerprints(ids, vectors))
    inside = doc_of[a] == doc_of[a + WINDOW - 1]
    a, b = a[inside], b[inside]
    if not len(a):
        return found
    # Exact weighted word-set similarity of the two windows.
    mine = ids[a[:, None] + np.arange(WINDOW)]
    theirs = index.wins[b]
    shared = (theirs[:, :, None] == mine[:, None, :]).any(2)
    wt = index.weights[theirs]
    own = np.where(mine < index.known, index.weights[np.minimum(mine, index.known - 1)], 1.0)
    ok = (wt * shared).sum(1) >= SHINGLE_SHARE * np.maximum(wt.sum(1), own.sum(1))
    a, b = a[ok], b[ok]
    if not len(a):
        return found
    s, j, doc = index.at[b, 0], index.at[b, 1], doc_of[a]
    order = np.lexsort((a - j, s, doc))
    a, s, j, doc = a[order], s[order], j[order], doc[order]
    diag = a - j
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (s[1:] != s[:-1]) | (diag[1:] - diag[:-1] > 5)])
    heads = np.flatnonzero(new)
    for lo, hi in zip(heads, [*heads[1:], len(a)]):
        d, k = int(doc[lo]), int(s[lo])
        if k in found[d]:
            continue
        sent = index.sent[k]
        pad = len(sent) // EDIT_EVERY + 2
        first = 0 if d == 0 else int(ends[d - 1])
        region = ids[max(first, int(diag[lo]) - pad) : min(int(ends[d]), int(diag[hi - 1]) + len(sent) + pad)]
        if enough(sent, ids, first, int(ends[d]), int(diag[lo]), int(diag[hi - 1])) and holds(sent, region):
            found[d].add(k)
    return found


def leaked(docs: DataFrame, doc_id: str, text: str, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that hold a passage of a sentence of the item.

    ``items`` has ``item_id`` and ``sentence``; it is the stated evaluation set.
    """
    texts = spread(docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, item_id string"
    out = None
    for block, more in _blocks_of(items):
        got = texts.mapInPandas(_scan(block), schema)
        got = cut(got) if more else got  # found and written before the next block is read
        out = got if out is None else out.unionByName(got)
    return out.distinct()


def _blocks_of(items: DataFrame) -> Iterator[tuple[list, bool]]:
    """Sentences with their items in blocks of about ``BLOCK_WORDS`` words, and whether more follow; the driver holds one block."""
    rows = items.where("item_id IS NOT NULL AND sentence IS NOT NULL").select("item_id", "sentence").distinct().toLocalIterator()
    by: dict[tuple[str, ...], set[str]] = {}
    size = 0
    done = lambda: sorted((list(ws), sorted(i)) for ws, i in by.items())
    for r in rows:
        ws = tuple(words(r["sentence"]))
        if len(ws) < MIN_WORDS:
            continue
        if size > BLOCK_WORDS:
            yield done(), True
            by, size = {}, 0
        size += 0 if ws in by else len(ws)
        by.setdefault(ws, set()).add(r["item_id"])
    yield done(), False


_INDEXES: dict[int, Index] = {}


def _scan(sentences: list[tuple[list[str], list[str]]]):
    tag = xxhash.xxh64_intdigest(repr(sentences))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if tag not in _INDEXES:
            _INDEXES.clear()
            _INDEXES[tag] = Index(sentences)
        index = _INDEXES[tag]
        for df in batches:
            ids, items = [], []
            open_ids, open_words, size = [], [], 0
            rows = list(zip(df["doc_id"].tolist(), df["text"].tolist()))
            for n, (d, t) in enumerate(rows, 1):
                ws = words(t)
                if len(ws) >= MIN_WORDS - MIN_WORDS // EDIT_EVERY and index.known:
                    open_ids.append(d), open_words.append(ws)
                    size += len(ws)
                if open_ids and (size > WORK_WORDS or n == len(rows)):
                    for doc, found in zip(open_ids, _found_in(open_words, index)):
                        for item in sorted({i for s in found for i in index.items[s]}):
                            ids.append(doc), items.append(item)
                    open_ids, open_words, size = [], [], 0
            yield objects(doc_id=ids, item_id=items)

    return run


def context_sentences(qa: DataFrame) -> DataFrame:
    """(item_id, sentence) of every context paragraph."""
    return qa.select(F.col("id").alias("item_id"), F.explode("context").alias("p")).select("item_id", F.explode("p.sentences").alias("sentence"))
