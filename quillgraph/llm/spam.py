"""Keyword-stuffed pages and link lists, by coherence of neighbouring words.

1. Corpus counts: in how many distinct documents a word, and a pair of neighbouring words, occurs
   (later ingests of a document count once). Counting documents, not occurrences, keeps a page that
   repeats a phrase a thousand times from vouching for it.
2. The mean pointwise mutual information of a line's neighbouring pairs, leaving its own document
   out: a pair that no other document holds gets the floor.
3. A line whose pairs are incoherent on average (word salad, lists of names) is spam. A line is
   suspect if its coherence is unlike that of sentences, low or so high that only fixed phrases
   reach it, if it repeats collocations, or if it is too short to measure. A suspect line is spam if
   its form confirms it: a few phrases over and over, or short phrases between separators; or if
   most of its collocations recur in its document while its coherence is unlike that of sentences or
   cannot be measured. Lines of links have no neighbouring words to measure and are told by their form.
4. A document is spam when more than half of its characters, line ends aside, are in such lines.

Words of spaceless scripts are their characters.

Layout: one pass over the texts makes chunks of about ``CHUNK_WORDS`` words, each one row with the
words of its lines as numbers. A chunk counts its own different words and pairs, so what is shuffled
is a row per chunk and term, not per occurrence, and no term has more rows than there are chunks.
Summed up they are the corpus counts; each chunk gets those of its terms back and scores its lines.

Defined results: null, empty and blank texts are no spam; repeated rows of one doc_id give one
row; a null document_id counts as a document of its own; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, once_per, spread
from .metricjoin import objects

PMI_FLOOR = -4.0
#: A line of at least MIN_PAIRS pairs with a lower mean is incoherent.
INCOHERENT = -2.8
MIN_PAIRS = 5
#: Coherence outside these bounds, or a smaller share of different pairs, makes a line suspect.
LOW, HIGH, DIFFERENT = -1.5, 2.9, 0.9
#: Share of different words within 12 neighbouring ones below which a line repeats itself.
DISTINCT_SHARE = 0.55
MIN_REPEATED = 4
LINK_SHARE = 0.4
#: Words outside its links beyond which a line is no link line.
LINK_WORDS = 6
LIST_SHARE = 0.7
SHORT_PHRASE = 4.5
#: Words that a phrase may have beyond that on a line without a full stop.
UNSTOPPED = 1
#: Words of a chunk, about; a single text may be longer.
CHUNK_WORDS = 2_000_000
#: A collocation or word recurs if its document has it so often, and once in RATE words; RECURRING is the share of such collocations that
#: counts in a line unlike sentences, RECURRING_HIGH in any suspect line, RECURRING_WORDS that of words in a short phrase.
OFTEN, RATE, RECURRING, RECURRING_HIGH, RECURRING_WORDS = 3, 40, 0.6, 0.8, 0.75
SHORT_LINE = 6

_LINE_END = re.compile(r"[\n\r\u2028\u2029\x0b\x0c\x85]")
_CJ = "぀-ヿ㐀-鿿豈-﫿"
_TH = "฀-๿"
_SPACELESS = _CJ + _TH
_TOKEN = re.compile(rf"[{_SPACELESS}]|[^\W_{_SPACELESS}]+(?:[ऀ-ॿ]+)*")
_RUN = re.compile(rf"[{_SPACELESS}]+|[^\W_{_SPACELESS}]+(?:[ऀ-ॿ]+)*")
_LATIN = re.compile(rf"[^\W_{_SPACELESS}]+(?:[ऀ-ॿ]+)*")
_LINK = re.compile(r"<a\s[^>]*>.*?</a>|\[[^\]\n]*\]\([^)\s]*\)|(?:https?://|www\.)\S+|[\w-]+(?:\.[\w-]+)*\.[a-z]{2,10}/\S*")
_LEAD = re.compile(r"^\s*(?:[-*•»]|\d+[.)]|[^\W\d_]{3,9}:|#+)\s*")
_SEPARATOR = re.compile(r'\s*(?:[|›»·•/,;!?।。！？、，；：:"“”«»()（）]+|\.(?=\s|$)|>>|\s{2,}|\s[-–—]\s|#)\s*')
_WIDE_GAP, _ANY_GAP = re.compile(r"[ \xa0]{2,}"), re.compile(r"[ \xa0]+")
_GAP = re.compile(rf"(?<=[{_SPACELESS}])\s+(?=[{_SPACELESS}])")
#: Particles and endings without which a Chinese or Japanese stretch is no clause.
_PARTICLE = re.compile("[了着过说吗呢吧はをがでとしれたてるすだ]")
_CJ_CHAR, _TH_CHAR, _SPACELESS_CHAR = re.compile(f"[{_CJ}]"), re.compile(f"[{_TH}]"), re.compile(f"[{_SPACELESS}]")

_STOP = re.compile(r"[.!?।。！？](?:\s|$)")
_DIGIT, _DEVA = re.compile(r"\d"), re.compile("[ऀ-ॿ]")

def _short(phrase: str, most: float, spaceless: bool = True, deva: bool = True) -> bool:
    """Whether a phrase is short; the flags say whether its line has such characters at all."""
    c = th = 0
    if spaceless:
        c = len(_CJ_CHAR.findall(phrase))
        if c and _PARTICLE.search(phrase):
            return False
        th = len(_TH_CHAR.findall(phrase))
    # Numbers and codes are no words; Hindi clauses of four words are common.
    words = _LATIN.findall(phrase)
    if _DIGIT.search(phrase):
        words = [w for w in words if not _DIGIT.search(w)]
    return len(words) + (sum(bool(_DEVA.match(w)) for w in words) / 2 if deva else 0) + c / 2 + th / 3 <= most


def without_links(line: str) -> tuple[str, int]:
    """A line with blanks for its links, and the characters of these."""
    if "/" not in line and "](" not in line:
        return line, 0
    rest = _LINK.sub(" ", line)
    return rest, sum(len(m[0]) for m in _LINK.finditer(line)) if rest != line else 0


def line_form(line: str) -> int:
    """The form of a line: 2 for mostly links, 1 for short phrases between separators or a few words over and over, else 0."""
    bare = line.strip()
    rest, link = without_links(bare)
    return _form(bare, rest, link, _RUN.findall(rest.lower()), bool(_SPACELESS_CHAR.search(rest)))


def _form(bare: str, rest: str, link: int, runs: list[str], spaceless: bool) -> int:
    if link > LINK_SHARE * len(bare) and len(runs) <= LINK_WORDS:
        return 2
    if "  " in rest or "\xa0" in rest:
        if 2 * len(_WIDE_GAP.findall(rest)) > len(_ANY_GAP.findall(rest)):
            rest = _WIDE_GAP.sub(" ", rest)  # a text set with wide blanks throughout: they separate nothing
    phrases = [p for p in _SEPARATOR.split(_LEAD.sub("", rest)) if p]
    phrases = [q for p in phrases for q in _GAP.split(p) if q.strip()] if spaceless else [p for p in phrases if p.strip()]
    if len(phrases) >= 3:
        most = SHORT_PHRASE + UNSTOPPED * (not _STOP.search(rest))
        deva = bool(_DEVA.search(rest))
        # Phrases too long to be short are left out of the sum until it cannot be reached.
        need, left, got = LIST_SHARE * sum(map(len, phrases)), sum(map(len, phrases)), 0
        for p in sorted(phrases, key=len, reverse=True):
            if _short(p, most, spaceless, deva):
                got += len(p)
                if got > need:
                    return 1
            left -= len(p)
            if got + left <= need:
                break
    w = [x for x in runs if not x.isdigit()]
    if len(w) < MIN_REPEATED:
        return 0
    if len(w) <= 12:
        return int(len(set(w)) < DISTINCT_SHARE * len(w))
    spans = range(0, len(w) - 11, 3)
    return int(sum(len(set(w[i : i + 12])) for i in spans) < DISTINCT_SHARE * 12 * len(spans))


def list_like(line: str) -> bool:
    return line_form(line) > 0


_DIGITS = "0123456789"


def tokens(rest: str) -> list[str]:
    """Words of a line without links; a number at the end of a word is no part of it."""
    return [t.rstrip(_DIGITS) or t for t in _TOKEN.findall(rest.lower())]


def _recurrence(pairs: list, words: list[str], goes_on: bool, often: set) -> float:
    """Share of a line's collocations that recur in its document; for a short phrase, 1 if most of its words do."""
    if not words:
        return 0.0
    if len(words) <= SHORT_LINE and not goes_on and sum(w in often for w in words) >= RECURRING_WORDS * len(words):
        return 1.0
    return sum(c in often for c in pairs) / len(pairs)


def _hash(w: str) -> int:
    h = xxhash.xxh64_intdigest(w)
    return h - (1 << 64) if h >= 1 << 63 else h


def read_lines(text: str, known: dict[str, int]) -> tuple[list[tuple[int, int, int, float, int]], list[int]]:
    """((place, characters, form, recurrence, words) of every line that is not blank, words as numbers)."""
    rows, runs, ids = [], [], []
    for k, line in enumerate(_LINE_END.split(text)):
        bare = line.strip()
        if not bare:
            continue
        rest, link = without_links(bare)
        plain = _RUN.findall(rest.lower())
        spaceless = bool(_SPACELESS_CHAR.search(rest))
        cut_ = [t.rstrip(_DIGITS) for t in plain]
        ws = tokens(rest) if spaceless else [c or t for c, t in zip(cut_, plain)]
        for w in ws:
            h = known.get(w)
            if h is None:
                if len(known) > 500_000:
                    known.clear()
                h = known[w] = _hash(w)
            ids.append(h)
        rows.append((k, len(line), _form(bare, rest, link, plain, spaceless), len(ws)))
        rs = [x for x in cut_ if x]
        runs.append((list(zip(rs, rs[1:])) if len(rs) != 1 else [(rs[0],)], rs, bare[:1].islower()))
    seen = Counter(c for r, _, _ in runs for c in r)
    seen.update(Counter(w for _, ws, _ in runs for w in ws))
    often = max(OFTEN, sum(len(ws) for _, ws, _ in runs) / RATE)
    again = {x for x, n in seen.items() if n >= often}
    return [(k, n, form, _recurrence(r, ws, low, again), size) for (k, n, form, size), (r, ws, low) in zip(rows, runs)], ids


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(doc_id, group, text) -> a row per chunk: its number, documents, and for all their lines the measures and words, packed."""
    known: dict[str, int] = {}
    part, count = TaskContext.get().partitionId(), 0
    ids, groups, n_lines, lines, words = [], [], [], [], []

    def done() -> pd.DataFrame:
        nonlocal count, ids, groups, n_lines, lines, words
        m = np.array(lines, np.float64).reshape(-1, 5)
        w = np.array(words, np.int64).tobytes()
        row = {"chunk": (part << 32) + count, "ids": ids, "groups": groups, "n_lines": n_lines, "lines": pa.compress(m.tobytes(), "zstd", asbytes=True), "n": len(m), "words": pa.compress(w, "zstd", asbytes=True), "n_words": len(words)}
        count += 1
        ids, groups, n_lines, lines, words = [], [], [], [], []
        return objects(**{k: [v] for k, v in row.items()})

    for df in batches:
        for d, g, t in zip(df["doc_id"].tolist(), df["group"].tolist(), df["text"].tolist()):
            found, ws = read_lines(t, known)
            if not found:
                continue
            if words and len(words) + len(ws) > CHUNK_WORDS:
                yield done()
            ids.append(d), groups.append(g), n_lines.append(len(found))
            lines += found
            words += ws
    if ids:
        yield done()


class Chunk:
    """The lines of a chunk, their words and neighbouring pairs."""

    def __init__(self, row: pd.Series):
        self.ids = list(row["ids"])
        self.lines = np.frombuffer(pa.decompress(row["lines"], int(row["n"]) * 40, "zstd"), np.float64).reshape(-1, 5)
        self.words = np.frombuffer(pa.decompress(row["words"], int(row["n_words"]) * 8, "zstd"), np.int64)
        self.doc_of = np.repeat(np.arange(len(self.ids)), np.array(list(row["n_lines"]), np.int64))
        self.line_of = np.repeat(np.arange(len(self.lines)), self.lines[:, 4].astype(np.int64))
        at = np.flatnonzero(self.line_of[1:] == self.line_of[:-1])
        self.a, self.b, self.pair_line = self.words[at], self.words[at + 1], self.line_of[at]
        self.pairs = pair_hash(self.a, self.b)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit number of each ordered pair of words."""
    with np.errstate(over="ignore"):
        x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ ((b.astype(np.uint64) << np.uint64(31)) | (b.astype(np.uint64) >> np.uint64(33)))
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).astype(np.int64)


def _document_counts(terms: np.ndarray, docs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different terms, and of each the number of documents that count and hold it."""
    inv, uniq = pd.factorize(terms)
    once = pd.unique(docs * max(1, len(uniq)) + inv)
    doc, term = once // max(1, len(uniq)), once % max(1, len(uniq))
    return uniq, np.bincount(term[counts[doc]], minlength=len(uniq))


def _terms(key, chunk: pd.DataFrame, later: pd.DataFrame) -> pd.DataFrame:
    """The different words and pairs of a chunk, with the number of its documents that hold them; later ingests do not count."""
    terms, n = [], []
    gone = set(later["doc_id"].tolist())
    for _, row in chunk.iterrows():
        c = Chunk(row)
        counts = np.array([d not in gone for d in c.ids])
        for t, line in ((c.words, c.line_of), (c.pairs, c.pair_line)):
            u, k = _document_counts(t, c.doc_of[line], counts)
            terms.append(u), n.append(k)
    return objects(chunk=np.full(sum(map(len, terms)), key[0], np.int64), term=np.concatenate(terms), n=np.concatenate(n).astype(np.int32))


def coherence(c: Chunk, terms: np.ndarray, df: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per line: pairs, different pairs, and mean mutual information; terms ascend, those not among them are in one document."""
    inv, uniq = pd.factorize(c.pairs)
    first = np.zeros(len(uniq), np.int64)
    first[inv[::-1]] = np.arange(len(inv))[::-1]

    def of(x: np.ndarray) -> np.ndarray:
        if not len(terms):
            return np.ones(len(x))
        at = np.minimum(np.searchsorted(terms, x), len(terms) - 1)
        return np.where(terms[at] == x, df[at], 1).astype(np.float64)

    n, da, db = of(uniq), of(c.a[first]), of(c.b[first])
    with np.errstate(divide="ignore"):
        pmi = np.where(n > 1, np.maximum(PMI_FLOOR, np.log((n - 1) * float(max(total, 1)) / (da * db))), PMI_FLOOR)
    size = len(c.lines)
    n_pairs = np.bincount(c.pair_line, minlength=size)
    different = np.bincount(pd.unique(c.pair_line * max(1, len(uniq)) + inv) // max(1, len(uniq)), minlength=size) if len(inv) else np.zeros(size, np.int64)
    mean = np.bincount(c.pair_line, weights=pmi[inv], minlength=size) / np.maximum(n_pairs, 1) if len(inv) else np.zeros(size)
    return n_pairs, different, mean


def spam_lines(form: np.ndarray, recurs: np.ndarray, n_pairs: np.ndarray, different: np.ndarray, mean: np.ndarray) -> np.ndarray:
    measured = n_pairs >= MIN_PAIRS
    none = n_pairs == 0
    salad = measured & (mean < INCOHERENT)
    unlike = ~measured | (mean < LOW) | (mean > HIGH)
    suspect = unlike | (~none & (different < DIFFERENT * n_pairs))
    return salad | (form == 2) | (suspect & (form == 1)) | (unlike & (recurs >= RECURRING)) | (suspect & (recurs >= RECURRING_HIGH))


def _scored(docs: DataFrame, by_line: bool) -> DataFrame:
    typ = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.coalesce("document_id", F.concat(F.lit("#"), "doc_id")).alias("group"), "text")
    chunks = cut(spread(once_per(texts, "doc_id")).mapInPandas(_chunks, f"chunk bigint, ids array<{typ}>, groups array<string>, n_lines array<int>, lines binary, n bigint, words binary, n_words bigint"))
    placed = cut(chunks.select("chunk", F.explode(F.arrays_zip("ids", "groups")).alias("x")).select("chunk", F.col("x.ids").alias("doc_id"), F.col("x.groups").alias("group")))
    first = placed.groupBy("group").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    total = first.count()
    later = placed.join(first.where("n > 1").select("group", "first"), "group").where("doc_id <> first").select(F.col("chunk").alias("at"), "doc_id")
    packed = chunks.select("chunk", "ids", "n_lines", "lines", "n", "words", "n_words")
    terms = cut(packed.groupBy("chunk").cogroup(later.groupBy("at")).applyInPandas(_terms, "chunk bigint, term bigint, n int"))
    df = terms.groupBy("term").agg(F.sum("n").alias("df")).where("df > 1")
    back = terms.select("chunk", "term").join(df, "term").select("chunk", "term", "df")

    def score(key, chunk: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        out = []
        order = np.argsort(counts["term"].to_numpy(np.int64), kind="stable")
        t, d = counts["term"].to_numpy(np.int64)[order], counts["df"].to_numpy(np.int64)[order]
        for _, row in chunk.iterrows():
            c = Chunk(row)
            n_pairs, different, mean = coherence(c, t, d, total)
            n, form = c.lines[:, 1].astype(np.int64), c.lines[:, 2].astype(np.int32)
            bad = spam_lines(form, c.lines[:, 3], n_pairs, different, mean)
            if by_line:
                out.append(objects(doc_id=[c.ids[i] for i in c.doc_of.tolist()], line=c.lines[:, 0].astype(np.int32), n=n, form=form, n_pairs=n_pairs.astype(np.int64), coherence=[x if k else None for x, k in zip(mean.tolist(), n_pairs.tolist())], spam=bad))
            else:
                size = len(c.ids)
                out.append(objects(doc_id=c.ids, n_chars=np.bincount(c.doc_of, weights=n, minlength=size).astype(np.int64), spam_chars=np.bincount(c.doc_of, weights=n * bad, minlength=size).astype(np.int64)))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=names, dtype=object)

    schema = f"doc_id {typ}, line int, n bigint, form int, n_pairs bigint, coherence double, spam boolean" if by_line else f"doc_id {typ}, n_chars bigint, spam_chars bigint"
    names = [x.split()[0] for x in schema.split(", ")]
    return packed.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInPandas(score, schema)


def line_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, line, n, form, n_pairs, coherence, spam) of every line that is not blank."""
    return _scored(docs, True)


def page_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, spam_chars, is_spam) of every document with text."""
    return _scored(docs, False).withColumn("is_spam", F.col("spam_chars") * 2 > F.col("n_chars"))
