"""Sentence units of whole texts in spaced and spaceless scripts, with code-point offsets.

Texts are cut into blocks first (blank lines; single line breaks unless the next line goes on in
lower case; lines of lists, links and keywords stand alone). Inside a block:

* Spaced scripts: a terminator lattice. Every terminator with its closing quotes and brackets is a
  node; quotations and brackets are edges that span the nodes inside them; each remaining node is
  classified by the token before it (abbreviation, initial, number, name turned round, plain word)
  and the opening of what follows.
* Spaceless scripts: a lattice of dictionary words (the lists below and the words of a public
  tokenizer's vocabulary), of which the cheapest path is taken. Its words classify the gaps: where
  no mark stands, a final particle before and an opening word after end a unit; after a closed
  quotation, the word that follows opens a unit or goes on with the sentence. Only runs in which a
  final and an opening word touch are laid out, as no other run has such a gap. A terminator or, in
  Thai, a blank ends a unit by itself, the blank unless a numeral or a Latin word is beside it.

Everything is decided within the text of one row, so the stage is narrow: no shuffle, no state.

Defined results: null, empty and blank texts have no unit; a unit neither starts nor ends with a
blank; repeated rows of one doc_id give the same units once; other columns are ignored; texts of
any length are cut whole, in time linear in their length.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..session import once_per, spread
from .metricjoin import objects
from .spam import list_like

#: Abbreviations that stand before what they belong to and so never end a unit before a word or number.
BEFORE = frozenset(
    "dr st ste mr mrs ms prof sra srta sr sres mme mlle mm messrs rev hon gen col sgt lt capt fig figs vol vols no nos nr nrn pp p pág págs pag núm num art arts ca vs cf env approx aprox gem abs bzw ggf vgl ed eds hr fr frau hrsg bd kap ziff sog inkl exkl evtl tel av bd blvd mt ft ch sec secs eq nº nos z.b d.h u.a e.g i.e p.ej p.ex c.-à-d viz al resp ee".split()
)
#: Abbreviations that may also be the last word of a unit: they end it before a capital, a quotation or an opening word.
EITHER = frozenset(
    "etc usw co corp inc ltd cía cia jr sen bros plc llc ag sa gmbh u.s u.k u.s.a uu ee.uu a.m p.m vorm nachm mill mio mrd dept univ s.a a.g g.m.b.h j.-c n.chr v.chr h min sek std jh jhd uhr "
    "eng bur mfg transp shpg fdrs instr comp chem elec electr tech text ind log labs lab manuf hldgs svcs assn assoc inst intl natl govt".split()
)
#: Legal forms that may follow a firm's abbreviated trade.
LEGAL = re.compile(r"(?:&|AG\b|A\.\s?G\.|GmbH\b|G\.m\.b\.H|Gesellschaft\b|Ltd|LTD|Limited\b|Inc\b|INC\b|Incorporated\b|Corp\b|CORP\b|Corporation\b|Co\b|CO\b|Company\b|S\.A\.|SA\b|Sociedad An|Soci[eé]t[eé]|Aktiengesellschaft\b|PLC\b|LLC\b|KG\b|(?:GESELLSCHAFT|LIMITED|CORPORATION|COMPANY|INCORPORATED|AKTIENGESELLSCHAFT|GMBH)\b)")
#: What follows an ordinal number written with a dot.
ORDINAL_NEXT = re.compile(r"(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Quartal|Jahrhundert|Jh\b|Jahr|Stock|Tag|Woche|Mal|Platz|Auflage|Kapitel|Halbjahr|Klasse|Grad|Armee|Bezirk)")
#: Two-part abbreviations written with a blank: first part, last part, whether they may end a unit.
PAIRS = {("z", "b"): False, ("d", "h"): False, ("u", "a"): False, ("i", "e"): False, ("e", "g"): False, ("p", "ej"): False, ("p", "ex"): False, ("o", "ä"): True, ("u", "u"): True, ("p", "m"): True, ("a", "m"): True, ("ee", "uu"): True, ("s", "a"): True, ("a", "g"): True, ("v", "chr"): True, ("n", "chr"): True, ("h", "c"): False}

_TERM = re.compile(r"\.{2,}|…+|[.!?。！？।॥｡]+")
_BLANKLINE = re.compile(r"\n[ \t\xa0\u3000\r]*\n[\s]*")
_URL = re.compile(r"(?:https?://|www\.)[^\s<>\"”»)]+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
_TOKEN = re.compile(r"[^\s(（\[\"“„«»”「『<>/—–\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\u0e00-\u0e7f、，。]*$")
_OPEN = "\"“„«「『‘‹¿¡(（["
_WORDCHAR = re.compile(r"\w")
_LISTMARK = re.compile(r"[ \t\xa0]*(?:[-*•»›·#]+|\d{1,3}[.)]|[a-z]\))[ \t\xa0]+")
_CJK = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ]")
_THAI = re.compile("[฀-๏๚๛]")
_DEVA = re.compile("[ऀ-ॿ]")
#: Hindi words with which a sentence goes on after a quotation.
HINDI_ON = ("और", "लेकिन", "मगर", "परन्तु", "किन्तु", "क्योंकि", "जबकि", "तो", "तथा", "एवं", "कि ", "ने", "यह", "ऐसा", "बोला", "कहा", "पर ", "फिर भी", "इसलिए")

#: Words that open a clause. Discourse words open one after any final particle; words of time and subjects need more (``_gap_ends``).
DISCOURSE = frozenset(
    "然而 不过 不過 后来 後來 随后 隨後 接着 此外 另外 因此 所以 于是 於是 最后 最後 首先 其次 总之 總之 据说 據說 据悉 与此同时 另一方面 尽管如此 事实上 实际上 例如 比如 "
    "しかし また さらに そして それから なお ところが ただし まず 次に 最後に つまり 例えば その後 一方 だから でも すると それで しかも 同時に とはいえ なぜなら "
    "แต่ ดังนั้น อย่างไรก็ตาม นอกจากนี้ ต่อมา จากนั้น หลังจากนั้น เพราะฉะนั้น อย่างไรก็ดี ในที่สุด ทั้งนี้".split()
)
TIME = frozenset(
    "昨天 今天 明天 前天 后天 当天 去年 今年 明年 前年 次日 翌日 上周 本周 下周 上个月 本月 下个月 昨晚 今晚 今早 春天 夏天 秋天 冬天 当时 目前 现在 最近 近日 "
    "昨年 来年 昨日 今日 明日 先月 今月 来月 先週 今週 来週 今朝 翌朝 翌年 翌週 昨夜 その日 "
    "เมื่อวาน วันนี้ พรุ่งนี้ ปีที่แล้ว ปีนี้ ปีหน้า ตอนนี้ ขณะนี้ เดือนที่แล้ว สัปดาห์ที่แล้ว เมื่อวานนี้ วันรุ่งขึ้น".split()
)
SUBJECT = frozenset(
    "我 我们 你 你们 他 她 它 他们 她们 它们 大家 人们 有人 我們 你們 他們 她們 "
    "私 私たち 彼 彼女 彼ら 僕 僕たち あなた みんな 皆 これ それ この その あの 誰も "
    "เขา เธอ ฉัน ผม เรา พวกเขา พวกเรา คุณ ดิฉัน ท่าน ทุกคน พวกเธอ".split()
)
#: Final particles and endings. The strong ones end a clause as a rule; after a weak one, an object may stand as well.
STRONG = frozenset("吗 嗎 呢 吧 啊 呀 嘛 啦 罢了 而已 です ます ました でした ません ませんでした でしょう ましょう ください ですか ますか ましたか ですね ですよ ますね ますよ ましたね ครับ ค่ะ จ้ะ".split())
WEAK = frozenset("了 過了 过了 した った れた んだ いた だった である แล้ว เลย ด้วย นะ คะ".split())
#: Words with which the sentence goes on after a quotation.
GOES_ON = frozenset("的 和 与 與 或 或者 以及 等 と って という との といった などと は が を に の も で へ や から など ว่า และ หรือ".split())
#: Everyday words, so that neighbouring particles are not found inside them.
WORDS = frozenset(
    "是 有 在 不 没有 就 也 都 还 很 会 能 可以 应该 已经 正在 将 把 被 从 向 对 为 上 下 中 里 这 那 这个 那个 一个 什么 怎么 为什么 说 表示 认为 时间 时候 问题 工作 会议 政府 公司 市场 国家 城市 学校 继续 结束 开始 返回 酒吧 网吧 了解 了不起 为了 除了 "
    "する して した しない こと もの ため よう そう どう ここ そこ 人 年 月 日 会社 学校 政府 工場 まで より ので のに けど できる なる なった ある いる いた ない られる された "
    "การ ความ ที่ ซึ่ง ใน ของ จาก กับ ให้ ได้ ไม่ เป็น มี จะ ก็ นี้ นั้น คน วัน ปี เดือน บ้าน ตลาด โรงงาน โรงเรียน ไป มา กลับ กิน ทำ พูด เห็น รู้ คะแนน ลงคะแนน กล่าว กล่าวว่า เพราะ เมื่อ หลัง ก่อน หลังการ ก่อนการ ขณะที่ ชนะ ฐานะ ขณะ ลักษณะ สถานะ แล้วเสร็จ นะคะ นะครับ แต่งงาน แต่ง แต่ละ ตั้งแต่ ผมยาว เขาใหญ่ ภูเขา".split()
)
_LISTED = DISCOURSE | TIME | SUBJECT | STRONG | WEAK | GOES_ON | WORDS
#: Numbered stretches of time: the third day, the second quarter.
_NUMBERED = re.compile("第[一二三四五六七八九十百\\d]{1,4}(?:个)?(?:天|年|周|月|季度|次|日|四半期|週|回)")
#: A phrase of time that heads a clause, with its comma.
_HEAD = re.compile("[぀-ヿ㐀-䶿一-鿿]{1,8}?(?:之前|之后|之後|以来|期间|前に|の後|後に|に)[，、]")
_FINALS = sorted(STRONG | WEAK, key=len, reverse=True)
_OPENERS = sorted(DISCOURSE | TIME | SUBJECT, key=len, reverse=True)
#: Places where a final particle and an opening word touch: only there can a gap without marks be one.
_TOUCH = re.compile("(?:" + "|".join(_FINALS) + ")(?=" + "|".join(_OPENERS) + "|第)")
_SPACELESS = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿々ｦ-ﾟ\u0e00-\u0e7f]+")
#: Costs of a lattice edge: a word of the lists, a word of the vocabulary, a character that is in no word.
LISTED, OF_VOCABULARY, UNKNOWN = 1.0, 1.1, 1.6
#: A public tokenizer's file, whose whole words of spaceless scripts widen the dictionary.
VOCABULARY = os.environ.get("QUILL_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


def vocabulary_words(path: str = VOCABULARY) -> tuple[str, ...]:
    """Words of two characters and more of spaceless scripts in a vocabulary of byte pairs (base64, rank); none where there is no file."""
    if not os.path.exists(path):
        return ()
    out = set()
    with open(path, "rb") as f:
        for line in f:
            w = base64.b64decode(line.split()[0]).decode(errors="ignore").strip()
            if len(w) > 1 and _SPACELESS.fullmatch(w):
                out.add(w)
    return tuple(sorted(out))


class Lattice:
    """Dictionary word lattice over runs of spaceless characters."""

    def __init__(self, vocabulary: tuple[str, ...] = ()):
        self.cost = {w: OF_VOCABULARY for w in vocabulary} | {w: LISTED for w in _LISTED}
        self.longest = max(map(len, self.cost), default=1)
        self.words = lru_cache(maxsize=50_000)(self._words)

    def _words(self, run: str) -> tuple[tuple[int, str, bool], ...]:
        """(start, word, known) on the cheapest path; equal costs go to the longer last word."""
        n, known = len(run), self.cost
        cost, back, is_word = [0.0] + [1e9] * n, [0] * (n + 1), [False] * (n + 1)
        numbered = {m.start(): m.end() for m in _NUMBERED.finditer(run)} if "第" in run else {}
        for i in range(n):
            c = cost[i]
            if c + UNKNOWN < cost[i + 1]:
                cost[i + 1], back[i + 1], is_word[i + 1] = c + UNKNOWN, i, False
            for j in range(i + 1, min(n, i + self.longest) + 1):
                w = known.get(run[i:j])
                if w is not None and c + w < cost[j]:
                    cost[j], back[j], is_word[j] = c + w, i, True
            if (j := numbered.get(i)) and c + LISTED < cost[j]:
                cost[j], back[j], is_word[j] = c + LISTED, i, True
        out, i = [], n
        while i > 0:
            out.append((back[i], run[back[i] : i], is_word[i]))
            i = back[i]
        return tuple(out[::-1])

    def first(self, text: str, at: int, hi: int) -> str | None:
        """The word of the dictionary that stands at a place, or None."""
        m = _SPACELESS.match(text, at, min(hi, at + 24))
        if not m:
            return None
        _, w, known = self.words(m[0])[0]
        return w if known else None

    def gaps(self, run: str, comma: bool = False) -> list[int]:
        """Places inside a run without marks where a clause ends and the next opens; a comma may follow the run."""
        if not _TOUCH.search(run):
            return []
        path = self.words(run)
        return [path[k][0] for k in range(1, len(path)) if k + 1 < len(path) and _gap_ends(path, k, comma)]


def _ending(w: str, among: frozenset[str]) -> bool:
    """Whether a word is one of some endings, or a longer word of the vocabulary, none of the lists, that ends in one."""
    return w in among or (w not in _LISTED and any(w.endswith(x) for x in among))


def _gap_ends(path: tuple[tuple[int, str, bool], ...], k: int, comma: bool) -> bool:
    """Whether the gap before the k-th word of a path ends a unit.

    A strong final before any opening word; a weak one before a discourse word, or before a word of
    time with a subject after it or as a phrase that a comma closes; in Thai, where objects need a
    verb, before a subject as well.
    """
    (_, before, known), (_, here, opening) = path[k - 1], path[k]
    if not known or not opening or k < 2:
        return False
    time = here in TIME or bool(_NUMBERED.fullmatch(here))
    if _ending(before, STRONG):
        return here in DISCOURSE or here in SUBJECT or time
    if _ending(before, WEAK):
        return here in DISCOURSE or (time and (path[k + 1][1] in SUBJECT or (comma and len(path) <= k + 4))) or (here in SUBJECT and bool(_THAI.match(here)))
    return False


_LATTICES: dict[tuple[str, ...], Lattice] = {}


def lattice_of(vocabulary: tuple[str, ...]) -> Lattice:
    if vocabulary not in _LATTICES:
        _LATTICES[vocabulary] = Lattice(vocabulary)
    return _LATTICES[vocabulary]


def opens(word: str | None) -> bool:
    """Whether a word of the lattice opens a unit."""
    return word is not None and (word in DISCOURSE or word in TIME or word in SUBJECT or bool(_NUMBERED.fullmatch(word)))


def _spans(text: str, lo: int, hi: int) -> tuple[dict[int, int], np.ndarray]:
    """Quotations and brackets of a block: closing place -> opening place, and the depth at every character."""
    pairs: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    close_of = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "‹": "›", '"': '"'}
    for m in re.finditer("[\"“”„«»「」『』()（）\\[\\]‹›]", text[lo:hi]):
        p, c = lo + m.start(), m[0]
        before = text[p - 1] if p > lo else " "
        after = text[p + 1] if p + 1 < hi else " "
        hit = next((k for k in range(len(stack) - 1, -1, -1) if c in close_of[stack[k][0]]), None)
        if c == '"':
            opening = hit is None if (before.isspace() == after.isspace()) or (not before.isspace() and not after.isspace()) else before.isspace()
            if before in "(（":
                opening = True
            if opening and hit is None:
                stack.append((c, p))
            elif hit is not None:
                pairs[p] = stack[hit][1]
                del stack[hit:]
            continue
        if hit is not None:
            pairs[p] = stack[hit][1]
            del stack[hit:]
        elif c in close_of and not (c == "«" and not after.strip()[:1] and p + 2 >= hi):
            stack.append((c, p))
    depth = np.zeros(hi - lo + 1, np.int32)
    for close, open_ in pairs.items():
        depth[open_ - lo + 1] += 1
        depth[close - lo] -= 1
    return pairs, np.cumsum(depth)


def _capital(text: str, at: int) -> bool:
    """Whether a capital opens the word at a place; names such as iName count."""
    c = text[at]
    if c.isupper() or c.istitle():
        return True
    return c.islower() and text[at + 1 : at + 2].isupper()


def _dot_ends(text: str, lo: int, dot: int, nxt: int, gap: bool, lattice: Lattice) -> bool:
    """Whether a single dot at ``dot`` ends a unit that is followed by the character at ``nxt``."""
    head = text[lo:dot]
    tok = _TOKEN.search(head[-60:])[0]
    c = text[nxt]
    cap = _capital(text, nxt)
    lower = c.islower() and not cap
    cjk = bool(_CJK.match(c))
    opening = c in _OPEN
    starts = cap or opening or c in "-•*#" or (cjk and (opens(lattice.first(text, nxt, len(text))) or bool(_HEAD.match(text, nxt))))
    if not gap and (not (cap or opening or cjk or c.isalpha() and not c.islower()) or text[nxt + 1 : nxt + 2] == "."):
        return False
    low = _ZERO_WIDTH.sub("", tok.lower()).strip("'’,;:-")
    if not low:
        return starts or not lower
    last = low.rsplit(".", 1)[-1]
    before = head[: len(head) - len(tok)].rstrip()
    prev = _TOKEN.search(before[-40:])[0].lower() if before else ""
    if low.isdigit():
        if not before or lower or ORDINAL_NEXT.match(text, nxt):
            return False
        return starts or not c.isdigit()
    if prev.endswith(".") and (prev[:-1], low) in PAIRS:
        return PAIRS[(prev[:-1], low)] and starts
    if low in BEFORE or (last in BEFORE and "." in low):
        # "no." before a capital is a plain word in Spanish and English; with a number it is an abbreviation.
        return low in ("no", "al", "ed", "ch", "p") and cap and not c.isdigit() and low == "al"
    if low == "dept" and re.match(r"[A-Z]\.", text[nxt : nxt + 2]):
        return False
    if low in EITHER or re.fullmatch(r"\w(?:\.-?\w)+", low):
        if low == "h" and not prev.isdigit():
            return starts and len(tok) == 1 and not cap
        if LEGAL.match(text, nxt):
            return False
        return starts and (gap or cap)
    if len(low) == 1 and low.isalpha():
        if prev == "dept.":
            return starts
        if not tok.isupper():
            return False
        # Initials. After "Surname," they end a name turned round, and may end the unit.
        back = before
        while m := re.search(r"(?:^|\s)[^\W\d_]\.$", back):
            back = back[: m.start()].rstrip()
        turned = re.search(r"[^\W\d_][\w'’-]{3,},$", back)
        if turned and turned[0][0].isupper() and cap:
            return not re.match(r"[^\W\d_]\.", text[nxt : nxt + 2])
        return False
    if not gap and not (cap or opening or cjk):
        return False
    if lower and len(low) <= 2:
        return False
    return True


def _block_units(text: str, lo: int, hi: int, lattice: Lattice) -> list[tuple[int, int]]:
    """Units of one block."""
    pairs, depth = _spans(text, lo, hi)
    urls = [(lo + m.start(), lo + len(m[0].rstrip(".,;:!?…")) + m.start()) for m in _URL.finditer(text[lo:hi])]
    thai = bool(_THAI.search(text, lo, hi))
    cuts: list[int] = []
    start = lo
    mark = _LISTMARK.match(text, lo, hi)
    u = 0
    for m in _TERM.finditer(text, mark.end() if mark else lo, hi):
        a, b = m.span()
        if a < start:
            continue
        while u < len(urls) and urls[u][1] <= a:
            u += 1
        if u < len(urls) and urls[u][0] <= a < urls[u][1]:
            continue
        # Closing quotes and brackets that belong to the terminator; French ones after a blank.
        end, quoted, bracket = b, False, None
        while True:
            p = end
            if p < hi and text[p] in " \xa0\u202f" and p + 1 < hi and text[p + 1] == "»" and p + 1 in pairs:
                p += 1
            if p < hi and p in pairs:
                if text[p] in ")）]":
                    bracket = pairs[p]
                else:
                    quoted = True
                end = p + 1
            elif p < hi and text[p] in "’'" and not (text[p + 1 : p + 2].isalnum()):
                end = p + 1
            else:
                # Terminators may follow the closing mark.
                t = _TERM.match(text, end, hi)
                if end > b and t:
                    end = t.end()
                    quoted = False
                    continue
                break
        if depth[end - 1 - lo] if end - 1 > a else depth[a - lo]:
            inner = depth[end - lo] if end < hi else 0
            if inner:
                continue
        if end < hi and depth[end - lo]:
            continue
        if bracket is not None and bracket > start and not _only_blank(text, start, bracket, mark, lo) and text[end - 1] in ")）]":
            continue
        nxt = end
        while nxt < hi and text[nxt].isspace():
            nxt += 1
        if nxt >= hi:
            continue
        gap = nxt > end
        c = text[nxt]
        if c in ",;:，、；：)）]»”":
            continue
        kind = m[0]
        wide = kind[-1] in "。！？।॥｡"
        if quoted:
            if wide or not (c.isalpha() and (c.islower() or c.isupper())):
                on = lattice.first(text, nxt, hi) in GOES_ON or (_DEVA.match(c) and text.startswith(HINDI_ON, nxt)) or (c in "–—") or c.isdigit()
                if on or (thai and not wide):
                    continue
            elif not _capital(text, nxt):
                continue
            cuts.append(end)
        elif wide:
            cuts.append(end)
        elif kind == ".":
            if not _dot_ends(text, start, a, nxt, gap, lattice):
                continue
            cuts.append(end)
        elif kind[0] in ".…" and not set(kind) & set("!?"):
            if not (_capital(text, nxt) or c in _OPEN or _CJK.match(c)):
                continue
            cuts.append(end)
        else:
            if not gap and not (_capital(text, nxt) or c in _OPEN or _CJK.match(c) or _DEVA.match(c)):
                continue
            if bracket is not None and c.islower() and not _capital(text, nxt):
                continue
            cuts.append(end)
        start = nxt
    if thai:
        cuts += _thai_gaps(text, lo, hi, depth)
    for m in _SPACELESS.finditer(text, lo, hi):
        cuts += [m.start() + g for g in lattice.gaps(m[0], text[m.end() : m.end() + 1] in ("、", "，")) if not depth[m.start() + g - lo]]
    out, s = [], lo
    for e in [*sorted(set(cuts)), hi]:
        a, b = s, e
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))
        s = e
    return out


def _only_blank(text: str, start: int, at: int, mark, lo: int) -> bool:
    """Whether nothing but blanks or the list mark stands between a unit's start and a place."""
    if mark and start == lo:
        start = max(start, min(mark.end(), at))
    return not text[start:at].strip()


def _thai_gaps(text: str, lo: int, hi: int, depth: np.ndarray) -> list[int]:
    """Blanks between Thai words: each ends a unit, except beside a numeral or a Latin word."""
    out = []
    for m in re.finditer(r"[ \t\xa0]+", text[lo:hi]):
        a, b = lo + m.start(), lo + m.end()
        if a <= lo or b >= hi or depth[a - lo] or depth[b - lo]:
            continue
        p = a - 1
        while p > lo and text[p] in "”\"’)）]»!?…":
            p -= 1
        q = b
        while q < hi - 1 and text[q] in "“\"‘(（[«":
            q += 1
        if _THAI.match(text[p]) and _THAI.match(text[q]) and text[b] not in "ๆฯ(（":
            out.append(b)
    return out


def blocks(text: str) -> list[tuple[int, int]]:
    """Stretches that no unit crosses."""
    out = []
    pos = 0
    ends = [(m.start(), m.end()) for m in _BLANKLINE.finditer(text)] + [(len(text), len(text))]
    for stop, after in ends:
        start, line = pos, pos
        alone = None
        while line < stop:
            nl = text.find("\n", line, stop)
            nl = stop if nl < 0 else nl
            row = text[line:nl]
            if line > start:
                bare = row.lstrip()
                q = 0
                while q < len(bare) and bare[q] in "(（\"“„«":
                    q += 1
                goes_on = q < len(bare) and bare[q].islower() and not _capital(bare, q)
                if goes_on and (alone := list_like(text[start:line]) if alone is None else alone) and list_like(row):
                    goes_on = False
                if goes_on and _LISTMARK.match(row):
                    goes_on = False
                if not goes_on:
                    out.append((start, line))
                    start, alone = line, None
            line = nl + 1
        if start < stop:
            out.append((start, stop))
        pos = after
    return out


_ZERO_WIDTH = re.compile("[\\u00ad\\u200b-\\u200f\\u2060\\ufeff]")
_LINE_ENDS = re.compile("[\\r\\x0b\\x0c\\x85\\u2028\\u2029]")
_LINKY = re.compile(r"https?://|www\.|<a\s")


def units(text: str, lattice: Lattice | None = None) -> list[tuple[int, int]]:
    """Half-open code-point offsets of the units of a text."""
    lattice = lattice or lattice_of(())
    # Other line ends of one character become line feeds, so offsets stay.
    text = _LINE_ENDS.sub("\n", text.replace("\r\n", " \n"))
    out: list[tuple[int, int]] = []
    for lo, hi in blocks(text):
        s = text[lo:hi]
        bare = s.strip()
        if not bare:
            continue
        a = lo + len(s) - len(s.lstrip())
        b = a + len(bare)
        # A line of links is one unit, and so is a keyword line without terminators of its own.
        if (_LINKY.search(bare) or _THAI.search(bare)) and list_like(bare):
            out.append((a, b))
            continue
        out += _block_units(text, a, b, lattice)
    return out


def _cut(vocabulary: tuple[str, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = lattice_of(vocabulary)
        for df in batches:
            ids, starts, ends, index = [], [], [], []
            for d, t in zip(df["doc_id"].tolist(), df["text"].tolist()):
                for k, (a, b) in enumerate(units(t, lattice)):
                    ids.append(d), starts.append(a), ends.append(b), index.append(k)
                if len(ids) > 20_000:
                    yield objects(doc_id=ids, sentence_index=np.array(index, np.int32), char_start=np.array(starts, np.int32), char_end=np.array(ends, np.int32))
                    ids, starts, ends, index = [], [], [], []
            yield objects(doc_id=ids, sentence_index=np.array(index, np.int32), char_start=np.array(starts, np.int32), char_end=np.array(ends, np.int32))

    return run


def sentence_units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, sentence_index, char_start, char_end) of every unit of every text.

    The vocabulary's words (some thousand) are read once, here, and go to the executors with the function.
    """
    rows = docs.where(docs[doc_id].isNotNull() & docs[text].isNotNull()).select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    typ = docs.schema[doc_id].dataType.simpleString()
    return spread(once_per(rows, "doc_id")).mapInPandas(_cut(vocabulary_words(vocabulary)), f"doc_id {typ}, sentence_index int, char_start int, char_end int")
