"""Variant spellings of persons and organisations.

A spelling is folded (case, accents, look-alike letters, zero-width marks), then parsed into a
discriminator that must agree and a core that may be misspelt:

* person: forename (a set of full forenames it may stand for, or an initial) and surname;
* organisation: trade word and the rest of the name without legal form; where there is neither a
  trade nor a legal form, the whole name.

What a forename may stand for is worked out once per distinct word, against the full forenames of
the collection in blocks of ``LEXICON_BLOCK``; a word nothing is known of stands for itself. Cores of
one block (person + initial, organisation + trade + prefix, whole names) meet in an exact radius join
(``metricjoin``). Two spellings mean the same when their cores are within the radius and their
forenames agree; an initial alone agrees only where a single full forename is near. Components
over records and spellings give the entities.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, parts
from .metricjoin import components, distances, encode, objects, radius_pairs

#: Letters that look like or stand for Latin ones and that Unicode does not decompose.
LOOKALIKE = str.maketrans(
    {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ο": "o", "α": "a", "ν": "v", "ρ": "p", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ß": "ss", "ı": "i"}
)
ZERO_WIDTH = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
#: Titles, dropped at either end of a person's name.
TITLES = frozenset("mr mrs ms miss mx dr prof sir dame herr frau fraulein sr sra srta don dona mme mlle monsieur madame mag ing rev hon jr".split())
#: Legal forms as sequences of folded words.
LEGAL = sorted(
    (tuple(x.split()) for x in ("ag", "a g", "aktiengesellschaft", "gmbh", "g m b h", "gesellschaft mbh", "gesellschaft m b h", "mbh", "inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "sa", "s a", "sociedad anonima", "societe anonyme", "plc", "llc", "l l c", "llp", "sl", "s l", "sarl", "s a r l", "kg", "ohg", "se", "bv", "b v", "nv", "n v", "spa", "s p a", "oy", "ab", "as", "kk", "pty")),
    key=len,
    reverse=True,
)
#: Trades and the short forms in which they are written.
TRADES = {
    "laboratories": "labs lab laboratory",
    "chemicals": "chem chemical",
    "components": "comp component",
    "engineering": "eng engg",
    "transport": "transp trans",
    "industries": "ind inds industry",
    "technologies": "tech technology",
    "foundries": "fdrs fdry foundry",
    "instruments": "instr instrument",
    "logistics": "log",
    "bureau": "bur",
    "shipping": "shpg shipg",
    "electric": "elec electr",
    "manufacturing": "mfg manuf mfrs",
    "textiles": "text textile",
    "trust": "tr",
    "authority": "auth",
    "exchange": "exch",
    "holdings": "hldgs hldg holding",
    "services": "svcs svc service",
    "pharmaceuticals": "pharm pharma",
    "insurance": "ins",
    "associates": "assoc assocs",
    "international": "intl",
    "brothers": "bros",
    "railway": "rly",
    "university": "univ",
    "institute": "inst",
    "bank": "bk",
    "works": "wks",
    "mills": "mls",
    "partners": "ptnrs",
    "solutions": "sol",
    "systems": "sys syst",
    "group": "grp",
    "society": "soc",
    "foundation": "fdn",
    "council": "cncl",
    "agency": "agcy",
    "press": "pr",
}
#: Words that may precede a firm's own name and belong to it.
PREFIXES = ("precision", "alpine", "united", "nordic", "general", "national", "royal", "first", "global", "central", "northern", "southern", "eastern", "western", "pacific", "atlantic", "continental")
#: Nicknames that are neither the beginning nor the end of the forename they stand for.
NICKNAMES = {
    "kit": "christopher", "bob": "robert", "bobby": "robert", "rob": "robert", "robbie": "robert", "bill": "william", "billy": "william", "liam": "william", "will": "william", "willy": "william",
    "liz": "elizabeth", "lizzie": "elizabeth", "betty": "elizabeth", "eliza": "elizabeth", "peggy": "margaret", "maggie": "margaret", "meg": "margaret", "daisy": "margaret", "kate": "katherine", "kathy": "katherine", "kat": "katherine", "katie": "katherine",
    "hetty": "henrietta", "etta": "henrietta", "harry": "henry", "hank": "henry", "vroni": "veronika", "nika": "veronika", "roz": "rosalind", "lindy": "rosalind", "wendy": "gwendolyn", "gwen": "gwendolyn", "gus": "augustin", "gusti": "augustin", "tin": "augustin",
    "paca": "francisca", "paquita": "francisca", "fran": "francisca", "poldi": "leopold", "leo": "leopold", "flip": "philippa", "pippa": "philippa", "pip": "philippa", "nino": "giovanni", "gianni": "giovanni", "vanni": "giovanni",
    "liesl": "anneliese elizabeth", "anne": "anneliese", "chava": "salvador", "salva": "salvador", "ted": "theodore edward", "teddy": "theodore edward", "theo": "theodore", "tori": "victoria", "vicky": "victoria", "lexi": "alexandra", "alex": "alexandra alexander", "sandra": "alexandra", "sandy": "alexandra alexander",
    "hannes": "johannes", "jo": "johannes", "hans": "johannes", "otti": "ottoline", "willa": "wilhelmina", "mina": "wilhelmina", "emmy": "emmeline", "lina": "emmeline", "isi": "isidora", "dora": "dorothea isidora theodora", "thea": "dorothea theodora", "nate": "nathaniel", "nat": "nathaniel", "neil": "nathaniel cornelius",
    "chris": "christopher", "ben": "benedikt benjamin", "bene": "benedikt", "berto": "umberto alberto roberto", "hias": "matthias", "matt": "matthias matthew", "mila": "ludmila", "cor": "cornelius", "zach": "zachariah", "beth": "elizabeth", "quin": "quentin", "yso": "ysolde", "sor": "soren", "helo": "heloise", "je": "jerome", "bjoern": "bjorn",
    "jim": "james", "jimmy": "james", "jack": "john", "johnny": "john", "dick": "richard", "rick": "richard", "mike": "michael", "mick": "michael", "tom": "thomas", "tommy": "thomas", "tony": "anthony", "pepe": "jose", "paco": "francisco", "pancho": "francisco", "nacho": "ignacio", "lupe": "guadalupe", "sepp": "josef", "toni": "anton", "fritz": "friedrich", "uli": "ulrich",
    "abby": "abigail", "polly": "mary", "molly": "mary", "sally": "sarah", "nell": "eleanor helen", "nora": "eleanor", "steve": "stephen", "dave": "david", "dan": "daniel", "sam": "samuel samantha", "joe": "joseph", "ed": "edward", "ned": "edward", "frank": "francis", "jerry": "gerald", "larry": "lawrence", "ron": "ronald", "don": "donald", "ken": "kenneth", "greg": "gregory",
}
#: A word is a full forename of the collection when so many spellings open with it, and at least twice as many as close with it.
LEXICON_ROWS = 5
#: Letters up to which a whole name may be an abbreviation that several firms share.
ABBREVIATION = 4
#: Forenames that a pass over the distinct words holds.
LEXICON_BLOCK = 5000


def fold(s: str) -> str:
    """Lower case without accents, look-alikes, zero-width marks and odd blanks."""
    s = ZERO_WIDTH.sub("", s)
    s = unicodedata.normalize("NFKD", s.casefold()).translate(LOOKALIKE)
    s = "".join(c for c in s if not unicodedata.combining(c)).translate(LOOKALIKE)
    return " ".join(s.split())


def words(s: str) -> list[str]:
    """Words of a folded spelling: dots split, apostrophes and inner hyphens join; digits inside words become letters."""
    s = re.sub(r"['’`´]", "", s)
    s = re.sub(r"(?<=\w)-(?=\w)", "", s)
    out = re.findall(r"[^\W_]+", s)
    return [_undigit(w) if re.search(r"[^\W\d]", w) else w for w in out]


def _undigit(w: str) -> str:
    return w.translate(str.maketrans("015", "ols")) if re.search(r"\d", w) else w


@lru_cache(maxsize=None)
def _trade_forms() -> dict[str, str]:
    return {f: t for t, fs in TRADES.items() for f in [t, *fs.split()]}


def limit_of(length: int) -> int:
    """Edits up to which a word of this length is taken for a misspelling of a known one."""
    return 3 if length >= 9 else 2 if length >= 5 else 1


def _without(w: str, k: int) -> set[str]:
    """A word without up to k of its letters."""
    out = last = {w}
    for _ in range(min(k, len(w))):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        out = out | last
    return out


class Near:
    """Known words within the limit of a word, by shared shortened forms: words within k edits have one after k deletions each."""

    def __init__(self, lexicon: list[str]):
        self.by: dict[str, set[str]] = {}
        # A word of n letters is asked for with limit_of(n), and n may exceed the known word's length by that.
        for w in lexicon:
            for x in _without(w, limit_of(len(w) + 3)):
                self.by.setdefault(x, set()).add(w)

    def nearest(self, w: str, most: int | None = None) -> tuple[int, list[str]]:
        """The least distance within the limit, and the known words at it."""
        most = limit_of(len(w)) if most is None else most
        met = {y for x in _without(w, most) for y in self.by.get(x, ()) if abs(len(y) - len(w)) <= most}
        if not met:
            return most + 1, []
        words_ = sorted(met)
        d = distances(w, *encode(words_))
        k = int(d.min())
        return (k, [words_[i] for i in np.flatnonzero(d == k)]) if k <= most else (most + 1, [])

    def only(self, w: str) -> str:
        """The only nearest known word within the limit, or ''."""
        _, hits = self.nearest(w)
        return hits[0] if len(hits) == 1 else ""


@lru_cache(maxsize=2)
def _near(words_: tuple[str, ...]) -> Near:
    return Near(list(words_))


_LONG_TRADES = tuple(t for t in TRADES if len(t) >= 6)


@lru_cache(maxsize=100_000)
def trade_of(w: str) -> str:
    """The trade a word is a form or misspelling of, or ''."""
    forms = _trade_forms()
    if w in forms:
        return forms[w]
    if len(w) < 5:
        return ""
    k, hits = _near(_LONG_TRADES).nearest(w)
    # A short word must be nearer to be a misspelling.
    return hits[0] if len(hits) == 1 and (len(w) > 5 or k <= 1) else ""


@lru_cache(maxsize=100_000)
def prefix_of(w: str) -> str:
    """The prefix a word is or is a misspelling of, or ''."""
    return w if w in PREFIXES else _near(PREFIXES).only(w) if len(w) >= 5 else ""


def parse_org(s: str) -> tuple[str, str] | None:
    """(prefix + trade, core) of a folded spelling, or None where it has no trade and no legal form."""
    ws = words(s.replace("&", " "))
    if ws and ws[0] == "the":
        ws = ws[1:]
    legal = False
    for form in LEGAL:
        if len(ws) > len(form) and tuple(ws[-len(form) :]) == form:
            ws, legal = ws[: -len(form)], True
            break
    ws = [w for w in ws if w not in ("and", "und", "y", "et")]
    prefix = ""
    if len(ws) > 1 and (p := prefix_of(ws[0])):
        prefix, ws = p, ws[1:]
    if len(ws) > 1:
        # The trade stands last, or first where the name was turned round.
        for at in (len(ws) - 1, 0, *range(1, len(ws) - 1)):
            if t := trade_of(ws[at]):
                return f"{prefix} {t}".strip(), "".join(ws[:at] + ws[at + 1 :])
    if legal and ws:
        return f"{prefix} -".strip(), "".join(ws)
    return None


def whole_name(s: str) -> str:
    """The core of a folded organisation name that shows neither a trade nor a legal form: all its words but articles and ands."""
    ws = [w for w in words(s.replace("&", " ")) if w not in ("the", "and", "und", "y", "et", "of")]
    return "".join(ws)


def person_words(s: str) -> tuple[list[str], list[str]] | None:
    """Words of a folded person's spelling without titles, those before a comma apart; None where there are too few."""
    before, comma, after = s.partition(",")
    one, two = ([w for w in ws if w not in TITLES] if len(ws) > 1 else ws for ws in (words(re.sub(r"(?<=\w)\.(?=\w)", ". ", x)) for x in (before, after)))
    if comma and one and two:
        return one, two
    ws = one + two
    return (ws, []) if len(ws) >= 2 else None


class Forenames:
    """What a forename may stand for, given full forenames of the collection (all of them, or a block)."""

    def __init__(self, lexicon: list[str]):
        self.known = frozenset(x for x in lexicon if x not in NICKNAMES and len(x) >= 4)
        self.near = Near(sorted(self.known))
        self.ends: dict[str, list[str]] = {}
        for x in sorted(self.known):
            for k in range(2, 6):
                self.ends.setdefault(x[:k], []).append(x)
                if k > 2 and x[-k:] != x[:k]:
                    self.ends.setdefault(x[-k:], []).append(x)

    def match(self, w: str) -> tuple[int, int, list[str]]:
        """(rule, edits, forenames), lesser rules first: itself, a nickname's, those it begins or ends, the nearest ones."""
        if w in self.known:
            return 0, 0, [w]
        if w in NICKNAMES:
            return 1, 0, [x for x in NICKNAMES[w].split() if x in self.known]
        if 2 <= len(w) <= 5 and (some := self.ends.get(w)):
            return 2, 0, some
        return 3, *(self.near.nearest(w) if len(w) >= 4 else (0, []))

    def stands(self, w: str) -> tuple[str, ...]:
        rule, _, full = self.match(w)
        return usual(w, full if rule < 3 or len(full) == 1 else [])


def usual(w: str, full: list[str]) -> tuple[str, ...]:
    """The forenames found; for a nickname without any in the collection, those it stands for as a rule."""
    return tuple(full) or tuple(NICKNAMES.get(w, "").split())


class Found:
    """The same from what was found for the words of one spelling."""

    def __init__(self, found: dict[str, list[str]]):
        self.found = found

    def stands(self, w: str) -> tuple[str, ...]:
        return usual(w, self.found.get(w, []))


def parse_person(s: str, fore: Forenames) -> tuple[tuple[str, ...], str, str, str] | None:
    """(full forenames it may be, initial, middle initial, surname) of a folded spelling."""
    p = person_words(s)
    return p and parse_words(*p, fore)


def parse_words(ws: list[str], after: list[str], fore: Forenames | Found) -> tuple[tuple[str, ...], str, str, str] | None:
    """The same of a person's words."""
    if after:
        sur, rest = "".join(ws), after
    else:
        first, last = ws[0], ws[-1]
        # A turned name without comma: the last word is a forename or an initial and the first is not.
        first_fore, last_fore = len(first) <= 2 or bool(fore.stands(first)), len(last) == 1 or bool(fore.stands(last))
        if last_fore and not first_fore and len(first) > 2:
            sur, rest = ws[0], ws[1:]
        else:
            k = 1
            while k < len(ws) - 1 and len(ws[k]) == 1:
                k += 1
            sur, rest = "".join(ws[k:]), ws[:k]
    if not rest or len(sur) < 2:
        return None
    head, mid = rest[0], (rest[1][0] if len(rest) > 1 else "")
    if len(head) == 1:
        return (), head, mid, sur
    if len(head) == 2 and head not in NICKNAMES:
        return (), head[0], mid or head[1], sur
    return fore.stands(head) or (head,), "", mid, sur


READ = "spelling string, kind string, n bigint, what string, core string, tag string, ws array<string>, after array<string>"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(kind, spelling, n) -> readings: 'O' with trade or form, 'W' a whole name, 'P' a person's words."""
    for df in batches:
        rows = []
        for kind, sp, n in zip(df["kind"].tolist(), df["spelling"].tolist(), df["n"].tolist()):
            s = fold(sp)
            org = parse_org(s) if kind != "PERSON" else None
            if org:
                rows.append((sp, kind, n, "O", org[1], org[0], None, None))
                continue
            if kind != "PERSON" and (core := whole_name(s)):
                rows.append((sp, kind, n, "W", core, "", None, None))
            if kind != "ORG" and (p := person_words(s)):
                rows.append((sp, kind, n, "P", "", "", *p))
        yield objects(**{c: list(x) for c, x in zip(("spelling", "kind", "n", "what", "core", "tag", "ws", "after"), zip(*rows))}) if rows else pd.DataFrame(columns=["spelling", "kind", "n", "what", "core", "tag", "ws", "after"], dtype=object)


def _blocks_of(lexicon: DataFrame) -> Iterator[list[tuple[str, int]]]:
    """The lexicon (w, f) in blocks; the driver holds one at a time."""
    block: list[tuple[str, int]] = []
    for r in lexicon.select("w", "f").coalesce(1).toLocalIterator():
        block.append((r["w"], r["f"]))
        if len(block) == LEXICON_BLOCK:
            yield block
            block = []
    if block:
        yield block


def forename_lexicon(tokens: DataFrame) -> DataFrame:
    """(w, f): the full forenames among (w, f, l), words with how many spellings they open and close.

    A near word that is more than six times as frequent makes a word its misspelling, no forename of its own.
    """
    often = cut(tokens.where((F.col("f") >= LEXICON_ROWS) & (F.col("f") >= 2 * F.col("l")) & (F.length("w") >= 4) & ~F.col("w").isin(*TITLES, *NICKNAMES)).select("w", "f"))
    bad = None
    for block in _blocks_of(often):

        def misspelt(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            near, rows = Near([w for w, _ in block]), dict(block)
            for df in batches:
                found = []
                for w, f in zip(df["w"].tolist(), df["f"].tolist()):
                    met = {y for x in _without(w, 2) for y in near.by.get(x, ()) if rows[y] > 6 * f}
                    if met and int(distances(w, *encode(sorted(met))).min()) <= 2:
                        found.append(w)
                yield objects(w=found)

        got = often.mapInPandas(misspelt, "w string")
        bad = got if bad is None else bad.unionByName(got)
    return often if bad is None else cut(often.join(bad.distinct(), "w", "left_anti"))


def stands_for(tokens: DataFrame) -> DataFrame:
    """(w, full): the full forenames a word may be: itself, a nickname's, those it begins or ends, the only nearest one."""
    lexicon = forename_lexicon(tokens)
    out = None
    for block in _blocks_of(lexicon):

        def match(batches: Iterator[pd.DataFrame], known=[w for w, _ in block]) -> Iterator[pd.DataFrame]:
            fore = Forenames(known)
            for df in batches:
                hits = [(w, *fore.match(w)) for w in df["w"].tolist()]
                hits = [x for x in hits if x[3]]
                yield objects(w=[x[0] for x in hits], rule=np.array([x[1] for x in hits], np.int32), d=np.array([x[2] for x in hits], np.int32), full=[x[3] for x in hits])

        got = tokens.select("w").mapInPandas(match, "w string, rule int, d int, full array<string>")
        out = got if out is None else out.unionByName(got)
    if out is None:
        return tokens.where("false").select("w", F.array("w").alias("full"))
    best = out.groupBy("w").agg(F.min_by("rule", F.struct("rule", "d")).alias("rule"), F.min(F.struct("rule", "d")).alias("_m"), F.collect_list(F.struct("rule", "d", "full")).alias("_x"))
    full = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter("_x", lambda x: F.struct(x["rule"], x["d"]) == F.col("_m")), lambda x: x["full"]))))
    return best.select("w", "rule", full.alias("full")).where((F.col("rule") < 3) | (F.size("full") == 1)).select("w", "full")


PARSED = "spelling string, kind string, full array<string>, mid string, core string, tag string, known boolean"


def _people(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(spelling, kind, ws, after, stands) -> parsed persons."""
    for df in batches:
        rows = []
        for sp, kind, ws, after, met in zip(*(df[c].tolist() for c in ("spelling", "kind", "ws", "after", "stands"))):
            found = {x["w"]: list(x["full"]) for x in met} if met is not None else {}
            known = {x for full in found.values() for x in full}
            if p := parse_words(list(ws), list(after), Found(found)):
                full, init, mid, sur = p
                rows.append((sp, kind, list(full), mid, re.sub("ph", "f", sur), init, set(full) <= known))
        cols = ("spelling", "kind", "full", "mid", "core", "tag", "known")
        yield objects(**{c: list(x) for c, x in zip(cols, zip(*rows))}) if rows else pd.DataFrame(columns=list(cols), dtype=object)


def same_names(entities: DataFrame, links: DataFrame) -> DataFrame:
    """(key, is_mention, comp): every person and organisation record and unresolved mention with its class.

    A class is named by one of its spellings. Spellings without a letter or digit, and single words of
    persons, give no row. Null and empty names and aliases are ignored, repeated ones count once, other columns are
    ignored; empty tables give no rows.
    """
    ents = entities.where(F.col("type").isin("PERSON", "ORG") & F.col("canonical_id").isNotNull())
    spell = ents.select(F.col("canonical_id").alias("key"), F.lit(False).alias("mention"), F.col("type").alias("kind"), F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_p", "spelling")).withColumn("own", F.col("_p") == 0).drop("_p")
    ment = links.where("canonical_id IS NULL AND document_id IS NOT NULL AND entity_ord IS NOT NULL").select(F.concat_ws("#", "document_id", "entity_ord").alias("key"), F.lit(True).alias("mention"), F.lit("ANY").alias("kind"), F.col("mention_text").alias("spelling"), F.lit(True).alias("own"))
    rows = cut(spell.unionByName(ment).where("spelling IS NOT NULL AND trim(spelling) <> ''").groupBy("key", "mention", "kind", "spelling").agg(F.max("own").alias("own")))
    n = parts(rows.sparkSession)
    spellings = rows.groupBy("kind", "spelling").agg(F.count(F.lit(1)).alias("n"))
    read = cut(spellings.repartition(n).mapInPandas(_read, READ))
    persons = read.where("what = 'P'")
    turned = F.size("after") > 0
    first, last = F.when(turned, F.col("after")[0]).otherwise(F.col("ws")[0]), F.when(turned, F.element_at("ws", -1)).otherwise(F.element_at("ws", -1))
    ends = F.array(F.struct(first.alias("w"), F.col("n").alias("f"), F.lit(0).cast("bigint").alias("l")), F.struct(last.alias("w"), F.lit(0).cast("bigint").alias("f"), F.col("n").alias("l")))
    second = F.when(~turned & (F.size("ws") > 2), F.array(F.struct(F.col("ws")[1].alias("w"), F.lit(0).cast("bigint").alias("f"), F.lit(0).cast("bigint").alias("l")))).otherwise(F.array().cast("array<struct<w:string,f:bigint,l:bigint>>"))
    tokens = cut(persons.select(F.explode(F.concat(ends, second)).alias("e")).select("e.*").where(F.length("w") > 1).groupBy("w").agg(F.sum("f").alias("f"), F.sum("l").alias("l")).repartition(n))
    stands = stands_for(tokens)
    asked = persons.select("spelling", "kind", F.explode(F.array_distinct(F.filter(F.array(first, last, F.try_element_at("ws", F.lit(2))), lambda w: w.isNotNull() & (F.length(w) > 1)))).alias("w"))
    met = asked.join(stands, "w").groupBy("spelling", "kind").agg(F.collect_list(F.struct("w", "full")).alias("stands"))
    people_read = persons.select("spelling", "kind", "ws", "after").join(met, ["spelling", "kind"], "left").mapInPandas(_people, PARSED)
    firms_read = read.where("what <> 'P'").select("spelling", "kind", F.array().cast("array<string>").alias("full"), F.lit("").alias("mid"), "core", "tag", F.lit(True).alias("known"), "what")
    parsed = people_read.withColumn("what", F.lit("P")).unionByName(firms_read)
    named = cut(rows.join(parsed, ["kind", "spelling"]).select("key", "mention", "what", "full", "mid", "core", "tag", "known", "own"))
    # Whole names tell records apart that show no trade in any spelling; a short one only as the record's own name,
    # as firms share abbreviations. Where no such record is, mentions have none to meet.
    traded = named.where("what = 'O'").select("key").distinct()
    whole = named.where((F.col("what") == "W") & (F.col("own") | (F.length("core") > ABBREVIATION))).join(traded, "key", "left_anti")
    named = named.where("what <> 'W'") if whole.where("NOT mention").isEmpty() else cut(named.where("what <> 'W'").unionByName(whole))

    # A record's own full forename says which one its nicknames and initials stand for.
    own = (
        named.where("what = 'P' AND size(full) > 0")
        .groupBy("key")
        .agg(F.min_by(F.col("full"), F.struct(~F.col("known"), F.size("full"), F.col("full"))).alias("own_full"))
    )
    mids = named.where("what = 'P' AND mid <> ''").groupBy("key").agg(F.min("mid").alias("own_mid"))
    people = (
        named.where("what = 'P'")
        .join(own, "key", "left")
        .join(mids, "key", "left")
        .select("key", "mention", "core", F.coalesce("own_full", F.array().cast("array<string>")).alias("full"), F.coalesce("own_mid", F.lit("")).alias("mid"), "tag")
    )
    # One block per initial; a nickname that may stand for forenames of several initials is in each.
    inits = F.when(F.size("full") > 0, F.array_distinct(F.transform("full", lambda x: F.substring(x, 1, 1)))).otherwise(F.array("tag"))
    people = people.withColumn("init", F.explode(inits)).where("init <> ''").select("key", "mention", F.concat(F.lit("P "), "init").alias("block"), "core", F.filter("full", lambda x: F.substring(x, 1, 1) == F.col("init")).alias("full"), "mid")
    orgs = named.where("what <> 'P'").select("key", "mention", F.when(F.col("what") == "O", F.concat(F.lit("O "), "tag")).otherwise("O *").alias("block"), "core", F.array().cast("array<string>").alias("full"), F.lit("").alias("mid"))
    profiled = cut(people.unionByName(orgs).distinct())
    profiles = cut(profiled.select("block", "core", "full", "mid").distinct())
    cores = profiles.select("block", F.col("core").alias("s")).distinct()
    near = cut(radius_pairs(cores))
    pairs = near.select("block", "a", "b").union(near.select("block", F.col("b").alias("a"), F.col("a").alias("b"))).union(cores.select("block", F.col("s").alias("a"), F.col("s").alias("b")))
    pid = F.concat_ws("|", "block", "core", F.array_join("full", "/"), "mid")
    left = profiles.select("block", F.col("core").alias("a"), F.col("full").alias("fa"), F.col("mid").alias("ma"), pid.alias("pa"))
    right = profiles.select("block", F.col("core").alias("b"), F.col("full").alias("fb"), F.col("mid").alias("mb"), pid.alias("pb"))
    met = cut(pairs.join(left, ["block", "a"]).join(right, ["block", "b"]).where("pa <> pb").select("block", "a", "b", "fa", "ma", "pa", "fb", "mb", "pb"))
    mid_ok = (F.col("ma") == "") | (F.col("mb") == "") | (F.col("ma") == F.col("mb"))
    org = F.col("block").startswith("O ")
    exact = (F.size("fa") > 0) & (F.size("fb") > 0) & F.arrays_overlap("fa", "fb")
    # How many full forenames an initial alone (or an open nickname) may stand for near its surname.
    vague = (F.size("fa") != 1) & (F.size("fb") == 1) & mid_ok & ((F.size("fa") == 0) | F.arrays_overlap("fa", "fb"))
    reach = met.where(~org & vague).groupBy("pa").agg(F.count_distinct(F.element_at("fb", 1)).alias("n_full"))
    # Whole names that only mentions have are no evidence for each other: they may be persons.
    recorded = profiled.where("block = 'O *' AND NOT mention").select(F.concat_ws("|", "block", "core", F.array_join("full", "/"), "mid").alias("_r")).distinct()
    whole = met.where("block = 'O *'").select("block", "pa", "pb")
    whole = whole.join(recorded, whole["pa"] == recorded["_r"], "left_semi")
    sure = met.where((org & (F.col("block") != "O *")) | (exact & mid_ok & (F.size("fa") == 1) & (F.size("fb") == 1)))
    single = met.where(~org & vague).join(reach.where("n_full = 1").select("pa"), "pa")
    # Where no full forename is near, initials of the same surname and middle initial meet each other.
    alone = met.where(~org & mid_ok & (F.size("fa") != 1) & (F.size("fb") != 1) & ((F.size("fa") == 0) | (F.size("fb") == 0) | F.arrays_overlap("fa", "fb"))).join(reach.select("pa"), "pa", "left_anti").join(reach.select(F.col("pa").alias("pb")), "pb", "left_anti")
    edges = sure.select("block", "pa", "pb").union(whole).union(single.select("block", "pa", "pb")).union(alone.select("block", "pa", "pb"))
    near_roots = cut(contracted(edges))
    holds = profiled.select("key", "mention", pid.alias("p")).distinct()
    rooted = cut(holds.join(near_roots, holds["p"] == near_roots["node"], "left").select("key", "mention", F.coalesce("root", "p").alias("root")).distinct())
    # Only keys, and profiles of a split block, that stand under several roots join these; all else is settled.
    several = lambda df, by: df.join(df.groupBy(by).agg(F.min("root").alias("a"), F.max("root").alias("_z")).where("a <> _z").select(by, "a"), by).select("a", F.col("root").alias("b"))
    comp = components(several(rooted, "key").union(several(near_roots, "node")))
    return rooted.join(comp, rooted["root"] == comp["node"], "left").select("key", F.col("mention").alias("is_mention"), F.coalesce("comp", "root").alias("comp")).distinct()


#: Edges of a block that one task contracts.
CONTRACT_ROWS = 100_000


def contracted(edges: DataFrame) -> DataFrame:
    """(block, pa, pb) -> (node, root): each node with the least node that the edges of its task join it to.

    A task takes a block, or a share of one of more than ``CONTRACT_ROWS`` edges; of a shared block, a
    node may have several roots.
    """
    shares = edges.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / CONTRACT_ROWS).cast("int").alias("shares"))
    dealt = edges.join(shares, "block").select("block", F.pmod(F.xxhash64("pa"), F.col("shares")).alias("share"), "pa", "pb").repartition(parts(edges.sparkSession), "block", "share")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict[str, str] = {}

        def top(x: str) -> str:
            root = x
            while (y := up.setdefault(root, root)) != root:
                root = y
            while up[x] != root:
                up[x], x = root, up[x]
            return root

        for df in batches:
            for a, b in zip(df["pa"].tolist(), df["pb"].tolist()):
                a, b = top(a), top(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        nodes = list(up)
        for lo in range(0, len(nodes), 50_000):
            some = nodes[lo : lo + 50_000]
            yield objects(node=some, root=[top(x) for x in some])

    return dealt.select("pa", "pb").mapInPandas(run, "node string, root string")


def same_pairs(classes: DataFrame) -> DataFrame:
    """(key_a, key_b), key_a < key_b: pairs of a class with at least one record."""
    a = classes.select("comp", F.col("key").alias("x"))
    b = classes.where("NOT is_mention").select("comp", F.col("key").alias("y"))
    return a.join(b, "comp").where("x <> y").select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()
