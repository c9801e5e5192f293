import random

import numpy as np
import pytest

from quillgraph.llm import metricjoin as MJ
from quillgraph.llm import names as N


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distances_exact():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(0, 12))) for _ in range(60)] + ["x" * 70, "x" * 69 + "y", ""]
    codes, lens, table = MJ.encode(words)
    for p in [*words[:12], "x" * 70, "zzz", ""]:
        assert MJ.distances(p, codes, lens, table).tolist() == [lev(p, w) for w in words]


@pytest.mark.parametrize("cell", [4000, 25])
def test_radius_join_equals_brute_force(spark, cell):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefghij") for _ in range(rng.choice([5, 8, 12]))) for _ in range(60)]

    def typo(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "q" + w[i + 1 :]])

    words = {b: s for s in base + [typo(w) for w in base] + [typo(typo(w)) for w in base] for b in [s]}
    rows = [(f"b{hash(w[:1]) % 1}", w) for w in words] + [(None, "x"), ("b0", None), ("b0", "")]
    df = spark.createDataFrame(rows, "block string, s string")
    got = {(r.a, r.b, r.d) for r in MJ.radius_pairs(df, cell).collect()}
    ws = sorted(words)
    want = {(a, b, lev(a, b)) for i, a in enumerate(ws) for b in ws[i + 1 :] if lev(a, b) <= MJ.radius_of(min(len(a), len(b)))}
    assert got == want


def test_partitioning_is_active_and_loses_no_pair(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(13)) for _ in range(150)]
    words = sorted({w for n in names for w in (n, n[:4] + n[5:], n[:7] + "z" + n[7:], n[1:] + "q")} | {"ab", "abc", "abcd", "abce"})
    df = spark.createDataFrame([("b", w) for w in words], "block string, s string")
    for sample in (16_384, 40):
        cells = MJ.placed(df, 100, sample).collect()
        homes = [r for r in cells if r.home]
        assert sorted(r.s for r in homes) == words
        if sample > len(words):  # a cell for each name, and hardly any spelling in a second one
            assert len({r.cell for r in homes}) > 100 and len(cells) < 1.5 * len(words)
        got = {(r.a, r.b, r.d) for r in MJ.radius_pairs(df, 100, sample).collect()}
        assert got == {(a, b, lev(a, b)) for i, a in enumerate(words) for b in words[i + 1 :] if lev(a, b) <= MJ.radius_of(min(len(a), len(b)))}


def test_pivots_are_apart_and_near_all():
    rng = random.Random(6)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(120)]
    chosen = MJ.choose_pivots(words)
    assert all(lev(a, b) > MJ.PIVOT_GAP for i, a in enumerate(chosen) for b in chosen[:i])
    assert all(min(lev(w, p) for p in chosen) <= MJ.PIVOT_GAP for w in words)


def test_near_finds_all_within_the_limit():
    rng = random.Random(8)
    lexicon = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(4, 11))) for _ in range(60)})
    near = N.Near(lexicon)
    for _ in range(200):
        w = "".join(rng.choice("abcd") for _ in range(rng.randrange(4, 11)))
        best = min(lev(w, x) for x in lexicon)
        d, hits = near.nearest(w)
        assert hits == ([x for x in lexicon if lev(w, x) == best] if best <= N.limit_of(len(w)) else []) and (not hits or d == best)


def test_components_that_do_not_settle_raise(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)]
    with pytest.raises(RuntimeError, match="settle"):
        MJ.components(spark.createDataFrame(edges, "a string, b string"), max_rounds=1)


def test_components(spark):
    edges = [("a", "b"), ("b", "c"), ("x", "y"), ("q", "q")] + [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)]
    got = {r.node: r.comp for r in MJ.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got["c"] == "a" and got["y"] == "x" and len({got[f"n{i:03}"] for i in range(61)}) == 1 and "q" not in got
    assert MJ.components(spark.createDataFrame([], "a string, b string")).count() == 0


ENT = "canonical_id string, name string, type string, aliases array<string>, extra int, document_id string"
LNK = "document_id string, entity_ord int, mention_text string, canonical_id string, entity_type string"


def run(spark, ents, links=()):
    e = spark.createDataFrame([(*x, 1, "clash") for x in ents], ENT)
    l_ = spark.createDataFrame(list(links), LNK)
    return {(r.key_a, r.key_b) for r in N.same_pairs(N.same_names(e, l_)).collect()}


def test_same_names(spark):
    # Enough company that forenames are known as such.
    crowd = [(f"c{i}", f"{f} Zzqxv{chr(97 + i % 26) * 3}{i}wmkp", "PERSON", None) for i, f in enumerate(["Christopher", "Victoria", "Veronika", "Johannes"] * 8)]
    ents = [
        ("e1", "Christopher Bratgemnuk", "PERSON", ["Kit Bratgemnuk", "Kit Bratgemnuk"]),
        ("e2", "Bratgemnuk, C. H.", "PERSON", []),
        ("e3", "Dr. christopher bratgmenuk", "PERSON", None),
        ("e4", "Victoria Bratgemnuk", "PERSON", None),
        ("e5", "Nordic Spumtrikdal Mfg. GmbH", "ORG", ["NSM"]),
        ("e6", "NORDIC SPUMTRIK-DAL MANUFACTURING", "ORG", [None, ""]),
        ("e7", "Nordic Spumtrikdal Textiles GmbH", "ORG", ["NSM"]),
        ("e8", "Bratgemnuk", "LOCATION", None),
        ("e9", None, "PERSON", None),
    ]
    links = [("d", 0, "Bratgemnuk, Christopher", None, "PERSON"), ("d", 0, "Bratgemnuk, Christopher", None, "PERSON"), ("d", 1, "The Nordic Spumtrikdаl Manufacturing Ltd.", None, "PERSON"), ("d", 2, "Kit Bratgemnuk", "e1", "PERSON"), ("d", 3, None, None, None), (None, 4, "Kit Bratgemnuk", None, "PERSON")]
    got = {p for p in run(spark, crowd + ents, links) if not (p[0].startswith("c") and p[1].startswith("c"))}
    assert got == {("e1", "e2"), ("e1", "e3"), ("e2", "e3"), ("d#0", "e1"), ("d#0", "e2"), ("d#0", "e3"), ("e5", "e6"), ("d#1", "e5"), ("d#1", "e6")}


def test_ambiguous_initial_joins_neither(spark):
    ents = [("v1", "Victoria Stelgruvmad", "PERSON", None), ("v2", "Veronika Stelgruvmad", "PERSON", None), ("v3", "V. Stelgruvmad", "PERSON", None)]
    assert run(spark, ents) == set()


def test_empty_and_long(spark):
    assert run(spark, []) == set()
    long = "Gasdrap" * 400
    assert run(spark, [("a", f"Anna {long}", "PERSON", None), ("b", f"Anna {long}x", "PERSON", None), ("c", "   ", "ORG", [])]) == {("a", "b")}


def test_parsing():
    fore = N.Forenames(["christopher", "victoria", "wilhelmina"])
    assert N.parse_person(N.fold("Sra. Wilhelmina R. Bratnuk"), fore) == (("wilhelmina",), "", "r", "bratnuk")
    assert N.parse_person(N.fold("RV Bratnuk"), fore) == ((), "r", "v", "bratnuk")
    assert N.parse_person(N.fold("Bratnuk Victoria"), fore)[0] == ("victoria",)
    assert N.parse_person(N.fold("Kit Bratnuk"), fore)[0] == ("christopher",)
    assert N.parse_person("bratnuk", fore) is None
    assert N.parse_org(N.fold("The Alpine Bratnuk, Shpg. & Co.")) == ("alpine shipping", "bratnuk")
    assert N.parse_org(N.fold("Textiles Bratnuk G.m.b.H.")) == ("textiles", "bratnuk")
    assert N.fold("Zа​chá") == "zacha" and np.int32(1) == 1


def test_firms_without_trade_or_form_are_linked_by_their_whole_name(spark):
    ents = [("r1", "Red Cross", "ORG", ["The Red Cross"]), ("r2", "Red Croos", "ORG", None), ("t1", "Toyota", "ORG", None), ("b1", "BBC", "ORG", None), ("b2", "BBD", "ORG", None), ("m1", "Médecins Sans Frontières", "ORG", None), ("x1", "Oxfam", "ORG", ["OX"]), ("x2", "Oxbow Mills", "ORG", ["OX"])]
    links = [("d", 0, "Toyotta", None, "ORG"), ("d", 1, "medecins sans frontieres", None, None), ("d", 2, "Anna Brat", None, "PERSON"), ("d", 3, "Anna Bratt", None, "PERSON"), ("d", 4, "BBC", None, "ORG")]
    got = run(spark, ents, links)
    assert got == {("r1", "r2"), ("d#0", "t1"), ("d#1", "m1"), ("b1", "d#4")}


def test_unknown_forenames_stand_for_themselves(spark):
    crowd = [(f"c{i}", f"{f} Zzqxv{chr(97 + i % 26) * 3}{i}wmkp", "PERSON", None) for i, f in enumerate(["Anneliese", "Emmeline", "Matthias"] * 8)]
    ents = [("a1", "Anna Bratgemnuk", "PERSON", None), ("a2", "Anneliese Bratgemnuk", "PERSON", None), ("l1", "Lena Stelgruvmad", "PERSON", None), ("l2", "Emmeline Stelgruvmad", "PERSON", None), ("m1", "Marta Kolvadrin", "PERSON", None), ("m2", "Matthias Kolvadrin", "PERSON", None), ("a3", "Anna Bratgemnukk", "PERSON", None)]
    got = {p for p in run(spark, crowd + ents) if not (p[0].startswith("c") and p[1].startswith("c"))}
    assert got == {("a1", "a3")}
    assert N.Forenames(["anneliese", "emmeline", "matthias"]).stands("lisa") == ()


def test_lexicon_does_not_depend_on_the_size(spark, monkeypatch):
    rare = [("rare" + c + "a", 5, 0) for c in "bcdfg"]
    few = spark.createDataFrame([*rare, ("dominik", 40, 1), ("domimik", 5, 0)], "w string, f bigint, l bigint")
    many = few.unionByName(spark.createDataFrame([(f"q{i:04}xyvw{i % 7}", 9, 0) for i in range(300)] + [("zzzz", 1_000_000, 0)], "w string, f bigint, l bigint"))
    want = {r[0] for r in rare} | {"dominik"}
    for block in (5000, 3):
        monkeypatch.setattr(N, "LEXICON_BLOCK", block)
        assert {r.w for r in N.forename_lexicon(few).collect()} == want
        assert want <= {r.w for r in N.forename_lexicon(many).collect()}
        stands = {r.w: r.full for r in N.stands_for(few.unionByName(spark.createDataFrame([("domini", 1, 0), ("domin", 1, 0), ("xx", 1, 0)], "w string, f bigint, l bigint"))).collect()}
        assert stands["domini"] == ["dominik"] and stands["domin"] == ["dominik"] and "xx" not in stands
