import re

from pyspark.sql import functions as F

from quillgraph.functions.text import heuristic_mentions, heuristic_sentences
from quillgraph.operators import linking as L

TEXTS = ["Ada Lovelace met Charles Babbage. She wrote!  ", "", "...", "The Analytical Engine? In London", "x" * 3000 + ". Y O'Neil-Smith 3M", "A😀 B. C"]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)] + [("null", None)], "document_id string, text string")


def test_sentences_match_python(spark):
    got = {(r.document_id, r.sentence_index): (r.text, r.char_start, r.char_end) for r in heuristic_sentences(docs(spark)).collect()}
    want = {}
    for i, t in enumerate(TEXTS):
        k = 0
        for m in re.finditer(r"[^.!?]+[.!?]?", t):
            s = m.group().strip()
            if s:
                a = m.start() + len(m.group()) - len(m.group().lstrip())
                want[f"d{i}", k] = (s, a, a + len(s))
                k += 1
    assert got == want


def test_mentions(spark):
    rows = heuristic_mentions(docs(spark)).collect()
    for r in rows:
        assert TEXTS[int(r.document_id[1:])][r.char_start : r.char_end] == r.text
    by = {}
    for r in rows:
        by.setdefault(r.document_id, []).append(r.text)
    assert by["d0"] == ["Ada Lovelace", "Charles Babbage"] and by["d3"] == ["Analytical Engine", "London"]
    assert heuristic_mentions(docs(spark, [])).count() == 0


def mentions(spark, rows):
    return spark.createDataFrame(rows, "document_id string, mention_idx int, text string, type string, char_start int, char_end int")


def test_doc_entities(spark):
    m = mentions(spark, [("d", 0, "Ada", "PERSON", 0, 3), ("d", 1, "Ada Lovelace", "ORG", 5, 17), ("d", 2, "London", "LOCATION", 20, 26)])
    c = spark.createDataFrame([("d", 0, "Ada Lovelace", ["Ada", "she"]), ("d", 1, "Nobody", None)], "document_id string, cluster_idx int, canonical string, members array<string>")
    got = [(r.entity_ord, r.surface, r.type, [tuple(x) for x in r.spans]) for r in L.doc_entities(m, c).orderBy("entity_ord").collect()]
    assert got == [(0, "Ada Lovelace", "ORG", [(0, 3), (5, 17)]), (1, "London", "LOCATION", [(20, 26)])]


def test_mention_context(spark):
    e = spark.createDataFrame([("d", 0, "X", [(12, 13), (0, 1)]), ("d", 1, "Y", [])], "document_id string, entity_ord int, surface string, spans array<struct<s:int,e:int>>")
    s = spark.createDataFrame([("d", 0, "First.", 0, 6), ("d", 1, "Second.", 10, 17)], "document_id string, sentence_index int, text string, char_start int, char_end int")
    got = {r.entity_ord: r.context for r in L.mention_context(e, s).collect()}
    assert got == {0: "X Second. First.", 1: "Y"}


def test_set_mode_equals_fold(spark):
    rows = [("d1", 1, 0, "Acme Corp.", "ORG"), ("d1", 1, 1, "London", "LOCATION"), ("d2", 2, 0, "acme corp", "ORG"), ("d2", 2, 1, "Acme", "ORG"), ("d3", 3, 0, "London", "ORG")]
    df = spark.createDataFrame(rows, "document_id string, ingest_order bigint, entity_ord int, surface string, type string")
    a = {(r.document_id, r.entity_ord): (r.canonical_id, r.is_new) for r in L.link_set_mode(df).collect()}
    b = {(r.document_id, r.entity_ord): (r.canonical_id, r.is_new) for r in L.link_fold(df.withColumn("context", F.col("surface")), threshold=2.0, top_k=0).collect()}
    assert a == b and a["d2", 0][0] == a["d1", 0][0] and not a["d2", 0][1]


def fold(spark, rows, **kw):
    df = spark.createDataFrame(rows, "document_id string, ingest_order bigint, entity_ord int, surface string, type string, context string")
    return {(r.document_id, r.entity_ord): r for r in L.link_fold(df, **kw).collect()}


def test_fold_merges_reordered_name_and_learns_alias(spark):
    got = fold(spark, [("a", 1, 0, "Barack Obama", "PERSON", "Barack Obama"), ("b", 2, 0, "Obama Barack", "PERSON", "Obama Barack"), ("c", 3, 0, "Obama Barack", "PERSON", "something else entirely")])
    ids = {r.canonical_id for r in got.values()}
    assert len(ids) == 1 and got["a", 0].is_new and not got["c", 0].is_new and abs(got["b", 0].score - 1) < 1e-9


def test_fold_tie_breaker(spark):
    rows = [("a", 1, 0, "one two three four five", "ORG", "one two three four five"), ("b", 2, 0, "one two three four six", "ORG", "one two three four six")]
    score = fold(spark, rows)["b", 0].score
    asked = fold(spark, rows, threshold=score + 0.01, tie_margin=0.05, tie_break=lambda *a: "Yes")
    assert not asked["b", 0].is_new
    assert fold(spark, rows, threshold=score + 0.01)["b", 0].is_new


def test_blocks(spark):
    e = spark.createDataFrame([("e2", "Apple Inc", "ORG", ["Apple"]), ("e1", "apple", "ORG", None), ("e3", "Apple", "PERSON", [])], "canonical_id string, name string, type string, aliases array<string>")
    m = spark.createDataFrame([("APPLE", "ORG"), ("pear", "ORG")], "surface string, type string")
    assert [(r.surface, r.winner, r.candidates) for r in L.block_candidates(m, e).collect()] == [("APPLE", "e1", 2)]


def test_link_fold_takes_every_mention_of_links(spark, tmp_path):
    from quillgraph.plans import reference_queries as RQ

    links = [("d2", 0, "Acme Works", None, "ORG"), ("d1", 0, "Acme", "e", "ORG"), ("d1", 1, "Acme", None, "PERSON"), ("d2", 0, "Acme Works", None, "ORG")]
    spark.createDataFrame(links, "document_id string, entity_ord int, mention_text string, canonical_id string, entity_type string").write.parquet(f"{tmp_path}/links.parquet")
    spark.createDataFrame([("d1", 0, "Acme Works builds."), ("d2", 0, "None of it."), ("d2", 1, "Acme Works builds.")], "document_id string, sentence_index int, text string").write.parquet(f"{tmp_path}/sentences.parquet")
    spark.createDataFrame([("d1", 1), ("d2", 2), ("d1", 3)], "document_id string, ingest_order bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.document_id, r.entity_ord): r for r in RQ.link_fold(spark, str(tmp_path)).collect()}
    assert sorted(got) == [("d1", 0), ("d1", 1), ("d2", 0)] and got["d1", 0].is_new and got["d1", 1].is_new
    assert got["d2", 0].canonical_id == got["d1", 0].canonical_id != got["d1", 1].canonical_id and not got["d2", 0].is_new and got["d2", 0].score > 0.82


def plain_fold(rows, threshold=0.82, top_k=5, dim=384):
    """The fold row by row: block by key, else the nearest of all entities of the type, else a new one."""
    from quillgraph.operators import fold as K

    out, keys, ents = {}, {}, {}
    for doc, _, ord_, surface, typ, context in sorted(rows, key=lambda r: (r[1], r[0], r[2])):
        vec, key = K.hashed(context, dim), (typ, K.name_key(surface))
        mine = ents.setdefault(typ, [])
        if key in keys:
            cid = keys[key]
            out[doc, ord_] = (cid, round(K.similarity(vec, dict(mine)[cid]), 9), False)
            continue
        met = [(K.similarity(vec, v), -i, c) for i, (c, v) in enumerate(mine) if set(vec) & set(v)] if top_k else []
        score, _, cid = max(met, default=(0.0, 0, None))
        new = cid is None or score < threshold
        if new:
            import hashlib

            cid = "e-" + hashlib.sha256(f"el:{typ}:{key[1]}".encode()).hexdigest()[:16]
            mine.append((cid, vec))
        keys[key] = cid
        out[doc, ord_] = (cid, round(float(score), 9), new)
    return out


def random_mentions(n, seed):
    import random

    rng = random.Random(seed)
    words = ["dock", "mill", "crane", "quarry", "port", "union", "bank", "court"]
    rows = {}
    for _ in range(n):
        doc, ord_ = f"d{rng.randrange(n // 3):03}", rng.randrange(4)
        surface = " ".join(rng.sample(words, rng.choice([1, 2, 2, 3]))).title()
        rows[doc, ord_] = (doc, int(doc[1:]) // 2, ord_, surface, rng.choice(["ORG", "ORG", "LAW"]), surface + " " + " ".join(rng.choice(words + ["the", "of"]) for _ in range(rng.randrange(4))))
    return list(rows.values())


MENTIONS = "document_id string, ingest_order bigint, entity_ord int, surface string, type string, context string"


def test_fold_equals_row_by_row(spark, monkeypatch):
    from quillgraph.operators import fold as K

    rows = random_mentions(150, 3)
    for block, kw in ((512, {}), (512, {"top_k": 0}), (512, {"threshold": 0.6})):
        monkeypatch.setattr(K, "BLOCK", block)
        got = {(r.document_id, r.entity_ord): (r.canonical_id, round(r.score, 9), r.is_new) for r in L.link_fold(spark.createDataFrame(rows, MENTIONS), **kw).collect()}
        assert got == plain_fold(rows, **kw)


def test_fold_in_blocks_equals_one_block():
    import pandas as pd

    from quillgraph.operators import fold as K

    rows = {r[3]: r for r in random_mentions(120, 5) if r[4] == "ORG"}.values()
    g = pd.DataFrame([(*r, K.name_key(r[3])) for r in rows], columns=["document_id", "ingest_order", "entity_ord", "surface", "type", "context", "key"])
    none = pd.DataFrame(columns=["canonical_id", "surface", "context", "is_new", "place"])
    whole = K.fold_keys(g, none, 0.7, 5, 384, 0.0, None)
    K.BLOCK, old = 3, K.BLOCK
    try:
        assert K.fold_keys(g, none, 0.7, 5, 384, 0.0, None).equals(whole) and 0 < whole["is_new"].sum() < len(whole)
    finally:
        K.BLOCK = old


def test_fold_state_across_batches(spark, tmp_path):
    from quillgraph.sources.files import KeyedTable

    rows = random_mentions(120, 4)
    whole = L.fold_batch(spark.createDataFrame(rows, MENTIONS))
    want = {(r.document_id, r.entity_ord): (r.canonical_id, round(r.score, 9), r.is_new) for r in whole.links.collect()}
    state = KeyedTable(spark, f"{tmp_path}/state", ["type", "key"], L.STATE, "place")
    got = {}
    for batch in range(3):
        some = spark.createDataFrame([r for r in rows if batch * 7 <= r[1] < batch * 7 + 7 or batch == 2 and r[1] >= 14], MENTIONS)
        for _ in range(2):  # replayed
            done = L.fold_batch(some, state.read())
            links = {(r.document_id, r.entity_ord): (r.canonical_id, round(r.score, 9), r.is_new) for r in done.links.collect()}
            if done.added.count():
                state.upsert(done.added, batch)
        got |= links
    assert got == want
    ents = {r.canonical_id: r for r in L.folded_entities(state.read()).collect()}
    assert set(ents) == {c for c, _, new in want.values() if new} and any(r.aliases for r in ents.values())
    assert all(r.name not in r.aliases for r in ents.values())


def test_fold_nulls_and_empty(spark):
    got = fold(spark, [("a", 1, 0, None, "ORG", None), ("b", None, 0, "x", None, "x")])
    assert got["a", 0].mention_text == "" and ("b", 0) not in got or got["b", 0].is_new
    assert L.link_fold(spark.createDataFrame([], MENTIONS)).count() == 0
