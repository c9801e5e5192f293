import json

import pytest
from pyspark.sql import functions as F

from quillgraph.__main__ import main
from quillgraph.operators import graph as G
from quillgraph.operators import harness as H
from quillgraph.operators import modelgraph as MG
from quillgraph.operators import store as T
from quillgraph.schemas import NODES, QA
from quillgraph.sources.files import KeyedTable

PARAGRAPHS = {
    "Mira Holt": ["Mira Holt built the Tidal Loom in Norvik.", "Mira Holt met Oren Vass there."],
    "Oren Vass": ["Oren Vass was born in Pelm.", "He drew the Tidal Loom."],
    "Norvik": ["Norvik is the capital of Sundmark.", "It lies by the sea."],
    "Tidal Loom": ["The Tidal Loom wove nets.", "It stood in Norvik."],
}
ITEMS = [
    ("m1", "Who built the Tidal Loom?", "Mira Holt", ["Holt, Mira"], [("Mira Holt", 0)], ["Mira Holt", "Tidal Loom"]),
    ("m2", "Where was Oren Vass born?", "Pelm", None, [("Oren Vass", 0)], ["Oren Vass", "Norvik"]),
    ("m3", "Which city lies by the sea: Norvik?", "Norvik", [], [("Norvik", 0), ("Norvik", 9)], ["Norvik"]),
    ("m4", "xyzzy", "nothing", None, [], []),
]


def qa(spark):
    return spark.createDataFrame([(i, q, a, al, f, [(t, PARAGRAPHS[t]) for t in c]) for i, q, a, al, f, c in ITEMS], QA)


def test_evaluate(spark):
    runs = [H.evaluate(qa(spark)) for _ in range(2)]
    docs = {r.title: r for r in runs[0].documents.collect()}
    assert set(docs) == set(PARAGRAPHS) and docs["Norvik"].text == " ".join(PARAGRAPHS["Norvik"])
    names = {r.name for r in runs[0].nodes.collect()}
    assert names == {"Mira Holt", "Tidal Loom", "Norvik", "Oren Vass", "Pelm", "Sundmark"}
    # One edge per sentence and two nodes named in it: 3 + 1, 1 + 0, 1 + 0, 0 + 0.
    assert runs[0].edges.count() == 6
    scores = [{r.id: r for r in x.scores.collect()} for x in runs]
    assert scores[0] == scores[1] and len(scores[0]) == 4
    s = scores[0]
    assert s["m2"].sf_recall == 1.0 and s["m3"].em == 1.0 and s["m3"].sf_recall == 0.5 and s["m4"].prediction is None and s["m4"].em == 0.0
    means = runs[0].means.first()
    assert means.em > 0 and means.sf_recall > 0 and all(0 <= means[m] <= 1 for m in H.METRICS)
    report = H.metrics_table(runs[0].means, 4, calls=2, subset="small").first().report
    assert report.startswith("subset: small\nquestions: 4\ndocuments: 4\ncalls: 2\nem: 0.") and report.count("\n") == 8
    assert "questions: 0" in H.metrics_table(H.evaluate(qa(spark).limit(0)).means, 0).first().report


def test_command_line(spark, tmp_path):
    (tmp_path / "qa.jsonl").write_text("\n\n".join(json.dumps({"_id": i, "question": q, "answer": a, "supporting_facts": f, "context": [[t, PARAGRAPHS[t]] for t in c]}) for i, q, a, _, f, c in ITEMS))
    assert "questions: 3\n" in main(["evaluate", str(tmp_path / "qa.jsonl"), "--limit", "3"], spark)
    corpus = tmp_path / "corpus"
    corpus.mkdir()
    for t, s in PARAGRAPHS.items():
        (corpus / f"{t}.md").write_text(" ".join(s))
    assert main(["build", str(corpus), str(tmp_path / "out")], spark) == "nodes: 6\nedges: 6" and spark.read.parquet(f"{tmp_path}/out/edges").count() == 6
    assert main(["ask", str(corpus), "Which is the capital, Norvik?"], spark).startswith("answer: Norvik\n1. Norvik ")
    with pytest.raises(SystemExit):
        main(["evaluate", "x", "--subset", "huge"], spark)


LINKS = "document_id string, entity_ord int, mention_text string, canonical_id string, entity_type string"


def test_graph_checkpoint_replaces_edges_and_keeps_nodes(spark, tmp_path):
    store = T.GraphStore(spark, str(tmp_path))
    nodes = lambda *ids: spark.createDataFrame([(i, i.upper(), "ORG", [], 1) for i in ids], NODES + ", seq bigint")
    docs = lambda *ds: spark.createDataFrame(list(ds), "document_id string, ingest_order bigint")

    def edges(*rows):
        cols = "subject_id string, predicate string, object_id string, date string, source_doc_id string, sentence_index int, source_sentence string, raw_predicate string, confidence double, char_start int, char_end int"
        return spark.createDataFrame([(s, p, o, None, d, 0, "x", None, None, 0, 1) for s, p, o, d in rows], cols)

    store.checkpoint(docs(("d1", 1), ("d2", 2)), nodes("a", "b", "c"), edges(("a", "OWNS", "b", "d1"), ("b", "OWNS", "c", "d2"), ("a", "OWNS", "zz", "d1"), ("a", "LIKES", "b", "d1")), 0)
    assert {(r.subject_id, r.object_id, r.source_doc_id) for r in store.edges().collect()} == {("a", "b", "d1"), ("b", "c", "d2")}
    for _ in range(2):  # a replay changes nothing
        store.checkpoint(docs(("d1", 3)), nodes("a"), edges(("a", "PART_OF", "c", "d1")), 1)
        assert {(r.predicate, r.source_doc_id) for r in store.edges().collect()} == {("PART_OF", "d1"), ("OWNS", "d2")}
        assert store.nodes.read().count() == 3
    store.checkpoint(docs(("d2", 4)), nodes("b"), edges(), 2)  # built without edges
    assert {r.source_doc_id for r in store.edges().collect()} == {"d1"}


def test_entity_records_and_blocks(spark):
    e = spark.createDataFrame([("e1", "Apple", "ORG", ["APPLE Inc.", None], [1.0], 1), ("e1", "Apple Inc", "ORG", ["apple"], None, 2), ("e2", "Pear", "ORG", None, None, 1), (None, "x", "ORG", None, None, 1)], "canonical_id string, name string, type string, aliases array<string>, vector array<double>, seq bigint")
    got = {r.canonical_id: r for r in T.entity_records(e, "seq").collect()}
    assert set(got) == {"e1", "e2"} and got["e1"].normalized_name == "apple inc" and got["e1"].aliases_normalized == ["apple"] and got["e1"].vector is None and got["e2"].aliases == []
    m = spark.createDataFrame([("APPLE", "ORG"), ("Apple", "PERSON"), ("plum", "ORG")], "surface string, type string")
    assert [(r.surface, r.canonical_id) for r in T.blocked(T.entity_records(e, "seq"), m).collect()] == [("APPLE", "e1")]


def test_node_records(spark):
    links = spark.createDataFrame([("d1", 0, "Old", "e", "ORG"), ("d2", 1, "New Co.", "e", "ORG"), ("d2", 2, "new co", "e", "ORG"), ("d2", 3, "NC", "e", "ORG"), ("d2", 3, "NC", "e", "ORG"), ("d2", 4, "...", "e", "ORG"), ("d2", 5, "May 3", "t", "DATE"), (None, 0, "x", "y", "ORG"), ("d2", 6, None, "n", "ORG")], LINKS)
    docs = spark.createDataFrame([("d1", 1), ("d2", 2), ("d1", 1)], "document_id string, ingest_order bigint")
    assert [(r.canonical_id, r.name, r.aliases, r.seq) for r in T.node_records(links, docs).collect()] == [("e", "New Co.", ["NC"], 2)]
    assert T.node_records(links.limit(0), docs).count() == 0


def test_tables_and_constraints(spark, tmp_path):
    for _ in range(2):
        t = T.create_tables(spark, str(tmp_path))
        assert set(t) == {"documents", "entities", "nodes", "edges"} and all(x.read().count() == 0 and len(x.parts()) == 1 for x in t.values())
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", 4)], "k string, v int")
    assert {(r.k, r.rows) for r in T.unique(df, ["k"]).collect()} == {("a", 2), (None, 1)}
    got = T.get_documents(df.select(F.col("k").alias("document_id"), F.col("v").alias("ingest_order")), spark.createDataFrame([("a",), ("a",), ("zz",), (None,)], "document_id string"))
    assert {(r.document_id, r.ingest_order) for r in got.collect()} == {("a", 2), ("zz", None)}
    KeyedTable(spark, f"{tmp_path}/nodes", ["canonical_id"], T.NODE_RECORD, "seq")


def test_model_stages(spark):
    docs = spark.createDataFrame([("d1", "Ada works for Acme. It is big."), ("d2", "Bob.")], "document_id string, text string")
    links = spark.createDataFrame([("d1", 0, "Ada", "a", "PERSON"), ("d1", 1, "Acme", "b", "ORG"), ("d2", 0, "Bob", "c", "PERSON")], LINKS)
    sents = spark.createDataFrame([("d1", 0, "Ada works for Acme.", 0, 19), ("d1", 1, "It is big.", 20, 30), ("d2", 0, "Bob.", 0, 4)], "document_id string, sentence_index int, text string, char_start int, char_end int")
    triples = [("a", "employed by", "b", 0), ("a", "secretly admires", "b", 1), ("a", "OWNS", "c", 0), ("a", "OWNS", "b", 7)]
    answer = "Here:\n```json\n" + json.dumps({"triples": [{"subject_id": s, "predicate": p, "object_id": o, "sentence_index": i, "date": "May", "confidence": 0.9} for s, p, o, i in triples]}) + "\n```"
    port = lambda prompts: [answer if "Ada" in p else "no" for p in prompts]
    cache = spark.createDataFrame([], "cache_key string, text string")
    got = MG.model_edges(docs, links, sents, cache, port)
    assert {(r.predicate, r.raw_predicate, r.sentence_index, r.date, r.confidence, r.source_sentence) for r in got.rows.collect()} == {("WORKS_FOR", None, 0, "May", 0.9, "Ada works for Acme."), ("RELATED_TO", "secretly admires", 1, "May", 0.9, "It is big.")}
    assert [(r.document_id, r.error) for r in got.dropped.collect()] == [("d2", "invalid answer")] and got.cache.count() == 1

    def never(prompts):
        raise RuntimeError("asked again")

    again = MG.model_edges(docs.where("document_id = 'd1'"), links, sents, got.cache, never)
    assert again.rows.count() == 2 and again.dropped.count() == 0
    failed = MG.model_edges(docs, links, sents, cache, never)
    assert failed.rows.count() == 0 and {r.error for r in failed.dropped.collect()} == {"RuntimeError: asked again"}
    mentions = spark.createDataFrame([("d1", 0, "Ada", "PERSON"), ("d2", 0, "Bob", "PERSON")], "document_id string, mention_idx int, text string, type string")
    c = MG.model_clusters(docs, mentions, cache, lambda ps: [json.dumps({"clusters": [{"canonical": "Ada", "members": ["Ada", "it"]}]})] * len(ps)).rows
    assert {(r.document_id, r.cluster_idx, r.canonical, tuple(r.members)) for r in c.collect()} == {("d1", 0, "Ada", ("Ada", "it")), ("d2", 0, "Ada", ("Ada", "it"))}


def test_synthesis_only_where_asked(spark):
    q = spark.createDataFrame([("q1", "Who?", True), ("q2", "What?", False)], "qid string, question string, synthesize boolean")
    ranked = spark.createDataFrame([("q1", "a", "Ada", "PERSON", 1.0, 1)], "qid string, canonical_id string, name string, type string, score double, rank int")
    edges = spark.createDataFrame([], "qid string, subject_id string, predicate string, object_id string, date string, source_doc_id string, sentence_index int")
    sents = spark.createDataFrame([("q1", "d", 0, "Ada.", 1)], "qid string, document_id string, sentence_index int, text string, rank int")
    cache = spark.createDataFrame([], "cache_key string, text string")
    prose, grown = MG.synthesis(q, ranked, edges, sents, cache, lambda ps: [" It is Ada. "] * len(ps))
    assert {(r.qid, r.prose) for r in prose.collect()} == {("q1", "It is Ada."), ("q2", None)} and grown.count() == 1
    card = H.scorecard(spark.createDataFrame([("q1", "Ada")], "qid string, answer string"), ranked, edges, sents).first().card
    assert card == "answer: Ada\n1. Ada 1.0000\nedges: 0\nd#0"


def test_checked_edges_stop_on_an_unknown_predicate(spark):
    with pytest.raises(Exception, match="unknown predicate"):
        G.checked_edges(spark.createDataFrame([("LIKES",)], "predicate string")).collect()
