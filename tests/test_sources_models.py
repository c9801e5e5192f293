import json

import pytest
from pyspark.sql import functions as F

from quillgraph import schemas
from quillgraph.functions.scalar import document_id
from quillgraph.operators import models as M
from quillgraph.sources import files
from quillgraph.streaming import ingest

QA = [{"_id": "b", "question": "Q?", "answer": "A", "answer_aliases": ["x"], "supporting_facts": [["T", 0], ["T", 3]], "context": [["T", ["s0", "s1"]]]}, {"id": "a", "question": "R?", "answer": "B"}]


@pytest.mark.parametrize("name,text", [("x.json", json.dumps(QA)), ("x.jsonl", "\n".join(map(json.dumps, QA)) + "\n\n")])
def test_read_qa(spark, tmp_path, name, text):
    (tmp_path / name).write_text(text)
    for at in (str(tmp_path / name), str(tmp_path)):
        rows = {r.id: r for r in files.read_qa(spark, at).collect()}
        assert set(rows) == {"a", "b"}
        assert [tuple(f) for f in rows["b"].supporting_facts] == [("T", 0), ("T", 3)] and rows["b"].context[0].sentences == ["s0", "s1"]
        assert rows["a"].context == [] and rows["a"].answer_aliases == []


def test_corpus_and_objects(spark, tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    (root / "b.md").write_bytes(b"two \xff")
    (root / "a.md").write_text("one")
    (root / "README.md").write_text("no")
    got = files.read_corpus(spark, str(root)).orderBy("ingest_order").collect()
    assert [(r.name, r.text) for r in got] == [("a.md", "one"), ("b.md", "two �")]
    objects = files.read_objects(spark, str(tmp_path), "docs")
    found, missing = files.get_objects(spark.createDataFrame([("docs", "a.md"), ("docs", "zz"), (None, "x")], "bucket string, object_key string"), objects)
    assert [r.object_key for r in missing.collect()] == ["zz"]
    raw = files.raw_documents(found).first()
    assert raw.text == "one" and raw.document_id == spark.range(1).select(document_id(F.lit("docs"), F.lit("a.md"))).first()[0]
    with pytest.raises(Exception):
        files.read_objects(spark, str(tmp_path), "nowhere").collect()


def test_records(spark):
    s = spark.createDataFrame([("d", 1, "b", 2, 3, [1.0]), ("d", 0, "a", 0, 1, [0.5]), ("e", 0, "x", 0, 1, None)], "document_id string, sentence_index int, text string, char_start int, char_end int, vector array<double>")
    d = spark.createDataFrame([("d",), ("e",), ("f",)], "document_id string")
    got = {r.document_id: ([x.text for x in r.sentences], r.sentence_vectors) for r in files.rebuild_records(d, s).collect()}
    assert got == {"d": (["a", "b"], [[0.5], [1.0]]), "e": (["x"], None), "f": ([], None)}


def test_keyed_table_and_stream(spark, tmp_path):
    t = files.KeyedTable(spark, str(tmp_path / "t"), ["k"], "k string, v int, seq bigint", "seq")
    assert t.read().count() == 0
    t.upsert(spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 1)], t.schema))
    t.upsert(spark.createDataFrame([("b", 9, 3)], t.schema))
    assert sorted(map(tuple, t.read().collect())) == [("a", 2, 2), ("b", 9, 3)]
    t.delete(spark.createDataFrame([("a",)], "k string"), "k")
    assert [r.k for r in t.read().collect()] == ["b"]
    t.compact()
    assert [tuple(r) for r in t.read().collect()] == [("b", 9, 3)] and len(t.parts()) == 1
    for _ in range(2):  # a batch and its replay
        t.upsert(spark.createDataFrame([("a", 5, 1)], t.schema), 7)
    assert sorted(map(tuple, t.read().collect())) == [("a", 5, 1), ("b", 9, 3)]

    src = str(tmp_path / "triggers")
    ingest.publish(spark.createDataFrame([("b", "x", 1), ("b", "x", 2), ("b", "gone", 1)], "bucket string, object_key string, seq bigint"), src)
    with open(f"{src}/bad.txt", "w") as f:
        f.write("not json\n{}\n")
    objects = spark.createDataFrame([("b", "x", "hello")], "bucket string, object_key string, text string")
    store = files.KeyedTable(spark, str(tmp_path / "docs"), ["document_id"], "document_id string, text string, seq bigint", "seq")
    handle = ingest.upsert_handler(store, objects, lambda df: df.select(document_id("bucket", "object_key").alias("document_id"), "text", "seq"))
    for _ in range(2):  # a second run finds nothing new
        ingest.run_available(ingest.trigger_stream(spark, src, 1), str(tmp_path / "cp"), handle)
    assert [(r.text, r.seq) for r in store.read().collect()] == [("hello", 2)]


def test_cache_and_ports(spark):
    p = M.keyed(spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b"), ("4", "bad"), ("5", "boom")], "id string, prompt string"), "m")
    cache = p.where("prompt = 'b'").select("cache_key", F.lit('{"clusters": []}').alias("text")).distinct()

    def port(prompts):
        if "boom" in prompts:
            raise RuntimeError("no provider")
        return ['x {"clusters": [{"canonical": "A", "members": ["it"]}]} y' if t == "a" else "nonsense" for t in prompts]

    calm = p.where("prompt <> 'boom'")
    answers, grown = M.complete(calm, cache, port, {"clusters"})
    got = {r.id: r.value for r in M.parsed(answers, "text", schemas.COREF_JSON).collect()}
    assert got["1"].clusters[0].canonical == got["2"].clusters[0].canonical == "A" and got["3"].clusters == [] and got["4"] is None
    assert grown.count() == 2
    tried = {r.cache_key: (r.calls, r.error) for r in M.call_port(M.misses(calm, cache), port, {"clusters"}).collect()}
    assert sorted(tried.values(), key=str) == [(1, None), (3, "invalid answer")]
    lost = M.call_port(M.misses(p.where("prompt = 'boom'"), cache), port).first()
    assert lost.text is None and "no provider" in lost.error


def test_prompts_and_udfs(spark):
    d = spark.createDataFrame([("d", "Ada."), ("e", None)], "document_id string, text string")
    m = spark.createDataFrame([("d", 0, "Ada", "PERSON")], "document_id string, mention_idx int, text string, type string")
    got = {r.document_id: r.prompt for r in M.coref_prompts(d, m).collect()}
    assert "- Ada (PERSON)" in got["d"] and "- (none)" in got["e"]
    e = spark.createDataFrame([("d", "e-1", "Ada", "PERSON")], "document_id string, canonical_id string, name string, type string")
    kg = M.triple_prompts(d, e).collect()
    assert len(kg) == 1 and "- e-1: Ada (PERSON)" in kg[0].prompt
    q = spark.createDataFrame([("q", "Who?", True), ("r", "What?", False)], "qid string, question string, synthesize boolean")
    ranked = spark.createDataFrame([("q", "e-1", "Ada", "PERSON", 1)], "qid string, canonical_id string, name string, type string, rank int")
    edges = spark.createDataFrame([("q", "e-1", "OWNS", "e-2", "2001", "d", 0)], "qid string, subject_id string, predicate string, object_id string, date string, source_doc_id string, sentence_index int")
    sents = spark.createDataFrame([("q", 1, "Ada.", "d", 0)], "qid string, rank int, text string, document_id string, sentence_index int")
    out = M.synthesis_prompts(q, ranked, edges, sents).collect()
    assert len(out) == 1 and "Ada --OWNS--> e-2, date=2001" in out[0].prompt and '"Ada."' in out[0].prompt
    emb = M.embedder(lambda ts: [[float(len(t)), 1.0] for t in ts], 2)
    assert [r[0] for r in d.orderBy("document_id").select(emb("text")).collect()] == [[4.0, 1.0], [0.0, 1.0]]
    ner = M.recognizer(lambda ts: [[{"text": "Ada", "label": "PERSON", "start": 0, "end": 3}] if t else [] for t in ts])
    assert d.mapInPandas(ner, "document_id string, mention_idx int, text string, label string, char_start int, char_end int").count() == 1
