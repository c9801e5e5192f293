import math

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import evaluation as E
from quillgraph.operators import retrieval as R
from quillgraph.operators.knn import dense_knn
from quillgraph.plans import reference_queries as RQ
from quillgraph.schemas import LABEL_TYPES


def test_rank_nodes(spark):
    nodes = spark.createDataFrame([(x, x, "ORG") for x in ("e1", "e2", "e3", "z", "a", "m")], "canonical_id string, name string, type string")
    reached = spark.createDataFrame([("q", "e1", 0), ("q", "e2", 1), ("q", "e3", 3), ("t", "z", 1), ("t", "a", 1), ("t", "m", 1)], "qid string, canonical_id string, depth int")
    seeds = spark.createDataFrame([("q", "e1", 0.9), ("q", "e1", 0.2)], "qid string, canonical_id string, score double")
    got = R.rank_nodes(reached, seeds, nodes).orderBy("qid", "rank").collect()
    assert [round(r.score, 6) for r in got if r.qid == "q"] == [0.93, 0.15, 0.075]
    assert [r.canonical_id for r in got if r.qid == "t"] == ["a", "m", "z"]


def test_select_answer(spark):
    ranked = spark.createDataFrame([("q", "p", "Alice", "PERSON", 1), ("q", "o", "Acme", "ORG", 2)], "qid string, canonical_id string, name string, type string, rank int")
    qs = spark.createDataFrame([("q",), ("none",)], "qid string")
    assert {r.qid: r.answer for r in R.select_answer(qs, ranked).collect()} == {"q": "Alice", "none": None}
    assert {r.qid: r.answer for r in R.select_answer(qs, ranked, F.lit("ORG")).collect()}["q"] == "Acme"


def test_rank_sentences(spark):
    q = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, vector array<double>")
    s = spark.createDataFrame([("q", "d1", 0, [0.0, 1.0]), ("q", "d1", 1, [1.0, 0.0]), ("q", "d2", 0, [0.7, 0.7]), ("q", "d3", 0, None)], "qid string, document_id string, sentence_index int, vector array<double>")
    got = R.rank_sentences(q, s, 5).orderBy("rank").collect()
    assert [(r.document_id, r.sentence_index) for r in got] == [("d1", 1), ("d2", 0), ("d1", 0)]


def test_endpoints(spark):
    q = spark.createDataFrame([("q", "How is Aurelia Components tied to the German Supply Chain Act?")], "qid string, question string")
    n = spark.createDataFrame([("q", "1", "German Supply Chain Act"), ("q", "2", "Aurelia Components"), ("q", "3", "Berlin")], "qid string, canonical_id string, name string")
    assert tuple(R.endpoints(q, n).first()) == ("q", "2", "1")


def test_retrieve_line(spark):
    nodes = spark.createDataFrame([("e-ada", "Ada Lovelace", "PERSON"), ("e-engine", "Analytical Engine", "PRODUCT"), ("e-babbage", "Charles Babbage", "PERSON")], "canonical_id string, name string, type string")
    edges = spark.createDataFrame([("e-ada", "RELATED_TO", "e-engine", "doc1", 0), ("e-engine", "PRODUCES", "e-babbage", "doc2", 0)], "subject_id string, predicate string, object_id string, source_doc_id string, sentence_index int")
    sents = spark.createDataFrame([("doc1", 0, "Ada Lovelace wrote about the engine."), ("doc2", 0, "Something else.")], "document_id string, sentence_index int, text string")
    qs = spark.createDataFrame([("q", "Ada Lovelace"), ("empty", "zzzzz")], "qid string, question string")
    r = R.retrieve(qs, nodes.where("canonical_id = 'e-ada'"), nodes, edges, sents)
    got = {x.canonical_id: round(x.score, 6) for x in r.ranked.where("qid = 'q'").collect()}
    assert got == {"e-ada": 1.0, "e-engine": 0.15, "e-babbage": 0.1}
    assert {x.qid: x.answer for x in r.answers.collect()} == {"q": "Ada Lovelace", "empty": None}
    assert r.subgraph_edges.count() == 2 and r.sentences.where("qid = 'q'").first().document_id == "doc1"


def test_ranked_nodes_have_the_whole_subgraph(spark, tmp_path):
    curated = spark.createDataFrame([("hub", "Acme", "ORG")], "canonical_id string, name string, type string")
    nodes = spark.createDataFrame([(f"n{i:02}", f"Leaf{i}", "ORG") for i in range(30)], "canonical_id string, name string, type string")
    edges = spark.createDataFrame([("hub", "OWNS", f"n{i:02}", "d", i) for i in range(30)], "subject_id string, predicate string, object_id string, source_doc_id string, sentence_index int")
    sents = spark.createDataFrame([("d", 0, "Acme.")], "document_id string, sentence_index int, text string")
    qa = spark.createDataFrame([("q", "Acme")], "id string, question string")
    for name, df in (("seed_entities", curated), ("entities", nodes), ("edges", edges), ("sentences", sents), ("qa", qa)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = RQ.ranked_nodes(spark, str(tmp_path)).orderBy("rank").collect()
    assert [(r["rank"], r.canonical_id) for r in got] == [(i + 1, x) for i, x in enumerate(["hub", *(f"n{i:02}" for i in range(30))])]


def test_retrieved_metrics_score_the_answers_of_retrieval(spark, tmp_path):
    one = spark.createDataFrame([("e", "Acme", "ORG")], "canonical_id string, name string, type string")
    one.write.parquet(f"{tmp_path}/entities.parquet"), one.limit(0).write.parquet(f"{tmp_path}/seed_entities.parquet")
    spark.createDataFrame([], "subject_id string, predicate string, object_id string, source_doc_id string, sentence_index int").write.parquet(f"{tmp_path}/edges.parquet")
    spark.createDataFrame([("d", 0, "Acme builds.")], "document_id string, sentence_index int, text string").write.parquet(f"{tmp_path}/sentences.parquet")
    spark.createDataFrame([("d", "T.txt")], "document_id string, object_key string").write.parquet(f"{tmp_path}/documents.parquet")
    qa = [("q", "Acme", "acme", None, [("T", 0)], [("T", ["Acme builds."])]), ("r", "zzz", "zzz", None, [("T", 0)], [("zzz", [""])])]
    spark.createDataFrame(qa, "id string, question string, answer string, answer_aliases array<string>, supporting_facts array<struct<title string, idx int>>, context array<struct<title string, sentences array<string>>>").write.parquet(f"{tmp_path}/qa.parquet")
    assert tuple(RQ.retrieved_metrics(spark, str(tmp_path)).first()) == (2, 0.5, 0.5, 0.5, 0.5, 0.5)


def test_stream_build_replaces_the_edges_of_a_document(spark, tmp_path):
    docs = [("b", "k1", 1, "Acme owns nothing."), ("b", "k1", 3, "Acme met Bolt. Bolt met Ada."), ("b", "k2", 2, "Zeta met Acme.")]
    spark.createDataFrame(docs, "bucket string, object_key string, ingest_order bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.source_sentence, r.sentence_index, *sorted([r.subject, r.object])) for r in RQ.stream_build(spark, str(tmp_path)).collect())
    assert got == [("Acme met Bolt.", 0, "Acme", "Bolt"), ("Bolt met Ada.", 1, "Ada", "Bolt"), ("Zeta met Acme.", 0, "Acme", "Zeta")]


def test_dense_knn(spark):
    rows = spark.createDataFrame([(i, [math.cos(i / 10), math.sin(i / 10)], i % 2) for i in range(30)] + [(99, None, 0), (98, [0.0, 0.0], 0)], "key bigint, v array<double>, grp int")
    q = rows.where("key = 10").select(F.col("key").alias("qid"), "v", "grp")
    assert [r.key for r in dense_knn(q, rows, 3).orderBy("rank").collect()] == [9, 11, 8]
    assert [r.key for r in dense_knn(q, rows, 2, same_group=True).orderBy("rank").collect()] == [8, 12]


def scored(spark, prediction, golds):
    df = spark.createDataFrame([(prediction, golds)], "p string, g array<string>")
    r = df.select(E.exact_match(F.col("p"), F.col("g")).alias("em"), E.token_f1(F.col("p"), F.col("g")).alias("f1")).first()
    return r.em, round(r.f1, 6)


@pytest.mark.parametrize("p,g,em,f1", [("Countess of Lovelace", ["Ada", "countess of lovelace"], 1.0, 1.0), ("wrong", ["right"], 0.0, 0.0), ("x", [], 0.0, 0.0), ("Charles Babbage Jr", ["Charles Babbage"], 0.0, 0.8), ("the", ["a"], 1.0, 1.0), ("the", ["x"], 0.0, 0.0)])
def test_answers(spark, p, g, em, f1):
    assert scored(spark, p, g) == (em, f1)


def test_supporting_facts_and_mean(spark):
    t = "id string, title string, idx int"
    p = spark.createDataFrame([("q", "Doc", 0), ("q", "Doc", 0), ("q", "Doc", 9), ("only", "x", 1)], t)
    g = spark.createDataFrame([("q", "Doc", 0), ("q", "Doc", 1)], t)
    got = {r.id: (r.sf_precision, r.sf_recall, r.sf_f1) for r in E.supporting_facts(p, g).collect()}
    assert got == {"q": (0.5, 0.5, 0.5), "only": (0.0, 0.0, 0.0)}
    s = spark.createDataFrame([(1.0, 0.5), (0.0, 1.0), (None, 0.75)], "em double, f1 double")
    r = E.mean_metrics(s, ["em", "f1"]).first()
    assert (r.questions, r.em, r.f1) == (3, 1 / 3, 0.75)
    assert E.mean_metrics(s.limit(0), ["em"]).count() == 0


def test_subset(spark):
    qa = spark.range(30).selectExpr("format_string('q%02d', id) AS id")
    assert [r.id for r in E.subset(qa, "small").collect()][:2] == ["q00", "q01"] and E.subset(qa, "small").count() == 20
    assert E.subset(qa, "full").count() == 30 and E.subset(qa, "full", 3).count() == 3
    with pytest.raises(KeyError):
        E.subset(qa, "huge")
    assert len(LABEL_TYPES) == 9


def test_scan_equals_index(spark):
    from quillgraph.operators import linking as L
    from quillgraph.operators.knn import scan_knn, sparse_knn

    texts = [("a", 0, "alpha beta gamma"), ("b", 0, "alpha beta gamma"), ("b", 1, "delta"), ("c", 0, "alpha"), ("d", 0, ""), ("e", 0, "!!"), ("f", 0, "word " * 300 + "alpha"), ("g", 0, None)]
    df = spark.createDataFrame(texts, "document_id string, sentence_index int, text string")
    qs = spark.createDataFrame([("q1", "alpha beta"), ("q2", "delta alpha"), ("q3", "nothing here"), ("q4", "")], "qid string, question string")
    key = ["document_id", "sentence_index"]
    want = sparse_knn(L.sparse_vectors(qs, ["qid"], "question", 64), L.sparse_vectors(df, key, "text", 64), 2, [F.col(k) for k in key], key)
    got = scan_knn(L.sparse_rows(qs, ["qid"], "question", 64), L.sparse_rows(df, key, "text", 64), 2, key, 64)
    rows = lambda d: sorted((r.qid, r["rank"], r.document_id, r.sentence_index, round(r.score, 9)) for r in d.collect())
    assert rows(got) == rows(want) and [r[2] for r in rows(got) if r[0] == "q1"] == ["a", "b"]
    assert scan_knn(L.sparse_rows(qs.limit(0), ["qid"], "question", 64), L.sparse_rows(df, key, "text", 64), 2, key, 64).count() == 0
