import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph as G
from quillgraph.plans import reference_queries as RQ

EDGE = "subject_id string, predicate string, object_id string, source_doc_id string, sentence_index int"


def line(spark):
    nodes = spark.createDataFrame([(x, x.upper(), "ORG") for x in "abcde"], "canonical_id string, name string, type string")
    edges = spark.createDataFrame([("a", "OWNS", "b", "d1", 0), ("b", "OWNS", "c", "d1", 1), ("c", "OWNS", "d", "d2", 0), ("e", "OWNS", "a", "d2", 1)], EDGE)
    return nodes, edges


def seeds(spark, *rows):
    return spark.createDataFrame(rows, "qid string, canonical_id string")


@pytest.mark.parametrize("start,hops,want", [(["a"], 0, {"a"}), (["a"], 1, {"a", "b", "e"}), (["a"], 2, {"a", "b", "c", "e"}), (["zz"], 2, set()), (["a", "d"], 1, set("abcde"))])
def test_khop_line(spark, start, hops, want):
    nodes, edges = line(spark)
    got = G.khop(seeds(spark, *[("q", s) for s in start]), edges, nodes, hops)
    assert {r.canonical_id for r in got.collect()} == want
    assert got.count() == len(want)


def test_khop_many_questions_against_brute_force(spark):
    rng = random.Random(3)
    ids = [f"n{i}" for i in range(40)]
    pairs = [(rng.choice(ids), "OWNS", rng.choice(ids), f"d{rng.randrange(9)}", 0) for _ in range(60)]
    qs = [(f"q{i:03}", rng.choice(ids)) for i in range(140)]  # three words of bits
    nodes = spark.createDataFrame([(x, x, "ORG") for x in ids], "canonical_id string, name string, type string")
    edges = spark.createDataFrame(pairs, EDGE)
    near = {}
    for a, _, b, _, _ in pairs:
        if a != b:
            near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    want = {}
    for q, s in qs:
        seen, front = {s: 0}, {s}
        for d in (1, 2):
            front = {y for x in front for y in near.get(x, ())} - set(seen)
            seen.update({y: d for y in front})
        want[q] = seen
    reached = G.khop(seeds(spark, *qs), edges, nodes, 2)
    got = {}
    for r in reached.collect():
        got.setdefault(r.qid, {})[r.canonical_id] = r.depth
    assert got == want
    sizes = {r.qid: (r.edges, r.documents) for r in G.subgraph_sizes(reached, edges).collect()}
    listed = {}
    for r in G.induced_edges(reached, edges).collect():
        listed.setdefault(r.qid, []).append(r.source_doc_id)
    assert sizes == {q: (len(x), len(set(x))) for q, x in listed.items()}
    assert {q: len(x) for q, x in listed.items()} == {q: n for q in want if (n := sum(a in want[q] and b in want[q] for a, _, b, _, _ in pairs))}


def test_shortest_path_is_least(spark):
    edges = spark.createDataFrame([("a", "OWNS", "c", "d", 0), ("a", "OWNS", "b", "d", 0), ("b", "OWNS", "z", "d", 0), ("c", "OWNS", "z", "d", 0)], EDGE)
    pairs = spark.createDataFrame([("1", "a", "z"), ("2", "a", "a"), ("3", "a", "nowhere"), ("4", "nowhere", "a")], "qid string, source string, target string")
    got = {r.qid: r.path for r in G.shortest_paths(pairs, edges).collect()}
    assert got == {"1": ["a", "b", "z"], "2": ["a"], "3": None, "4": None}


def test_shortest_path_of_any_length(spark):
    edges = spark.createDataFrame([(f"n{i}", "OWNS", f"n{i + 1}", "d", 0) for i in range(9)], EDGE)
    pairs = spark.createDataFrame([("far", "n0", "n9"), ("back", "n9", "n1")], "qid string, source string, target string")
    got = {r.qid: r.path for r in G.shortest_paths(pairs, edges).collect()}
    assert got == {"far": [f"n{i}" for i in range(10)], "back": [f"n{i}" for i in range(9, 0, -1)]}
    assert {r.path is None for r in G.shortest_paths(pairs, edges, 6).collect()} == {True}


def test_all_paths_searches_from_every_curated_id_on_the_graph(spark, tmp_path):
    curated = spark.createDataFrame([("a-off", "A", "ORG"), ("n0", "N", "ORG")], "canonical_id string, name string, type string")
    nodes = spark.createDataFrame([(f"n{i}", "N", "ORG") for i in range(1, 6)], "canonical_id string, name string, type string")
    edges = spark.createDataFrame([(f"n{i}", "OWNS", f"n{i + 1}", "d", 0) for i in range(5)], EDGE)
    for name, df in (("seed_entities", curated), ("entities", nodes), ("edges", edges)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r.source, r.target): r.path for r in RQ.all_paths(spark, str(tmp_path)).collect()}
    assert got["n0", "n5"] == "n0>n1>n2>n3>n4>n5" and got["n0", "a-off"] is None and len(got) == 7


def test_subgraph_edges_hold_the_edges_of_two_steps(spark, tmp_path):
    curated = spark.createDataFrame([("n0", "N", "ORG")], "canonical_id string, name string, type string")
    nodes = spark.createDataFrame([(f"n{i}", "N", "ORG") for i in range(1, 5)], "canonical_id string, name string, type string")
    edges = spark.createDataFrame([(f"n{i}", "OWNS", f"n{i + 1}", "d", i) for i in range(4)] + [("n0", "OWNS", "n1", "d", 0), ("n2", "OWNS", "n2", "d", 9)], EDGE)
    for name, df in (("seed_entities", curated), ("entities", nodes), ("edges", edges)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = sorted((r.qid, r.subject_id, r.object_id) for r in RQ.subgraph_edges(spark, str(tmp_path)).collect())
    assert got == [("n0", "n0", "n1"), ("n0", "n1", "n2"), ("n0", "n2", "n2")]


def test_upsert_and_replace(spark):
    log = spark.createDataFrame([("e", "Apple", 1), ("e", "Apple Inc.", 2)], "canonical_id string, name string, o int")
    assert [r.name for r in G.latest(log, ["canonical_id"], ["o"]).collect()] == ["Apple Inc."]
    nodes, edges = line(spark)
    gone = spark.createDataFrame([("d1",)], "document_id string")
    kept = G.replace_document_edges(edges, edges.limit(0), gone)
    assert kept.count() == 2 and nodes.count() == 5
    again = G.replace_document_edges(edges, edges.where("source_doc_id = 'd1'"), gone)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, edges.collect()))


def test_valid_edges(spark):
    nodes, edges = line(spark)
    more = edges.unionByName(spark.createDataFrame([("a", "OWNS", "ghost", "d", 0), ("a", "LIKES", "b", "d", 0), (None, "OWNS", "a", "d", 0), ("a", "OWNS", "a", "d", 0)], EDGE))
    assert G.valid_edges(more, nodes).count() == 5  # the self-loop stays
    with pytest.raises(Exception, match="unknown predicate"):
        G.checked_edges(more).collect()


def test_incident_and_between(spark):
    _, edges = line(spark)
    loop = edges.unionByName(spark.createDataFrame([("a", "OWNS", "a", "d", 0)], EDGE))
    ids = spark.createDataFrame([("a",)], "canonical_id string")
    assert G.incident_edges(ids, loop).count() == 3
    pairs = spark.createDataFrame([("a", "b"), ("a", "e"), ("a", "d")], "a string, b string")
    assert {(r.a, r.b, r.subject_id) for r in G.first_edge_between(pairs, edges).collect()} == {("a", "b", "a"), ("a", "e", "e")}


def test_cooccurrence_and_triples(spark):
    links = spark.createDataFrame([("d", 0, "Ada", "p", "PERSON"), ("d", 1, "Acme", "o", "ORG"), ("d", 2, "2001", "t", "DATE"), ("d", 3, "Acme", None, "ORG")], "document_id string, entity_ord int, mention_text string, canonical_id string, entity_type string")
    sents = spark.createDataFrame([("d", 0, "Adamant Acme in 2001", 0, 20), ("d", 1, "Acme", 21, 25)], "document_id string, sentence_index int, text string, char_start int, char_end int")
    got = G.cooccurrence_edges(links, sents).collect()
    assert [(r.subject_id, r.object_id, r.sentence_index, r.source_sentence) for r in got] == [("o", "p", 0, "Adamant Acme in 2001")]
    t = spark.createDataFrame([("d", "p", "OWNS", "o", 0), ("d", "p", "OWNS", "ghost", 0), ("d", "p", "OWNS", "o", 7), ("d", "p", "OWNS", "p", 1)], "document_id string, subject_id string, predicate string, object_id string, sentence_index int")
    assert {(r.object_id, r.sentence_index) for r in G.validated_triples(t, links, sents).collect()} == {("o", 0), ("p", 1)}


def test_nodes_last_writer_wins(spark):
    links = spark.createDataFrame([("d1", 0, "Apple", "e", "ORG"), ("d2", 0, "Apple Inc.", "e", "ORG"), ("d2", 1, "apple", "e", "ORG"), ("d1", 1, "2001", "t", "DATE")], "document_id string, entity_ord int, mention_text string, canonical_id string, entity_type string")
    docs = spark.createDataFrame([("d1", 1), ("d2", 2)], "document_id string, ingest_order bigint")
    assert [tuple(r) for r in G.graph_nodes(links, docs).collect()] == [("e", "Apple Inc.", "ORG")]


def test_empty(spark):
    nodes, edges = line(spark)
    none = edges.limit(0)
    assert G.khop(seeds(spark, ("q", "a")), none, nodes, 2).count() == 1
    assert G.adjacency(none).count() == 0 and G.induced_edges(G.khop(seeds(spark, ("q", "a")), none, nodes, 2), none).count() == 0
    assert G.first_per(edges, ["predicate"], [F.col("subject_id")]).count() == 1
