"""One query per operator over the whole test tables, with the same result as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.text import heuristic_mentions, heuristic_sentences
from ..operators import evaluation as E
from ..operators import graph as G
from ..operators import linking as L
from ..operators import models as M
from ..operators import retrieval as R
from ..operators.build import build_graph
from ..operators.knn import dense_knn, scan_knn, sparse_knn
from ..schemas import LEADING_WORDS, PREDICATE_PHRASES, PREDICATES, Settings
from ..session import cut, scratch, spread, table
from ..sources import files as files_
from ..streaming import ingest

DIM = Settings().embed_dim


def six(name: str):
    """Six decimals by plain double arithmetic, on which SQL engines agree."""
    return (F.floor(F.col(name) * 1e6 + 0.5) / 1e6).alias(name)


# --- shared inputs -----------------------------------------------------------------------


def latest_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("document_id", "bucket", "object_key", "text", "ingest_order")
    return G.latest(d, ["document_id"], ["ingest_order"])


def all_nodes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "entities").select("canonical_id", "name", "type")
    return e.unionByName(table(spark, sf, "seed_entities").select("canonical_id", "name", "type")).where("type <> 'DATE'")


def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.valid_edges(table(spark, sf, "edges"), all_nodes(spark, sf))


def seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Each curated entity as the only seed of a question of its own."""
    return table(spark, sf, "seed_entities").select(F.col("canonical_id").alias("qid"), "canonical_id")


def link_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Links as mentions, one per document and place."""
    rows = table(spark, sf, "links").where("document_id IS NOT NULL AND mention_text IS NOT NULL")
    return rows.groupBy("document_id", "entity_ord").agg(F.min(F.struct("mention_text", "entity_type", "canonical_id")).alias("m")).select(
        "document_id", F.col("entity_ord").alias("mention_idx"), F.col("m.mention_text").alias("text"), F.col("m.entity_type").alias("type"), F.col("m.canonical_id").alias("canonical_id"),
        (F.col("entity_ord") * 10).alias("char_start"), (F.col("entity_ord") * 10 + 5).alias("char_end"),
    )


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    """The spellings that a document links to one id, as a cluster."""
    m = link_mentions(spark, sf).where("canonical_id IS NOT NULL")
    return m.groupBy("document_id", "canonical_id").agg(F.min("mention_idx").alias("cluster_idx"), F.min_by("text", "mention_idx").alias("canonical"), F.array_sort(F.collect_set("text")).alias("members")).where(F.size("members") > 1).select("document_id", "cluster_idx", "canonical", "members")


# --- scalar functions ----------------------------------------------------------------------


def document_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.document_id("bucket", "object_key").alias("document_id"))


def normalize_names(spark, sf):
    e = table(spark, sf, "entities")
    names = e.select("name").union(e.select(F.explode("aliases"))).union(table(spark, sf, "links").select("mention_text")).where("name IS NOT NULL").distinct()
    return names.select("name", S.normalize_name("name").alias("norm"))


def normalize_answers(spark, sf):
    q = table(spark, sf, "qa")
    names = q.select(F.col("answer").alias("a")).union(q.select("question")).union(table(spark, sf, "sentences").select("text")).where("a IS NOT NULL").distinct()
    return names.select("a", S.normalize_answer("a").alias("norm"))


def map_predicates(spark, sf):
    e = table(spark, sf, "edges")
    raw = e.select(F.col("raw_predicate").alias("raw")).union(e.select("predicate")).union(table(spark, sf, "events").select("event_type")).where("raw IS NOT NULL").distinct()
    return S.map_predicates(raw, "raw").select("raw", "predicate", "raw_predicate")


def decode_replace(spark, sf):
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    return d.select("doc_id", S.decode_text(F.concat(F.unhex(F.lit("FF")), F.encode("text", "UTF-8"), F.unhex(F.lit("C3")))).alias("text"))


def label_to_type(spark, sf):
    labels = table(spark, sf, "links").select(F.col("entity_type").alias("label")).union(table(spark, sf, "events").select(F.upper("event_type")))
    return labels.select("label", S.curated_type("label").alias("type")).where("type IS NOT NULL").groupBy("label", "type").agg(F.count(F.lit(1)).alias("n"))


def object_key_slugs(spark, sf):
    q = table(spark, sf, "qa").select("id", F.posexplode("context").alias("p", "c")).select("id", "p", F.col("c.title").alias("title"), S.object_key_slug("c.title").alias("object_key"))
    return q.groupBy("object_key").agg(F.min_by("title", F.struct("id", "p")).alias("title"), F.count(F.lit(1)).alias("n"))


def json_extract(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("Here it is:\n```json\n"), F.coalesce("props", F.lit("none")), F.lit("\n```")).alias("answer"))
    got = e.select("event_id", S.extract_json("answer").alias("body"))
    return got.select("event_id", "body", F.from_json("body", "map<string,string>").isNotNull().alias("valid"))


# --- text ----------------------------------------------------------------------------------


def sentences_heuristic(spark, sf):
    return heuristic_sentences(latest_documents(spark, sf))


def mentions_heuristic(spark, sf):
    return heuristic_mentions(latest_documents(spark, sf))


def doc_entities(spark, sf):
    d = L.doc_entities(link_mentions(spark, sf), clusters(spark, sf))
    return d.select("document_id", "entity_ord", "surface", "type", F.size("spans").alias("n_spans"), F.element_at("spans", 1)["s"].alias("first_start"))


def mention_context(spark, sf):
    docs = latest_documents(spark, sf)
    m = heuristic_mentions(docs)
    ents = m.select("document_id", F.col("mention_idx").alias("entity_ord"), F.col("text").alias("surface"), F.array(F.struct(F.col("char_start").alias("s"), F.col("char_end").alias("e"))).alias("spans"))
    return L.mention_context(ents, table(spark, sf, "sentences"))


# --- linking -------------------------------------------------------------------------------


def feature_hash(spark, sf):
    e = table(spark, sf, "entities").select("canonical_id", "name")
    return L.sparse_vectors(e, ["canonical_id"], "name", DIM)


def link_set_mode(spark, sf):
    docs = latest_documents(spark, sf)
    m = heuristic_mentions(docs).join(docs.select("document_id", "ingest_order"), "document_id")
    return L.link_set_mode(m.select("document_id", "ingest_order", F.col("mention_idx").alias("entity_ord"), F.col("text").alias("surface"), "type"))


def block_candidates(spark, sf):
    m = link_mentions(spark, sf).where("canonical_id IS NULL").select("document_id", "mention_idx", F.col("text").alias("surface"), "type")
    return L.block_candidates(m, table(spark, sf, "entities")).select("document_id", "mention_idx", "surface", "type", "winner", "candidates")


def link_fold(spark, sf):
    """Ordered linking with fuzzy candidates of every mention of links, in the order of first ingest, with the first sentence that holds its text as context."""
    m = link_mentions(spark, sf).select("document_id", F.col("mention_idx").alias("entity_ord"), F.col("text").alias("surface"), "type")
    order = table(spark, sf, "documents").groupBy("document_id").agg(F.min("ingest_order").alias("ingest_order"))
    s = table(spark, sf, "sentences").select(F.col("document_id").alias("_d"), "sentence_index", F.col("text").alias("_t"))
    # Everything is keyed by the document, so that texts move once.
    met = m.join(order, "document_id", "left").join(s, (F.col("document_id") == F.col("_d")) & F.contains("_t", "surface"), "left")
    rows = met.groupBy("document_id", "entity_ord").agg(F.first("ingest_order").alias("ingest_order"), F.first("surface").alias("surface"), F.first("type").alias("type"), F.min_by("_t", "sentence_index").alias("_t"))
    return L.link_fold(rows.select("document_id", "ingest_order", "entity_ord", "surface", "type", F.concat_ws(" ", "surface", "_t").alias("context")))


# --- graph ---------------------------------------------------------------------------------


def graph_nodes(spark, sf):
    return G.graph_nodes(table(spark, sf, "links"), table(spark, sf, "documents"))


def valid_edges(spark, sf):
    return graph_edges(spark, sf).groupBy("predicate").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("subject_id").alias("subjects"), F.count_distinct("object_id").alias("objects"))


def cooccurrence_edges(spark, sf):
    return G.cooccurrence_edges(table(spark, sf, "links"), table(spark, sf, "sentences"))


def triples_validated(spark, sf):
    t = table(spark, sf, "edges").select(F.col("source_doc_id").alias("document_id"), "subject_id", "predicate", "object_id", "sentence_index", "date", "confidence").distinct()
    return G.validated_triples(t, table(spark, sf, "links"), table(spark, sf, "sentences"))


def edges_replace_doc(spark, sf):
    """Documents that were ingested again bring their co-occurrence edges in place of the stored ones."""
    again = table(spark, sf, "documents").groupBy("document_id").count().where("count > 1").select("document_id")
    links, sents = table(spark, sf, "links").join(again, "document_id", "left_semi"), table(spark, sf, "sentences").join(again, "document_id", "left_semi")
    out = G.replace_document_edges(table(spark, sf, "edges"), G.cooccurrence_edges(links, sents), again)
    return out.groupBy("source_doc_id").agg(F.count(F.lit(1)).alias("edges"), F.count("raw_predicate").alias("raw"), F.count_distinct("predicate").alias("predicates"))


def khop_nodes(spark, sf):
    return G.khop(seeds(spark, sf), graph_edges(spark, sf), all_nodes(spark, sf), 2)


def khop_edges(spark, sf):
    reached = G.khop(seeds(spark, sf), graph_edges(spark, sf), all_nodes(spark, sf), 1)
    return G.subgraph_sizes(reached, graph_edges(spark, sf), ["predicate"])


def induced_edges(spark, sf):
    """The edges of each curated entity to itself, and those among all curated entities, by their place in the text. ``subgraph_edges`` has the neighbourhoods."""
    reached = G.khop(seeds(spark, sf), graph_edges(spark, sf), all_nodes(spark, sf), 0)
    pairs = reached.unionByName(reached.withColumn("qid", F.lit("all curated"))).select("qid", "canonical_id").distinct()
    return G.induced_edges(pairs, graph_edges(spark, sf)).select("qid", "subject_id", "predicate", "object_id", "source_doc_id", "sentence_index").distinct()


def subgraph_edges(spark, sf):
    """The edges themselves of the subgraph around each curated entity, as retrieval expands it, by their place in the text."""
    edges = cut(graph_edges(spark, sf).select("subject_id", "predicate", "object_id", "source_doc_id", "sentence_index").distinct())
    return G.induced_edges(G.khop(seeds(spark, sf), edges, all_nodes(spark, sf), Settings().khop_depth), edges)


def incident_edges(spark, sf):
    e = G.incident_edges(table(spark, sf, "seed_entities"), table(spark, sf, "edges"))
    return e.groupBy("canonical_id", "predicate").agg(F.count(F.lit(1)).alias("edges"))


def shortest_paths(spark, sf):
    """From the least curated id to every other node, at most 3 steps: no path where that id is on no edge. ``all_paths`` has the whole job."""
    first = table(spark, sf, "seed_entities").agg(F.min("canonical_id").alias("source"))
    pairs = all_nodes(spark, sf).select(F.col("canonical_id").alias("target")).distinct().withColumn("_k", F.lit(1)).join(first.withColumn("_k", F.lit(1)), "_k").select(F.col("target").alias("qid"), "source", "target")
    return G.shortest_paths(pairs, graph_edges(spark, sf), 3).select("qid", F.array_join("path", ">").alias("path"))


def all_paths(spark, sf):
    """From every curated id that is on the graph to every node, by as many steps as it takes."""
    edges = cut(graph_edges(spark, sf).select("subject_id", "object_id"))
    on_graph = G.adjacency(edges).select(F.col("a").alias("source")).distinct()
    sources = table(spark, sf, "seed_entities").select(F.col("canonical_id").alias("source")).distinct().join(on_graph, "source", "left_semi")
    pairs = all_nodes(spark, sf).select(F.col("canonical_id").alias("target")).distinct().crossJoin(F.broadcast(sources)).select(F.struct("source", "target").alias("qid"), "source", "target")
    return G.shortest_paths(pairs, edges).select("qid.source", "qid.target", F.array_join("path", ">").alias("path"))


def edge_between(spark, sf):
    s = table(spark, sf, "seed_entities").select("canonical_id")
    pairs = s.select(F.col("canonical_id").alias("a"), F.lit(1).alias("_k")).join(s.select(F.col("canonical_id").alias("b"), F.lit(1).alias("_k")), "_k").where("a < b").select("a", "b")
    e = table(spark, sf, "edges").select("subject_id", "predicate", "object_id", "source_doc_id", "sentence_index").where("predicate IS NOT NULL AND source_doc_id IS NOT NULL AND sentence_index IS NOT NULL")
    return G.first_edge_between(pairs, e)


def counts(spark, sf):
    e, n = table(spark, sf, "edges"), all_nodes(spark, sf)
    parts_ = [("nodes", n.select("canonical_id").distinct()), ("edges", e), ("entities", table(spark, sf, "entities")), ("documents", table(spark, sf, "documents").select("document_id").distinct()), ("source_documents", e.where("source_doc_id IS NOT NULL").select("source_doc_id").distinct()), ("surfaces", G.surfaces(table(spark, sf, "links")))]
    out = None
    for name, df in parts_:
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# --- search, ranking, retrieval --------------------------------------------------------------


def _embeddings(spark, sf):
    e = table(spark, sf, "embeddings")
    rows = e.select(F.col("vec_id").alias("key"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.col("label").alias("grp"))
    return rows.where("key % 20 = 0").select(F.col("key").alias("qid"), "v", "grp"), rows


def knn_dense(spark, sf):
    """The 5 most similar vectors of every vector whose id is divisible by 20."""
    q, rows = _embeddings(spark, sf)
    return dense_knn(q, rows, 5).select("qid", "key", "rank", six("score"))


def knn_dense_typed(spark, sf):
    """The same among vectors of the query's label."""
    q, rows = _embeddings(spark, sf)
    return dense_knn(q, rows, 5, same_group=True).select("qid", "key", "rank", six("score"))


def _questions(spark, sf):
    return table(spark, sf, "qa").select(F.col("id").alias("qid"), "question")


def knn_sentences(spark, sf):
    """The 5 sentences nearest to every question, scored in one pass over the sentences."""
    q = L.sparse_rows(_questions(spark, sf), ["qid"], "question", DIM)
    s = L.sparse_rows(spread(table(spark, sf, "sentences").select("document_id", "sentence_index", "text")), ["document_id", "sentence_index"], "text", DIM)
    return scan_knn(q, s, 5, ["document_id", "sentence_index"], DIM).select("qid", "document_id", "sentence_index", "rank", six("score"))


def knn_entities(spark, sf):
    """The 5 entities whose names are nearest to every question, by an inverted index."""
    q = L.sparse_vectors(_questions(spark, sf), ["qid"], "question", DIM)
    e = L.sparse_vectors(spread(table(spark, sf, "entities").select("canonical_id", "name")), ["canonical_id"], "name", DIM)
    return sparse_knn(q, e, 5, [F.col("canonical_id")], ["canonical_id"]).select("qid", "canonical_id", "rank", six("score"))


def _retrieved(spark, sf):
    n = all_nodes(spark, sf)
    e = graph_edges(spark, sf).select("subject_id", "predicate", "object_id", "source_doc_id", "sentence_index")
    return R.retrieve(_questions(spark, sf), n, n, e, spread(table(spark, sf, "sentences").select("document_id", "sentence_index", "text")))


def seed_entities(spark, sf):
    return _retrieved(spark, sf).seeds.select("qid", "canonical_id", "rank", six("score"))


def rank_nodes(spark, sf):
    """The 20 best nodes of every question; ``ranked_nodes`` has them all."""
    return _retrieved(spark, sf).ranked.where("rank <= 20").select("qid", "canonical_id", "name", "type", six("score"), "rank")


def ranked_nodes(spark, sf):
    """Every node of every question's subgraph, ranked."""
    return _retrieved(spark, sf).ranked.select("qid", "canonical_id", "name", "type", six("score"), "rank")


def select_answers(spark, sf):
    """The best node, and the best person, of every question."""
    r = _retrieved(spark, sf)
    q = _questions(spark, sf)
    typed = R.select_answer(q, r.ranked, F.lit("PERSON")).select("qid", F.col("canonical_id").alias("person_id"), F.col("answer").alias("person"))
    return R.select_answer(q, r.ranked).join(typed, "qid")


def retrieve(spark, sf):
    """Flagship: per question the answer, the size of its subgraph and its best supporting sentence."""
    r = _retrieved(spark, sf)
    nodes = r.subgraph_nodes.groupBy("qid").agg(F.count(F.lit(1)).alias("nodes"))
    edges = G.subgraph_sizes(r.subgraph_nodes, r.edges)
    best = r.sentences.where("rank = 1").select("qid", F.col("document_id").alias("sentence_document"), "sentence_index")
    return r.answers.join(nodes, "qid", "left").join(edges, "qid", "left").join(best, "qid", "left").select("qid", "canonical_id", "answer", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("documents", F.lit(0)).alias("documents"), "sentence_document", "sentence_index")


def demo_endpoints(spark, sf):
    """The two nodes that each question names."""
    q = _questions(spark, sf)
    n = all_nodes(spark, sf).select(F.explode(F.split(S.normalize_name("name"), " ")).alias("w"), "canonical_id", "name").where("w <> ''")
    asked = q.select("qid", F.explode(F.split(S.normalize_name("question"), " ")).alias("w")).join(n, "w").select("qid", "canonical_id", "name").distinct()
    return R.endpoints(q, asked)


# --- evaluation -------------------------------------------------------------------------------


def _predictions(spark, sf):
    """The title of each question's first paragraph as its prediction."""
    return table(spark, sf, "qa").select("id", F.col("context")[0]["title"].alias("prediction"), E.golds().alias("golds"))


def answer_scores(spark, sf):
    p = _predictions(spark, sf)
    return p.select("id", "prediction", E.exact_match(F.col("prediction"), F.col("golds")).alias("em"), E.token_f1(F.col("prediction"), F.col("golds")).alias("token_f1")).select("id", "prediction", "em", six("token_f1"))


def _facts(spark, sf):
    q = table(spark, sf, "qa")
    gold = q.select("id", F.explode("supporting_facts").alias("f")).select("id", "f.title", "f.idx")
    predicted = q.select("id", F.explode("context").alias("c")).select("id", F.col("c.title").alias("title"), F.lit(0).alias("idx"))
    return E.supporting_facts(predicted, gold)


def supporting_fact_scores(spark, sf):
    return _facts(spark, sf).select("id", six("sf_precision"), six("sf_recall"), six("sf_f1"))


def aggregate_metrics(spark, sf):
    p = _predictions(spark, sf)
    scores = p.select("id", E.exact_match(F.col("prediction"), F.col("golds")).alias("em"), E.token_f1(F.col("prediction"), F.col("golds")).alias("token_f1")).join(_facts(spark, sf), "id", "left")
    m = E.mean_metrics(scores, ["em", "token_f1", "sf_precision", "sf_recall", "sf_f1"])
    return m.select("questions", *[six(c) for c in ("em", "token_f1", "sf_precision", "sf_recall", "sf_f1")])


def subset_small(spark, sf):
    """The named subset of 20 questions: the limit is the operator."""
    return E.subset(table(spark, sf, "qa"), "small").select("id", "question")


# --- sinks, sources, models --------------------------------------------------------------------


def latest_upsert(spark, sf):
    return G.latest(table(spark, sf, "documents").select("document_id", "doc_id", "ingest_order", "n_chars"), ["document_id"], ["ingest_order"])


def sentence_vectors_merge(spark, sf):
    s = files_.attach_vectors(table(spark, sf, "sentences"), table(spark, sf, "document_records"))
    return s.select("document_id", "sentence_index", F.size("vector").alias("width"), (F.round(F.element_at("vector", 1) * 128)).cast("bigint").alias("first"))


def records_rebuild(spark, sf):
    s = files_.attach_vectors(table(spark, sf, "sentences"), table(spark, sf, "document_records"))
    r = files_.rebuild_records(table(spark, sf, "document_records"), s)
    return r.select("document_id", F.size("sentences").alias("n_sentences"), F.size("sentence_vectors").alias("n_vectors"), F.col("sentences")[0]["text"].alias("first_text"))


def _prompts(spark, sf):
    """Prompts to resolve mentions, of every document that is linked."""
    m = link_mentions(spark, sf)
    docs = latest_documents(spark, sf).join(m.select("document_id").distinct(), "document_id", "left_semi")
    return M.coref_prompts(docs, m)


def prompt_build(spark, sf):
    return M.keyed(_prompts(spark, sf), "offline").select("document_id", F.length("prompt").alias("n"), "cache_key")


def llm_cache_misses(spark, sf):
    """Questions without aliases are not in the cache."""
    q = M.keyed(table(spark, sf, "qa").select("id", F.col("question").alias("prompt"), "answer_aliases"), "offline")
    cached = q.where("answer_aliases IS NOT NULL AND size(answer_aliases) > 0").select("cache_key", F.lit("known").alias("text"))
    return M.misses(q, cached)


def triple_prompts(spark, sf):
    nodes = G.document_nodes(table(spark, sf, "links"))
    return M.triple_prompts(latest_documents(spark, sf), nodes).select("document_id", F.length("prompt").alias("n"))


def qa_round_trip(spark, sf):
    """The evaluation set written as JSON lines in its loose form and read back."""
    q = table(spark, sf, "qa")
    loose = q.select(F.to_json(F.struct(F.col("id").alias("_id"), "question", "answer", "answer_aliases", F.transform("supporting_facts", lambda f: F.array(f["title"], f["idx"].cast("string"))).alias("supporting_facts"), F.transform("context", lambda c: F.array(c["title"], F.to_json(c["sentences"]))).alias("context"))).alias("value"))
    at = scratch(spark)
    loose.coalesce(1).write.text(at)
    raw = spark.read.text(at).select(files_.parse_qa(F.col("value")).alias("q")).select("q.*")
    return raw.select("id", "question", "answer", F.size("answer_aliases").alias("n_aliases"), F.size("supporting_facts").alias("n_facts"), F.size("context").alias("n_context"), F.col("context")[0]["sentences"][0].alias("first_sentence"))


def stream_ingest(spark, sf):
    """Every ingest of every document as a trigger stream, upserted in micro-batches; the table at the end."""
    at = scratch(spark)
    docs = table(spark, sf, "documents")
    ingest.publish(docs.select("bucket", "object_key", F.col("ingest_order").alias("seq")).repartition(4), f"{at}/triggers")
    objects = docs.select("bucket", "object_key", F.col("ingest_order").alias("seq"), "n_chars")
    store = files_.KeyedTable(spark, f"{at}/table", ["document_id"], "document_id string, bucket string, object_key string, seq bigint, n_chars bigint", "seq")

    def handle(batch, number):
        last = batch.groupBy("bucket", "object_key").agg(F.max("seq").alias("seq"))
        rows = last.join(objects, ["bucket", "object_key", "seq"])
        store.upsert(rows.select(S.document_id("bucket", "object_key").alias("document_id"), "bucket", "object_key", "seq", "n_chars"), number)

    ingest.run_available(ingest.trigger_stream(spark, f"{at}/triggers", max_files=2), f"{at}/checkpoint", handle)
    return store.read().select("document_id", "seq", "n_chars")


def stream_build(spark, sf):
    """The same stream, each micro-batch built from text to graph; a document that comes again brings its nodes and edges in place of the old ones. The edges at the end, with the names of their ends as the last document wrote them."""
    at = scratch(spark)
    docs = table(spark, sf, "documents")
    ingest.publish(docs.select("bucket", "object_key", F.col("ingest_order").alias("seq")).repartition(4), f"{at}/triggers")
    objects = docs.select("bucket", "object_key", F.col("ingest_order").alias("seq"), "text")
    # One row per document with all it brings, so that an upsert replaces it; a sentence stands once, not with each of its edges.
    store = files_.KeyedTable(spark, f"{at}/graph", ["document_id"], "document_id string, seq bigint, nodes array<struct<canonical_id:string,name:string,type:string>>, edges array<struct<subject_id:string,predicate:string,object_id:string,sentence_index:int>>, sentences array<struct<sentence_index:int,text:string,char_start:int,char_end:int>>", "seq")

    def handle(batch, number):
        last = batch.groupBy("bucket", "object_key").agg(F.max("seq").alias("seq")).join(objects, ["bucket", "object_key", "seq"])
        rows = cut(last.select(S.document_id("bucket", "object_key").alias("document_id"), "text", F.col("seq").alias("ingest_order")))
        built = build_graph(rows)
        n = G.document_nodes(built.links).groupBy("document_id").agg(F.collect_list(F.struct("canonical_id", "name", "type")).alias("nodes"))
        e = built.edges.groupBy(F.col("source_doc_id").alias("document_id")).agg(F.collect_list(F.struct("subject_id", "predicate", "object_id", "sentence_index")).alias("edges"))
        t = built.sentences.groupBy("document_id").agg(F.collect_list(F.struct("sentence_index", "text", "char_start", "char_end")).alias("sentences"))
        whole = rows.join(n, "document_id", "left").join(e, "document_id", "left").join(t, "document_id", "left")
        store.upsert(whole.select("document_id", F.col("ingest_order").alias("seq"), "nodes", "edges", "sentences"), number)

    ingest.run_available(ingest.trigger_stream(spark, f"{at}/triggers", max_files=2), f"{at}/checkpoint", handle)
    held = cut(store.read())
    nodes = G.latest(held.select("document_id", "seq", F.explode("nodes").alias("n")).select("document_id", "seq", "n.*"), ["canonical_id"], ["seq", "document_id"])
    ends = [nodes.select(F.col("canonical_id").alias(f"{x}_id"), F.col("name").alias(x)) for x in ("subject", "object")]
    edges = held.select(F.col("document_id").alias("source_doc_id"), F.explode("edges").alias("e")).select("source_doc_id", "e.*").join(ends[0], "subject_id").join(ends[1], "object_id")
    said = held.select(F.col("document_id").alias("source_doc_id"), F.explode("sentences").alias("t")).select("source_doc_id", "t.sentence_index", F.col("t.text").alias("source_sentence"), "t.char_start", "t.char_end")
    return edges.join(said, ["source_doc_id", "sentence_index"]).select("subject_id", "predicate", "object_id", "source_doc_id", "sentence_index", "source_sentence", "char_start", "char_end", "subject", "object")


def retrieved_metrics(spark, sf):
    """Answers and supporting sentences of retrieval over the graph, scored against the evaluation set."""
    r = _retrieved(spark, sf)
    q = table(spark, sf, "qa")
    p = q.select("id", E.golds().alias("golds")).join(r.answers.select(F.col("qid").alias("id"), F.col("answer").alias("prediction")), "id")
    em, f1 = (F.coalesce(f(F.col("prediction"), F.col("golds")), F.lit(0.0)) for f in (E.exact_match, E.token_f1))
    gold = q.select("id", F.explode("supporting_facts").alias("f")).select("id", "f.title", "f.idx")
    keys = table(spark, sf, "documents").select("document_id", "object_key").distinct()
    titles = q.select(F.explode("context.title").alias("title")).distinct().select("title", S.object_key_slug("title").alias("object_key"))
    facts = r.sentences.join(keys, "document_id").join(titles, "object_key").select(F.col("qid").alias("id"), "title", F.col("sentence_index").alias("idx"))
    scores = p.select("id", em.alias("em"), f1.alias("token_f1")).join(E.supporting_facts(facts, gold), "id", "left")
    names = ("em", "token_f1", "sf_precision", "sf_recall", "sf_f1")
    return E.mean_metrics(scores, list(names)).select("questions", *[six(c) for c in names])


QUERIES = {
    f.__name__: f
    for f in (
        document_ids, normalize_names, normalize_answers, map_predicates, decode_replace, label_to_type, object_key_slugs, json_extract, sentences_heuristic, mentions_heuristic, doc_entities, mention_context, feature_hash, link_set_mode,
        block_candidates, link_fold, graph_nodes, valid_edges, cooccurrence_edges, triples_validated, edges_replace_doc, khop_nodes, khop_edges, induced_edges, subgraph_edges, incident_edges, shortest_paths, all_paths, edge_between, counts, knn_dense, knn_dense_typed, knn_sentences, knn_entities,
        seed_entities, rank_nodes, ranked_nodes, select_answers, retrieve, demo_endpoints, answer_scores, supporting_fact_scores, aggregate_metrics, subset_small, latest_upsert, sentence_vectors_merge, records_rebuild, prompt_build, triple_prompts, llm_cache_misses, qa_round_trip, stream_ingest, stream_build, retrieved_metrics,
    )
}

# --- SQL -----------------------------------------------------------------------------------------

_LEAD = "|".join(LEADING_WORDS)
_PHRASES = ", ".join(f"('{a}', '{b}')" for a, b in sorted({**{p.lower().replace("_", " "): p for p in PREDICATES}, **{x: p for p, xs in PREDICATE_PHRASES.items() for x in xs}}.items()))


def _norm(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(replace(replace(replace(lower({c}), 'ß', 'ss'), 'ſ', 's'), 'ς', 'σ'), '[^\p{{L}}\p{{N}}_\s\p{{Z}}]+', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"


def _answer(c: str) -> str:
    punct = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
    article = r"'(^|[^\p{L}\p{N}_])(?:a|an|the)($|[^\p{L}\p{N}_])', '\1 \2', 'g'"
    # Twice: neighbouring articles share the blank between them.
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(translate(lower({c}), '{punct}', ''), {article}), {article}), '[\s\p{{Z}}]+', ' ', 'g'))"


_LATEST = "latest AS (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ingest_order DESC) = 1)"
_STRIP = r"regexp_replace(regexp_replace({0}, '^[\s\p{{Z}}\v\x85]+', ''), '[\s\p{{Z}}\v\x85]+$', '')"


def _tiles(pattern: str) -> str:
    return f"""{_LATEST}, x AS (SELECT document_id, regexp_extract_all(text, '{pattern}') AS a FROM latest WHERE text IS NOT NULL),
t AS (SELECT document_id, unnest(a) AS t, generate_subscripts(a, 1) AS p FROM x),
o AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY document_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM t)"""


_MENTION = r"[A-Z][A-Za-z0-9]*(?:[''\-][A-Za-z0-9]+)*"
_MENTIONS = (
    _tiles(rf"{_MENTION}(?:[\s\p{{Z}}\v\x85]+{_MENTION})*|[^A-Z]+")
    + rf""", m0 AS (SELECT document_id, p, t, s, regexp_replace(t, '(?i)^(({_LEAD})([\s\p{{Z}}\v\x85]+|$))+', '') AS r FROM o WHERE regexp_matches(t, '^[A-Z]')),
m1 AS (SELECT document_id, p, {_STRIP.format("r")} AS text, s + length(t) - length(r) AS char_start FROM m0),
men AS (SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY p) - 1)::INT AS mention_idx, text, 'ORG' AS type, char_start::INT AS char_start, (char_start + length(text))::INT AS char_end FROM m1 WHERE text <> '')"""
)

_LM = """lm AS (SELECT document_id, entity_ord AS mention_idx, (min({'t': mention_text, 'e': entity_type, 'c': canonical_id})) AS m FROM links WHERE document_id IS NOT NULL AND mention_text IS NOT NULL GROUP BY ALL),
lmen AS (SELECT document_id, mention_idx, m.t AS text, m.e AS type, m.c AS canonical_id, mention_idx * 10 AS char_start FROM lm)"""

_NODES = "nodes AS (SELECT canonical_id, name, type FROM entities WHERE type <> 'DATE' UNION ALL SELECT canonical_id, name, type FROM seed_entities WHERE type <> 'DATE')"
_IN = ", ".join(f"'{p}'" for p in PREDICATES)
_GRAPH = f"{_NODES}, ge AS (SELECT * FROM edges WHERE predicate IN ({_IN}) AND subject_id IN (SELECT canonical_id FROM nodes) AND object_id IN (SELECT canonical_id FROM nodes)), adj AS (SELECT DISTINCT a, b FROM (SELECT subject_id AS a, object_id AS b FROM ge UNION ALL SELECT object_id, subject_id FROM ge) WHERE a <> b)"


def _khop(seeds_sql: str, hops: int) -> str:
    out = f"h0 AS (SELECT DISTINCT qid, canonical_id, 0 AS depth FROM ({seeds_sql}) WHERE canonical_id IN (SELECT canonical_id FROM nodes))"
    for d in range(1, hops + 1):
        out += f", h{d} AS (SELECT qid, canonical_id, min(depth) AS depth FROM (SELECT * FROM h{d - 1} UNION ALL SELECT h.qid, adj.b, {d} FROM h{d - 1} h JOIN adj ON adj.a = h.canonical_id) GROUP BY ALL)"
    return out


_SEEDS = "SELECT canonical_id AS qid, canonical_id FROM seed_entities"
_SURF = "surf AS (SELECT DISTINCT document_id, canonical_id, mention_text AS surface FROM links WHERE canonical_id IS NOT NULL AND mention_text IS NOT NULL AND mention_text <> '' AND entity_type <> 'DATE')"
_COOC = f"""{_SURF}, pres AS (SELECT DISTINCT s.document_id, s.sentence_index, canonical_id FROM sentences s JOIN surf ON surf.document_id = s.document_id AND contains(s.text, surface)),
co AS (SELECT a.canonical_id AS subject_id, 'RELATED_TO' AS predicate, b.canonical_id AS object_id, NULL::VARCHAR AS date, a.document_id AS source_doc_id, a.sentence_index, s.text AS source_sentence, NULL::VARCHAR AS raw_predicate, NULL::DOUBLE AS confidence, s.char_start, s.char_end
  FROM pres a JOIN pres b ON a.document_id = b.document_id AND a.sentence_index = b.sentence_index AND a.canonical_id < b.canonical_id JOIN sentences s ON s.document_id = a.document_id AND s.sentence_index = a.sentence_index)"""


def _hash(name: str, src: str, key: str, text: str) -> str:
    """CTEs that end in ``name`` (key, bucket, w, norm2)."""
    n = _norm(text)
    return f"""{name}0 AS (SELECT {key}, length({text}) AS len, unnest(CASE WHEN {n} = '' THEN [CASE WHEN {text} = '' THEN chr(0) ELSE {text} END] ELSE string_split({n}, ' ') END) AS t FROM {src} WHERE {text} IS NOT NULL),
{name}1 AS (SELECT {key}, len, (('0x' || substr(sha256(t), 1, 16))::UBIGINT % {DIM})::INT AS bucket, CASE WHEN ('0x' || substr(sha256(t), 17, 2))::INT % 2 = 0 THEN 1 ELSE -1 END AS s FROM {name}0),
{name}2 AS (SELECT {key}, len, bucket, sum(s)::INT AS w FROM {name}1 GROUP BY ALL),
{name}3 AS (SELECT {key}, len, sum(w * w)::BIGINT AS n2 FROM {name}2 GROUP BY ALL),
{name} AS (SELECT {", ".join(f"a.{k.strip()}" for k in key.split(","))}, bucket, w, n2 AS norm2 FROM {name}2 a JOIN {name}3 b ON {" AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in key.split(","))} WHERE w <> 0
  UNION ALL SELECT {key}, (len % {DIM})::INT, 1, 1 FROM {name}3 WHERE n2 = 0)"""


def _six(expr: str) -> str:
    return f"floor(({expr}) * 1e6 + 0.5) / 1e6"


def _knn(q: str, rows: str, key: str) -> str:
    return f"""dots AS (SELECT q.qid, {", ".join(f"r.{k.strip()}" for k in key.split(","))}, sum(r.w * q.w) AS d, max(r.norm2) AS n1, max(q.norm2) AS n2 FROM {rows} r JOIN {q} q ON q.bucket = r.bucket GROUP BY ALL HAVING sum(r.w * q.w) > 0),
knn AS (SELECT qid, {key}, d / sqrt((n1 * n2)::DOUBLE) AS score, row_number() OVER (PARTITION BY qid ORDER BY d / sqrt((n1 * n2)::DOUBLE) DESC, {key}) AS rank FROM dots QUALIFY rank <= 5)"""


_QV = _hash("qv", "qq", "qid", "question")
_RETRIEVE = f"""WITH {_GRAPH}, qq AS (SELECT id AS qid, question FROM qa), en AS (SELECT DISTINCT canonical_id, name FROM nodes), {_QV}, {_hash("ev", "en", "canonical_id", "name")}, {_knn("qv", "ev", "canonical_id")},
{_khop("SELECT qid, canonical_id FROM knn", 2)},
ranked AS (SELECT h.qid, h.canonical_id, n.name, n.type, 0.7::DOUBLE * coalesce(k.score, 0.0::DOUBLE) + 0.3::DOUBLE * coalesce(1.0::DOUBLE / (1.0::DOUBLE + h.depth), 0.0::DOUBLE) AS score FROM h2 h LEFT JOIN knn k ON k.qid = h.qid AND k.canonical_id = h.canonical_id JOIN nodes n ON n.canonical_id = h.canonical_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, canonical_id) AS rank FROM ranked)"""
_DENSE = """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
p AS (SELECT q.vec_id AS qid, r.vec_id AS key, list_cosine_similarity(q.e, r.e) AS score FROM v q JOIN v r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id{0}),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, key) AS rank FROM p QUALIFY rank <= 5)
SELECT qid, key, rank, floor(score * 1e6 + 0.5) / 1e6 AS score FROM k"""

_GOLD = "list_filter(list_concat([answer], coalesce(answer_aliases, []::VARCHAR[])), lambda g: g IS NOT NULL)"
_SCORES = f"""WITH pr AS (SELECT id, context[1].title AS prediction, {_GOLD} AS golds FROM qa),
gx AS (SELECT id, prediction, unnest(golds) AS g FROM pr),
gn AS (SELECT id, prediction, {_answer("prediction")} AS p, {_answer("g")} AS g FROM gx),
tk AS (SELECT id, prediction, p, g, CASE WHEN p = '' THEN []::VARCHAR[] ELSE string_split(p, ' ') END AS pt, CASE WHEN g = '' THEN []::VARCHAR[] ELSE string_split(g, ' ') END AS gt FROM gn),
sm AS (SELECT *, list_sum(list_transform(list_distinct(pt), lambda w: least(len(list_filter(pt, lambda x: x = w)), len(list_filter(gt, lambda x: x = w)))))::DOUBLE AS same FROM tk),
f1 AS (SELECT id, prediction, (p = g) AS em, CASE WHEN len(pt) = 0 AND len(gt) = 0 THEN 1.0 WHEN len(pt) = 0 OR len(gt) = 0 THEN 0.0 WHEN same = 0 THEN 0.0 ELSE 2 * (same / len(pt)) * (same / len(gt)) / (same / len(pt) + same / len(gt)) END AS f FROM sm),
sc AS (SELECT pr.id, pr.prediction, coalesce(max(CASE WHEN em THEN 1.0 ELSE 0.0 END), 0.0)::DOUBLE AS em, coalesce(max(f), 0.0)::DOUBLE AS token_f1 FROM pr LEFT JOIN f1 ON f1.id = pr.id GROUP BY ALL),
gf AS (SELECT DISTINCT id, f.title AS title, f.idx AS idx FROM (SELECT id, unnest(supporting_facts) AS f FROM qa)),
pf AS (SELECT DISTINCT id, c.title AS title, 0 AS idx FROM (SELECT id, unnest(context) AS c FROM qa)),
ff AS (SELECT coalesce(gf.id, pf.id) AS id, count(gf.id) AS ng, count(pf.id) AS np, count(CASE WHEN gf.id IS NOT NULL AND pf.id IS NOT NULL THEN 1 END) AS hit FROM gf FULL JOIN pf ON gf.id = pf.id AND gf.title = pf.title AND gf.idx = pf.idx GROUP BY 1),
fs AS (SELECT id, CASE WHEN np > 0 THEN hit / np ELSE 0.0 END::DOUBLE AS sf_precision, CASE WHEN ng > 0 THEN hit / ng ELSE 0.0 END::DOUBLE AS sf_recall FROM ff),
ft AS (SELECT *, CASE WHEN sf_precision + sf_recall > 0 THEN 2 * sf_precision * sf_recall / (sf_precision + sf_recall) ELSE 0.0 END::DOUBLE AS sf_f1 FROM fs)
"""

_PROMPT = "'Cluster the mentions of one document that name the same thing, pronouns included. Use forms of the text as they stand.' || chr(10) || chr(10) || 'Text:' || chr(10) || coalesce(l.text, '') || chr(10) || chr(10) || 'Mentions:' || chr(10) || ml"

ORACLE = {
    "document_ids": "SELECT doc_id, sha256(bucket || '/' || object_key) AS document_id FROM documents",
    "normalize_names": f"WITH n AS (SELECT name FROM entities UNION SELECT unnest(aliases) FROM entities UNION SELECT mention_text FROM links) SELECT name, {_norm('name')} AS norm FROM n WHERE name IS NOT NULL",
    "normalize_answers": f"WITH n AS (SELECT answer AS a FROM qa UNION SELECT question FROM qa UNION SELECT text FROM sentences) SELECT a, {_answer('a')} AS norm FROM n WHERE a IS NOT NULL",
    "map_predicates": f"""WITH n AS (SELECT raw_predicate AS raw FROM edges UNION SELECT predicate FROM edges UNION SELECT event_type FROM events), k(phrase, mapped) AS (VALUES {_PHRASES})
SELECT raw, coalesce(mapped, 'RELATED_TO') AS predicate, CASE WHEN mapped IS NULL THEN raw END AS raw_predicate FROM n LEFT JOIN k ON k.phrase = trim(regexp_replace(lower(raw), '[^0-9a-z]+', ' ', 'g')) WHERE raw IS NOT NULL""",
    "decode_replace": "SELECT doc_id, chr(65533) || text || chr(65533) AS text FROM documents WHERE text IS NOT NULL",
    "label_to_type": """WITH l AS (SELECT entity_type AS label FROM links UNION ALL SELECT upper(event_type) FROM events),
m(label, type) AS (VALUES ('PERSON','PERSON'),('ORG','ORG'),('GPE','LOCATION'),('LOC','LOCATION'),('LAW','LAW'),('DATE','DATE'),('EVENT','EVENT'),('NORP','NORP'),('PRODUCT','PRODUCT'))
SELECT l.label, m.type, count(*) AS n FROM l JOIN m ON m.label = l.label GROUP BY ALL""",
    "object_key_slugs": r"""WITH c AS (SELECT id, unnest(context).title AS title, generate_subscripts(context, 1) AS p FROM qa),
k AS (SELECT *, coalesce(nullif(regexp_replace(regexp_replace(title, '[^\p{L}\p{N}_.\-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'untitled') || '.txt' AS object_key FROM c)
SELECT object_key, arg_min(title, {'i': id, 'p': p}) AS title, count(*) AS n FROM k GROUP BY object_key""",
    "json_extract": "SELECT event_id, props AS body, TRUE AS valid FROM events WHERE props LIKE '{%}' UNION ALL SELECT event_id, trim('Here it is:' || chr(10) || '```json' || chr(10) || coalesce(props, 'none') || chr(10) || '```'), FALSE FROM events WHERE props IS NULL OR props NOT LIKE '{%}'",
    "sentences_heuristic": "WITH "
    + _tiles("[^.!?]+[.!?]?|[.!?]")
    + rf""", k AS (SELECT document_id, p, {_STRIP.format("t")} AS text, s + length(t) - length(regexp_replace(t, '^[\s\p{{Z}}\v\x85]+', '')) AS char_start FROM o WHERE t NOT IN ('.', '!', '?'))
SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY p) - 1)::INT AS sentence_index, text, char_start::INT AS char_start, (char_start + length(text))::INT AS char_end FROM k WHERE text <> ''""",
    "mentions_heuristic": f"WITH {_MENTIONS} SELECT * FROM men",
    "doc_entities": f"""WITH {_LM},
cl AS (SELECT document_id, canonical_id, min(mention_idx) AS cluster_idx, arg_min(text, mention_idx) AS canonical, list_distinct(list(text)) AS members FROM lmen WHERE canonical_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT text) > 1),
ct AS (SELECT DISTINCT document_id, cluster_idx, canonical, unnest(members) AS text FROM cl),
hit AS (SELECT ct.*, mention_idx, type, char_start FROM ct JOIN lmen USING (document_id, text)),
bc AS (SELECT document_id, 0 AS k, cluster_idx AS o, canonical AS surface, arg_min(type, {{'a': text <> canonical, 'b': mention_idx}}) AS type, count(DISTINCT mention_idx) AS n_spans, arg_min(char_start, mention_idx) AS first_start FROM hit GROUP BY document_id, cluster_idx, canonical),
al AS (SELECT document_id, 1 AS k, mention_idx AS o, text AS surface, type, 1 AS n_spans, char_start AS first_start FROM lmen WHERE (document_id, mention_idx) NOT IN (SELECT (document_id, mention_idx) FROM hit))
SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY k, o) - 1)::INT AS entity_ord, surface, type, n_spans, first_start FROM (SELECT * FROM bc UNION ALL SELECT * FROM al)""",
    "mention_context": f"""WITH {_MENTIONS} SELECT m.document_id, m.mention_idx AS entity_ord, any_value(m.text) || coalesce(' ' || string_agg(s.text, ' ' ORDER BY s.sentence_index), '') AS context
FROM men m LEFT JOIN sentences s ON s.document_id = m.document_id AND m.char_start >= s.char_start AND m.char_start < s.char_end GROUP BY 1, 2""",
    "feature_hash": f"WITH {_hash('v', 'entities', 'canonical_id', 'name')} SELECT * FROM v",
    "link_set_mode": f"""WITH {_MENTIONS}, k AS (SELECT m.*, l.ingest_order, {_norm('m.text')} AS norm FROM men m JOIN latest l ON l.document_id = m.document_id),
f AS (SELECT *, row_number() OVER w AS r, first_value(text) OVER w AS seed_name FROM k WINDOW w AS (PARTITION BY type, norm ORDER BY ingest_order, document_id, mention_idx))
SELECT document_id, mention_idx AS entity_ord, text AS mention_text, 'e-' || substr(sha256('el:' || type || ':' || norm), 1, 16) AS canonical_id, type AS entity_type, r = 1 AS is_new, seed_name FROM f""",
    "block_candidates": f"""WITH {_LM}, n AS (SELECT canonical_id, type, unnest(list_concat([name], coalesce(aliases, []::VARCHAR[]))) AS n FROM entities),
k AS (SELECT DISTINCT canonical_id, type, {_norm('n')} AS key FROM n WHERE n IS NOT NULL), b AS (SELECT type, key, min(canonical_id) AS winner, count(*) AS candidates FROM k GROUP BY ALL)
SELECT document_id, mention_idx, text AS surface, m.type, winner, candidates FROM lmen m JOIN b ON b.type = m.type AND b.key = {_norm('m.text')} WHERE m.canonical_id IS NULL""",
    "graph_nodes": """WITH f AS (SELECT document_id, canonical_id, mention_text AS name, entity_type AS type FROM links WHERE canonical_id IS NOT NULL AND document_id IS NOT NULL AND entity_type <> 'DATE' QUALIFY row_number() OVER (PARTITION BY document_id, canonical_id ORDER BY entity_ord, mention_text, entity_type) = 1),
o AS (SELECT document_id, max(ingest_order) AS i FROM documents GROUP BY 1)
SELECT canonical_id, name, type FROM f JOIN o USING (document_id) QUALIFY row_number() OVER (PARTITION BY canonical_id ORDER BY i DESC, document_id DESC) = 1""",
    "valid_edges": f"WITH {_GRAPH} SELECT predicate, count(*) AS edges, count(DISTINCT subject_id) AS subjects, count(DISTINCT object_id) AS objects FROM ge GROUP BY predicate",
    "cooccurrence_edges": f"WITH {_COOC} SELECT * FROM co",
    "triples_validated": """WITH t AS (SELECT DISTINCT source_doc_id AS document_id, subject_id, predicate, object_id, sentence_index, date, confidence FROM edges), own AS (SELECT DISTINCT document_id, canonical_id FROM links WHERE canonical_id IS NOT NULL AND entity_type <> 'DATE')
SELECT t.*, s.text AS source_sentence, s.char_start, s.char_end FROM t JOIN own a ON a.document_id = t.document_id AND a.canonical_id = subject_id JOIN own b ON b.document_id = t.document_id AND b.canonical_id = object_id JOIN sentences s ON s.document_id = t.document_id AND s.sentence_index = t.sentence_index""",
    "edges_replace_doc": f"""WITH {_COOC}, again AS (SELECT document_id FROM documents GROUP BY 1 HAVING count(*) > 1),
a AS (SELECT source_doc_id, raw_predicate, predicate FROM edges WHERE source_doc_id IS NULL OR source_doc_id NOT IN (SELECT document_id FROM again) UNION ALL SELECT source_doc_id, raw_predicate, predicate FROM co WHERE source_doc_id IN (SELECT document_id FROM again))
SELECT source_doc_id, count(*) AS edges, count(raw_predicate) AS raw, count(DISTINCT predicate) AS predicates FROM a GROUP BY 1""",
    "khop_nodes": f"WITH {_GRAPH}, {_khop(_SEEDS, 2)} SELECT * FROM h2",
    "khop_edges": f"WITH {_GRAPH}, {_khop(_SEEDS, 1)} SELECT a.qid, predicate, count(*) AS edges, count(DISTINCT source_doc_id) AS documents FROM ge JOIN h1 a ON a.canonical_id = subject_id JOIN h1 b ON b.canonical_id = object_id AND b.qid = a.qid GROUP BY ALL",
    "induced_edges": f"WITH {_GRAPH}, p AS (SELECT canonical_id AS qid, canonical_id FROM seed_entities UNION ALL SELECT 'all curated', canonical_id FROM seed_entities), r AS (SELECT * FROM p WHERE canonical_id IN (SELECT canonical_id FROM nodes)) SELECT DISTINCT a.qid, subject_id, predicate, object_id, source_doc_id, sentence_index FROM ge JOIN r a ON a.canonical_id = subject_id JOIN r b ON b.canonical_id = object_id AND a.qid = b.qid",
    "subgraph_edges": f"WITH {_GRAPH}, {_khop(_SEEDS, 2)}, u AS (SELECT DISTINCT subject_id, predicate, object_id, source_doc_id, sentence_index FROM ge) SELECT a.qid, u.* FROM u JOIN h2 a ON a.canonical_id = subject_id JOIN h2 b ON b.canonical_id = object_id AND a.qid = b.qid",
    "incident_edges": "SELECT s.canonical_id, predicate, count(*) AS edges FROM edges e JOIN seed_entities s ON s.canonical_id = e.subject_id OR s.canonical_id = e.object_id GROUP BY ALL",
    "shortest_paths": f"""WITH {_GRAPH}, src AS (SELECT min(canonical_id) AS s FROM seed_entities), p0 AS (SELECT s AS node, [s] AS path FROM src WHERE s IN (SELECT a FROM adj)),
p1 AS (SELECT * FROM p0 UNION ALL SELECT b, min(list_append(path, b)) FROM p0 JOIN adj ON a = node WHERE b NOT IN (SELECT node FROM p0) GROUP BY b),
p2 AS (SELECT * FROM p1 UNION ALL SELECT b, min(list_append(path, b)) FROM p1 JOIN adj ON a = node WHERE len(path) = 2 AND b NOT IN (SELECT node FROM p1) GROUP BY b),
p3 AS (SELECT * FROM p2 UNION ALL SELECT b, min(list_append(path, b)) FROM p2 JOIN adj ON a = node WHERE len(path) = 3 AND b NOT IN (SELECT node FROM p2) GROUP BY b)
SELECT n.canonical_id AS qid, array_to_string(path, '>') AS path FROM (SELECT DISTINCT canonical_id FROM nodes) n LEFT JOIN p3 ON p3.node = n.canonical_id""",
    "all_paths": f"""WITH RECURSIVE {_GRAPH}, src AS (SELECT DISTINCT canonical_id AS source FROM seed_entities WHERE canonical_id IN (SELECT a FROM adj)),
p(source, node, path) USING KEY (source, node) AS (SELECT source, source, [source] FROM src
UNION SELECT p.source, b, min(list_append(path, b)) FROM p JOIN adj ON a = node WHERE NOT EXISTS (SELECT 1 FROM recurring.p r WHERE r.source = p.source AND r.node = b) GROUP BY p.source, b)
SELECT src.source, n.canonical_id AS target, array_to_string(path, '>') AS path FROM src CROSS JOIN (SELECT DISTINCT canonical_id FROM nodes) n LEFT JOIN p ON p.source = src.source AND p.node = n.canonical_id""",
    "edge_between": """WITH e AS (SELECT subject_id, predicate, object_id, source_doc_id, sentence_index FROM edges WHERE subject_id IS NOT NULL AND object_id IS NOT NULL AND predicate IS NOT NULL AND source_doc_id IS NOT NULL AND sentence_index IS NOT NULL)
SELECT a.canonical_id AS a, b.canonical_id AS b, e.* FROM seed_entities a JOIN seed_entities b ON a.canonical_id < b.canonical_id JOIN e ON least(subject_id, object_id) = a.canonical_id AND greatest(subject_id, object_id) = b.canonical_id
QUALIFY row_number() OVER (PARTITION BY a.canonical_id, b.canonical_id ORDER BY subject_id, predicate, object_id, source_doc_id, sentence_index) = 1""",
    "counts": f"""WITH {_NODES}, {_SURF} SELECT 'nodes' AS what, count(DISTINCT canonical_id) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'entities', count(*) FROM entities
UNION ALL SELECT 'documents', count(DISTINCT document_id) FROM documents UNION ALL SELECT 'source_documents', count(DISTINCT source_doc_id) FROM edges UNION ALL SELECT 'surfaces', count(*) FROM surf""",
    "knn_dense": _DENSE.replace("{0}", ""),
    "knn_dense_typed": _DENSE.replace("{0}", " AND q.label = r.label"),
    "knn_sentences": f"WITH qq AS (SELECT id AS qid, question FROM qa), {_QV}, {_hash('sv', 'sentences', 'document_id, sentence_index', 'text')}, {_knn('qv', 'sv', 'document_id, sentence_index')} SELECT qid, document_id, sentence_index, rank, {_six('score')} AS score FROM knn",
    "knn_entities": f"WITH qq AS (SELECT id AS qid, question FROM qa), {_QV}, {_hash('ev', 'entities', 'canonical_id', 'name')}, {_knn('qv', 'ev', 'canonical_id')} SELECT qid, canonical_id, rank, {_six('score')} AS score FROM knn",
    "seed_entities": _RETRIEVE + f" SELECT qid, canonical_id, rank, {_six('score')} AS score FROM knn",
    "rank_nodes": _RETRIEVE + f" SELECT qid, canonical_id, name, type, {_six('score')} AS score, rank FROM rk WHERE rank <= 20",
    "ranked_nodes": _RETRIEVE + f" SELECT qid, canonical_id, name, type, {_six('score')} AS score, rank FROM rk",
    "select_answers": _RETRIEVE
    + """, pp AS (SELECT qid, canonical_id, name FROM rk WHERE type = 'PERSON' QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank) = 1)
SELECT qq.qid, a.canonical_id, a.name AS answer, pp.canonical_id AS person_id, pp.name AS person FROM qq LEFT JOIN rk a ON a.qid = qq.qid AND a.rank = 1 LEFT JOIN pp ON pp.qid = qq.qid""",
    "retrieve": _RETRIEVE
    + f""", {_hash('sv', 'sentences', 'document_id, sentence_index', 'text')}, sd AS (SELECT q.qid, r.document_id, r.sentence_index, sum(r.w * q.w) / sqrt((max(r.norm2) * max(q.norm2))::DOUBLE) AS sc FROM sv r JOIN qv q ON q.bucket = r.bucket GROUP BY ALL HAVING sum(r.w * q.w) > 0),
sb AS (SELECT qid, document_id, sentence_index FROM sd QUALIFY row_number() OVER (PARTITION BY qid ORDER BY sc DESC, document_id, sentence_index) = 1),
nn AS (SELECT qid, count(*) AS nodes FROM h2 GROUP BY 1), ee AS (SELECT a.qid, count(*) AS edges, count(DISTINCT source_doc_id) AS documents FROM ge JOIN h2 a ON a.canonical_id = subject_id JOIN h2 b ON b.canonical_id = object_id AND b.qid = a.qid GROUP BY 1)
SELECT qq.qid, a.canonical_id, a.name AS answer, coalesce(nodes, 0) AS nodes, coalesce(edges, 0) AS edges, coalesce(documents, 0) AS documents, sb.document_id AS sentence_document, sb.sentence_index
FROM qq LEFT JOIN rk a ON a.qid = qq.qid AND a.rank = 1 LEFT JOIN nn ON nn.qid = qq.qid LEFT JOIN ee ON ee.qid = qq.qid LEFT JOIN sb ON sb.qid = qq.qid""",
    "demo_endpoints": f"""WITH {_NODES}, qw AS (SELECT id AS qid, string_split({_norm('question')}, ' ') AS q FROM qa), nw AS (SELECT canonical_id, name, list_distinct(string_split({_norm('name')}, ' ')) AS w FROM nodes),
nx AS (SELECT canonical_id, name, w, unnest(w) AS x FROM nw), qx AS (SELECT DISTINCT qid, q, unnest(q) AS x FROM qw),
ov AS (SELECT qid, canonical_id, name, count(DISTINCT qx.x) AS o, min(list_position(q, qx.x)) AS p FROM qx JOIN nx ON nx.x = qx.x AND qx.x <> '' GROUP BY ALL),
tp AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY o DESC, name, canonical_id) AS r FROM ov QUALIFY r <= 2), ls AS (SELECT qid, list(canonical_id ORDER BY p, r) AS e FROM tp GROUP BY qid)
SELECT qid, e[1] AS first, e[2] AS second FROM ls""",
    "answer_scores": _SCORES + f"SELECT id, prediction, em, {_six('token_f1')} AS token_f1 FROM sc",
    "supporting_fact_scores": _SCORES + f"SELECT id, {_six('sf_precision')} AS sf_precision, {_six('sf_recall')} AS sf_recall, {_six('sf_f1')} AS sf_f1 FROM ft",
    "aggregate_metrics": _SCORES + "SELECT count(*) AS questions, " + ", ".join(f"{_six(f'avg(coalesce({c}, 0.0))')} AS {c}" for c in ("em", "token_f1", "sf_precision", "sf_recall", "sf_f1")) + " FROM sc LEFT JOIN ft USING (id)",
    "subset_small": "SELECT id, question FROM qa ORDER BY id LIMIT 20",
    "latest_upsert": f"WITH {_LATEST} SELECT document_id, doc_id, ingest_order, n_chars FROM latest",
    "sentence_vectors_merge": "WITH v AS (SELECT document_id, unnest(sentence_vectors) AS v, generate_subscripts(sentence_vectors, 1) - 1 AS i FROM document_records) SELECT s.document_id, sentence_index, len(v) AS width, round(v[1] * 128)::BIGINT AS first FROM sentences s LEFT JOIN v ON v.document_id = s.document_id AND v.i = sentence_index",
    "records_rebuild": """WITH s AS (SELECT document_id, count(*) AS n, arg_min(text, sentence_index) AS t FROM sentences GROUP BY 1)
SELECT r.document_id, coalesce(n, 0) AS n_sentences, CASE WHEN n > 0 AND len(sentence_vectors) >= n THEN n END AS n_vectors, t AS first_text FROM document_records r LEFT JOIN s ON s.document_id = r.document_id""",
    "prompt_build": f"""WITH {_LATEST}, {_LM}, g AS (SELECT document_id, coalesce(string_agg('- ' || text || ' (' || type || ')', chr(10) ORDER BY mention_idx), '- (none)') AS ml FROM lmen GROUP BY 1),
p AS (SELECT l.document_id, {_PROMPT} AS prompt FROM latest l JOIN g ON g.document_id = l.document_id) SELECT document_id, length(prompt) AS n, sha256('offline' || chr(0) || prompt || chr(0) || '{{}}') AS cache_key FROM p""",
    "llm_cache_misses": "SELECT DISTINCT sha256('offline' || chr(0) || question || chr(0) || '{}') AS cache_key, question AS prompt FROM qa WHERE question NOT IN (SELECT question FROM qa WHERE len(answer_aliases) > 0)",
    "qa_round_trip": "SELECT id, question, answer, len(coalesce(answer_aliases, []::VARCHAR[])) AS n_aliases, len(supporting_facts) AS n_facts, len(context) AS n_context, context[1].sentences[1] AS first_sentence FROM qa",
    "stream_build": f"""WITH {_MENTIONS}, links AS (SELECT document_id, mention_idx AS entity_ord, text AS mention_text, 'e-' || substr(sha256('el:' || type || ':' || {_norm('text')}), 1, 16) AS canonical_id, type AS entity_type FROM men),
sx AS (SELECT document_id, regexp_extract_all(text, '[^.!?]+[.!?]?|[.!?]') AS a FROM latest WHERE text IS NOT NULL), st AS (SELECT document_id, unnest(a) AS t, generate_subscripts(a, 1) AS p FROM sx),
so AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY document_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM st),
sk AS (SELECT document_id, p, {_STRIP.format("t")} AS text, s + length(t) - length(regexp_replace(t, '^[\\s\\p{{Z}}\\v\\x85]+', '')) AS char_start FROM so WHERE t NOT IN ('.', '!', '?')),
sentences AS (SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY p) - 1)::INT AS sentence_index, text, char_start::INT AS char_start, (char_start + length(text))::INT AS char_end FROM sk WHERE text <> ''),
{_COOC}, fn AS (SELECT document_id, canonical_id, mention_text AS name FROM links QUALIFY row_number() OVER (PARTITION BY document_id, canonical_id ORDER BY entity_ord, mention_text, entity_type) = 1),
gn AS (SELECT canonical_id, name FROM fn JOIN (SELECT document_id, ingest_order FROM latest) USING (document_id) QUALIFY row_number() OVER (PARTITION BY canonical_id ORDER BY ingest_order DESC, document_id DESC) = 1)
SELECT subject_id, predicate, object_id, source_doc_id, sentence_index, source_sentence, char_start, char_end, a.name AS subject, b.name AS object FROM co JOIN gn a ON a.canonical_id = subject_id JOIN gn b ON b.canonical_id = object_id""",
    "stream_ingest": f"WITH {_LATEST} SELECT document_id, ingest_order AS seq, n_chars FROM latest",
}
