"""Queries of the composed stages, stores, sources and ports over whole tables, with the same result as SQL."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.text import heuristic_mentions
from ..operators import graph as G
from ..operators import harness as H
from ..operators import linking as L
from ..operators import modelgraph as MG
from ..operators import models as M
from ..operators import retrieval as R
from ..operators import store as T
from ..schemas import PREDICATES
from ..session import cut, scratch, table
from ..sources import files as files_
from ..streaming import ingest
from . import reference_queries as RQ
from .reference_queries import latest_documents, six

# --- evaluation --------------------------------------------------------------------------------


def evaluate_qa(spark, sf):
    """The evaluation set's context built into a graph, every question answered from it and scored."""
    s = H.evaluate(table(spark, sf, "qa")).scores
    return s.select("id", "prediction", "em", *[six(c) for c in H.METRICS[1:]])


def evaluate_report(spark, sf):
    """The same as the lines of a report."""
    e = H.evaluate(table(spark, sf, "qa"))
    return H.metrics_table(e.means, e.documents.count())


def qa_corpus(spark, sf):
    """The documents of the evaluation set's context, each title once."""
    return H.corpus_of(table(spark, sf, "qa"), "documents").select("document_id", "object_key", "title", "text")


def sentence_endpoints(spark, sf):
    """The two linked nodes of its document that each sentence names best, every sentence asked as a question."""
    q = table(spark, sf, "sentences").select(F.concat_ws("#", "document_id", "sentence_index").alias("qid"), "document_id", F.col("text").alias("question"))
    n = G.document_nodes(table(spark, sf, "links")).where("name IS NOT NULL")
    return R.endpoints(q.select("qid", "question"), q.select("qid", "document_id").join(n, "document_id").select("qid", "canonical_id", "name"))


def ranked_sentences(spark, sf):
    """The sentences of each document ranked by their likeness to its first sentence."""
    s = files_.attach_vectors(table(spark, sf, "sentences"), table(spark, sf, "document_records")).select(F.col("document_id").alias("qid"), "document_id", "sentence_index", "vector")
    q = s.where("sentence_index = 0 AND vector IS NOT NULL").select("qid", "vector")
    return R.rank_sentences(q, s, 3).select("document_id", "sentence_index", "rank", six("score"))


# --- stores ------------------------------------------------------------------------------------


def entity_store(spark, sf):
    """Entities written once, and those with aliases a second time under their first alias, as the store keeps them."""
    e = table(spark, sf, "entities").select("canonical_id", "name", "type", "aliases", "vector", F.lit(1).alias("seq"))
    again = e.where("aliases IS NOT NULL AND size(aliases) > 0").withColumn("name", F.col("aliases")[0]).withColumn("seq", F.lit(2))
    store = files_.KeyedTable(spark, f"{scratch(spark)}/entities", ["canonical_id"], T.ENTITY_RECORD, "seq")
    for batch, rows in enumerate((e, again, again)):  # the last batch is written twice
        store.upsert(T.entity_records(rows, "seq"), min(batch, 1))
    return store.read().select("canonical_id", "name", "normalized_name", "type", F.array_join("aliases_normalized", "|").alias("aliases"), F.coalesce(F.size("vector"), F.lit(-1)).alias("width"))


def entity_blocks(spark, sf):
    """For each unresolved mention's spelling, the stored entities that a name or alias blocks it with."""
    e = table(spark, sf, "entities").withColumn("seq", F.lit(1))
    m = table(spark, sf, "links").where("canonical_id IS NULL AND mention_text IS NOT NULL").select(F.col("mention_text").alias("surface"), F.col("entity_type").alias("type"))
    return T.blocked(T.entity_records(e, "seq"), m)


def node_aliases(spark, sf):
    """Nodes as the last document wrote them, with its other spellings as aliases."""
    n = T.node_records(table(spark, sf, "links"), table(spark, sf, "documents"))
    return n.select("canonical_id", "name", "type", F.array_join("aliases", "|").alias("aliases"), "seq")


def graph_checkpoint(spark, sf):
    """Co-occurrence edges of all documents written in one batch; documents that were ingested again bring their stored edges in the next, which is replayed."""
    links, docs, sents = (table(spark, sf, t) for t in ("links", "documents", "sentences"))
    nodes = T.node_records(links, docs)
    store = T.GraphStore(spark, scratch(spark))
    once = docs.groupBy("document_id").agg(F.min("ingest_order").alias("ingest_order"), F.count(F.lit(1)).alias("n"), F.max("ingest_order").alias("last"))
    store.checkpoint(once, nodes, G.cooccurrence_edges(links, sents), 0)
    again = once.where("n > 1").select("document_id", F.col("last").alias("ingest_order"))
    stored = table(spark, sf, "edges").join(again.select(F.col("document_id").alias("source_doc_id")), "source_doc_id", "left_semi")
    for _ in range(2):
        store.checkpoint(again, nodes.join(links.join(again, "document_id", "left_semi").select("canonical_id").distinct(), "canonical_id", "left_semi"), stored, 1)
    return store.edges().groupBy("source_doc_id").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("predicate").alias("predicates"), F.count("raw_predicate").alias("raw"))


def document_get(spark, sf):
    """Every document that an edge names, with its latest row, or nulls."""
    keys = table(spark, sf, "edges").select(F.col("source_doc_id").alias("document_id")).union(table(spark, sf, "links").select(F.concat(F.lit("none-"), "document_id")))
    d = table(spark, sf, "documents").select("document_id", "doc_id", "ingest_order", "n_chars")
    return T.get_documents(d, keys)


def constraint_report(spark, sf):
    """Keys that a uniqueness constraint would refuse."""
    d = T.unique(table(spark, sf, "documents"), ["document_id"]).select(F.lit("documents").alias("what"), F.col("document_id").alias("key"), "rows")
    e = T.unique(table(spark, sf, "entities"), ["canonical_id"]).select(F.lit("entities").alias("what"), F.col("canonical_id").alias("key"), "rows")
    li = T.unique(table(spark, sf, "links").withColumn("key", F.concat_ws("#", "document_id", "entity_ord")), ["key"]).select(F.lit("links").alias("what"), "key", "rows")
    return d.unionByName(e).unionByName(li)


def checked_edges(spark, sf):
    """Edges by predicate, where an unknown predicate stops the job."""
    return G.checked_edges(table(spark, sf, "edges")).groupBy("predicate").agg(F.count(F.lit(1)).alias("edges"))


def stream_link(spark, sf):
    """Documents in micro-batches, their mentions linked in order against the entities of all batches before; a row per key that was met."""
    at = scratch(spark)
    docs = latest_documents(spark, sf)
    last = docs.agg(F.max("ingest_order")).first()[0] or 0
    state = files_.KeyedTable(spark, f"{at}/state", ["type", "key"], L.STATE, "place")
    for batch in range(4):
        some = cut(docs.where(F.col("ingest_order").between(batch * (last + 1) // 4, (batch + 1) * (last + 1) // 4 - 1)).select("document_id", "text", "ingest_order"))
        m = heuristic_mentions(some).join(some.select("document_id", "ingest_order"), "document_id")
        rows = m.select("document_id", "ingest_order", F.col("mention_idx").alias("entity_ord"), F.col("text").alias("surface"), "type", F.col("text").alias("context"))
        state.upsert(L.fold_batch(rows, state.read()).added, batch)
    return state.read().select("key", "canonical_id", "surface", "is_new", "document_id", "entity_ord")


# --- sources -----------------------------------------------------------------------------------


def _one_file(text: DataFrame, folder: str, name: str) -> None:
    """A small text frame as one file of a given name."""
    spark = text.sparkSession
    text.coalesce(1).write.mode("overwrite").text(f"{folder}/_parts")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(x.getPath() for x in fs.listStatus(path(f"{folder}/_parts")) if x.getPath().getName().startswith("part-"))
    fs.rename(part, path(f"{folder}/{name}"))
    fs.delete(path(f"{folder}/_parts"), True)


def _loose(q: DataFrame) -> DataFrame:
    """Questions as published: _id, and pairs [title, x]."""
    pair = lambda a, b: F.concat(F.lit("["), F.to_json(F.array(a)), F.lit(","), b, F.lit("]"))
    quote = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    pairs = lambda c, f: F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(c, F.array()), f), ","), F.lit("]"))
    facts = pairs(F.col("supporting_facts"), lambda x: F.concat(F.lit("["), quote(x["title"]), F.lit(","), x["idx"].cast("string"), F.lit("]")))
    context = pairs(F.col("context"), lambda x: F.concat(F.lit("["), quote(x["title"]), F.lit(","), F.to_json(x["sentences"]), F.lit("]")))
    aliases = F.when(F.col("answer_aliases").isNotNull(), F.concat(F.lit(',"answer_aliases":'), F.to_json("answer_aliases"))).otherwise(F.lit(""))
    body = F.concat(F.lit('{"_id":'), quote(F.col("id")), F.lit(',"question":'), quote(F.col("question")), F.lit(',"answer":'), quote(F.col("answer")), aliases, F.lit(',"supporting_facts":'), facts, F.lit(',"context":'), context, F.lit("}"))
    return q.select("id", body.alias("value"))


def _shown(q: DataFrame) -> DataFrame:
    return q.select("id", "question", "answer", F.size("answer_aliases").alias("n_aliases"), F.size("supporting_facts").alias("n_facts"), F.array_join(F.transform("context", lambda c: F.concat_ws("|", c["title"], F.size(c["sentences"]).cast("string"), c["sentences"][0])), "\n").alias("context"))


def read_qa_lines(spark, sf):
    """The evaluation set from a file of JSON lines in a folder, blank lines between them."""
    at = scratch(spark)
    _one_file(_loose(table(spark, sf, "qa")).select(F.concat("value", F.lit("\n")).alias("value")), at, "b.jsonl")
    return _shown(files_.read_qa(spark, at))


def read_qa_array(spark, sf):
    """The evaluation set from a JSON array, the first file of a folder by name."""
    at = scratch(spark)
    whole = _loose(table(spark, sf, "qa")).agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "value"))), lambda x: x["value"]), ","), F.lit("]")).alias("value"))
    _one_file(whole, at, "a.json")
    _one_file(spark.range(1).select(F.lit("{}").alias("value")), at, "b.json")
    return _shown(files_.read_qa(spark, at))


def read_corpus(spark, sf):
    """A folder of Markdown files, one per nation, and a README that is no document."""
    at = scratch(spark)
    for r in table(spark, sf, "nation").select("n_name", "n_regionkey").collect():  # 25 rows
        _one_file(spark.range(1).select(F.lit(f"# {r['n_name']}\n\nRegion {r['n_regionkey']}").alias("value")), at, f"{r['n_name']}.md")
    _one_file(spark.range(1).select(F.lit("read me").alias("value")), at, "README.md")
    return files_.read_corpus(spark, at).select("name", "text", "ingest_order")


def object_get(spark, sf):
    """Objects of a bucket as triggers ask for them: found with their text, or missing."""
    at = scratch(spark)
    for r in table(spark, sf, "region").select("r_regionkey", "r_name").collect():  # 5 rows
        _one_file(spark.range(1).select(F.lit(r["r_name"]).alias("value")), f"{at}/bucket", f"r{r['r_regionkey']}.txt")
    asked = table(spark, sf, "nation").select(F.lit("bucket").alias("bucket"), F.concat(F.lit("r"), (F.col("n_regionkey") + F.col("n_nationkey") % 2 * 3).cast("string"), F.lit(".txt")).alias("object_key"))
    found, missing = files_.get_objects(asked, files_.read_objects(spark, at, "bucket"))
    return files_.raw_documents(found).select("document_id", "object_key", F.rtrim(F.regexp_replace("text", r"\n$", "")).alias("text")).unionByName(missing.select(F.lit(None).cast("string").alias("document_id"), "object_key", F.lit(None).cast("string").alias("text")))


# --- ports -------------------------------------------------------------------------------------


def port_completion(spark, sf):
    """Questions through cache and port: cached, answered, and dropped after answers that are no JSON."""
    q = M.keyed(table(spark, sf, "qa").select("id", F.col("question").alias("prompt"), "answer_aliases"), "offline")
    cache = q.where("answer_aliases IS NOT NULL AND size(answer_aliases) > 0").select("cache_key", F.lit('{"n": -1}').alias("text")).distinct()

    def port(prompts: list[str]) -> list[str]:
        return [f'It is\n```json\n{{"n": {len(p)}}}\n```' if len(p) % 2 == 0 else "I do not know" for p in prompts]

    said, _ = M.complete(q, cache, port, {"n"})
    return M.parsed(said, "text", "n bigint").select("id", F.col("value.n").alias("n"))


def triple_prompt_texts(spark, sf):
    """The prompt that asks for the triples of each linked document, by length and digest."""
    p = M.triple_prompts(latest_documents(spark, sf), G.document_nodes(table(spark, sf, "links")).where("name IS NOT NULL"))
    return p.select("document_id", F.length("prompt").alias("n"), F.sha2("prompt", 256).alias("digest"))


def _two_ids(prompts: list[str]) -> list[str]:
    """A stand-in for a model: states that the first listed id is based in the second, in sentence 0."""
    out = []
    for p in prompts:
        ids = re.findall(r"^- (\S+): ", p.rsplit("\nIds:\n", 1)[1], re.M)
        out.append(json.dumps({"triples": [{"subject_id": ids[0], "predicate": "Based In", "object_id": ids[1], "sentence_index": 0, "date": None, "confidence": 0.5}, {"subject_id": ids[0], "predicate": "admires", "object_id": "nobody", "sentence_index": 0}]}) if len(ids) > 1 else "none")
    return out


def model_graph(spark, sf):
    """Edges of every linked document as a port states them, checked against its own ids and sentences."""
    links = table(spark, sf, "links").where("mention_text IS NOT NULL")
    cache = spark.createDataFrame([], "cache_key string, text string")
    return MG.model_edges(latest_documents(spark, sf), links, table(spark, sf, "sentences"), cache, _two_ids).rows.select("subject_id", "predicate", "object_id", "source_doc_id", "sentence_index", "source_sentence", "raw_predicate", "confidence", "char_start", "char_end")


def embedded_names(spark, sf):
    """Names through an embedder port: length and counts of two letters."""

    def port(texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), float(t.count("a")), float(t.count("e"))] for t in texts]

    v = table(spark, sf, "entities").where("name IS NOT NULL").select("canonical_id", M.embedder(port, 3)("name").alias("v"))
    return v.select("canonical_id", F.col("v")[0].cast("bigint").alias("n"), F.col("v")[1].cast("bigint").alias("a"), F.col("v")[2].cast("bigint").alias("e"))


def vector_scores(spark, sf):
    """The cosine of every vector to the next one, and back from a score of 0 to 1."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id").withColumn("c", S.cosine("v", "w"))
    return both.withColumn("back", S.score_to_cosine((1 + F.col("c")) / 2)).select("vec_id", six("c"), six("back"))


QUERIES = {
    f.__name__: f
    for f in (
        evaluate_qa, evaluate_report, qa_corpus, sentence_endpoints, ranked_sentences, entity_store, entity_blocks, node_aliases, graph_checkpoint, document_get, constraint_report, checked_edges, stream_link,
        read_qa_lines, read_qa_array, read_corpus, object_get, port_completion, triple_prompt_texts, model_graph, embedded_names, vector_scores,
    )
}

# --- SQL ---------------------------------------------------------------------------------------

_n = RQ._norm
_QC = r"""qc0 AS (SELECT id, unnest(context) AS c, generate_subscripts(context, 1) AS p FROM qa WHERE id IS NOT NULL),
qc1 AS (SELECT id, p, c.title AS title, array_to_string(c.sentences, ' ') AS text, coalesce(nullif(trim(regexp_replace(c.title, '[^\p{L}\p{N}_.\-]+', '_', 'g'), '_'), ''), 'untitled') || '.txt' AS object_key FROM qc0 WHERE c.title IS NOT NULL),
documents AS (SELECT *, sha256('documents/' || object_key) AS document_id, row_number() OVER (ORDER BY id, p) AS ingest_order FROM qc1 QUALIFY row_number() OVER (PARTITION BY object_key ORDER BY id, p) = 1)"""
_SENTS = rf"""sx AS (SELECT document_id, regexp_extract_all(text, '[^.!?]+[.!?]?|[.!?]') AS a FROM latest WHERE text IS NOT NULL), st AS (SELECT document_id, unnest(a) AS t, generate_subscripts(a, 1) AS p FROM sx),
so AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY document_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM st),
sk AS (SELECT document_id, p, {RQ._STRIP.format("t")} AS text, s + length(t) - length(regexp_replace(t, '^[\s\p{{Z}}\v\x85]+', '')) AS char_start FROM so WHERE t NOT IN ('.', '!', '?')),
sentences AS (SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY p) - 1)::INT AS sentence_index, text, char_start::INT AS char_start, (char_start + length(text))::INT AS char_end FROM sk WHERE text <> '')"""
_LINKS = f"links AS (SELECT document_id, mention_idx AS entity_ord, text AS mention_text, 'e-' || substr(sha256('el:' || type || ':' || {_n('text')}), 1, 16) AS canonical_id, type AS entity_type FROM men)"
_BUILT = f"""{RQ._MENTIONS}, {_LINKS}, {_SENTS}, {RQ._COOC},
fn AS (SELECT document_id, canonical_id, mention_text AS name, entity_type AS type FROM links QUALIFY row_number() OVER (PARTITION BY document_id, canonical_id ORDER BY entity_ord, mention_text, entity_type) = 1),
nodes AS (SELECT canonical_id, name, type FROM fn JOIN (SELECT document_id, ingest_order FROM latest) USING (document_id) QUALIFY row_number() OVER (PARTITION BY canonical_id ORDER BY ingest_order DESC, document_id DESC) = 1),
adj AS (SELECT DISTINCT a, b FROM (SELECT subject_id AS a, object_id AS b FROM co UNION ALL SELECT object_id, subject_id FROM co) WHERE a <> b)"""
_ANSWERED = RQ._RETRIEVE.split(", qq AS (", 1)[1]
_SDOTS = """sdots AS (SELECT q.qid, r.document_id, r.sentence_index, sum(r.w * q.w) AS d, max(r.norm2) AS n1, max(q.norm2) AS n2 FROM sv r JOIN qv q ON q.bucket = r.bucket GROUP BY ALL HAVING sum(r.w * q.w) > 0),
sknn AS (SELECT qid, document_id, sentence_index, row_number() OVER (PARTITION BY qid ORDER BY d / sqrt((n1 * n2)::DOUBLE) DESC, document_id, sentence_index) AS rank FROM sdots QUALIFY rank <= 5)"""
_EVALUATED = (
    f"WITH {_QC}, {_BUILT}, qq AS ({_ANSWERED}, {RQ._hash('sv', 'sentences', 'document_id, sentence_index', 'text')}, {_SDOTS}, "
    + RQ._SCORES.split("WITH ", 1)[1]
    .replace(f"pr AS (SELECT id, context[1].title AS prediction, {RQ._GOLD} AS golds FROM qa)", f"pr AS (SELECT id, rk.name AS prediction, {RQ._GOLD} AS golds FROM qa LEFT JOIN rk ON rk.qid = qa.id AND rk.rank = 1)")
    .replace("gn AS (SELECT id, prediction,", "gn9 AS (SELECT id, prediction,").replace("FROM gn)", "FROM gn9)")
    .replace("pf AS (SELECT DISTINCT id, c.title AS title, 0 AS idx FROM (SELECT id, unnest(context) AS c FROM qa))", "pf AS (SELECT DISTINCT qid AS id, title, sentence_index AS idx FROM sknn JOIN documents d ON d.document_id = sknn.document_id)")
    + ", ev9 AS (SELECT sc.id, sc.prediction, CASE WHEN sc.prediction IS NULL THEN 0.0 ELSE em END AS em, CASE WHEN sc.prediction IS NULL THEN 0.0 ELSE token_f1 END AS token_f1, coalesce(sf_precision, 0.0) AS sf_precision, coalesce(sf_recall, 0.0) AS sf_recall, coalesce(sf_f1, 0.0) AS sf_f1 FROM sc LEFT JOIN ft USING (id))"
)
_RETRIEVED = f"""{RQ._RETRIEVE}, {RQ._hash('sv', 'sentences', 'document_id, sentence_index', 'text')}, {_SDOTS},
tt AS (SELECT title, coalesce(nullif(trim(regexp_replace(title, '[^\\p{{L}}\\p{{N}}_.\\-]+', '_', 'g'), '_'), ''), 'untitled') || '.txt' AS object_key FROM (SELECT DISTINCT unnest(context).title AS title FROM qa)), pr AS (""" + _EVALUATED.split(", pr AS (", 1)[1].replace(
    "SELECT DISTINCT qid AS id, title, sentence_index AS idx FROM sknn JOIN documents d ON d.document_id = sknn.document_id", "SELECT DISTINCT qid AS id, title, sentence_index AS idx FROM sknn JOIN (SELECT DISTINCT document_id, object_key FROM documents) d ON d.document_id = sknn.document_id JOIN tt USING (object_key)"
)
_FIRST_NAMES = "fn AS (SELECT document_id, canonical_id, mention_text AS name, entity_type AS type FROM links WHERE canonical_id IS NOT NULL AND document_id IS NOT NULL AND entity_type <> 'DATE' QUALIFY row_number() OVER (PARTITION BY document_id, canonical_id ORDER BY entity_ord, mention_text, entity_type) = 1)"
_NODE_RECORDS = f"""nl AS (SELECT DISTINCT l.document_id, canonical_id, entity_ord, mention_text, entity_type, o.seq FROM links l JOIN (SELECT document_id, max(ingest_order) AS seq FROM documents GROUP BY 1) o ON o.document_id = l.document_id WHERE canonical_id IS NOT NULL AND entity_type <> 'DATE' AND mention_text IS NOT NULL),
nw AS (SELECT canonical_id, document_id, seq FROM (SELECT DISTINCT canonical_id, document_id, seq FROM nl) QUALIFY row_number() OVER (PARTITION BY canonical_id ORDER BY seq DESC, document_id DESC) = 1),
nx AS (SELECT nl.*, {_n('mention_text')} AS k, row_number() OVER (PARTITION BY nl.canonical_id ORDER BY entity_ord, mention_text, entity_type) AS i FROM nl JOIN nw USING (canonical_id, document_id)),
nk AS (SELECT *, row_number() OVER (PARTITION BY canonical_id, k ORDER BY i) AS f FROM nx),
nr AS (SELECT canonical_id, max(CASE WHEN i = 1 THEN mention_text END) AS name, max(CASE WHEN i = 1 THEN entity_type END) AS type, coalesce(string_agg(CASE WHEN f = 1 AND i > 1 AND k <> '' THEN mention_text END, '|' ORDER BY i), '') AS aliases, max(seq) AS seq FROM nk GROUP BY 1)"""
_WANTED = ", ".join(p for p in PREDICATES if p != "RELATED_TO")
_IDS = "ei AS (SELECT document_id, string_agg('- ' || canonical_id || ': ' || name || ' (' || type || ')', chr(10) ORDER BY canonical_id, name, type) AS ids FROM fn WHERE name IS NOT NULL GROUP BY 1)"
_ASK = f"'State the relations of one document as triples of the ids below. Predicates: {_WANTED}; RELATED_TO if none fits. Give the number of the sentence, from 0, and a date as a field.' || chr(10) || chr(10) || 'Text:' || chr(10) || coalesce(l.text, '') || chr(10) || chr(10) || 'Ids:' || chr(10) || ids"
_QSHOW = "SELECT id, question, answer, len(coalesce(answer_aliases, []::VARCHAR[])) AS n_aliases, len(supporting_facts) AS n_facts, array_to_string(list_transform(context, lambda c: c.title || '|' || len(c.sentences) || coalesce('|' || c.sentences[1], '')), chr(10)) AS context FROM qa"

ORACLE = {
    "evaluate_qa": _EVALUATED + " SELECT id, prediction, em, " + ", ".join(f"{RQ._six(c)} AS {c}" for c in H.METRICS[1:]) + " FROM ev9",
    "evaluate_report": _EVALUATED
    + " SELECT 'subset: full' || chr(10) || 'questions: ' || count(*) || chr(10) || 'documents: ' || (SELECT count(*) FROM documents) || chr(10) || 'calls: 0' || chr(10) || "
    + " || chr(10) || ".join(f"'{c}: ' || printf('%.4f', avg({c})::DOUBLE)" for c in H.METRICS)
    + " AS report FROM ev9",
    "retrieved_metrics": _RETRIEVED + " SELECT count(*) AS questions, " + ", ".join(f"{RQ._six(f'avg({c})')} AS {c}" for c in H.METRICS) + " FROM ev9",
    "triple_prompts": f"WITH {RQ._LATEST}, {_FIRST_NAMES}, {_IDS.replace(' WHERE name IS NOT NULL', '')}, p AS (SELECT l.document_id, {_ASK.replace('|| ids', '|| coalesce(ids, chr(0))').replace('chr(0)', repr(''))} AS prompt FROM latest l JOIN ei ON ei.document_id = l.document_id) SELECT document_id, length(prompt) AS n FROM p",
    "qa_corpus": f"WITH {_QC} SELECT document_id, object_key, title, text FROM documents",
    "sentence_endpoints": f"""WITH {_FIRST_NAMES}, sq AS (SELECT document_id, document_id || '#' || sentence_index AS qid, string_split({_n('text')}, ' ') AS q FROM sentences),
nw AS (SELECT document_id, canonical_id, name, unnest(list_distinct(string_split({_n('name')}, ' '))) AS x FROM fn WHERE name IS NOT NULL),
ov AS (SELECT qid, canonical_id, name, count(DISTINCT x) AS o, min(list_position(q, x)) AS p FROM sq JOIN nw ON nw.document_id = sq.document_id AND list_contains(q, x) GROUP BY ALL),
tp AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY o DESC, name, canonical_id) AS r FROM ov QUALIFY r <= 2), ls AS (SELECT qid, list(canonical_id ORDER BY p, r) AS e FROM tp GROUP BY qid)
SELECT qid, e[1] AS first, e[2] AS second FROM ls""",
    "ranked_sentences": f"""WITH v AS (SELECT s.document_id, s.sentence_index, r.sentence_vectors[s.sentence_index + 1] AS v FROM sentences s JOIN document_records r USING (document_id)),
q AS (SELECT document_id, v AS q FROM v WHERE sentence_index = 0 AND v IS NOT NULL), d AS (SELECT document_id, sentence_index, list_inner_product(v, q) AS d, sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q)) AS n FROM v JOIN q USING (document_id) WHERE v IS NOT NULL),
s AS (SELECT document_id, sentence_index, CASE WHEN n = 0 THEN 0.0 ELSE d / n END AS score FROM d)
SELECT document_id, sentence_index, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, sentence_index) AS rank, {RQ._six('score')} AS score FROM s QUALIFY rank <= 3""",
    "entity_store": f"""WITH w AS (SELECT canonical_id, CASE WHEN len(aliases) > 0 THEN aliases[1] ELSE name END AS name, type, list_filter(coalesce(aliases, []::VARCHAR[]), lambda a: a IS NOT NULL) AS al, vector FROM entities)
SELECT canonical_id, name, {_n('name')} AS normalized_name, type, array_to_string(list_transform(al, lambda a: {_n('a')}), '|') AS aliases, coalesce(len(vector), -1) AS width FROM w""",
    "entity_blocks": f"""WITH k AS (SELECT DISTINCT canonical_id, type, unnest(list_transform(list_filter(list_concat([name], coalesce(aliases, []::VARCHAR[])), lambda a: a IS NOT NULL), lambda a: {_n('a')})) AS k FROM entities),
m AS (SELECT DISTINCT mention_text AS surface, entity_type AS type, {_n('mention_text')} AS n FROM links WHERE canonical_id IS NULL AND mention_text IS NOT NULL) SELECT surface, m.type, canonical_id FROM m JOIN k ON k.type = m.type AND k.k = m.n""",
    "node_aliases": f"WITH {_NODE_RECORDS} SELECT canonical_id, name, type, aliases, seq FROM nr",
    "graph_checkpoint": f"""WITH {_NODE_RECORDS}, {RQ._COOC}, again AS (SELECT document_id FROM documents GROUP BY 1 HAVING count(*) > 1),
x AS (SELECT source_doc_id, subject_id, object_id, predicate, raw_predicate FROM co WHERE source_doc_id NOT IN (SELECT document_id FROM again) AND source_doc_id IN (SELECT document_id FROM documents) UNION ALL SELECT source_doc_id, subject_id, object_id, predicate, raw_predicate FROM edges WHERE source_doc_id IN (SELECT document_id FROM again))
SELECT source_doc_id, count(*) AS edges, count(DISTINCT predicate) AS predicates, count(raw_predicate) AS raw FROM x WHERE predicate IN ({RQ._IN}) AND subject_id IN (SELECT canonical_id FROM nr) AND object_id IN (SELECT canonical_id FROM nr) GROUP BY 1""",
    "document_get": f"WITH {RQ._LATEST}, k AS (SELECT source_doc_id AS document_id FROM edges UNION SELECT 'none-' || document_id FROM links) SELECT k.document_id, doc_id, ingest_order, n_chars FROM k LEFT JOIN latest l ON l.document_id = k.document_id WHERE k.document_id IS NOT NULL",
    "constraint_report": """SELECT 'documents' AS what, document_id AS key, count(*) AS rows FROM documents GROUP BY 2 HAVING count(*) > 1 OR document_id IS NULL
UNION ALL SELECT 'entities', canonical_id, count(*) FROM entities GROUP BY 2 HAVING count(*) > 1 OR canonical_id IS NULL UNION ALL SELECT 'links', concat_ws('#', document_id, entity_ord) AS key, count(*) FROM links GROUP BY 2 HAVING count(*) > 1""",
    "checked_edges": "SELECT predicate, count(*) AS edges FROM edges GROUP BY 1",
    "read_qa_lines": _QSHOW,
    "read_qa_array": _QSHOW,
    "read_corpus": "SELECT n_name || '.md' AS name, '# ' || n_name || chr(10) || chr(10) || 'Region ' || n_regionkey || chr(10) AS text, row_number() OVER (ORDER BY n_name || '.md') AS ingest_order FROM nation",
    "object_get": """WITH a AS (SELECT DISTINCT n_regionkey + n_nationkey % 2 * 3 AS k FROM nation)
SELECT CASE WHEN r_name IS NOT NULL THEN sha256('bucket/r' || k || '.txt') END AS document_id, 'r' || k || '.txt' AS object_key, r_name AS text FROM a LEFT JOIN region ON r_regionkey = k""",
    "port_completion": "SELECT id, CASE WHEN question IN (SELECT question FROM qa WHERE len(answer_aliases) > 0) THEN -1 WHEN length(question) % 2 = 0 THEN length(question) END AS n FROM qa",
    "triple_prompt_texts": f"WITH {RQ._LATEST}, {_FIRST_NAMES}, {_IDS}, p AS (SELECT l.document_id, {_ASK} AS prompt FROM latest l JOIN ei ON ei.document_id = l.document_id) SELECT document_id, length(prompt) AS n, sha256(prompt) AS digest FROM p",
    "model_graph": f"""WITH {RQ._LATEST}, {_FIRST_NAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY canonical_id) AS i FROM fn WHERE name IS NOT NULL)
SELECT a.canonical_id AS subject_id, 'LOCATED_IN' AS predicate, b.canonical_id AS object_id, a.document_id AS source_doc_id, 0 AS sentence_index, s.text AS source_sentence, NULL::VARCHAR AS raw_predicate, 0.5::DOUBLE AS confidence, s.char_start, s.char_end
FROM r a JOIN r b ON a.document_id = b.document_id AND a.i = 1 AND b.i = 2 JOIN latest l ON l.document_id = a.document_id JOIN sentences s ON s.document_id = a.document_id AND s.sentence_index = 0""",
    "embedded_names": "SELECT canonical_id, length(name) AS n, length(name) - length(replace(name, 'a', '')) AS a, length(name) - length(replace(name, 'e', '')) AS e FROM entities WHERE name IS NOT NULL",
    "vector_scores": f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), c AS (SELECT a.vec_id, list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) AS c FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, {RQ._six('c')} AS c, {RQ._six('2 * ((1 + c) / 2) - 1')} AS back FROM c""",
}
