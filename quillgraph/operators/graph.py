"""The property graph as two tables: upserts, edge replacement, neighbourhoods, paths, co-occurrence, triple checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import PREDICATES
from ..session import cut


#: Short entries (an id, a word of bits) of a side up to which it is sent to the executors; they are counted first.
SENT_ROWS = 300_000


def is_small(df: DataFrame, entries: Column | None = None) -> bool:
    """Whether a side of short rows has at most SENT_ROWS of them, or of the entries in them."""
    n = df.agg(F.count(F.lit(1)) if entries is None else F.sum(entries)).first()[0]
    return (n or 0) <= SENT_ROWS


def small_side(df: DataFrame) -> DataFrame:
    """A side of short rows, marked for broadcast only if a count shows it to be small; else the join shuffles."""
    df = cut(df)
    return F.broadcast(df) if is_small(df) else df


def latest(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """Last-write-wins upsert of a log of rows: per key the row that is greatest by ``order``.

    ``max_by`` combines on the map side, so a key that is written a million times sends one row per
    map task.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*key).agg(F.max_by(row, F.struct(*order)).alias("_r")).select("_r.*")


def document_nodes(links: DataFrame) -> DataFrame:
    """(document_id, canonical_id, name, type): per document the first link of each id; dates are no nodes."""
    ok = links.where("canonical_id IS NOT NULL AND document_id IS NOT NULL AND entity_type <> 'DATE'")
    first = ok.groupBy("document_id", "canonical_id").agg(F.min_by(F.struct("mention_text", "entity_type"), F.struct("entity_ord", "mention_text", "entity_type")).alias("_f"))
    return first.select("document_id", "canonical_id", F.col("_f.mention_text").alias("name"), F.col("_f.entity_type").alias("type"))


def graph_nodes(links: DataFrame, documents: DataFrame) -> DataFrame:
    """(canonical_id, name, type): the node as the last ingested document wrote it."""
    order = documents.groupBy("document_id").agg(F.max("ingest_order").alias("ingest_order"))
    return latest(document_nodes(links).join(order, "document_id"), ["canonical_id"], ["ingest_order", "document_id"]).select("canonical_id", "name", "type")


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of the closed predicate set of which both ends are nodes, as a graph store would keep them."""
    ids = small_side(nodes.select(F.col("canonical_id").alias("_id")).distinct())
    kept = edges.where(F.col("predicate").isin(*PREDICATES))
    return kept.join(ids, kept["subject_id"] == ids["_id"], "left_semi").join(ids, kept["object_id"] == ids["_id"], "left_semi")


def checked_edges(edges: DataFrame) -> DataFrame:
    """As ``valid_edges`` for the predicate alone, but an unknown predicate stops the job."""
    return edges.where(F.assert_true(F.col("predicate").isin(*PREDICATES), F.concat(F.lit("unknown predicate: "), F.coalesce("predicate", F.lit("null")))).isNull())


def replace_document_edges(edges: DataFrame, new: DataFrame, documents: DataFrame) -> DataFrame:
    """Edges after re-ingesting ``documents``: theirs are taken out and the new ones put in; nodes stay."""
    gone = documents.select(F.col("document_id").alias("_d")).distinct()
    return edges.join(gone, edges["source_doc_id"] == gone["_d"], "left_anti").unionByName(new)


def adjacency(edges: DataFrame) -> DataFrame:
    """(a, b): undirected neighbours, each once, without self-loops."""
    ok = edges.where("subject_id IS NOT NULL AND object_id IS NOT NULL AND subject_id <> object_id")
    return ok.select(F.explode(F.array(F.struct(F.col("subject_id").alias("a"), F.col("object_id").alias("b")), F.struct(F.col("object_id").alias("a"), F.col("subject_id").alias("b")))).alias("_x")).select("_x.*").distinct()


WORD_BITS = 63


def _numbered(rows: DataFrame) -> DataFrame:
    """(qid, word, bit): a bit for each question of the batch, which the caller states."""
    n = F.row_number().over(Window.orderBy("qid")) - 1
    return cut(rows.select("qid").distinct().select("qid", n.alias("_o")).select("qid", F.floor(F.col("_o") / WORD_BITS).cast("int").alias("word"), (F.col("_o") % WORD_BITS).cast("int").alias("bit")))


def _bits(rows: DataFrame, numbered: DataFrame) -> DataFrame:
    """(qid, canonical_id) -> (canonical_id, word, bits)."""
    return rows.join(numbered, "qid").groupBy("canonical_id", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))


def khop(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, hops: int) -> DataFrame:
    """(qid, canonical_id, depth): every node within ``hops`` undirected steps of a seed (qid, canonical_id), with its least depth.

    All questions of the batch walk together: a node carries one word of bits for 63 questions, a
    step sends words along the edges and joins them with OR, and bits already seen are cleared. A
    hub is expanded once for all questions, and a step costs edges x words, not edges x questions.
    """
    known = nodes.select("canonical_id").distinct()
    start = cut(seeds.select("qid", "canonical_id").distinct().join(known, "canonical_id", "left_semi"))
    if hops <= 0:
        return start.select("qid", "canonical_id", F.lit(0).alias("depth"))
    near = cut(adjacency(edges))
    numbered = _numbered(start)
    seen = fresh = cut(_bits(start, numbered))
    levels = fresh.withColumn("depth", F.lit(0))
    for d in range(1, hops + 1):
        step = fresh.join(near, F.col("canonical_id") == F.col("a")).groupBy(F.col("b").alias("canonical_id"), "word").agg(F.bit_or("bits").alias("bits"))
        old = seen.select("canonical_id", "word", F.col("bits").alias("_old"))
        fresh = cut(step.join(old, ["canonical_id", "word"], "left").select("canonical_id", "word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_old", F.lit(0).cast("bigint")))).alias("bits")).where("bits <> 0"))
        levels = levels.unionByName(fresh.withColumn("depth", F.lit(d)))
        if d < hops:
            seen = cut(seen.unionByName(fresh).groupBy("canonical_id", "word").agg(F.bit_or("bits").alias("bits")))
    return _per_question(levels, numbered).select("qid", "canonical_id", "depth")


def _masks(reached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The batch's numbered questions, and per node those that reached it: (canonical_id, mask map<int,bigint>)."""
    numbered = _numbered(reached)
    words = _bits(reached, numbered)
    return numbered, words.groupBy("canonical_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("mask"))


def _edge_words(edges: DataFrame, masks: DataFrame) -> DataFrame:
    """Edges with (word, bits) rows of the questions that reached both ends."""
    masks = cut(masks)
    send = F.broadcast if is_small(masks, F.size("mask")) else (lambda df: df)
    a = send(masks.select(F.col("canonical_id").alias("subject_id"), F.col("mask").alias("_ma")))
    b = send(masks.select(F.col("canonical_id").alias("object_id"), F.col("mask").alias("_mb")))
    both = edges.join(a, "subject_id").join(b, "object_id")
    common = F.filter(F.transform(F.map_keys("_ma"), lambda w: F.struct(w.alias("word"), F.col("_ma")[w].bitwiseAND(F.coalesce(F.col("_mb")[w], F.lit(0).cast("bigint"))).alias("bits"))), lambda x: x["bits"] != 0)
    return both.withColumn("_w", F.explode(common)).select(*edges.columns, "_w.word", "_w.bits")


def _per_question(df: DataFrame, numbered: DataFrame) -> DataFrame:
    """(…, word, bits) rows once per set bit, with the question."""
    on = F.expr(f"filter(sequence(0, {WORD_BITS - 1}), i -> (shiftright(bits, i) & 1L) = 1L)")
    return df.withColumn("bit", F.explode(on)).join(numbered, ["word", "bit"]).drop("word", "bit", "bits")


def induced_edges(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, edge…): edges of which both ends were reached by the question."""
    numbered, masks = _masks(reached)
    return _per_question(_edge_words(edges, masks), numbered).select("qid", *edges.columns)


def subgraph_sizes(reached: DataFrame, edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(qid, by…, edges, documents) of the induced subgraphs, without a row per question and edge.

    Edges of equal mask are counted together, and documents are the union of their edges' masks;
    questions are only told apart at the end, over distinct masks.
    """
    by = by or []
    numbered, masks = _masks(reached)
    rows = cut(_edge_words(edges.select("subject_id", "object_id", "source_doc_id", *by), masks).groupBy(*by, "source_doc_id", "word", "bits").agg(F.count(F.lit(1)).alias("n")))
    n_edges = _per_question(rows.groupBy(*by, "word", "bits").agg(F.sum("n").alias("n")), numbered).groupBy("qid", *by).agg(F.sum("n").alias("edges"))
    docs = rows.where("source_doc_id IS NOT NULL").groupBy(*by, "source_doc_id", "word").agg(F.bit_or("bits").alias("bits")).groupBy(*by, "word", "bits").agg(F.count(F.lit(1)).alias("d"))
    n_docs = _per_question(docs, numbered).groupBy("qid", *by).agg(F.sum("d").alias("documents"))
    return n_edges.join(n_docs, ["qid", *by], "left").select("qid", *by, "edges", F.coalesce("documents", F.lit(0)).alias("documents"))


def incident_edges(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(canonical_id, edge…): edges at either end of an id; a self-loop once."""
    ends = F.array_distinct(F.array("subject_id", "object_id"))
    return edges.withColumn("canonical_id", F.explode(ends)).join(ids.select("canonical_id").distinct(), "canonical_id", "left_semi")


def shortest_paths(pairs: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(qid, path) for (qid, source, target): the least of the shortest undirected paths in id order; null if none.

    Searches until a step reaches no new node, or ``max_depth`` steps. Each source walks once for
    all its questions, and each level keeps one path per source and node, the least, so work is
    bounded by sources x nodes, not by paths.
    """
    near = cut(adjacency(edges))
    on_graph = near.select(F.col("a").alias("source")).distinct()
    start = pairs.select("source").distinct().join(on_graph, "source", "left_semi")
    reached = fresh = cut(start.select("source", F.col("source").alias("node"), F.array("source").alias("path")))
    d = 0
    while (max_depth is None or d < max_depth) and not fresh.isEmpty():
        step = fresh.join(near, F.col("node") == F.col("a")).select("source", F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"))
        fresh = cut(step.join(reached.select("source", "node"), ["source", "node"], "left_anti").groupBy("source", "node").agg(F.min("path").alias("path")))
        reached = reached.unionByName(fresh)
        d += 1
    ends = reached.select("source", F.col("node").alias("target"), "path")
    return pairs.select("qid", "source", "target").join(ends, ["source", "target"], "left").select("qid", "path")


def first_edge_between(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, edge…): one edge that joins two ids in either direction, the least by its columns."""
    row = F.struct(*[F.col(c) for c in edges.columns])
    least = edges.where("subject_id IS NOT NULL AND object_id IS NOT NULL").groupBy(F.least("subject_id", "object_id").alias("_l"), F.greatest("subject_id", "object_id").alias("_g")).agg(F.min(row).alias("_e"))
    return pairs.join(least, (F.least("a", "b") == F.col("_l")) & (F.greatest("a", "b") == F.col("_g"))).select("a", "b", "_e.*")


def surfaces(links: DataFrame) -> DataFrame:
    """(document_id, canonical_id, surface): the distinct spellings under which a document links an id."""
    return links.where("canonical_id IS NOT NULL AND mention_text IS NOT NULL AND mention_text <> '' AND entity_type <> 'DATE'").select("document_id", "canonical_id", F.col("mention_text").alias("surface")).distinct()


def present(links: DataFrame, sentences: DataFrame) -> DataFrame:
    """(document_id, sentence_index, canonical_id): ids of which a spelling occurs in the sentence, case and all.

    The join is on the document; containment is a residual of it.
    """
    s = sentences.select("document_id", "sentence_index", F.col("text").alias("_t"))
    return s.join(surfaces(links), "document_id").where(F.contains(F.col("_t"), F.col("surface"))).select("document_id", "sentence_index", "canonical_id").distinct()


def cooccurrence_edges(links: DataFrame, sentences: DataFrame) -> DataFrame:
    """RELATED_TO edges between every two ids of one sentence, the smaller id first, with the sentence as provenance."""
    sets = present(links, sentences).groupBy("document_id", "sentence_index").agg(F.array_sort(F.collect_set("canonical_id")).alias("_ids")).where(F.size("_ids") > 1)
    heads = sets.select("document_id", "sentence_index", "_ids", F.posexplode("_ids").alias("_p", "subject_id"))
    pairs = heads.select("document_id", "sentence_index", "subject_id", F.explode(F.slice("_ids", F.col("_p") + 2, F.size("_ids"))).alias("object_id"))
    s = sentences.select("document_id", "sentence_index", F.col("text").alias("source_sentence"), "char_start", "char_end")
    return pairs.join(s, ["document_id", "sentence_index"]).select(
        "subject_id", F.lit("RELATED_TO").alias("predicate"), "object_id", F.lit(None).cast("string").alias("date"), F.col("document_id").alias("source_doc_id"), "sentence_index", "source_sentence",
        F.lit(None).cast("string").alias("raw_predicate"), F.lit(None).cast("double").alias("confidence"), "char_start", "char_end",
    )


def validated_triples(triples: DataFrame, links: DataFrame, sentences: DataFrame) -> DataFrame:
    """Triples (document_id, subject_id, …, sentence_index) of which both ends are the document's own ids and the sentence exists, with its text and offsets."""
    own = links.where("canonical_id IS NOT NULL AND entity_type <> 'DATE'").select("document_id", "canonical_id").distinct()
    t = triples.join(own.withColumnRenamed("canonical_id", "subject_id"), ["document_id", "subject_id"], "left_semi").join(own.withColumnRenamed("canonical_id", "object_id"), ["document_id", "object_id"], "left_semi")
    return t.join(sentences.select("document_id", "sentence_index", F.col("text").alias("source_sentence"), "char_start", "char_end"), ["document_id", "sentence_index"])


def contributing_documents(edges: DataFrame) -> DataFrame:
    """Per question, the number of documents behind its subgraph."""
    return edges.groupBy("qid").agg(F.count_distinct("source_doc_id").alias("documents"))


def first_per(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """First row per key in an order that is total within the key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
