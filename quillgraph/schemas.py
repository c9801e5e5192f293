"""Declared schemas (as DDL), closed sets and settings. Nothing is inferred."""

from __future__ import annotations

from dataclasses import dataclass

TRIGGER = "bucket string, object_key string"
RAW_DOCUMENTS = "bucket string, object_key string, content binary, ingest_order bigint"
DOCUMENTS = "document_id string, bucket string, object_key string, text string, ingest_order bigint"
SENTENCES = "document_id string, sentence_index int, text string, char_start int, char_end int"
MENTIONS = "document_id string, mention_idx int, text string, type string, char_start int, char_end int"
COREF = "document_id string, cluster_idx int, canonical string, members array<string>"
COREF_JSON = "clusters array<struct<canonical:string,members:array<string>>>"
LINKS = "document_id string, entity_ord int, mention_text string, canonical_id string, entity_type string, score double, is_new boolean"
ENTITIES = "canonical_id string, name string, type string, aliases array<string>, vector array<double>"
NODES = "canonical_id string, name string, type string, aliases array<string>"
RAW_TRIPLES = "document_id string, subject_id string, predicate string, object_id string, sentence_index int, date string, confidence double"
EDGES = "subject_id string, predicate string, object_id string, date string, source_doc_id string, sentence_index int, source_sentence string, raw_predicate string, confidence double, char_start int, char_end int"
TRIPLE_JSON = "triples array<struct<subject_id:string,predicate:string,object_id:string,sentence_index:int,date:string,confidence:double>>"
QUESTIONS = "qid string, question string, synthesize boolean"
QA = "id string, question string, answer string, answer_aliases array<string>, supporting_facts array<struct<title:string,idx:int>>, context array<struct<title:string,sentences:array<string>>>"
LLM_CACHE = "cache_key string, text string"

#: Curated entity types.
ENTITY_TYPES = ("PERSON", "ORG", "LOCATION", "LAW", "DATE", "EVENT", "NORP", "PRODUCT")

#: Recogniser label -> curated type; other labels are dropped.
LABEL_TYPES = {
    "PERSON": "PERSON",
    "ORG": "ORG",
    "GPE": "LOCATION",
    "LOC": "LOCATION",
    "LAW": "LAW",
    "DATE": "DATE",
    "EVENT": "EVENT",
    "NORP": "NORP",
    "PRODUCT": "PRODUCT",
}

#: The closed predicate set.
PREDICATES = (
    "LOCATED_IN",
    "PART_OF",
    "MEMBER_OF",
    "WORKS_FOR",
    "HAS_ROLE",
    "FOUNDED",
    "OWNS",
    "PRODUCES",
    "PARTICIPATED_IN",
    "OCCURRED_ON",
    "AFFILIATED_WITH",
    "RELATED_TO",
)
FALLBACK_PREDICATE = "RELATED_TO"

#: Phrases that map to a predicate, beside each predicate's own name in words.
PREDICATE_PHRASES = {
    "LOCATED_IN": ("location", "located", "based in", "headquartered in", "is in", "situated in"),
    "PART_OF": ("part of", "subsidiary of", "division of", "belongs to"),
    "MEMBER_OF": ("member", "belongs to group"),
    "WORKS_FOR": ("employed by", "employee of", "works at", "works for"),
    "HAS_ROLE": ("role", "has title", "serves as", "position"),
    "FOUNDED": ("founder of", "co founded", "established", "created"),
    "OWNS": ("owner of", "acquired", "controls"),
    "PRODUCES": ("makes", "manufactures", "develops", "produced"),
    "PARTICIPATED_IN": ("took part in", "attended", "involved in", "participant in"),
    "OCCURRED_ON": ("happened on", "took place on", "dated", "on date"),
    "AFFILIATED_WITH": ("associated with", "affiliation", "allied with"),
    "RELATED_TO": ("relates to", "connected to", "linked to"),
}

#: Words stripped from the front of a capitalised span.
LEADING_WORDS = (
    "the a an this that these those in on at of for and but or he she it they his her its their "
    "who what when where which why how is was were are be after before during by to from as"
).split()

#: Sizes of the named evaluation subsets; full has no limit.
SUBSETS = {"small": 20, "medium": 200, "full": None}


@dataclass(frozen=True)
class Settings:
    """Knobs whose defaults are part of the results."""

    embed_dim: int = 384
    el_threshold: float = 0.82
    el_knn_top_k: int = 5
    tiebreaker_margin: float = 0.05
    khop_depth: int = 2
    seed_top_k_entities: int = 5
    seed_top_k_sentences: int = 5
    rank_weight_seed: float = 0.7
    rank_weight_proximity: float = 0.3
    llm_max_retries: int = 2
    bucket: str = "documents"
