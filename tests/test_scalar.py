import hashlib
import math

from pyspark.sql import functions as F

from quillgraph.functions import scalar as S
from quillgraph.operators.fold import hashed


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def values(spark, xs, f, typ="string"):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {typ}").orderBy("i").select(f("x")).collect()]


def test_normalize_name(spark):
    got = values(spark, ["Apple, Inc.", "  Straße  ", "A B_c", "...", None, ""], S.normalize_name)
    assert got == ["apple inc", "strasse", "a b_c", "", None, ""]


def test_normalize_answer(spark):
    got = values(spark, ["The United States", "A. B. C.", ".,;:!?", "Thebes Panama", None], S.normalize_answer)
    assert got == ["united states", "b c", "", "thebes panama", None]


def test_map_predicates(spark):
    rows = spark.createDataFrame([("acquired",), ("has a crush on",), ("connected to",), ("WORKS_FOR",), ("Works-For",), ("is employed by",)], "raw string")
    got = {r.raw: (r.predicate, r.raw_predicate) for r in S.map_predicates(rows, "raw").collect()}
    assert got["acquired"] == ("OWNS", None)
    assert got["has a crush on"] == ("RELATED_TO", "has a crush on")
    assert got["connected to"] == ("RELATED_TO", None)
    assert got["WORKS_FOR"] == got["Works-For"] == ("WORKS_FOR", None)
    assert got["is employed by"] == ("RELATED_TO", "is employed by")


def test_labels(spark):
    assert values(spark, ["GPE", "LOC", "ORG", "CARDINAL", None], S.curated_type) == ["LOCATION", "LOCATION", "ORG", None, None]


def test_ids(spark):
    r = one(spark, d=S.document_id(F.lit("a"), F.lit("b/c")), m=S.mint_id(F.lit("ORG"), F.lit("acme")), k=S.cache_key(F.lit("m"), F.lit("p"), F.lit("{}")))
    assert r.d == hashlib.sha256(b"a/b/c").hexdigest() and len(r.d) == 64
    assert r.m == "e-" + hashlib.sha256(b"el:ORG:acme").hexdigest()[:16]
    assert r.k == hashlib.sha256(b"m\0p\0{}").hexdigest()


def test_hash_vector_matches_python(spark):
    for w in ["apple", "über", "x", "東京"]:
        r = spark.range(1).select(F.sha2(F.lit(w), 256).alias("h")).select(S.digest_bucket("h", 384).alias("b"), S.digest_sign("h").alias("s")).first()
        assert hashed(w, 384) == {r.b: float(r.s)}


def test_cosine_and_scores(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    r = one(spark, a=S.cosine(v(1, 0), v(0.7, 0.7)), z=S.cosine(v(0, 0), v(1, 1)), n0=S.node_score(F.lit(0.9), F.lit(0), 0.7, 0.3), n1=S.node_score(F.lit(None).cast("double"), F.lit(1), 0.7, 0.3), n2=S.node_score(F.lit(0.5), F.lit(None).cast("int"), 0.7, 0.3), e=S.score_to_cosine(F.lit(0.75)))
    assert math.isclose(r.a, 1 / math.sqrt(2)) and r.z == 0
    assert math.isclose(r.n0, 0.93) and math.isclose(r.n1, 0.15) and math.isclose(r.n2, 0.35) and r.e == 0.5


def test_json_and_slug(spark):
    got = values(spark, ['```json\n{"a": {"b": 1}}\n```', "  none ", None], S.extract_json)
    assert got == ['{"a": {"b": 1}}', "none", None]
    assert values(spark, ["Ada Lovelace", "__", "a/b: c", "Größe-1.x"], S.object_key_slug) == ["Ada_Lovelace.txt", "untitled.txt", "a_b_c.txt", "Größe-1.x.txt"]


def test_decode(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb"),)], "c binary")
    assert df.select(S.decode_text("c")).first()[0] == "a�b"
