"""Objects, corpora and question files; keyed tables as sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalar import decode_text, document_id
from ..operators.graph import latest
from ..schemas import QA


def read_objects(spark: SparkSession, root: str, bucket: str, glob: str | None = None) -> DataFrame:
    """(bucket, object_key, content) of the files under root/bucket; a missing bucket raises at analysis, as a missing path does."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    key = F.regexp_replace("path", r"^.*/" + bucket + "/", "")
    return reader.load(f"{root}/{bucket}").select(F.lit(bucket).alias("bucket"), key.alias("object_key"), "content")


def get_objects(triggers: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missing) of (bucket, object_key) triggers: rows with content, and triggers without an object."""
    t = triggers.select("bucket", "object_key").where("bucket IS NOT NULL AND object_key IS NOT NULL").distinct()
    return t.join(objects, ["bucket", "object_key"]), t.join(objects, ["bucket", "object_key"], "left_anti")


def raw_documents(objects: DataFrame) -> DataFrame:
    """(document_id, bucket, object_key, text) of objects."""
    return objects.select(document_id("bucket", "object_key").alias("document_id"), "bucket", "object_key", decode_text("content").alias("text"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(name, text, ingest_order) of the *.md files of a folder in name order, its README left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), decode_text("content").alias("text")).where("name <> 'README.md'")
    return named.withColumn("ingest_order", F.expr("row_number() OVER (ORDER BY name)").cast("bigint"))


def parse_qa(raw: Column) -> Column:
    """A question row of a JSON text: id from _id, else id, else empty; pairs [title, x] become structs; missing lists are empty."""
    loose = F.from_json(raw, "_id string, id string, question string, answer string, answer_aliases array<string>, supporting_facts array<array<string>>, context array<array<string>>")
    facts = F.transform(F.coalesce(loose["supporting_facts"], F.array().cast("array<array<string>>")), lambda p: F.struct(p[0].alias("title"), p[1].cast("int").alias("idx")))
    paras = F.transform(F.coalesce(loose["context"], F.array().cast("array<array<string>>")), lambda p: F.struct(p[0].alias("title"), F.coalesce(F.from_json(p[1], "array<string>"), F.array().cast("array<string>")).alias("sentences")))
    return F.struct(
        F.coalesce(F.nullif(loose["_id"], F.lit("")), F.nullif(loose["id"], F.lit("")), F.lit("")).alias("id"),
        F.coalesce(loose["question"], F.lit("")).alias("question"),
        F.coalesce(loose["answer"], F.lit("")).alias("answer"),
        F.coalesce(loose["answer_aliases"], F.array().cast("array<string>")).alias("answer_aliases"),
        facts.alias("supporting_facts"),
        paras.alias("context"),
    )


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON array or JSON lines, told apart by the first character; blank lines are skipped. A folder gives its first *.json or *.jsonl by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{json,jsonl}").load(path) if not path.endswith((".json", ".jsonl")) else spark.read.format("binaryFile").load(path)
    first = files.agg(F.min_by(F.col("content"), F.col("path")).alias("content")).select(F.ltrim(decode_text("content")).alias("t"))
    # Array elements are kept as JSON texts through VARIANT.
    whole = F.transform(F.from_json("t", "array<variant>"), lambda v: F.to_json(v))
    lines = F.filter(F.split("t", r"\r?\n"), lambda x: F.trim(x) != "")
    rows = first.select(F.explode(F.when(F.startswith("t", F.lit("[")), whole).otherwise(lines)).alias("raw"))
    return rows.select(parse_qa(F.col("raw")).alias("q")).select("q.*").to(StructType.fromDDL(QA))


def write_object(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def rebuild_records(documents: DataFrame, sentences: DataFrame) -> DataFrame:
    """(document_id, sentences, sentence_vectors): sentences in order; vectors only if every sentence has one."""
    s = sentences.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("sentence_index", "text", "char_start", "char_end", "vector"))).alias("_s"))
    whole = F.forall("_s", lambda x: x["vector"].isNotNull())
    return documents.select("document_id").join(s, "document_id", "left").select(
        "document_id",
        F.coalesce(F.transform("_s", lambda x: F.struct(x["sentence_index"].alias("index"), x["text"].alias("text"), x["char_start"].alias("char_start"), x["char_end"].alias("char_end"))), F.array().cast("array<struct<index:int,text:string,char_start:int,char_end:int>>")).alias("sentences"),
        F.when((F.size("_s") > 0) & whole, F.transform("_s", lambda x: x["vector"])).alias("sentence_vectors"),
    )


def attach_vectors(sentences: DataFrame, records: DataFrame) -> DataFrame:
    """Sentences with the vector at their position; vectors beyond the list are dropped, missing ones null."""
    v = records.select("document_id", F.posexplode("sentence_vectors").alias("sentence_index", "vector"))
    return sentences.join(v, ["document_id", "sentence_index"], "left")


class KeyedTable:
    """A parquet table with last-write-wins upserts by key, kept as a log.

    An upsert writes the batch's rows as one more part of the log, so it costs the batch, not the
    table. A part counts once it is complete, which its committer marks; a batch that is written
    again under its number replaces its part. Reading takes the row of greatest (order, part) per
    key; ``compact`` writes that out as one part and drops the rest.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: str, order: str):
        self.spark, self.path, self.key, self.schema, self.order = spark, path, key, schema, order

    def _hadoop(self):
        make = self.spark._jvm.org.apache.hadoop.fs.Path
        root = make(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), make, root

    def parts(self) -> list[int]:
        """Numbers of the complete parts."""
        fs, make, root = self._hadoop()
        if not fs.exists(root):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(root)]
        return sorted(int(n[5:]) for n in names if n.startswith("part=") and fs.exists(make(f"{self.path}/{n}/_SUCCESS")))

    def log(self) -> DataFrame:
        """Every row of every complete part, with ``part`` and ``deleted``."""
        schema = self.schema + ", deleted boolean"
        found = self.parts()
        if not found:
            return self.spark.createDataFrame([], schema + ", part int")
        return self.spark.read.schema(schema + ", part int").option("basePath", self.path).parquet(*[f"{self.path}/part={n}" for n in found])

    def read(self) -> DataFrame:
        return latest(self.log(), self.key, [self.order, "part"]).where("NOT deleted").drop("deleted", "part")

    def _next(self) -> int:
        """The next odd number; numbered batches have the even ones."""
        last = max(self.parts(), default=-1)
        return last + 1 + last % 2

    def _write(self, rows: DataFrame, batch: int | None) -> None:
        part = self._next() if batch is None else 2 * batch
        rows.write.mode("overwrite").parquet(f"{self.path}/part={part}")

    def upsert(self, rows: DataFrame, batch: int | None = None) -> None:
        names = StructType.fromDDL(self.schema).names
        self._write(latest(rows.select(*names), self.key, [self.order]).withColumn("deleted", F.lit(False)), batch)

    def delete(self, keys: DataFrame, on: str) -> None:
        """Takes out the rows whose ``on`` is among the keys, as they are now."""
        self._write(self.read().join(keys.select(on).distinct(), on, "left_semi").select(*StructType.fromDDL(self.schema).names).withColumn("deleted", F.lit(True)), None)

    def compact(self) -> None:
        old = self.parts()
        if len(old) < 2:
            return
        self._write(self.read().withColumn("deleted", F.lit(False)), None)
        fs, make, _ = self._hadoop()
        for n in old:
            fs.delete(make(f"{self.path}/part={n}"), True)
