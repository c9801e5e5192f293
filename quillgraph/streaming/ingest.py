"""Incremental ingestion: triggers as a stream, keyed upserts per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import TRIGGER
from ..session import ship
from ..sources.files import KeyedTable


def trigger_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """(bucket, object_key, seq) of JSON payloads in text files; malformed payloads give no row."""
    raw = spark.readStream.schema("value string").option("maxFilesPerTrigger", max_files).text(path)
    parsed = raw.select(F.from_json("value", "bucket string, object_key string, seq bigint").alias("t"))
    return parsed.select("t.*").where("bucket IS NOT NULL AND object_key IS NOT NULL")


def kafka_triggers(spark: SparkSession, servers: str, topic: str, group: str = "ingest", max_offsets: int = 10_000) -> DataFrame:
    """The same from Kafka, from the earliest offset; needs the connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("kafka.group.id", group).option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", max_offsets).load()
    return raw.select(F.from_json(F.col("value").cast("string"), TRIGGER).alias("t")).select("t.*").where("bucket IS NOT NULL AND object_key IS NOT NULL")


def publish(triggers: DataFrame, path: str) -> None:
    """Triggers as JSON payloads, one a line."""
    triggers.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def run_available(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Work off what is there in micro-batches and stop. A batch that is replayed after a failure must be handled the same: use keyed upserts."""
    ship(stream.sparkSession)
    q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def upsert_handler(table: KeyedTable, objects: DataFrame, build: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Per micro-batch: the latest trigger per object, its rows built and upserted under the batch's number; triggers without an object are dropped."""

    def handle(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("bucket", "object_key").agg(F.max("seq").alias("seq"))
        table.upsert(build(last.join(objects, ["bucket", "object_key"])), number)

    return handle
