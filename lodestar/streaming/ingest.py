"""Structured Streaming forms (an extension): documents and review decisions arrive as files.

Both sinks are ``foreachBatch`` writers that are idempotent by batch: a batch that runs again after a failure or a
restart replaces its own output. Documents are replaced by key; the review state of batch n is computed from that of
batch n - 1, which is looked up on disk and kept until batch n + 1 is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import classify as cl
from lodestar.operators import review
from lodestar.runtime import complete_tables, delete_path
from lodestar.sources.chunkers import chunk
from lodestar.sources.store import Store


def ingest_documents(spark: SparkSession, source: str, schema, out: str, checkpoint: str) -> None:
    """New documents (project_id, doc_id, source_type, text) become classified chunks, replaced by (project_id, doc_id).

    A document that comes twice in a batch counts once, in its last version by source type and text.
    """
    folder, table = out.rstrip("/").rsplit("/", 1)

    def write(batch: DataFrame, _: int) -> None:
        docs = batch.groupBy("project_id", "doc_id").agg(F.max(F.struct("source_type", "text")).alias("d")).select("project_id", "doc_id", "d.*")
        docs = docs.withColumn("key", F.to_json(F.struct("project_id", "doc_id")))
        rows = chunk(docs.select(F.col("key").alias("doc_id"), "source_type", "text")).withColumnRenamed("doc_id", "key").join(docs.select("key", "project_id", "doc_id"), "key").drop("key")
        rows = rows.withColumn("scope", cl.scope_flag(F.col("text"))["flag"]).withColumn("expected_empty", cl.expects_nothing(F.col("text"), F.col("location")))
        Store(spark, folder).replace_docs(rows, table, docs)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def fold_reviews(spark: SparkSession, source: str, schema, folder: str) -> DataFrame:
    """Fold a stream of events into the review state: last decision and number of decisions per requirement.

    The state is small next to the log (one row per requirement) and is merged with each batch by one aggregation.
    ``folder`` keeps states and offsets, so a later call goes on where the last one ended. Without any event so far the
    result is empty.
    """
    at = lambda number: f"{folder}/state-{number}"

    def write(batch: DataFrame, number: int) -> None:
        log = review.review_log(batch)
        new = log.groupBy("requirement_id").agg(F.max(F.struct("seq", "action")).alias("last"), F.count("*").alias("n"))
        if number > 0:
            old = spark.read.parquet(at(number - 1))
            new = new.unionByName(old).groupBy("requirement_id").agg(F.max("last").alias("last"), F.sum("n").alias("n"))
        new.write.mode("overwrite").parquet(at(number))
        if number > 1:
            delete_path(spark, at(number - 2))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()
    known = [int(n.removeprefix("state-")) for n in complete_tables(spark, folder, "state-")]
    if not known:
        return spark.createDataFrame([], "requirement_id string, status string, n long")
    return spark.read.parquet(at(max(known))).select("requirement_id", F.when(F.col("last.action") == "reject", "rejected").otherwise("approved").alias("status"), "n")


def windowed_decisions(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Decisions per event-time window; with a watermark when ``events`` is a stream."""
    log = review.review_log(events.withWatermark("ts", late) if events.isStreaming else events)
    return log.groupBy(F.window("ts", width).alias("w"), "action").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "action", "n")
