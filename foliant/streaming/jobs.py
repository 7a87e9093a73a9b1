"""Continuous ingest, duplicate removal, current status and error rates."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.plans import text_corpus
from foliant.sources import versions
from foliant.sources.files import MAX_BYTES, describe_files, text_files
from foliant.sources.tables import spread

FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def file_stream(
    spark: SparkSession, path: str, max_files: int = 1000, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """Text files of an allowed size as they arrive; the checkpoint remembers which were taken.

    The size is tested before a file is opened. What is not taken, ``read_text_corpus`` lists.
    """
    reader = text_files(spark.readStream.schema(FILE_SCHEMA).option("maxFilesPerTrigger", max_files))
    return describe_files(reader.load(path).where(F.col("length") <= max_bytes), max_bytes)


def job_of(spark: SparkSession, checkpoint: str) -> str:
    """The name of the job that a checkpoint belongs to; a lost checkpoint makes a new one."""
    place = f"{checkpoint}/job"
    spark.createDataFrame([(uuid.uuid4().hex,)], "job STRING").coalesce(1).write.mode("ignore").parquet(place)
    return spark.read.schema("job STRING").parquet(place).first().job


def ingest(
    documents: DataFrame, sink: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame]
) -> StreamingQuery:
    """Ground every new document once, as commits of the versions' store at ``sink``.

    ``prepare`` adds the metadata columns that ``text_corpus.ground`` needs. A batch that is
    repeated after a failure is one commit, and a document that arrives again gets a newer
    version, so the result does not depend on how often a batch runs.
    """
    job = job_of(documents.sparkSession, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        versions.commit(text_corpus.ground(spread(prepare(batch))), sink, job, batch_id)

    return (
        documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def drop_duplicates(
    materials: DataFrame, within: str | None = None, event_time: str = "created_at"
) -> DataFrame:
    """First arrival of every (topic, content). ``within`` bounds the state by event time.

    Materials without a hash are not known to be equal: each of them passes.
    """
    alone = F.when(F.col("file_hash").isNull(), F.col("material_id").cast("string"))
    marked = materials.withColumn("_alone", alone)
    key = ["topic_id", "file_hash", "_alone"]
    if within is None:
        return marked.dropDuplicates(key).drop("_alone")
    timed = marked.withWatermark(event_time, within)
    return timed.dropDuplicatesWithinWatermark(key).drop("_alone")


def accept_new(
    materials: DataFrame, catalog: DataFrame, within: str, event_time: str = "created_at"
) -> DataFrame:
    """Arrivals whose content their topic neither has in the stored ``catalog`` nor saw ``within`` that time.

    ``catalog`` counts as it is when the stream starts; ``within`` covers what is accepted from then on until
    the stream is started again, and bounds the state. Materials without a hash or a topic are not
    known to be equal: they pass.
    """
    known = catalog.where("file_hash IS NOT NULL").select("topic_id", "file_hash").distinct()
    fresh = materials.join(known, ["topic_id", "file_hash"], "left_anti")
    return drop_duplicates(fresh, within, event_time)


def status_stream(audit: DataFrame) -> DataFrame:
    """Latest event per material, in update mode; the state is one row per material."""
    latest = F.max_by(F.struct("log_id", "stage", "level"), F.struct("created_at", "log_id"))
    return audit.groupBy("material_id").agg(
        F.count(F.lit(1)).alias("events"), latest.alias("last")
    ).select("material_id", "events", "last.*")


def error_rate(audit: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events per level and window; batch and streaming alike."""
    return (
        audit.withWatermark("created_at", late)
        .groupBy(F.window("created_at", window).alias("_w"), "level")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("_w.start").alias("window_start"), "level", "n")
    )


def to_parquet(df: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    return (
        df.writeStream.format("parquet").outputMode("append")
        .option("path", sink).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def upsert_batches(df: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Update-mode results as versions by batch; the newest version of a key is its value."""

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(sink)
        )

    return (
        df.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
