"""Streaming jobs run to the end of the given tables; their results equal the batch ones."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from foliant.operators import state
from foliant.session import shared_dir
from foliant.sources import versions
from foliant.sources.fixtures import Tables, shape_sql
from foliant.streaming import jobs, materials
from registry import ORACLES, query

C = F.col


def stream_of(t: Tables, table: str):
    """A driver table as a stream of its files."""
    schema = getattr(t, table).schema
    return t.spark.readStream.schema(schema).parquet(f"{t.folder}/{table}.parque[t]")


def streamed_shape(t: Tables, shape: str, table: str):
    """A shape with one of its tables replaced by its stream."""
    sql = shape_sql(shape)
    others = {
        name: getattr(t, name) for name in ("customer", "orders", "events") if "{" + name + "}" in sql
    }
    return t.spark.sql(sql, **{**others, table: stream_of(t, table)})


def run_folder(t: Tables) -> tuple[str, str]:
    base = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    return f"{base}/data", f"{base}/checkpoint"


@query("ingest_stream")
def ingest_stream(t):
    """Documents grounded as they arrive; the newest version of each is the result."""
    sink, checkpoint = run_folder(t)

    def prepare(batch):
        return batch.select(
            C("doc_id").alias("material_id"),
            F.concat(F.lit("module-0"), (F.length("source") % 5).cast("string")).alias("module_code"),
            F.concat(F.lit('Module "'), "lang", F.lit('"')).alias("module_name"),
            F.concat(F.lit("topic "), "source").alias("topic_code"),
            F.concat(F.lit("Topic "), "source").alias("topic_name"),
            F.lit("literature").alias("type"),
            F.concat(F.lit("Kitob | "), C("doc_id").cast("string"), F.lit("].TXT")).alias("original_filename"),
            F.replace(C("text"), F.lit(". "), F.lit(".\n\n\n")).alias("text"),
        )

    scripted = t.spark.sql(shape_sql("script_text"), documents=stream_of(t, "documents"))
    jobs.ingest(scripted, sink, checkpoint, prepare).awaitTermination()
    return versions.read_newest(t.spark, sink).drop("commit", "version", "part")


@query("dedup_stream", "SELECT DISTINCT topic_id, file_hash FROM {materials}")
def dedup_stream(t):
    """Which copy comes first depends on arrival, so the kept contents are the result."""
    sink, checkpoint = run_folder(t)
    kept = jobs.drop_duplicates(streamed_shape(t, "materials", "orders"))
    jobs.to_parquet(kept.select("topic_id", "file_hash"), sink, checkpoint).awaitTermination()
    return t.spark.read.parquet(sink)


@query("dedup_stream_within", "SELECT DISTINCT topic_id, file_hash FROM {materials}")
def dedup_stream_within(t):
    """The form with bounded state, with a span that covers the table."""
    sink, checkpoint = run_folder(t)
    rows = streamed_shape(t, "materials", "orders").withColumn(
        "created_at", C("created_at").cast("timestamp")
    )
    kept = jobs.drop_duplicates(rows, within="4000 days")
    jobs.to_parquet(kept.select("topic_id", "file_hash"), sink, checkpoint).awaitTermination()
    return t.spark.read.parquet(sink)


@query(
    "error_rate_stream",
    "SELECT date_trunc('hour', created_at) AS window_start, level, count(*) AS n FROM {audit_logs} GROUP BY ALL",
)
def error_rate_stream(t):
    sink, checkpoint = run_folder(t)
    audit = streamed_shape(t, "audit_logs", "events").select(
        "level", C("created_at").cast("timestamp").alias("created_at")
    )
    jobs.upsert_batches(jobs.error_rate(audit), sink, checkpoint).awaitTermination()
    newest = t.spark.read.parquet(sink).groupBy("window_start", "level").agg(
        F.max_by("n", "batch").alias("n")
    )
    return newest.withColumn("window_start", C("window_start").cast("timestamp_ntz"))


@query(
    "status_stream",
    """SELECT material_id, count(*) AS events, arg_max(log_id, (created_at, log_id)) AS log_id, arg_max(stage, (created_at, log_id)) AS stage,
    arg_max(level, (created_at, log_id)) AS level FROM {audit_logs} WHERE material_id IS NOT NULL GROUP BY material_id""",
)
def status_stream(t):
    sink, checkpoint = run_folder(t)
    audit = streamed_shape(t, "audit_logs", "events").where(C("material_id").isNotNull())
    jobs.upsert_batches(jobs.status_stream(audit), sink, checkpoint).awaitTermination()
    rows = t.spark.read.parquet(sink)
    newest = rows.groupBy("material_id").agg(
        F.max_by(F.struct("events", "log_id", "stage", "level"), "batch").alias("_row")
    )
    return newest.select("material_id", "_row.*")


@query(
    "accept_new_stream",
    """SELECT DISTINCT topic_id, file_hash FROM {materials} m WHERE created_at >= TIMESTAMP '1996-01-01' AND NOT EXISTS (
    SELECT 1 FROM {materials} s WHERE s.created_at < TIMESTAMP '1996-01-01' AND s.topic_id = m.topic_id AND s.file_hash = m.file_hash)""",
)
def accept_new_stream(t):
    """Later materials whose content the catalog of the earlier ones does not have, once each."""
    sink, checkpoint = run_folder(t)
    start = F.lit("1996-01-01").cast("timestamp")
    arriving = streamed_shape(t, "materials", "orders").withColumn("created_at", C("created_at").cast("timestamp"))
    catalog = t.materials.where(C("created_at").cast("timestamp") < start)
    kept = jobs.accept_new(arriving.where(C("created_at") >= start), catalog, within="30 days")
    jobs.to_parquet(kept.select("topic_id", "file_hash"), sink, checkpoint).awaitTermination()
    return t.spark.read.parquet(sink)


_UNFINISHED = ["click", "signup"]
_STATES = """SELECT material_id, count(*) AS events, count(*) FILTER (WHERE level = 'error') AS failures,
    arg_max(log_id, (created_at, log_id)) AS log_id, arg_max(stage, (created_at, log_id)) AS stage, arg_max(level, (created_at, log_id)) AS level,
    max(created_at) AS created_at, arg_max(stage, (created_at, log_id)) IN ('click', 'signup')
      AND max(created_at) + INTERVAL 24 HOUR <= (SELECT max(created_at) - INTERVAL 1 HOUR FROM {audit_logs} WHERE material_id IS NOT NULL) AS interrupted
    FROM {audit_logs} WHERE material_id IS NOT NULL GROUP BY material_id"""


@query("material_states_stream", _STATES)
def material_states_stream(t):
    """State per material with a timer for stuck runs, run to the end of the events."""
    sink, checkpoint = run_folder(t)
    audit = streamed_shape(t, "audit_logs", "events").withColumn("created_at", C("created_at").cast("timestamp"))
    restore = materials.configured(t.spark)
    try:
        states = materials.material_states(audit, _UNFINISHED, datetime.timedelta(hours=24))
        jobs.upsert_batches(states, sink, checkpoint).awaitTermination()
    finally:
        restore()
    return materials.newest_states(t.spark.read.parquet(sink))


@query("material_states", _STATES)
def material_states(t):
    """The same over the whole table at once."""
    audit = t.audit_logs
    end = audit.where(C("material_id").isNotNull()).agg(F.max("created_at") - F.expr("INTERVAL 1 HOUR")).scalar()
    return state.status_at(audit, _UNFINISHED, end, F.expr("INTERVAL 24 HOURS"))


_SESSIONS = """WITH g AS (SELECT *, failed_at - lag(failed_at) OVER (PARTITION BY material_id ORDER BY failed_at, event_id) <= INTERVAL 48 HOUR AS same FROM {failures}),
    s AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY material_id ORDER BY failed_at, event_id) AS run FROM g)
    SELECT material_id, min(failed_at) AS first_failed_at, max(failed_at) AS last_failed_at, count(*) AS attempts,
      count(*) FILTER (WHERE event_id % 4 < 2) AS transient_failures FROM s GROUP BY material_id, run"""


@query("failure_sessions", _SESSIONS)
def failure_sessions(t):
    return state.failure_sessions(t.failures, "48 hours")


@query(
    "failure_sessions_stream",
    _SESSIONS + " HAVING max(failed_at) + INTERVAL 48 HOUR <= (SELECT max(failed_at) - INTERVAL 1 HOUR FROM {failures})",
)
def failure_sessions_stream(t):
    """Runs of failures that are over, as the stream closes them."""
    sink, checkpoint = run_folder(t)
    failures = streamed_shape(t, "failures", "events").withColumn("failed_at", C("failed_at").cast("timestamp"))
    closed = state.failure_sessions(failures.withWatermark("failed_at", "1 hour"), "48 hours")
    jobs.to_parquet(closed, sink, checkpoint).awaitTermination()
    times = {c: C(c).cast("timestamp_ntz") for c in ("first_failed_at", "last_failed_at")}
    return t.spark.read.parquet(sink).withColumns(times)


ORACLES["ingest_stream"] = ORACLES["grounded_markdown"]
