"""State as data: current status, retries, and the plan that brings the index in step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.names import agent_slug, kb_name
from foliant.operators.ordering import minute_of, number_rows
from foliant.operators.rows import each

RETRY_ATTEMPTS = 6
RETRY_BASE_SECONDS = 20.0
RETRY_CAP_SECONDS = 300.0
# Longer than all waits of a run together.
RUN_GAP = "1 hour"

# Refusals worth another attempt.
TRANSIENT_STATUS = [429, 502, 503, 504]
TRANSIENT = (
    r"(?i)(?<![\w-])(?:429|502|503|504)(?![\w-])|too many requests|service unavailable"
    r"|resource[_ ]exhausted|rate.?limit|temporarily unavailable|overloaded"
)


def current_status(audit: DataFrame) -> DataFrame:
    """Latest audit event per material: one partial aggregate, no sort."""
    latest = F.max_by(
        F.struct("log_id", "stage", "level", "created_at"), F.struct("created_at", "log_id")
    )
    return (
        audit.where(F.col("material_id").isNotNull())
        .groupBy("material_id").agg(latest.alias("_last"), F.count(F.lit(1)).alias("events"))
        .select("material_id", "events", "_last.*")
    )


def status_at(audit: DataFrame, unfinished: list[str], at: Column, stuck: Column) -> DataFrame:
    """``current_status`` with the number of failures, and whether the run is stuck at time ``at``.

    It is, when its latest event is an ``unfinished`` stage that began ``stuck`` (an interval) before.
    """
    latest = F.max_by(
        F.struct("log_id", "stage", "level", "created_at"), F.struct("created_at", "log_id")
    )
    return (
        audit.where(F.col("material_id").isNotNull()).groupBy("material_id").agg(
            F.count(F.lit(1)).alias("events"), F.count_if(F.col("level") == "error").alias("failures"),
            latest.alias("_last"),
        )
        .select("material_id", "events", "failures", "_last.*")
        .withColumn("interrupted", F.col("stage").isin(unfinished) & (F.col("created_at") + stuck <= at))
    )


def failure_sessions(failures: DataFrame, gap: str = RUN_GAP) -> DataFrame:
    """Failures of a material with no more than ``gap`` between them are one run's; batch and stream alike.

    ``attempts`` counts them; a stream has a row once the watermark has passed the run's end.
    """
    return failures.groupBy("material_id", F.session_window("failed_at", gap).alias("_w")).agg(
        F.count(F.lit(1)).alias("attempts"), F.max("failed_at").alias("last_failed_at"),
        F.count_if(is_transient(failures)).alias("transient_failures"),
    ).select(
        "material_id", F.col("_w.start").alias("first_failed_at"), "last_failed_at", "attempts", "transient_failures"
    )


def with_run(failures: DataFrame, gap_seconds: int) -> DataFrame:
    """Add ``run_started_at``, the first failure of the run that each failure belongs to.

    A run covers slots of ``gap_seconds``, and no more of them than it has failures and one; two runs share
    a slot at most. So runs are joined by material and slot, and no key holds all of a material.
    """
    micros = gap_seconds * 1_000_000

    def slot(name: str) -> Column:
        kind = dict(failures.dtypes)["failed_at"]
        epoch = (
            F.unix_micros(F.col(name)) if kind == "timestamp"
            else F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {name})")
        )
        return F.floor(epoch / micros).cast("long")

    runs = failure_sessions(failures, f"{gap_seconds} seconds").select(
        F.col("material_id").alias("_material"), F.col("first_failed_at").alias("run_started_at"), "last_failed_at",
        F.explode(F.sequence(slot("first_failed_at"), slot("last_failed_at"))).alias("_slot"),
    )
    rows = failures.withColumn("_own_slot", slot("failed_at"))
    same = (
        F.col("material_id").eqNullSafe(F.col("_material")) & (F.col("_own_slot") == F.col("_slot"))
        & F.col("failed_at").between(F.col("run_started_at"), F.col("last_failed_at"))
    )
    return rows.join(runs, same).drop("_material", "_slot", "_own_slot", "last_failed_at")


def is_transient(failures: DataFrame) -> Column:
    """Transient by its ``detail`` or, where that column exists, by its HTTP ``status``."""
    transient = F.coalesce(F.col("detail").rlike(TRANSIENT), F.lit(False))
    if "status" in failures.columns:
        transient = transient | F.coalesce(F.col("status").isin(TRANSIENT_STATUS), F.lit(False))
    return transient


def retry_plan(
    failures: DataFrame,
    attempts: int = RETRY_ATTEMPTS,
    base: float = RETRY_BASE_SECONDS,
    cap: float = RETRY_CAP_SECONDS,
    run: str | int | None = None,
) -> DataFrame:
    """What follows each failure: wait and retry, or give up and stay ready for a later run.

    The wait doubles from ``base`` to ``cap``; the last attempt, like a permanent refusal, is
    not followed by one. Attempts are numbered anew in every run: ``run`` is the column that names
    it, or the seconds without a failure after which the next one is another run's (then
    ``run_started_at`` is added). Without it all failures of a material are one run's.
    """
    transient = is_transient(failures)
    keys = ["material_id"]
    if isinstance(run, int):
        failures, keys = with_run(failures, run), [*keys, "run_started_at"]
    elif run is not None:
        keys = [*keys, run]
    numbered = number_rows(
        failures, keys, [F.col("failed_at"), F.col("event_id")],
        minute_of("failed_at"), "attempt",
    )
    retry = F.col("transient") & (F.col("attempt") < attempts)
    # Beyond 60 doublings the cap has long been reached, and the power stays finite.
    doubling = F.pow(F.lit(2.0), F.least(F.col("attempt"), F.lit(60)) - 1)
    wait = F.least(F.lit(float(base)) * doubling, F.lit(float(cap)))
    return (
        numbered.withColumn("transient", transient)
        .withColumn("action", F.when(retry, "retry").otherwise("give_up"))
        .withColumn("wait_seconds", F.when(retry, wait))
        .withColumn(
            "next_attempt_at",
            F.when(
                retry,
                F.col("failed_at") + F.make_dt_interval(secs=F.col("wait_seconds").cast("decimal(18,6)")),
            ),
        )
        .withColumn("next_status", F.when(retry, "uploading").otherwise("md_ready"))
    )


def sync_plan(
    modules: DataFrame, kbs: DataFrame, agents: DataFrame, master_agent: str, prefix: str = "agent-"
) -> DataFrame:
    """``(object, id, module_code, name, action)``: how the index gets in step with the catalog.

    A module without a knowledge base or agent, or whose stored one is gone, has it created. An
    existing agent is updated when it reads another knowledge base or differs in being active;
    names and settings of existing objects are left alone. What no module owns is deleted, but
    never the master agent.
    """

    def diff(kind: str, wanted: DataFrame, actual: DataFrame, changed) -> DataFrame:
        action = (
            F.when(F.col("module_code").isNull(), "delete")
            .when(F.col("exists").isNull(), "create")
            .when(changed, "update")
            .otherwise("keep")
        )
        return wanted.join(actual, "id", "full_outer").select(
            F.lit(kind).alias("object"), "id", "module_code",
            F.coalesce("actual_name", "wanted_name").alias("name"), action.alias("action"),
        )

    there = F.lit(True).alias("exists")
    code = F.col("code").alias("module_code")
    kb = diff(
        "kb",
        modules.select(
            F.nullif("kb_id", F.lit("")).alias("id"), code,
            kb_name(F.col("code"), F.col("name")).alias("wanted_name"),
        ),
        kbs.select(F.col("kb_id").alias("id"), F.col("name").alias("actual_name"), there),
        F.lit(False),
    )
    default = agent_slug(F.col("code"), F.col("module_id"), prefix)
    agent = diff(
        "agent",
        modules.select(
            F.coalesce(F.nullif("agent_id", F.lit("")), default).alias("id"), code,
            F.col("name").alias("wanted_name"), F.nullif("kb_id", F.lit("")).alias("wanted_kb"),
            F.col("is_active").alias("wanted_active"),
        ),
        agents.where(F.col("agent_id") != master_agent).select(
            F.col("agent_id").alias("id"), F.col("name").alias("actual_name"), there,
            F.col("kb_id").alias("actual_kb"), F.col("is_active").alias("actual_active"),
        ),
        ~F.col("wanted_kb").eqNullSafe(F.col("actual_kb"))
        | (F.col("wanted_active") != F.col("actual_active")),
    )
    return kb.unionByName(agent)


def master_knowledge(modules: DataFrame, kbs: DataFrame) -> DataFrame:
    """Knowledge of the master agent: existing bases of active modules, as ordered rows."""
    named = modules.where("is_active AND kb_id <> ''").select(
        "order_index", F.col("code").alias("module_code"), "kb_id"
    )
    return named.join(kbs.select("kb_id", "name"), "kb_id").select(
        "order_index", "module_code", "kb_id", "name"
    )


def master_action(knowledge: DataFrame, agents: DataFrame, master_agent: str) -> DataFrame:
    """One row: ``none`` while there is nothing to search and no agent, else create or update."""
    bases = knowledge.agg(F.count(F.lit(1)).alias("bases"))
    exists = agents.agg(F.count_if(F.col("agent_id") == master_agent)).scalar() > 0
    return bases.select(
        F.lit(master_agent).alias("agent_id"), "bases",
        F.when(exists, "update").when(F.col("bases") > 0, "create").otherwise("none").alias("action"),
    )


def attachable(existing: DataFrame, modules: DataFrame, column: str, master: str | None = None):
    """Objects a module can be attached to; a stored id that no longer exists is flagged."""
    offered = existing.select(F.col(column), "name")
    if master is not None:
        offered = offered.where(F.col(column) != master)
    attached = modules.where(F.col(column) != "").groupBy(column).agg(
        F.count(F.lit(1)).alias("modules")
    )
    return offered.join(attached, column, "full_outer").select(
        F.col(column).alias("id"), "name",
        F.coalesce("modules", F.lit(0)).cast("long").alias("modules"),
        F.col("name").isNull().alias("missing"),
    )


# Messages of a run.
RUN_STARTED = "Hujjatni o'qish boshlandi: \"%s\""
RUN_READ = "OCR tugadi: %d ta sahifa, o'rtacha ishonch %s, tillar: %s"
RUN_DONE = "Markdown tayyor: %d ta chunk, %d ta grounding marker, %s belgi, yozuv: %s"
RUN_FAILED = "Pipeline xatosi: %s"


def _finished(script: str) -> Column:
    return F.format_string(RUN_DONE, "chunk_count", "marker_count", F.format_number("char_count", 0), script)


def run_audit(grounded: DataFrame, at) -> DataFrame:
    """Audit rows of a finished run: one per material, counts or the reason it failed."""
    done = F.col("status") == "md_ready"
    return grounded.select(
        "material_id",
        F.when(done, "conversion").otherwise("pipeline").alias("stage"),
        F.when(done, "info").otherwise("error").alias("level"),
        F.when(done, _finished("script")).otherwise(F.format_string(RUN_FAILED, "error_message")).alias("message"),
        at.alias("created_at"),
    )


def run_trail(outcomes: DataFrame, meta: DataFrame, warnings: DataFrame, run: str, at: Column) -> DataFrame:
    """The whole audit trail of a run over books, for ``sources.tables.append_audit``.

    ``outcomes`` are those of ``plans.paged_books`` and ``warnings`` their page warnings. A book is begun; then
    either its recognition is summed up, its Markdown counted and each warning logged, or the
    reason of its failure is. Ids follow from run, book and place, and times from ``at`` and the stage of the
    run, so the same run gives the same rows. Books without metadata are begun under their id.
    """
    names = meta.select("doc_id", "original_filename").dropDuplicates(["doc_id"])
    rows = outcomes.join(names, "doc_id", "left")
    done = F.col("status") == "md_ready"

    def entry(place: int, stage: str, level: str, message: Column, when: Column) -> Column:
        return F.when(when, F.struct(
            F.lit(place).alias("place"), F.lit(0).alias("kind_no"), F.lit(0).alias("page_no"), F.lit(stage).alias("stage"),
            F.lit(level).alias("level"), message.alias("message")))

    share = F.coalesce(F.concat(F.bround("ocr_confidence", 0).cast("int").cast("string"), F.lit("%")), F.lit("—"))
    entries = F.array_compact(F.array(
        entry(0, "conversion", "info", F.format_string(RUN_STARTED, F.coalesce("original_filename", "doc_id")), F.lit(True)),
        entry(1, "ocr", "info", F.format_string(RUN_READ, "ocr_page_count", share, F.coalesce("ocr_languages", F.lit(""))),
              done & F.col("was_read")),
        entry(2, "conversion", "info", _finished("detected_script"), done),
        entry(4, "pipeline", "error", F.format_string(RUN_FAILED, "error_message"), ~done),
    ))
    steps = each(rows, ["doc_id"], entries, "_at", "_e").select("doc_id", "_e.*")
    warned = warnings.join(outcomes.where(done).select("doc_id"), "doc_id", "left_semi").select(
        "doc_id", F.lit(3).alias("place"), "kind_no", "page_no", F.lit("conversion").alias("stage"),
        F.lit("warn").alias("level"), "message",
    )
    place = F.concat_ws("/", F.lit(run), "doc_id", "place", "kind_no", "page_no")
    return steps.unionByName(warned).select(
        F.sha2(place, 256).alias("log_id"), F.col("doc_id").alias("material_id"), "stage", "level", "message",
        (at + F.make_dt_interval(secs=F.col("place"))).alias("created_at"),
    )
