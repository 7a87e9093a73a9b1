"""Queries of pipeline state: status, retries, index plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import state
from registry import query
from foliant.streaming import jobs

C = F.col


@query(
    "current_status",
    """SELECT material_id, count(*) AS events, arg_max(log_id, (created_at, log_id)) AS log_id, arg_max(stage, (created_at, log_id)) AS stage,
    arg_max(level, (created_at, log_id)) AS level, max(created_at) AS created_at FROM {audit_logs} WHERE material_id IS NOT NULL GROUP BY material_id""",
)
def current_status(t):
    return state.current_status(t.audit_logs)


_TRANSIENT = r"(?i)(^|[^\w-])(429|502|503|504)($|[^\w-])|too many requests|service unavailable|resource[_ ]exhausted|rate.?limit|temporarily unavailable|overloaded"


@query(
    "retry_plan",
    f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY failed_at, event_id) AS attempt, regexp_matches(detail, '{_TRANSIENT}') AS transient FROM {{failures}}),
    w AS (SELECT *, transient AND attempt < 6 AS again, CASE WHEN transient AND attempt < 6 THEN least(20.0 * pow(2, attempt - 1), 300.0) END AS wait FROM a)
    SELECT event_id, material_id, attempt, transient, CASE WHEN again THEN 'retry' ELSE 'give_up' END AS action, CAST(wait AS DOUBLE) AS wait_seconds,
    failed_at + to_seconds(CAST(wait AS DOUBLE)) AS next_attempt_at, CASE WHEN again THEN 'uploading' ELSE 'md_ready' END AS next_status FROM w""",
)
def retry_plan(t):
    return state.retry_plan(t.failures).select(
        "event_id", "material_id", "attempt", "transient", "action", "wait_seconds",
        "next_attempt_at", "next_status",
    )


@query(
    "retry_plan_by_run",
    f"""WITH g AS (SELECT *, failed_at - lag(failed_at) OVER (PARTITION BY material_id ORDER BY failed_at, event_id) <= INTERVAL 48 HOUR AS same FROM {{failures}}),
    s AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY material_id ORDER BY failed_at, event_id) AS run FROM g),
    a AS (SELECT *, min(failed_at) OVER (PARTITION BY material_id, run) AS run_started_at, row_number() OVER (PARTITION BY material_id, run ORDER BY failed_at, event_id) AS attempt, regexp_matches(detail, '{_TRANSIENT}') AS transient FROM s),
    w AS (SELECT *, transient AND attempt < 6 AS again, CASE WHEN transient AND attempt < 6 THEN least(20.0 * pow(2, attempt - 1), 300.0) END AS wait FROM a)
    SELECT event_id, material_id, run_started_at, attempt, transient, CASE WHEN again THEN 'retry' ELSE 'give_up' END AS action, CAST(wait AS DOUBLE) AS wait_seconds,
    failed_at + to_seconds(CAST(wait AS DOUBLE)) AS next_attempt_at, CASE WHEN again THEN 'uploading' ELSE 'md_ready' END AS next_status FROM w""",
)
def retry_plan_by_run(t):
    """Attempts start anew after two days without a failure."""
    return state.retry_plan(t.failures, run=48 * 3600).select(
        "event_id", "material_id", "run_started_at", "attempt", "transient", "action", "wait_seconds",
        "next_attempt_at", "next_status",
    )


_MODULE_AGENTS = """
WITH mods AS (SELECT module_id, code, name, kb_id, is_active, CASE WHEN module_id = 3 THEN 'agent-3' ELSE agent_id END AS agent_id FROM {modules})"""


@query(
    "sync_plan",
    _MODULE_AGENTS + """,
    kb AS (SELECT 'kb' AS object, coalesce(m.kb_id, k.kb_id) AS id, m.code AS module_code, coalesce(k.name, m.code || ' - ' || m.name) AS name,
      CASE WHEN m.code IS NULL THEN 'delete' WHEN k.kb_id IS NULL THEN 'create' ELSE 'keep' END AS action FROM mods m FULL JOIN {kbs} k ON m.kb_id = k.kb_id),
    wanted AS (SELECT coalesce(agent_id, 'agent-' || code) AS id, * FROM mods),
    ag AS (SELECT 'agent' AS object, coalesce(m.id, a.agent_id) AS id, m.code AS module_code, coalesce(a.name, m.name) AS name,
      CASE WHEN m.code IS NULL THEN 'delete' WHEN a.agent_id IS NULL THEN 'create'
           WHEN m.kb_id IS DISTINCT FROM a.kb_id OR m.is_active <> a.is_active THEN 'update' ELSE 'keep' END AS action
      FROM wanted m FULL JOIN (SELECT * FROM {agents} WHERE agent_id <> 'agent-4') a ON m.id = a.agent_id)
    SELECT * FROM kb UNION ALL SELECT * FROM ag""",
)
def sync_plan(t):
    modules = t.modules.withColumn(
        "agent_id", F.when(C("module_id") == 3, "agent-3").otherwise(C("agent_id"))
    )
    return state.sync_plan(modules, t.kbs, t.agents, master_agent="agent-4")


@query(
    "master_knowledge",
    """SELECT m.order_index, m.code AS module_code, m.kb_id, k.name FROM {modules} m JOIN {kbs} k ON k.kb_id = m.kb_id WHERE m.is_active AND m.kb_id <> ''""",
)
def master_knowledge(t):
    return state.master_knowledge(t.modules, t.kbs)


@query(
    "master_action",
    """SELECT 'agent-master' AS agent_id, count(*) AS bases, CASE WHEN (SELECT count(*) FROM {agents} WHERE agent_id = 'agent-master') > 0 THEN 'update'
    WHEN count(*) > 0 THEN 'create' ELSE 'none' END AS action FROM {modules} m JOIN {kbs} k ON k.kb_id = m.kb_id WHERE m.is_active""",
)
def master_action(t):
    knowledge = state.master_knowledge(t.modules, t.kbs)
    return state.master_action(knowledge, t.agents, "agent-master")


@query(
    "attachable",
    """WITH k AS (SELECT kb_id AS id, count(*) AS modules FROM {modules} WHERE kb_id <> '' GROUP BY 1), a AS (SELECT agent_id AS id, count(*) AS modules FROM {modules} WHERE agent_id <> '' GROUP BY 1)
    SELECT 'kb' AS object, coalesce(b.kb_id, k.id) AS id, b.name, coalesce(k.modules, 0) AS modules, b.name IS NULL AS missing FROM {kbs} b FULL JOIN k ON k.id = b.kb_id
    UNION ALL SELECT 'agent', coalesce(g.agent_id, a.id), g.name, coalesce(a.modules, 0), g.name IS NULL FROM (SELECT agent_id, name FROM {agents} WHERE agent_id <> 'agent-4') g FULL JOIN a ON a.id = g.agent_id""",
)
def attachable(t):
    kbs = state.attachable(t.kbs, t.modules, "kb_id")
    agents = state.attachable(t.agents, t.modules, "agent_id", master="agent-4")
    return kbs.withColumn("object", F.lit("kb")).unionByName(
        agents.withColumn("object", F.lit("agent"))
    )


@query(
    "error_rate_hourly",
    "SELECT date_trunc('hour', created_at) AS window_start, level, count(*) AS n FROM {audit_logs} GROUP BY ALL",
)
def error_rate_hourly(t):
    """The streaming query's plan run over a table; UTC times, so the session zone is undone."""
    rows = t.audit_logs.select("level", C("created_at").cast("timestamp").alias("created_at"))
    return jobs.error_rate(rows).select(
        C("window_start").cast("timestamp_ntz").alias("window_start"), "level", "n"
    )
