"""Queries of the catalog: joins, lists, reports, integrity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.operators import catalog, integrity, reports
from foliant.schemas import STATUSES
from registry import duck, query

C = F.col
SEARCH = "doc 12"

_CONTEXT = """
WITH context AS (SELECT m.*, t.module_id, t.code AS topic_code, t.name AS topic_name, t.order_index AS topic_order,
  o.code AS module_code, o.name AS module_name, o.order_index AS module_order
  FROM {materials} m JOIN {topics} t USING (topic_id) JOIN {modules} o USING (module_id))"""


def context(t):
    return catalog.material_context(t.materials, t.topics, t.modules)


@query(
    "material_context",
    _CONTEXT + """ SELECT material_id, topic_id, original_filename, topic_code, topic_name, module_code, module_name, u.email AS uploaded_by_email
    FROM context LEFT JOIN {users} u ON u.user_id = uploaded_by""",
)
def material_context(t):
    return catalog.material_context(t.materials, t.topics, t.modules, t.users).select(
        "material_id", "topic_id", "original_filename", "topic_code", "topic_name", "module_code",
        "module_name", "uploaded_by_email",
    )


@query(
    "audit_context",
    """SELECT a.log_id, a.material_id, a.module_id, a.stage, a.level, m.original_filename AS material_filename, o.code AS module_code
    FROM {audit_logs} a LEFT JOIN {materials} m USING (material_id) LEFT JOIN {modules} o ON o.module_id = a.module_id""",
)
def audit_context(t):
    return catalog.audit_context(t.audit_logs, t.materials, t.modules).select(
        "log_id", "material_id", "module_id", "stage", "level", "material_filename", "module_code"
    )


@query(
    "module_document",
    """SELECT o.module_id, o.code, o.name, o.order_index, o.is_active, (SELECT count(*) FROM {topics} x WHERE x.module_id = o.module_id) AS topics_count,
    (SELECT count(*) FROM {materials} m JOIN {topics} x USING (topic_id) WHERE x.module_id = o.module_id) AS materials_count,
    t.topic_id, t.code AS topic_code, t.name AS topic_name, t.order_index AS topic_order FROM {modules} o LEFT JOIN {topics} t USING (module_id)""",
)
def module_document(t):
    stats = reports.material_stats(t.materials, t.topics)
    return catalog.module_document(t.modules, t.topics, stats)


@query(
    "existing_kbs",
    "SELECT module_id, code, kb_id FROM {modules} WHERE kb_id IN (SELECT kb_id FROM {kbs})",
)
def existing_kbs(t):
    return catalog.existing_only(t.modules.select("module_id", "code", "kb_id"), t.kbs, "kb_id")


@query(
    "materials_without_audit",
    "SELECT material_id FROM {materials} m WHERE NOT EXISTS (SELECT 1 FROM {audit_logs} a WHERE a.material_id = m.material_id)",
)
def materials_without_audit(t):
    return catalog.not_in(t.materials.select("material_id"), t.audit_logs, ["material_id"])


@query(
    "cascade",
    """WITH gone_m AS (SELECT module_id FROM {modules} WHERE module_id IN (1, 3)), gone_t AS (SELECT topic_id FROM {topics} WHERE module_id IN (FROM gone_m)),
    gone_x AS (SELECT material_id FROM {materials} WHERE topic_id IN (FROM gone_t))
    SELECT 'modules' AS table_name, CAST(module_id AS VARCHAR) AS id FROM gone_m UNION ALL SELECT 'topics', CAST(topic_id AS VARCHAR) FROM gone_t
    UNION ALL SELECT 'materials', CAST(material_id AS VARCHAR) FROM gone_x
    UNION ALL SELECT 'audit_logs', CAST(log_id AS VARCHAR) FROM {audit_logs} WHERE module_id IN (FROM gone_m) OR material_id IN (FROM gone_x)""",
)
def cascade(t):
    doomed = t.modules.where(C("module_id").isin(1, 3))
    return catalog.cascade(doomed, t.topics, t.materials, t.audit_logs)


# -- reports ----------------------------------------------------------------------------------

_BY_STATUS = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in STATUSES)


@query("material_stats", _CONTEXT + f" SELECT module_id, count(*) AS total, {_BY_STATUS} FROM context GROUP BY 1")
def material_stats(t):
    return reports.material_stats(t.materials, t.topics)


@query(
    "topic_counts",
    "SELECT t.topic_id, t.code, count(DISTINCT m.material_id) AS materials_count FROM {topics} t LEFT JOIN {materials} m USING (topic_id) GROUP BY ALL",
)
def topic_counts(t):
    return reports.topic_material_counts(t.topics, t.materials).select(
        "topic_id", "code", "materials_count"
    )


@query(
    "module_counts",
    """SELECT o.module_id, o.code, count(DISTINCT t.topic_id) AS num_topics, count(DISTINCT m.material_id) AS num_materials
    FROM {modules} o LEFT JOIN {topics} t USING (module_id) LEFT JOIN {materials} m USING (topic_id) GROUP BY ALL""",
)
def module_counts(t):
    return reports.module_counts(t.modules, t.topics, t.materials).select(
        "module_id", "code", "num_topics", "num_materials"
    )


_DAY = "CAST(timezone('Asia/Tashkent', timezone('UTC', created_at)) AS DATE)"


@query(
    "daily_uploads",
    f"""WITH per AS (SELECT {_DAY} AS day, count(*) AS n FROM {{materials}} GROUP BY 1), last AS (SELECT max(day) AS day FROM per),
    spine AS (SELECT CAST(unnest(generate_series(day - INTERVAL 13 DAY, CAST(day AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM last)
    SELECT s.day, strftime(s.day, '%d.%m') AS label, coalesce(p.n, 0) AS uploads FROM spine s LEFT JOIN per p USING (day)""",
)
def daily_uploads(t):
    return reports.daily_uploads(t.materials, reports.latest_day(t.materials))


@query(
    "kpis",
    """SELECT (SELECT count(*) FROM {modules}) AS modules, (SELECT count(*) FROM {modules} WHERE is_active) AS active_modules,
    (SELECT count(*) FROM {topics}) AS topics, count(*) AS materials, count(*) FILTER (WHERE status IN ('queued', 'converting', 'uploading')) AS in_progress,
    count(*) FILTER (WHERE status = 'indexed') AS indexed, count(*) FILTER (WHERE status = 'failed') AS failed FROM {materials}""",
)
def kpis(t):
    return reports.kpis(t.modules, t.topics, t.materials)


_STATUS_LIST = "[" + ", ".join(f"'{s}'" for s in STATUSES) + "]"


@query(
    "status_breakdown",
    f"""SELECT CAST(list_position({_STATUS_LIST}, status) AS INTEGER) AS position, status, count(*) AS count,
    {duck.percent('count(*)', 'sum(count(*)) OVER ()')} AS percent FROM {{materials}} GROUP BY status""",
)
def status_breakdown(t):
    return reports.status_breakdown(t.materials)


@query(
    "module_progress",
    _CONTEXT + f""", shown AS (SELECT * FROM {{modules}} ORDER BY order_index, code, module_id LIMIT 8)
    SELECT s.module_id, s.code, s.name, s.order_index, count(c.material_id) AS total, count(*) FILTER (WHERE status = 'indexed') AS indexed,
    count(*) FILTER (WHERE status = 'failed') AS failed, {duck.percent("count(*) FILTER (WHERE status = 'indexed')", 'count(c.material_id)')} AS percent
    FROM shown s LEFT JOIN context c USING (module_id) GROUP BY ALL""",
)
def module_progress(t):
    return reports.module_progress(t.modules, t.topics, t.materials)


def _tree_sql(keep: str, needle: str) -> str:
    counts = (
        "count(material_id) AS total, count(*) FILTER (WHERE status = 'indexed') AS indexed, "
        "count(*) FILTER (WHERE status = 'failed') AS failed, "
        + duck.percent("count(*) FILTER (WHERE status = 'indexed')", "count(material_id)") + " AS percent"
    )
    none = "NULL AS topic_code, NULL AS material_filename, CAST(NULL AS BIGINT) AS material_id, NULL AS status"
    return f"""
WITH kept AS (SELECT * FROM {{modules}} o WHERE {keep}),
full_tree AS (SELECT o.order_index AS module_order, o.code AS module_code, t.topic_id, t.code AS topic_code, m.material_id, m.status, m.original_filename
  FROM kept o LEFT JOIN {{topics}} t USING (module_id) LEFT JOIN {{materials}} m USING (topic_id))
SELECT 0 AS level, module_order, module_code, {none}, {counts} FROM full_tree GROUP BY module_order, module_code
UNION ALL BY NAME SELECT 1 AS level, module_order, module_code, topic_code, {counts} FROM full_tree WHERE topic_id IS NOT NULL GROUP BY module_order, module_code, topic_code
UNION ALL BY NAME SELECT 2 AS level, module_order, module_code, topic_code, original_filename AS material_filename, material_id, status
  FROM full_tree WHERE material_id IS NOT NULL AND contains(lower(original_filename), '{needle}')"""


@query("content_tree", _tree_sql("true", ""))
def content_tree(t):
    return reports.content_tree(t.modules, t.topics, t.materials)


_KEEP = f"""contains(lower(o.code), '{SEARCH}') OR contains(lower(o.name), '{SEARCH}') OR o.module_id IN
  (SELECT t.module_id FROM {{topics}} t LEFT JOIN {{materials}} m USING (topic_id) WHERE contains(lower(t.code), '{SEARCH}') OR contains(lower(t.name), '{SEARCH}')
   OR contains(lower(m.original_filename), '{SEARCH}'))"""


@query("tree_search", _tree_sql(_KEEP, SEARCH))
def tree_search(t):
    return reports.content_tree(t.modules, t.topics, t.materials, SEARCH)


@query(
    "tree_modules",
    "SELECT o.module_id, o.code FROM {modules} o WHERE "
    + _KEEP.replace(SEARCH, "nation_7"),
)
def tree_modules(t):
    """Modules a search keeps for a topic name."""
    return catalog.tree_search(t.modules, t.topics, t.materials, "Nation_7").select("module_id", "code")


def _facet_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS facet, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {source} GROUP BY 2"
        for c in columns
    )


@query(
    "audit_summary",
    "WITH a AS (SELECT l.*, o.code AS module_code FROM {audit_logs} l LEFT JOIN {modules} o USING (module_id)) "
    + _facet_sql("a", ["level", "stage", "module_code"]),
)
def audit_summary(t):
    codes = t.modules.select("module_id", C("code").alias("module_code"))
    return reports.audit_summary(t.audit_logs.join(codes, "module_id", "left"))


@query(
    "material_facets",
    _CONTEXT + _facet_sql("context", ["status", "type", "module_code", "detected_script", "extraction_method"]),
)
def material_facets(t):
    return reports.material_facets(context(t))


@query(
    "date_drilldown",
    f"""WITH d AS (SELECT {_DAY} AS day FROM {{materials}})
    SELECT CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month, CAST(dayofmonth(day) AS INTEGER) AS day, count(*) AS n FROM d GROUP BY 1, 2, 3
    UNION ALL SELECT CAST(year(day) AS INTEGER), CAST(month(day) AS INTEGER), NULL, count(*) FROM d GROUP BY 1, 2
    UNION ALL SELECT CAST(year(day) AS INTEGER), NULL, NULL, count(*) FROM d GROUP BY 1""",
)
def date_drilldown(t):
    return reports.date_drilldown(t.materials)


@query(
    "extraction_badges",
    "SELECT material_id, CASE WHEN extraction_method <> 'text' AND ocr_confidence < 60 THEN 'low' ELSE extraction_method END AS badge FROM {materials}",
)
def extraction_badges(t):
    badge = reports.extraction_badge(C("extraction_method"), C("ocr_confidence"))
    return t.materials.select("material_id", badge.alias("badge"))


# -- lists ------------------------------------------------------------------------------------


@query(
    "list_modules",
    "SELECT module_id, code, name FROM {modules} WHERE is_active AND (upper(code) LIKE '%AS%' OR upper(name) LIKE '%AS%' OR upper(description) LIKE '%AS%')",
)
def list_modules(t):
    return catalog.list_modules(t.modules, True, "as").select("module_id", "code", "name")


@query(
    "list_topics",
    "SELECT topic_id, code, name FROM {topics} WHERE module_id = 2 AND (upper(code) LIKE '%TION_1%' OR upper(name) LIKE '%TION_1%' OR upper(description) LIKE '%TION_1%')",
)
def list_topics(t):
    return catalog.list_topics(t.topics, 2, "tion_1").select("topic_id", "code", "name")


@query(
    "ordered_topics",
    """SELECT o.code AS module_code, t.code AS topic_code, row_number() OVER (ORDER BY o.order_index, o.code, o.module_id, t.order_index, t.topic_id) AS place,
    row_number() OVER (ORDER BY o.order_index, o.created_at, o.module_id, t.order_index, t.topic_id) AS api_place
    FROM {topics} t JOIN {modules} o USING (module_id)""",
)
def ordered_topics(t):
    """Topics in the order of the dashboard and of the lists, with their places."""
    rows = t.topics.select("topic_id", "module_id", C("code").alias("topic_code"), C("order_index").alias("topic_order")).join(
        t.modules.select("module_id", C("code"), C("order_index"), "created_at"), "module_id")
    place = {name: F.row_number().over(Window.orderBy(*order, C("topic_order"), C("topic_id"))).cast("long")
             for name, order in (("place", catalog.dashboard_order()), ("api_place", catalog.module_order()))}
    return rows.withColumns(place).select(C("code").alias("module_code"), "topic_code", "place", "api_place")


_LIST = """ WHERE module_id = 1 AND type = 'literature' AND upper(original_filename) LIKE '%DOC 1%'"""


@query(
    "list_materials",
    _CONTEXT + f"""SELECT material_id, original_filename, status, module_code, topic_code, created_at FROM context {_LIST}
    ORDER BY created_at DESC, material_id LIMIT 20 OFFSET 20""",
)
def list_materials(t):
    """Second page of a filtered list, newest first."""
    rows = catalog.list_materials(context(t), module_id=1, kind="literature", search="doc 1")
    page = catalog.paginate(rows, catalog.newest_first("material_id"), page=2)
    return page.select(
        "material_id", "original_filename", "status", "module_code", "topic_code", "created_at"
    )


@query(
    "materials_page_info",
    _CONTEXT + f"SELECT count(*) AS total, 2 AS page, 20 AS limit, CAST(ceil(count(*) / 20) AS INTEGER) AS total_pages FROM context {_LIST}".replace("AS limit", 'AS "limit"'),
)
def materials_page_info(t):
    rows = catalog.list_materials(context(t), module_id=1, kind="literature", search="doc 1")
    return catalog.page_info(rows, page=2)


@query(
    "keyset_page",
    """SELECT material_id, created_at FROM {materials} WHERE created_at < TIMESTAMP '1998-06-01' OR (created_at = TIMESTAMP '1998-06-01' AND material_id > 500)
    ORDER BY created_at DESC, material_id LIMIT 50""",
)
def keyset_page(t):
    import datetime

    after = (datetime.datetime(1998, 6, 1), 500)
    rows = t.materials.select("material_id", "created_at")
    return catalog.keyset_page(rows, "material_id", after, 50)


@query(
    "list_audit",
    """SELECT log_id, material_id, stage, level, message, created_at FROM {audit_logs} WHERE module_id = 3 AND level = 'error' AND upper(message) LIKE '%4%'
    ORDER BY created_at DESC, log_id LIMIT 100""",
)
def list_audit(t):
    rows = catalog.list_audit(t.audit_logs, module_id=3, level="error", search="4")
    page = catalog.paginate(rows, catalog.newest_first("log_id"), 1, 100)
    return page.select("log_id", "material_id", "stage", "level", "message", "created_at")


@query(
    "recent_errors",
    """SELECT e.log_id, e.created_at, m.original_filename AS material_filename, o.code AS module_code
    FROM (SELECT * FROM {audit_logs} WHERE level = 'error' ORDER BY created_at DESC, log_id LIMIT 6) e
    LEFT JOIN {materials} m USING (material_id) LEFT JOIN {modules} o ON o.module_id = e.module_id""",
)
def recent_errors(t):
    newest = catalog.recent_errors(t.audit_logs)
    return catalog.audit_context(newest, t.materials, t.modules).select(
        "log_id", "created_at", "material_filename", "module_code"
    )


@query(
    "status_feed",
    "SELECT material_id, status, original_filename FROM {materials} WHERE status = 'failed'",
)
def status_feed(t):
    failed = t.materials.where("status = 'failed'").select("material_id")
    return catalog.status_feed(t.materials, failed).select("material_id", "status", "original_filename")


_RUNNING = "(SELECT DISTINCT material_id FROM {audit_logs} WHERE level = 'warn' AND material_id IS NOT NULL)"


@query(
    "materials_to_run",
    _CONTEXT + f"""SELECT material_id, created_at, CASE WHEN material_id IN {_RUNNING} THEN 'skip' ELSE 'queue' END AS action
    FROM context WHERE module_id = 2 AND status IN ('md_ready', 'failed')""",
)
def materials_to_run(t):
    running = t.audit_logs.where("level = 'warn' AND material_id IS NOT NULL")
    return catalog.materials_to_run(context(t), running, 2, True).select(
        "material_id", "created_at", "action"
    )


@query(
    "interrupted",
    f"SELECT material_id, status FROM {{materials}} WHERE status IN ('queued', 'converting', 'uploading') AND material_id NOT IN {_RUNNING}",
)
def interrupted(t):
    running = t.audit_logs.where("level = 'warn'")
    return catalog.interrupted(t.materials, running).select("material_id", "status")


# -- integrity --------------------------------------------------------------------------------

_FIRST = """
WITH ranked AS (SELECT material_id, topic_id, file_hash, first_value(material_id) OVER (PARTITION BY topic_id, file_hash ORDER BY created_at, material_id) AS duplicate_of
  FROM {materials})"""


@query("duplicates", _FIRST + " SELECT material_id, topic_id, duplicate_of FROM ranked WHERE material_id <> duplicate_of")
def duplicates(t):
    return integrity.duplicates(t.materials).select("material_id", "topic_id", "duplicate_of")


@query("accepted_materials", _FIRST + " SELECT material_id, topic_id FROM ranked WHERE material_id = duplicate_of")
def accepted_materials(t):
    return integrity.accepted(t.materials).select("material_id", "topic_id")


_BAD = """
WITH mods AS (SELECT s_suppkey AS module_id, CASE WHEN s_suppkey % 9 = 0 THEN '-bad ' || CAST(s_suppkey AS VARCHAR) ELSE 'm' || CAST(s_suppkey % 70 AS VARCHAR) END AS code,
   CASE WHEN s_suppkey % 4 <> 0 THEN 'kb-' || CAST(s_suppkey % 60 AS VARCHAR) END AS kb_id,
   CASE WHEN s_suppkey % 50 = 1 THEN 'agent-master' WHEN s_suppkey % 3 = 0 THEN 'agent-' || CAST(s_suppkey AS VARCHAR) END AS agent_id FROM supplier),
tops AS (SELECT p_partkey AS topic_id, p_partkey % 7 AS module_id, CASE WHEN p_partkey % 500 = 0 THEN '' ELSE p_brand || '.' || CAST(p_partkey % 90 AS VARCHAR) END AS code FROM part)"""


@query(
    "catalog_violations",
    _BAD + """
    SELECT 'module_code_pattern' AS rule, code AS key, CAST(1 AS BIGINT) AS n FROM mods WHERE NOT regexp_matches(code, '^[A-Za-z0-9][A-Za-z0-9._-]*$')
    UNION ALL SELECT 'topic_code_pattern', code, 1 FROM tops WHERE NOT regexp_matches(code, '^[A-Za-z0-9][A-Za-z0-9._-]*$')
    UNION ALL SELECT 'module_code_unique', code, count(*) FROM mods GROUP BY code HAVING count(*) > 1
    UNION ALL SELECT 'topic_code_unique', CAST(module_id AS VARCHAR) || '/' || code, count(*) FROM tops GROUP BY module_id, code HAVING count(*) > 1
    UNION ALL SELECT 'kb_shared', kb_id, count(*) FROM mods WHERE kb_id IS NOT NULL GROUP BY kb_id HAVING count(*) > 1
    UNION ALL SELECT 'agent_shared', agent_id, count(*) FROM mods WHERE agent_id IS NOT NULL GROUP BY agent_id HAVING count(*) > 1
    UNION ALL SELECT 'master_as_module_agent', code, 1 FROM mods WHERE agent_id = 'agent-master'""",
)
def catalog_violations(t):
    s = C("s_suppkey")
    number = lambda n: (s % n).cast("string")
    modules = t.supplier.select(
        s.alias("module_id"),
        F.when(s % 9 == 0, F.concat(F.lit("-bad "), s.cast("string")))
        .otherwise(F.concat(F.lit("m"), number(70))).alias("code"),
        F.when(s % 4 != 0, F.concat(F.lit("kb-"), number(60))).alias("kb_id"),
        F.when(s % 50 == 1, "agent-master")
        .when(s % 3 == 0, F.concat(F.lit("agent-"), s.cast("string"))).alias("agent_id"),
    )
    p = C("p_partkey")
    topics = t.part.select(
        p.alias("topic_id"), (p % 7).alias("module_id"),
        F.when(p % 500 == 0, "")
        .otherwise(F.concat("p_brand", F.lit("."), (p % 90).cast("string"))).alias("code"),
    )
    return integrity.catalog_violations(modules, topics, "agent-master")


@query(
    "orphans",
    """WITH m AS (SELECT file_hash, 'md/' || CAST(material_id AS VARCHAR) AS md_file_path, CASE WHEN status = 'indexed' THEN 'f-' || CAST(material_id AS VARCHAR) END AS index_file_id FROM {materials}),
    hashes AS (SELECT DISTINCT md5(CAST(n_nationkey AS VARCHAR) || '/' || CAST(k AS VARCHAR)) AS h FROM nation, (SELECT unnest(range(0, 120)) AS k)),
    paths AS (SELECT DISTINCT 'md/' || CAST(l_orderkey * 2 AS VARCHAR) AS p FROM lineitem), files AS (SELECT DISTINCT 'f-' || CAST(l_orderkey AS VARCHAR) AS f FROM lineitem)
    SELECT 'page_results' AS kind, h AS id FROM hashes WHERE h NOT IN (SELECT file_hash FROM m)
    UNION ALL SELECT 'markdown', p FROM paths WHERE p NOT IN (SELECT md_file_path FROM m)
    UNION ALL SELECT 'index_file', f FROM files WHERE f NOT IN (SELECT index_file_id FROM m WHERE index_file_id IS NOT NULL)""",
)
def orphans(t):
    key = C("material_id").cast("string")
    materials = t.materials.select(
        "file_hash", F.concat(F.lit("md/"), key).alias("md_file_path"),
        F.when(C("status") == "indexed", F.concat(F.lit("f-"), key)).alias("index_file_id"),
    )
    hashes = t.nation.select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(119))).alias("k")).select(
        F.md5(F.concat_ws("/", C("n_nationkey").cast("string"), C("k").cast("string"))).alias("file_hash")
    )
    line = C("l_orderkey")
    paths = t.lineitem.select(F.concat(F.lit("md/"), (line * 2).cast("string")).alias("md_file_path"))
    files = t.lineitem.select(F.concat(F.lit("f-"), line.cast("string")).alias("index_file_id"))
    return integrity.orphans(materials, hashes, paths, files)


@query(
    "upsert_state",
    """WITH changes AS (SELECT material_id, CASE level WHEN 'error' THEN 'failed' ELSE 'indexed' END AS status, created_at + INTERVAL 30 YEAR AS created_at, log_id
       FROM {audit_logs} WHERE material_id IS NOT NULL),
    newest AS (SELECT material_id, arg_max(status, (created_at, log_id)) AS status FROM changes GROUP BY 1)
    SELECT material_id, coalesce(n.status, m.status) AS status FROM {materials} m FULL JOIN newest n USING (material_id)""",
)
def upsert_state(t):
    version = F.struct("created_at", "log_id").alias("version")
    stored = t.materials.select(
        "material_id", "status", F.struct("created_at", F.lit(-1).cast("long").alias("log_id")).alias("version")
    )
    changes = t.audit_logs.where(C("material_id").isNotNull()).select(
        "material_id",
        F.when(C("level") == "error", "failed").otherwise("indexed").alias("status"),
        version,
    )
    return integrity.upsert(stored, changes, "material_id", "version").select("material_id", "status")
