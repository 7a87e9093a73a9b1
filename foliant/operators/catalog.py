"""Catalog joins, lists and look-ups over modules, topics, materials and audit logs.

Column names follow ``foliant.schemas``. Modules, topics and users are joined without a broadcast
hint: Spark broadcasts them when their measured size allows it, and otherwise shuffles and splits
a frequent key's partition (adaptive skew join). Where both sides are large, ``lookup`` is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import icontains
from foliant.operators.ordering import lookup
from foliant.schemas import IN_PROGRESS, UNINDEXED

PAGE_SIZE = 20
MAX_PAGE_SIZE = 100
RECENT_ERRORS = 6


# -- joins ------------------------------------------------------------------------------------


def topic_context(topics: DataFrame, modules: DataFrame) -> DataFrame:
    """Topics with their module; small against materials, so it is joined first."""
    return topics.select(
        "topic_id", "module_id", F.col("code").alias("topic_code"), F.col("name").alias("topic_name"),
        F.col("order_index").alias("topic_order"),
    ).join(
        modules.select(
            "module_id", F.col("code").alias("module_code"), F.col("name").alias("module_name"),
            F.col("order_index").alias("module_order"),
        ),
        "module_id",
    )


def material_context(
    materials: DataFrame, topics: DataFrame, modules: DataFrame, users: DataFrame | None = None
) -> DataFrame:
    """Materials with topic and module, and the uploader where one is known."""
    found = materials.join(topic_context(topics, modules), "topic_id")
    if users is None:
        return found
    mail = users.select(
        F.col("user_id").alias("uploaded_by"), F.col("email").alias("uploaded_by_email")
    )
    return found.join(mail, "uploaded_by", "left")


def audit_context(audit: DataFrame, materials: DataFrame, modules: DataFrame) -> DataFrame:
    """Audit rows with file name and module code; both references may be missing."""
    names = materials.select("material_id", F.col("original_filename").alias("material_filename"))
    codes = modules.select("module_id", F.col("code").alias("module_code"))
    # Both sides are large and one material can have most of the events.
    named = lookup(audit, names, ["material_id"], "left", spread=["log_id"])
    return named.join(codes, "module_id", "left")


def module_document(modules: DataFrame, topics: DataFrame, stats: DataFrame) -> DataFrame:
    """Each module with its counts and its topics as child rows, in module and topic order.

    Children stay rows: a module may hold any number of topics, and one nested array would
    put them all into one cell. Sort by the order columns, or nest after filtering a page.
    """
    counts = topics.groupBy("module_id").agg(F.count(F.lit(1)).alias("topics_count"))
    children = topics.select(
        "module_id", "topic_id", F.col("code").alias("topic_code"),
        F.col("name").alias("topic_name"), F.col("order_index").alias("topic_order"),
    )
    zero = F.lit(0).cast("long")
    parents = (
        modules.select("module_id", "code", "name", "order_index", "is_active")
        .join(counts, "module_id", "left")
        .join(stats.select("module_id", F.col("total").alias("materials_count")), "module_id", "left")
        .withColumn("topics_count", F.coalesce("topics_count", zero))
        .withColumn("materials_count", F.coalesce("materials_count", zero))
    )
    return parents.join(children, "module_id", "left")


def existing_only(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return rows.join(existing.select(key), key, "left_semi")


def not_in(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key does not occur in ``other``; a row without a key is not in it either."""
    known = other.select(*keys).dropna().distinct()
    return rows.join(known, keys, "left_anti")


def cascade(
    modules: DataFrame, topics: DataFrame, materials: DataFrame, audit: DataFrame
) -> DataFrame:
    """What deleting ``modules`` deletes: ``(table_name, id)`` per table."""
    gone_topics = topics.join(modules.select("module_id"), "module_id", "left_semi")
    gone_materials = materials.join(gone_topics.select("topic_id"), "topic_id", "left_semi")
    by_material = audit.join(gone_materials.select("material_id"), "material_id", "left_semi")
    by_module = audit.join(modules.select("module_id"), "module_id", "left_semi")
    gone_audit = by_material.select("log_id").unionByName(by_module.select("log_id")).distinct()

    def ids(df: DataFrame, table: str, key: str) -> DataFrame:
        return df.select(F.lit(table).alias("table_name"), F.col(key).cast("string").alias("id"))

    return (
        ids(modules, "modules", "module_id")
        .unionByName(ids(gone_topics, "topics", "topic_id"))
        .unionByName(ids(gone_materials, "materials", "material_id"))
        .unionByName(ids(gone_audit, "audit_logs", "log_id"))
    )


# -- filters and lists ------------------------------------------------------------------------


def filtered(df: DataFrame, **equals) -> DataFrame:
    """Equality filters; one that is absent or empty does not filter."""
    for column, value in equals.items():
        if value is not None and value != "":
            df = df.where(F.col(column) == F.lit(value))
    return df


def searched(df: DataFrame, columns: list[str], needle: str | None) -> DataFrame:
    return df.where(icontains([F.col(c) for c in columns], needle)) if needle else df


def list_modules(modules: DataFrame, is_active: bool | None = None, search: str | None = None):
    return searched(filtered(modules, is_active=is_active), ["code", "name", "description"], search)


def list_topics(topics: DataFrame, module_id=None, search: str | None = None) -> DataFrame:
    return searched(filtered(topics, module_id=module_id), ["code", "name", "description"], search)


def list_materials(
    context: DataFrame, topic_id=None, module_id=None, kind=None, status=None, search=None
) -> DataFrame:
    """``context`` is ``material_context``; filters on material columns reach its scan."""
    rows = filtered(context, topic_id=topic_id, module_id=module_id, type=kind, status=status)
    return searched(rows, ["original_filename"], search)


def list_audit(
    audit: DataFrame, module_id=None, material_id=None, level=None, stage=None, search=None
) -> DataFrame:
    rows = filtered(
        audit, module_id=module_id, material_id=material_id, level=level, stage=stage
    )
    return searched(rows, ["message"], search)


# Orderings of the lists; the id makes each of them total.


def module_order() -> list[Column]:
    return [F.asc("order_index"), F.asc("created_at"), F.asc("module_id")]


def dashboard_order() -> list[Column]:
    return [F.asc("order_index"), F.asc("code"), F.asc("module_id")]


def topic_order() -> list[Column]:
    return [F.asc("module_order"), F.asc("topic_order"), F.asc("created_at"), F.asc("topic_id")]


def newest_first(key: str) -> list[Column]:
    return [F.desc("created_at"), F.asc(key)]


def page_limit(limit: int | None, most: int = MAX_PAGE_SIZE) -> int:
    """Rows of a page. More than ``most`` are refused, not cut."""
    size = limit or PAGE_SIZE
    if size > most:
        raise ValueError(f"a page has at most {most} rows, not {size}")
    return size


def paginate(df: DataFrame, order: list[Column], page: int = 1, limit: int | None = None) -> DataFrame:
    """One page of rows. Early pages are a top-k per task; for deep ones use ``keyset_page``."""
    size = page_limit(limit)
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_info(df: DataFrame, page: int = 1, limit: int | None = None) -> DataFrame:
    """``total``, ``page``, ``limit``, ``total_pages`` of a list; no rows make no pages."""
    size = page_limit(limit)
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        F.lit(page).alias("page"),
        F.lit(size).alias("limit"),
        F.ceil(F.col("total") / size).cast("int").alias("total_pages"),
    )


def keyset_page(df: DataFrame, key: str, after: tuple | None, limit: int | None = None) -> DataFrame:
    """The next page after ``(created_at, id)``, newest first: the cost does not grow with depth."""
    if after is not None:
        created, last = F.lit(after[0]), F.lit(after[1])
        df = df.where(
            (F.col("created_at") <= created)
            & ((F.col("created_at") < created) | (F.col(key) > last))
        )
    return df.orderBy(*newest_first(key)).limit(page_limit(limit))


def recent_errors(audit: DataFrame, limit: int = RECENT_ERRORS) -> DataFrame:
    """Newest error rows; join their context after this, to ``limit`` rows only."""
    return audit.where(F.col("level") == "error").orderBy(*newest_first("log_id")).limit(limit)


def status_feed(materials: DataFrame, ids: DataFrame) -> DataFrame:
    """Status columns of the materials whose ``material_id`` is in ``ids``, however many."""
    return materials.join(ids.select("material_id").distinct(), "material_id", "left_semi")


def tree_search(
    modules: DataFrame, topics: DataFrame, materials: DataFrame, needle: str
) -> DataFrame:
    """Modules a tree search keeps: a hit in the module, one of its topics, or a file name."""
    low = needle.lower()

    hit = F.contains(F.lower("code"), F.lit(low)) | F.contains(F.lower("name"), F.lit(low))

    files = searched(materials, ["original_filename"], needle).select("topic_id").distinct()
    hits = (
        modules.where(hit).select("module_id")
        .unionByName(topics.where(hit).select("module_id"))
        .unionByName(topics.join(files, "topic_id", "left_semi").select("module_id"))
    )
    return modules.join(hits.distinct(), "module_id", "left_semi")


# -- what to run ------------------------------------------------------------------------------


def materials_to_run(
    context: DataFrame, running: DataFrame, module_id=None, only_unindexed: bool = False
) -> DataFrame:
    """Candidates of a module in creation order with ``action`` queue or skip (already running)."""
    rows = filtered(context, module_id=module_id)
    if only_unindexed:
        rows = rows.where(F.col("status").isin(UNINDEXED))
    busy = running.select("material_id").distinct().withColumn("_busy", F.lit(True))
    return rows.join(busy, "material_id", "left").withColumn(
        "action", F.when(F.col("_busy"), "skip").otherwise("queue")
    ).drop("_busy")


def interrupted(materials: DataFrame, running: DataFrame) -> DataFrame:
    """Materials left in the middle of a run that nobody runs now: to be queued again."""
    stuck = materials.where(F.col("status").isin(IN_PROGRESS))
    return not_in(stuck, running, ["material_id"])
