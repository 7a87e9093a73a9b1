"""Dashboard, tree and facet reports. Materials are counted per topic before any join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import percent
from foliant.schemas import IN_PROGRESS, STATUSES

CHART_DAYS = 14
DASHBOARD_MODULES = 8
ZONE = "Asia/Tashkent"


def _zero() -> Column:
    return F.lit(0).cast("long")


def _rows() -> Column:
    return F.count(F.lit(1))


def topic_status_counts(materials: DataFrame) -> DataFrame:
    """``(topic_id, status, n)``: the small table every report below starts from."""
    return materials.groupBy("topic_id", "status").agg(_rows().alias("n"))


def topic_totals(materials: DataFrame) -> DataFrame:
    counts = topic_status_counts(materials)
    is_status = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), _zero())
    return counts.groupBy("topic_id").agg(
        F.sum("n").alias("total"),
        is_status("indexed").alias("indexed"),
        is_status("failed").alias("failed"),
    )


def material_stats(materials: DataFrame, topics: DataFrame) -> DataFrame:
    """Per module that has materials: the total and one column per status."""
    joined = topic_status_counts(materials).join(topics.select("topic_id", "module_id"), "topic_id")
    by_status = [
        F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), _zero()).alias(s)
        for s in STATUSES
    ]
    return joined.groupBy("module_id").agg(F.sum("n").alias("total"), *by_status)


def topic_material_counts(topics: DataFrame, materials: DataFrame) -> DataFrame:
    """Materials per topic; topics without any count zero."""
    counts = materials.groupBy("topic_id").agg(_rows().alias("_n"))
    return (
        topics.join(counts, "topic_id", "left")
        .withColumn("materials_count", F.coalesce("_n", _zero())).drop("_n")
    )


def module_counts(modules: DataFrame, topics: DataFrame, materials: DataFrame) -> DataFrame:
    """Topics and materials per module, each branch counted before the join: no fan-out."""
    counts = topic_material_counts(topics, materials).groupBy("module_id").agg(
        _rows().alias("_topics"), F.sum("materials_count").alias("_materials")
    )
    return (
        modules.join(counts, "module_id", "left")
        .withColumn("num_topics", F.coalesce("_topics", _zero()))
        .withColumn("num_materials", F.coalesce("_materials", _zero()))
        .drop("_topics", "_materials")
    )


def local_day(timestamp: Column, zone: str = ZONE) -> Column:
    """Calendar day in ``zone`` of a zone-less UTC timestamp, whatever the session zone is."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), timestamp))


def daily_uploads(
    materials: DataFrame, as_of: Column, days: int = CHART_DAYS, zone: str = ZONE
) -> DataFrame:
    """Uploads per local day over the ``days`` days that end on the day ``as_of``, zero-filled."""
    day = local_day(F.col("created_at"), zone)
    start = F.date_sub(as_of, days - 1)
    counts = (
        materials.select(day.alias("day")).where((F.col("day") >= start) & (F.col("day") <= as_of))
        .groupBy("day").agg(_rows().alias("_n"))
    )
    spine = materials.sparkSession.range(1).select(
        F.explode(F.sequence(start, as_of)).alias("day")
    )
    return spine.join(counts, "day", "left").select(
        "day",
        F.date_format("day", "dd.MM").alias("label"),
        F.coalesce("_n", _zero()).alias("uploads"),
    )


def latest_day(materials: DataFrame, zone: str = ZONE) -> Column:
    """The last day with an upload, as a scalar of the plan."""
    return materials.agg(F.max(local_day(F.col("created_at"), zone)).alias("day")).scalar()


def kpis(modules: DataFrame, topics: DataFrame, materials: DataFrame) -> DataFrame:
    """One row of headline numbers."""
    m = materials.agg(
        _rows().alias("materials"),
        F.count_if(F.col("status").isin(IN_PROGRESS)).alias("in_progress"),
        F.count_if(F.col("status") == "indexed").alias("indexed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    return m.select(
        modules.agg(_rows()).scalar().alias("modules"),
        modules.agg(F.count_if("is_active")).scalar().alias("active_modules"),
        topics.agg(_rows()).scalar().alias("topics"),
        "materials", "in_progress", "indexed", "failed",
    )


def status_breakdown(materials: DataFrame) -> DataFrame:
    """Statuses that occur, in lifecycle order, with whole percents of all materials."""
    counts = materials.groupBy("status").agg(_rows().alias("count"))
    total = F.sum("count").over(Window.partitionBy(F.lit(1)))
    place = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))
    # A handful of rows, one per status, so the one-partition total is no bottleneck.
    return counts.where(F.col("status").isin(STATUSES)).select(
        place.cast("int").alias("position"), "status", "count",
        percent(F.col("count"), total).alias("percent"),
    )


def module_progress(
    modules: DataFrame, topics: DataFrame, materials: DataFrame, limit: int = DASHBOARD_MODULES
) -> DataFrame:
    """Indexing progress of the first modules of the dashboard."""
    shown = modules.orderBy("order_index", "code", "module_id").limit(limit)
    totals = (
        topics.select("topic_id", "module_id").join(topic_totals(materials), "topic_id")
        .groupBy("module_id")
        .agg(*[F.sum(c).alias(c) for c in ("total", "indexed", "failed")])
    )
    return (
        shown.select("module_id", "code", "name", "order_index").join(totals, "module_id", "left")
        .withColumns({c: F.coalesce(c, _zero()) for c in ("total", "indexed", "failed")})
        .withColumn("percent", percent(F.col("indexed"), F.col("total")))
    )


def topic_tree(
    modules: DataFrame, topics: DataFrame, materials: DataFrame, needle: str | None = None
) -> DataFrame:
    """Topic rows of the content tree: ids, labels, counts, and whether the search keeps the module.

    A module without topics has one row without a topic. Materials are read once: their counts and
    whether a file name is hit come from the same grouping.
    """
    low = (needle or "").lower()

    def hit(*columns: str) -> Column:
        found = [F.contains(F.lower(c), F.lit(low)) for c in columns]
        return F.coalesce(reduce(lambda x, y: x | y, found), F.lit(False))

    def counted(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    totals = materials.groupBy("topic_id").agg(
        _rows().alias("total"), counted("indexed").alias("indexed"), counted("failed").alias("failed"),
        F.bool_or(hit("original_filename")).alias("_file_hit"),
    )
    per_topic = topics.select(
        "topic_id", "module_id", F.col("code").alias("topic_code"), F.col("name").alias("topic_name"),
        F.col("order_index").alias("topic_order"), hit("code", "name").alias("_topic_hit"),
    ).join(totals, "topic_id", "left")
    head = modules.select(
        "module_id", F.col("code").alias("module_code"), F.col("name").alias("module_name"),
        F.col("order_index").alias("module_order"), hit("code", "name").alias("_module_hit"),
    )
    own = F.col("_module_hit") | F.coalesce("_topic_hit", F.lit(False)) | F.coalesce("_file_hit", F.lit(False))
    kept = F.bool_or(own).over(Window.partitionBy("module_id"))
    return (
        head.join(per_topic, "module_id", "left")
        .withColumns({c: F.coalesce(c, _zero()) for c in ("total", "indexed", "failed")})
        .withColumn("kept", kept).drop("_module_hit", "_topic_hit", "_file_hit")
    )


def content_tree(
    modules: DataFrame, topics: DataFrame, materials: DataFrame, needle: str | None = None
) -> DataFrame:
    """The whole tree as outline rows: level, ids, label and counts, one row per node.

    ``needle`` limits the modules to those a search keeps and the material rows to the file names
    it hits; the counts ignore it. Sorting by the order columns gives the screen's order. Modules and
    topics are grouping sets of one pass; materials are read for the counts and for the leaves.
    """
    from foliant.operators.catalog import searched

    tree = topic_tree(modules, topics, materials, needle)
    if needle is not None:
        tree = tree.where("kept")
    sets = [["module_order", "module_code", "module_id"], ["module_order", "module_code", "module_id", "topic_code", "topic_id"]]
    sums = tree.groupingSets(
        [[F.col(c) for c in columns] for columns in sets], *[F.col(c) for c in sets[1]]
    ).agg(
        *[F.sum(c).alias(c) for c in ("total", "indexed", "failed")], F.grouping("topic_id").alias("_whole")
    )
    none = F.lit(None).cast("long")
    counted = sums.where((F.col("_whole") == 1) | F.col("topic_id").isNotNull()).select(
        (1 - F.col("_whole")).cast("int").alias("level"), "module_order", "module_code", "topic_code",
        F.lit(None).cast("string").alias("material_filename"), none.alias("material_id"),
        F.lit(None).cast("string").alias("status"), "total", "indexed", "failed",
        percent(F.col("indexed"), F.col("total")).alias("percent"),
    )
    places = tree.where("topic_id IS NOT NULL").select("topic_id", "topic_code", "module_code", "module_order")
    if needle is None:
        # Every topic is a place then, and no count is needed for that.
        places = topics.select("topic_id", "module_id", F.col("code").alias("topic_code")).join(
            modules.select("module_id", F.col("code").alias("module_code"), F.col("order_index").alias("module_order")),
            "module_id",
        )
    leaf = searched(materials, ["original_filename"], needle).join(places, "topic_id")
    material_rows = leaf.select(
        F.lit(2).alias("level"), "module_order", "module_code", "topic_code",
        F.col("original_filename").alias("material_filename"),
        F.col("material_id"), "status",
        none.alias("total"), none.alias("indexed"), none.alias("failed"),
        F.lit(None).cast("int").alias("percent"),
    )
    return counted.unionByName(material_rows)


def audit_summary(audit: DataFrame) -> DataFrame:
    """Facets by level, stage and module: one pass over the log, then sums of a small table."""
    return facets(audit, ["level", "stage", "module_code"])


def material_facets(context: DataFrame) -> DataFrame:
    return facets(
        context, ["status", "type", "module_code", "detected_script", "extraction_method"]
    )


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(facet, value, n)`` for every column, from one grouping by all of them."""
    base = df.groupBy(*columns).agg(_rows().alias("_n"))
    pairs = F.array(*[
        F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns
    ])
    return (
        base.select("_n", F.explode(pairs).alias("_f"))
        .groupBy("_f.facet", "_f.value").agg(F.sum("_n").alias("n"))
    )


def date_drilldown(df: DataFrame, timestamp: str = "created_at", zone: str = ZONE) -> DataFrame:
    """Counts by year, month and day of the local date, rolled up from the daily counts."""
    day = local_day(F.col(timestamp), zone)
    daily = df.groupBy(day.alias("_day")).agg(_rows().alias("_n"))
    return (
        daily.select(
            F.year("_day").alias("year"), F.month("_day").alias("month"),
            F.dayofmonth("_day").alias("day"), "_n",
        )
        .rollup("year", "month", "day").agg(F.sum("_n").alias("n"))
        .where(F.col("year").isNotNull())
    )


def extraction_badge(method: Column, confidence: Column, threshold: float = 60.0) -> Column:
    """The method, ``low`` for a recognised document below the threshold, a dash for none yet."""
    low = (method != "text") & (confidence < threshold)
    return F.when(low, "low").otherwise(F.coalesce(method, F.lit("—")))


def script_census(df: DataFrame) -> DataFrame:
    return df.groupBy("script").agg(_rows().alias("documents"))
