"""Duplicates, violations, orphans, and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.names import CODE_PATTERN
from foliant.functions.text import strip
from foliant.operators.ordering import lookup


def duplicates(materials: DataFrame) -> DataFrame:
    """Materials whose topic already holds the same content, with the first one of it.

    The first is a partial aggregate, not a window, so a content with very many copies is not
    gathered; its copies are spread when they look the first one up.
    """
    hashed = materials.where(F.col("file_hash").isNotNull())
    key = ["topic_id", "file_hash"]
    first = (
        hashed.groupBy(*key)
        .agg(F.min(F.struct("created_at", "material_id")).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
        .select(*key, F.col("_first.material_id").alias("duplicate_of"))
    )
    return lookup(hashed, first, key, "inner", spread=["material_id"]).where(
        F.col("material_id") != F.col("duplicate_of")
    )


def accepted(materials: DataFrame) -> DataFrame:
    """Materials without the rejected duplicates; content without a hash is never one."""
    rejected = duplicates(materials).select("material_id")
    return materials.join(rejected, "material_id", "left_anti")


def catalog_violations(modules: DataFrame, topics: DataFrame, master_agent: str) -> DataFrame:
    """``(rule, key, n)`` for every broken rule of the catalog."""
    one = F.count(F.lit(1)).alias("n")

    def found(df: DataFrame, rule: str, key) -> DataFrame:
        return df.select(
            F.lit(rule).alias("rule"), key.cast("string").alias("key"), F.col("n").cast("long")
        )

    def shared(column: str, rule: str) -> DataFrame:
        used = strip(F.col(column))
        many = (
            modules.where(used != "").groupBy(used.alias("_k")).agg(one).where(F.col("n") > 1)
        )
        return found(many, rule, F.col("_k"))

    def bad_code(df: DataFrame, rule: str) -> DataFrame:
        bad = df.where(~F.col("code").rlike(CODE_PATTERN)).withColumn("n", F.lit(1))
        return found(bad, rule, F.col("code"))

    same_module = modules.groupBy("code").agg(one).where(F.col("n") > 1)
    same_topic = topics.groupBy("module_id", "code").agg(one).where(F.col("n") > 1)
    master = modules.where(strip(F.col("agent_id")) == master_agent).withColumn("n", F.lit(1))
    rules = [
        bad_code(modules, "module_code_pattern"),
        bad_code(topics, "topic_code_pattern"),
        found(same_module, "module_code_unique", F.col("code")),
        found(same_topic, "topic_code_unique", F.concat_ws("/", F.col("module_id").cast("string"), "code")),
        shared("kb_id", "kb_shared"),
        shared("agent_id", "agent_shared"),
        found(master, "master_as_module_agent", F.col("code")),
    ]
    out = rules[0]
    for rule in rules[1:]:
        out = out.unionByName(rule)
    return out


def orphans(
    materials: DataFrame, stored_hashes: DataFrame, md_paths: DataFrame, index_files: DataFrame
) -> DataFrame:
    """Stored things no material refers to: ``(kind, id)``."""

    def unused(df: DataFrame, column: str, kind: str) -> DataFrame:
        used = materials.select(column).where(F.col(column).isNotNull()).distinct()
        return (
            df.select(column).where(F.col(column).isNotNull()).distinct()
            .join(used, column, "left_anti")
            .select(F.lit(kind).alias("kind"), F.col(column).cast("string").alias("id"))
        )

    return (
        unused(stored_hashes, "file_hash", "page_results")
        .unionByName(unused(md_paths, "md_file_path", "markdown"))
        .unionByName(unused(index_files, "index_file_id", "index_file"))
    )


def upsert(stored: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of every key; ``version`` orders the rows of a key."""
    both = stored.unionByName(changes, allowMissingColumns=True)
    rest = [c for c in both.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.col(version))
    return both.groupBy(key).agg(newest.alias("_row")).select(key, "_row.*")
