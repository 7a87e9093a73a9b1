"""Catalog, page and audit tables in Parquet or behind JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.pages import merge_results
from foliant.schemas import TABLES, column_names
from foliant.session import stored


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of ``schemas.TABLES`` with its fixed schema; nothing is inferred."""
    return spark.read.schema(TABLES[name]).parquet(f"{path}/{name}")


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of an input that comes in fewer splits than there are cores.

    A large input has more splits and is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def read_catalog(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {
        name: read_table(spark, path, name)
        for name in ("modules", "topics", "materials", "audit_logs")
    }


def read_jdbc_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """The same table from a database; pass partitionColumn, bounds and numPartitions for size."""
    columns = column_names(name)
    return (
        spark.read.format("jdbc").options(url=url, dbtable=name, **options).load().select(*columns)
    )


def append_audit(rows: DataFrame, path: str, run: str) -> None:
    """Audit rows of a run, one folder per run and day, so that a time filter prunes folders.

    A run that is repeated replaces its own folders and nothing else; rows of all runs stay.
    """
    (
        rows.withColumns({"run": F.lit(run), "day": F.to_date("created_at")})
        .hint("rebalance", "day")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "run").parquet(path)
    )


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _prefixed(results: DataFrame) -> DataFrame:
    return results.withColumn("hash2", F.substring("file_hash", 1, 2))


def write_page_results(results: DataFrame, path: str) -> None:
    """A new page-result store, without failed pages, partitioned by the first hash characters."""
    kept = _prefixed(results.where(F.col("error").isNull())).hint("rebalance", "hash2")
    kept.write.mode("overwrite").partitionBy("hash2").parquet(path)


def read_page_results(spark: SparkSession, path: str, file_hashes: list[str] | None = None):
    rows = spark.read.parquet(path)
    if file_hashes is not None:
        rows = rows.where(F.col("hash2").isin(sorted({h[:2] for h in file_hashes})))
        rows = rows.where(F.col("file_hash").isin(file_hashes))
    return rows


def merge_page_results(spark: SparkSession, fresh: DataFrame, path: str) -> list[str]:
    """Merge a run's results into the store at ``path``; returns the folders that were rewritten.

    Only folders that a fresh result falls into are read and written, of 256 at most; the files of all
    others stay as they are. The merged rows are stored before they take the old ones' place, so they
    are neither lost nor read while that happens.
    """
    fresh = stored(_prefixed(fresh.where(F.col("error").isNull())))
    touched = sorted(r.hash2 for r in fresh.select("hash2").distinct().collect())
    if not touched:
        return []
    known = spark.read.schema(fresh.schema).parquet(path).where(F.col("hash2").isin(touched))
    merged = stored(_prefixed(merge_results(known.drop("hash2"), fresh.drop("hash2"))))
    merged.hint("rebalance", "hash2").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "hash2").parquet(path)
    return touched
