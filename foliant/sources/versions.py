"""A store of Markdown versions, written commit by commit.

A commit is one batch of one job: a folder of data that nobody else writes to, then a manifest of
one row that makes it visible. Readers take the data of manifests only, so what a failed run left
behind is never seen. A batch that is repeated finds its manifest and writes nothing. Jobs are named
by whoever runs them (a stream by an id kept in its checkpoint), so equal batch numbers of two streams,
or of a stream that lost its checkpoint, are different commits.

The newest commit that holds a material has its version, all parts of it; where that is in the
store, and under which module, does not matter. ``compact`` gathers the newest versions in one
commit that replaces those it has read; commits that came in the meantime stay.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

MANIFEST = (
    "commit STRING, job STRING, batch BIGINT, version BIGINT, files INT, row_schema STRING, "
    "replaces ARRAY<STRING>"
)

def _folder(path: str, commit: str) -> str:
    # A letter in front keeps Spark from reading a folder name as a number.
    return f"{path}/data/commit={commit}"


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """All commits, one of those that wrote the same batch of a job; none for a new store."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)
    others = [c for c in rows.columns if c not in ("job", "batch")]
    first = rows.groupBy("job", "batch").agg(F.min(F.struct("version", *[c for c in others if c != "version"])).alias("_m"))
    return first.select("_m.commit", "job", "batch", "_m.version", "_m.files", "_m.row_schema", "_m.replaces")


def commits_in_force(spark: SparkSession, path: str) -> DataFrame:
    """Commits that no compaction has replaced."""
    rows = manifests(spark, path)
    gone = rows.select(F.explode("replaces").alias("commit")).distinct()
    return rows.join(gone, "commit", "left_anti")


def commit(
    df: DataFrame, path: str, job: str, batch: int, replaces: list[str] | None = None
) -> bool:
    """Store ``df`` as batch ``batch`` of ``job``; False if that batch is stored already.

    ``df`` has ``material_id``, ``status``, ``module_dir`` and what else a version holds. A document of
    several rows has a ``part``; without that column each is part 0. Rows may carry the
    ``version`` they had before. Rebalancing gives every module few files of even size.
    """
    spark = df.sparkSession
    key = (F.col("job") == job) & (F.col("batch") == batch)
    if not manifests(spark, path).where(key).isEmpty():
        return False
    name, version = f"c{uuid.uuid4().hex}", time.time_ns() // 1000
    if "part" not in df.columns:
        df = df.withColumn("part", F.lit(0).cast("long"))
    if "version" not in df.columns:
        df = df.withColumn("version", F.lit(version))
    df.hint("rebalance", "module_dir").write.partitionBy("module_dir").parquet(_folder(path, name))
    files = spark.read.schema(df.schema).parquet(_folder(path, name)).inputFiles()
    row = (name, job, batch, version, len(files), df.schema.json(), replaces or [])
    # One row, so one file, and writing it is what makes the commit visible.
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.parquet(f"{path}/commits/commit={name}")
    return True


def read_all(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all commits in force, with ``commit`` and ``version``."""
    known = commits_in_force(spark, path)
    newest = known.orderBy(F.desc("version"), "commit").select("row_schema").first()
    if newest is None:
        raise ValueError(f"nothing is stored in {path}")
    schema = StructType.fromJson(json.loads(newest.row_schema)).add("commit", StringType())
    rows = spark.read.schema(schema).parquet(f"{path}/data")
    # Spark broadcasts the few names of commits and reads no other folders.
    return rows.join(known.select("commit"), "commit", "left_semi")


def read_newest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of every material; a failed one only where there is no good one.

    Versions are counted on ids alone; what is joined to the Markdown are the few that another
    commit has replaced, which Spark broadcasts if they are as few as they should be.
    """
    rows = read_all(spark, path)
    order = F.struct((F.col("status") == "md_ready").alias("good"), "version", "commit")
    versions = rows.groupBy("material_id", "commit").agg(F.max(order).alias("_order"))
    newest = (
        versions.groupBy("material_id")
        .agg(F.max("_order").alias("_newest"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    )
    replaced = versions.join(newest, "material_id").where(F.col("_order") < F.col("_newest"))
    return rows.join(replaced.select("material_id", "commit"), ["material_id", "commit"], "left_anti")


def compact(spark: SparkSession, path: str) -> bool:
    """Gather the newest versions in one commit in place of all that were read for it.

    Every row keeps its version, so a commit that ends while this runs is still newer. False if there
    is nothing to gather.
    """
    read = [r.commit for r in commits_in_force(spark, path).select("commit").collect()]
    if len(read) < 2:
        return False
    newest = read_newest(spark, path).where(F.col("commit").isin(read)).drop("commit")
    return commit(newest, path, f"compaction-{uuid.uuid4().hex}", 0, replaces=read)


def unread_folders(spark: SparkSession, path: str) -> DataFrame:
    """Names of replaced commits, whose folders may be deleted once no reader is on them."""
    return manifests(spark, path).join(
        commits_in_force(spark, path).select("commit"), "commit", "left_anti"
    ).select("commit", "job", "batch")
