"""What the operators share: settings, stored intermediate tables, connected components."""

from __future__ import annotations

import pickle
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the operators rely on; they hold for every size of input.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


class Sent:
    """A value of any class of this package, broadcast once and unpacked once by each task.

    Spark pickles what it broadcasts by name, which executors without a copy of this package cannot
    follow; here the classes go along.
    """

    def __init__(self, spark: SparkSession, value):
        self._packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._value = None

    def __getstate__(self):
        return {"_packed": self._packed, "_value": None}

    @property
    def value(self):
        if self._value is None:
            self._value = pickle.loads(self._packed.value)
        return self._value


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local master, where there is one machine, may do without one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith(("local[", "local")) or (
            spark.sparkContext.master.startswith("local-cluster")
        ):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and go on from there.

    Lineage ends here: a lost executor costs a re-read, not a re-run. Whoever cleans the
    checkpoint folder of the cluster cleans these tables as well.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a, b): every node with its smallest reachable node.

    Returns ``node`` and ``root`` for all nodes with a link to another one. Stars are contracted
    in rounds until nothing changes, about as many as the logarithm of the longest path. Only
    the smallest neighbour of a node is gathered, so a node may have any number of links.
    """
    edges = links.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct()
    edges = stored(edges)
    mark = _mark(edges)
    while True:
        # Large stars: the greater neighbours of a node are linked to its smallest one.
        both = edges.union(edges.selectExpr("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) m")
        large = both.join(least, "a").where("b > a").selectExpr("b a", "m b").where("a <> b")
        large = stored(large.distinct())
        # Small stars: a node and its smaller neighbours are linked to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").selectExpr("b a", "m b").union(least.selectExpr("a", "m b"))
        edges = stored(small.where("a <> b").distinct())
        now = _mark(edges)
        if now == mark:
            return edges.selectExpr("a node", "b root").union(
                edges.selectExpr("b node", "b root").distinct()
            )
        mark = now
