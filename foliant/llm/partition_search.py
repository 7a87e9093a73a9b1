"""Approximate nearest neighbours over learned partitions.

On a bounded sample of the vectors the exact neighbour graph is cut into balanced parts that keep
neighbours together. A small network learns, for a vector, in which parts its neighbours lie. It
places every row in its most probable part, and sends a query to its most probable parts; all rows
found there are compared exactly. How many parts a query visits is measured on sample vectors kept
from the training: as few as find the wanted share of their true neighbours.

Equal vectors are one candidate with their smallest ids, as many as a result can hold, so a vector
that very many rows share is compared once. Parts are searched in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.shared import Sent, stored

# Rows of the sample, neighbours in its graph, parts, and training rows per part at least.
SAMPLE, NEIGHBOURS, PARTS, LEAST = 4096, 10, 32, 64
# Share of true neighbours that sample queries must find.
WANTED = 0.95
HIDDEN, ROUNDS = 64, 25
# Rows and queries of a block, and queries compared at a time.
BLOCK, AT_ONCE = 8192, 256


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaling by the largest component first keeps squares of very large and small numbers finite.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def neighbours(x: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Rows of ``x`` nearest to rows of ``x`` named by ``queries``, themselves left out."""
    out = []
    for i in range(0, len(queries), 128):
        part = queries[i:i + 128]
        near = x[part] @ x.T
        near[np.arange(len(part)), part] = -2
        out.append(np.argpartition(-near, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def _halves(graph: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Cut a neighbour graph's ``rows`` in two equal halves with few edges in between."""
    place = np.full(len(graph), -1)
    place[rows] = np.arange(len(rows))
    near = place[graph[rows]]
    source, target = np.nonzero(near >= 0)[0], near[near >= 0]
    source, target = np.concatenate([source, target]), np.concatenate([target, source])
    n = len(rows)
    degree = np.maximum(np.bincount(source, minlength=n), 1)

    def spread(f):
        return np.bincount(source, f[target], n) / degree

    # Smoothing along the edges leaves the slowest change over the graph; its median cuts it.
    f = rng.standard_normal(n)
    for _ in range(60):
        f = (f + spread(f)) / 2
        f -= np.average(f, weights=degree)
        f /= np.sqrt((f * f).sum()) or 1
    side = np.zeros(n, bool)
    side[np.argsort(f, kind="stable")[n // 2:]] = True
    # Swap the same number of rows from both sides while that removes edges in between.
    for _ in range(20):
        other = np.bincount(source, side[target] != side[source], n)
        gain = 2 * other - degree
        left = np.flatnonzero(~side)
        right = np.flatnonzero(side)
        left = left[np.argsort(-gain[left], kind="stable")]
        right = right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        good = int(((gain[left[:m]] + gain[right[:m]]) > 0).sum()) // 2
        if not good:
            break
        side[left[:good]], side[right[:good]] = True, False
    return side


def balanced_parts(graph: np.ndarray, depth: int, seed: int = 7) -> np.ndarray:
    """Part of every row of a neighbour graph: ``2 ** depth`` parts of nearly equal size."""
    rng = np.random.default_rng(seed)
    part = np.zeros(len(graph), np.int64)
    for _ in range(depth):
        halves = part * 2
        for k in np.unique(part):
            rows = np.flatnonzero(part == k)
            halves[rows] += _halves(graph, rows, rng)
        part = halves
    return part


class Router:
    """A network of one hidden layer from unit vectors to the probabilities of parts."""

    def __init__(self, layers: tuple, probes: int):
        self.layers, self.probes = layers, probes

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        z = np.maximum(x @ a + b, 0) @ c + d
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> tuple:
    """Weights of a router from unit vectors and the parts' shares of their neighbours."""
    rng = np.random.default_rng(seed)
    weights = [
        rng.standard_normal((x.shape[1], HIDDEN)) / math.sqrt(x.shape[1]) * 2, np.zeros(HIDDEN),
        rng.standard_normal((HIDDEN, y.shape[1])) / math.sqrt(HIDDEN), np.zeros(y.shape[1]),
    ]
    first, second, t = [0.0] * 4, [0.0] * 4, 0
    for _ in range(ROUNDS):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 256):
            part = order[i:i + 256]
            a, b, c, d = weights
            h = np.maximum(x[part] @ a + b, 0)
            z = h @ c + d
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            slope = (p - y[part]) / len(part)
            back = (slope @ c.T) * (h > 0)
            t += 1
            for k, g in enumerate((x[part].T @ back, back.sum(0), h.T @ slope, slope.sum(0))):
                g = g + 1e-4 * weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] = weights[k] - 0.003 * (first[k] / (1 - 0.9 ** t)) / (
                    np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)
    return tuple(weights)


def fit(sample: np.ndarray, k: int = 5) -> Router | None:
    """A router from sample vectors; None if they are too few for more than one part."""
    n = len(sample)
    depth = int(math.log2(min(PARTS, max(1, n // LEAST))))
    if depth == 0:
        return None
    x = _unit(sample)
    graph = neighbours(x, np.arange(n), NEIGHBOURS)
    part = balanced_parts(graph, depth)
    share = np.zeros((n, 1 << depth))
    np.add.at(share, (np.repeat(np.arange(n), NEIGHBOURS), part[graph].ravel()), 1 / (NEIGHBOURS + 1))
    share[np.arange(n), part] += 1 / (NEIGHBOURS + 1)
    kept = np.arange(n) % 8 == 0
    router = Router(train(x[~kept], share[~kept]), 1 << depth)
    # Where the router itself places the rows decides what a query finds.
    chance = router.probabilities(x)
    home = chance.argmax(1)
    asked = np.flatnonzero(kept)
    near = home[neighbours(x, asked, min(k, n - 1))]
    visited = np.argsort(-chance[asked], axis=1, kind="stable")
    order = np.empty_like(visited)
    np.put_along_axis(order, visited, np.arange(visited.shape[1])[None, :].repeat(len(asked), 0), 1)
    rank = np.take_along_axis(order, near, 1).ravel()
    router.probes = int(np.quantile(rank, WANTED, method="higher")) + 1
    return router


def usable(vector: Column, size: int | None = None) -> Column:
    """Vectors with finite components, not all zero, and, if given, of ``size`` components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)
    return F.coalesce(good & (F.size(vector) == size) if size else good, F.lit(False))


def _scores(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Cosines of vectors, from components as doubles; equal vectors have equal scores.

    Vectors are scaled by powers of two first, which changes no digit and keeps squares finite.
    """
    one, many = (np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) for x in (one, many))
    return (one * many).sum(1) / (np.sqrt((one * one).sum(1)) * np.sqrt((many * many).sum(1)))


def search(
    rows: DataFrame, queries: Column, k: int = 5, id_column: str = "vec_id", vector: str = "embedding",
    sample: int = SAMPLE,
) -> DataFrame:
    """The ``k`` nearest rows by cosine for every row where ``queries`` holds, approximately.

    Returns ``query_id``, ``rank`` from 1, ``vec_id`` and ``score``, the exact cosine of the
    vectors in double precision; nearest first, ties to the smaller id. A query never finds its own
    id, and finds all others if they are fewer than ``k``. Rows take no part if the id or the vector
    is NULL, a component is NULL or not finite, all are zero, or there are not as many components as
    in most vectors of the sample. Repeated rows count once. The sample are the first ``sample``
    rows by a hash of the id; it bounds what comes to the driver. No rows give no rows.
    """
    spark = rows.sparkSession
    rows = rows.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"),
        F.coalesce(queries, F.lit(False)).alias("asked"),
    ).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toPandas()["v"]
    empty = "query_id long, rank int, vec_id long, score double"
    if not len(some):
        return spark.createDataFrame([], empty)
    sizes = pd.Series([len(v) for v in some])
    size = int(sizes.mode()[0])
    router = fit(np.unique(np.stack([v for v in some if len(v) == size]), axis=0), k)
    del some
    parts = 1 if router is None else router.layers[3].shape[0]
    probes = 1 if router is None else router.probes
    rows = rows.where(F.size("v") == size)
    sent = Sent(spark, router)

    def routed(most: int, vectors: str):
        @F.pandas_udf("array<int>")
        def run(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
            ready = sent.value
            for part in vectors:
                if ready is None or not len(part):
                    yield pd.Series([[0]] * len(part))
                    continue
                chance = ready.probabilities(_unit(np.stack(part.to_numpy())))
                yield pd.Series(list(np.argsort(-chance, axis=1, kind="stable")[:, :most]))

        return run(vectors)

    # Of equal vectors a query can need k, and one more if it is one of them.
    same = Window.partitionBy("v").orderBy("vec_id")
    index = stored(
        rows.select("v", "vec_id").withColumn("_rank", F.dense_rank().over(same))
        .where(F.col("_rank") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
        .withColumn("part", routed(1, "v")[0])
    )
    asked = stored(
        rows.where("asked").select(F.col("vec_id").alias("query_id"), F.col("v").alias("w")).distinct()
        .withColumn("parts", routed(probes, "w"))
    )

    found = stored(_compared(index, asked.withColumn("part", F.explode("parts")), k))
    # Parts can hold fewer than k rows; such queries visit all parts.
    others = rows.select("vec_id").distinct().limit(k + 1).count() - 1
    if probes < parts:
        full = found.groupBy("query_id").count().where(F.col("count") >= min(k, others))
        short = asked.join(full, "query_id", "left_anti")
        everywhere = short.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        found = found.join(full.select("query_id"), "query_id", "left_semi").unionByName(
            _compared(index, everywhere, k))
    return found.select("query_id", "rank", "vec_id", "score")


def _compared(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query in the parts it visits."""

    def blocks(df: DataFrame, key: str) -> dict[int, int]:
        """Blocks a part's rows are cut into; there are as many counts as parts."""
        counts = df.groupBy("part").count().collect()
        return {row["part"]: math.ceil(row["count"] / BLOCK) for row in counts} or {0: 1}

    own, other = blocks(index, "v"), blocks(asked, "query_id")

    def cut(df: DataFrame, mine: dict, theirs: dict, key: str, name: str, copy: str) -> DataFrame:
        def number(counts):
            return F.coalesce(F.try_element_at(
                F.create_map(*[F.lit(x) for pair in counts.items() for x in pair]), "part"), F.lit(1))

        return df.withColumn(name, F.pmod(F.xxhash64(key), number(mine)).cast("int")).withColumn(
            copy, F.explode(F.sequence(F.lit(0), number(theirs) - 1)))

    left = cut(index, own, other, "v", "b", "q").select("part", "b", "q", "v", "ids")
    right = cut(asked, other, own, "query_id", "q", "b").select("part", "b", "q", "w", "query_id")

    def compare(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            x, ids = np.stack(rows["v"].to_numpy()), rows["ids"].to_numpy()
            units, asked_ids = _unit(x), queries["query_id"].to_numpy()
            vectors = np.stack(queries["w"].to_numpy())
            most = min(k + 1, len(x))
            for i in range(0, len(vectors), AT_ONCE):
                y = vectors[i:i + AT_ONCE]
                near = _unit(y) @ units.T
                last = np.partition(near, len(x) - most, axis=1)[:, len(x) - most]
                # Whatever may tie with the last one is compared exactly.
                q, r = np.nonzero(near >= last[:, None] - 1e-9)
                score = _scores(y[q], x[r])
                count = np.array([len(ids[j]) for j in r])
                one = pd.DataFrame({
                    "query_id": np.repeat(asked_ids[i:i + AT_ONCE][q], count),
                    "vec_id": np.concatenate([ids[j] for j in r]), "score": np.repeat(score, count),
                })
                one = one[one["query_id"] != one["vec_id"]]
                one = one.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
                out.append(one.groupby("query_id").head(k))
        return pd.concat(out) if out else pd.DataFrame(
            {"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"),
             "score": pd.Series(dtype="float64")})

    best = (
        left.groupBy("part", "b", "q").cogroup(right.groupBy("part", "b", "q"))
        .applyInPandas(compare, "query_id long, vec_id long, score double")
    )
    # An id with several vectors counts with the nearest.
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
