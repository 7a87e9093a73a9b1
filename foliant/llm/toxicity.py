"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary texts, one on the passages of
toxic texts that ordinary texts do not have, found by contrasting in how many texts of either kind
the byte n-grams of words occur. How many must hold an n-gram follows from how likely chance makes the
contrast, not from a share of all toxic texts, so a rarer language leaves its evidence too. Near copies
count once. A window of a text is compressed with the ordinary dictionary, and
with the ordinary and the toxic one together. Where the second is shorter, the window holds what
only toxic texts hold. The differences of all windows of a text make a few numbers, and a logistic
regression calibrates them to a probability, on texts that the toxic dictionary was not trained on.

The model is fitted on the driver from a sample of labelled texts whose number, lengths and bytes are
bounded by parameters; the n-grams of the sample are counted in the tasks. Scoring is one pass over whole texts in the tasks, without a shuffle.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.shared import stored

# Lengths of the byte n-grams that are counted.
GRAMS = (5, 7)
WINDOW = 96
# Windows compressed at a time.
FLUSH = 4096
ORDINARY_BYTES, TOXIC_BYTES = 16384, 2048
# An n-gram's share of the toxic texts is so many times that of the ordinary ones, at least.
CONTRAST = 5
# Different n-grams that a task counts before it hands them on.
COUNTED = 300_000
# Words that a text is known by when near copies are looked for.
SKETCH = 16
FOLDS = 2
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from."""
    return F.crc32(doc_id.cast("string")) % 3 == 1


def _words(text: str) -> list[bytes]:
    return [b" " + word for word in WORD.findall(text.lower().encode())]


def _grams(text: str) -> set[bytes]:
    found = set()
    for word in set(_words(text)):
        for n in GRAMS:
            found.update(word[i:i + n] for i in range(len(word) - n + 1))
    return found


def _passages(text: str, marks: set[bytes]) -> set[bytes]:
    """The parts of words that are covered by marked n-grams."""
    found = set()
    for word in set(_words(text)):
        hits = [(i, i + n) for i in range(len(word)) for n in GRAMS if word[i:i + n] in marks]
        if hits:
            found.add(word[hits[0][0]:max(end for _, end in hits)])
    return found


def _windows(text: str) -> Iterator[bytes]:
    """Cut a text at the first space after every WINDOW bytes, or after half as many again."""
    data = text.lower().encode()
    start, step = 0, WINDOW
    while start < len(data):
        end = data.find(b" ", start + step, start + step + step // 2)
        end = end if end >= 0 else start + step + step // 2
        yield data[start:end]
        start = end


def _trained(size: int, samples: list[bytes], **settings) -> bytes:
    """A dictionary's bytes; the last samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, **settings).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Model:
    """Two dictionaries and the weights of the regression."""

    def __init__(self, ordinary: bytes, toxic: bytes, weights: np.ndarray | None = None):
        self.ordinary, self.toxic, self.weights = ordinary, toxic, weights

    def _compressors(self):
        settings = zstandard.ZstdCompressionParameters.from_level(
            5, source_size=WINDOW + WINDOW // 2, dict_size=len(self.ordinary) + len(self.toxic),
            min_match=4, write_content_size=0, write_dict_id=0,
        )
        for content in (self.ordinary, self.toxic + self.ordinary):
            raw = zstandard.ZstdCompressionDict(
                content or b"        ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(compression_params=settings)
            yield zstandard.ZstdCompressor(compression_params=settings, dict_data=raw)

    def features(self, texts: list[str]) -> np.ndarray:
        """A row of numbers per text, from the differences of all its windows."""
        plain, both = self._compressors()
        most = np.zeros((len(texts), 3))
        sums = np.zeros((len(texts), 6))
        windows: list[bytes] = []
        owners: list[int] = []

        def flush():
            if not windows:
                return
            sizes = [
                np.fromiter((len(x) for x in c.multi_compress_to_buffer(windows, threads=1)),
                            np.int64, len(windows))
                for c in (plain, both)
            ]
            less = sizes[0] - sizes[1]
            owner = np.array(owners)
            cuts = [0, *(np.flatnonzero(np.diff(owner)) + 1), len(owner)]
            for a, b in zip(cuts, cuts[1:]):
                i, part = owner[a], less[a:b]
                most[i] = np.sort(np.concatenate([most[i], part]))[-3:]
                sums[i] += [b - a, part.sum(), *((part >= k).sum() for k in (1, 2, 3, 4))]
            windows.clear()
            owners.clear()

        for i, text in enumerate(texts):
            for window in _windows(text):
                windows.append(window)
                owners.append(i)
                if len(windows) == FLUSH:
                    flush()
        flush()
        n = np.maximum(sums[:, :1], 1)
        return np.column_stack([
            np.ones(len(texts)), most[:, 2] / 4, most.sum(1) / 12, sums[:, 1:] / n,
            sums[:, 4:] / np.sqrt(n), np.log(n),
        ])

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights, -30, 30)))


def _regression(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _apart(texts: list[str]) -> list[str]:
    """The texts without those that share half of their sketch with one before."""
    kept, seen = [], {}
    for text in texts:
        sketch = heapq.nsmallest(SKETCH, {zlib.crc32(word) for word in _words(text)})
        near = Counter(i for value in sketch for i in seen.get(value, ()))
        if near and 2 * max(near.values()) >= len(sketch):
            continue
        for value in sketch:
            seen.setdefault(value, []).append(len(kept))
        kept.append(text)
    return kept


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts n-grams occur, by kind and fold of the texts; partial sums."""
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        grams, kinds = zip(*counts) if counts else ((), ())
        found = pa.RecordBatch.from_arrays(
            [pa.array(grams, pa.binary()), pa.array(kinds, pa.int32()), pa.array(list(counts.values()), pa.int64())],
            names=["gram", "kind", "n"])
        counts.clear()
        return found

    for batch in batches:
        for text, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.update((gram, kind) for gram in _grams(text))
            if len(counts) > COUNTED:
                yield flush()
    yield flush()


def marks(kept: DataFrame, toxic: list[int], ordinary: list[int]) -> list[set[bytes]]:
    """N-grams that toxic texts have far more often, beyond what chance does among so many.

    ``kept`` has ``text`` and ``kind``, which is the text's fold, plus ``FOLDS`` for toxic ones; the
    lists say how many there are of each. Returns the marks from all texts but a fold's, for every
    fold, and those from all texts. All n-grams are counted in tasks; only marks come to the driver.

    A mark is in 4 toxic texts at least, its share of them is ``CONTRAST`` times that of ordinary ones, and
    Chernoff's bound for that many of its texts being toxic is below one over the n-grams tried.
    """
    counted = kept.select("text", "kind").mapInArrow(_counted, "gram binary, kind int, n long")

    def count(kind: int, but: int | None) -> Column:
        folds = [F.coalesce(F.sum(F.when(F.col("kind") == kind * FOLDS + f, F.col("n"))), F.lit(0))
                 for f in range(FOLDS) if f != but]
        return sum(folds[1:], folds[0])

    settings = [*range(FOLDS), None]
    wide = stored(counted.groupBy("gram").agg(*[
        count(kind, but).alias(f"{name}{i}") for i, but in enumerate(settings)
        for name, kind in (("k", 1), ("c", 0))
    ]))
    tried = wide.agg(*[F.count_if(F.col(f"k{i}") > 1).alias(f"t{i}") for i in range(len(settings))]).first()
    found = []
    for i, but in enumerate(settings):
        n, m = (sum(x for f, x in enumerate(texts) if f != but) for texts in (toxic, ordinary))
        if not n or not m:
            found.append(F.lit(False))
            continue
        k, total, p = F.col(f"k{i}"), F.col(f"k{i}") + F.col(f"c{i}"), n / (n + m)
        q = k / total
        rest = F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0)
        chance = F.when(q > p, -total * (q * F.log(q / p) + rest)).otherwise(0.0)
        found.append((k >= 4) & (k / n >= CONTRAST * (F.col(f"c{i}") + 0.5) / m)
                     & (chance <= -math.log(max(10, tried[f"t{i}"]))))
    flags = wide.select("gram", *[x.alias(f"m{i}") for i, x in enumerate(found)])
    rows = flags.where(" OR ".join(f"m{i}" for i in range(len(settings)))).collect()
    return [{bytes(r.gram) for r in rows if r[f"m{i}"]} for i in range(len(settings))]


def _toxic_part(texts: list[str], marked: set[bytes]) -> bytes:
    """The toxic dictionary, from the marked passages of toxic texts."""
    passages = [b"".join(sorted(_passages(t, marked))) for t in texts]
    passages = [p for p in passages if len(p) >= 8]
    again = max(1, 3000 // max(1, len(passages)))
    return _trained(TOXIC_BYTES, passages * again, k=64, d=6) if passages else b""


def fit(spark: SparkSession, toxic: list[str], ordinary: list[str], windows: int = 40_000) -> Model:
    """A model from texts of both kinds. Without either kind nothing is toxic to it.

    The ordinary dictionary is trained on every k-th ordinary window, for the largest k that leaves
    ``windows`` of them: all where there are fewer than twice as many.
    """
    if not toxic or not ordinary:
        return Model(b"", b"")
    spread = [w for text in ordinary for w in _windows(text)]
    spread = spread[::max(1, len(spread) // windows)]
    plain = _trained(ORDINARY_BYTES, spread)
    kinds = [_apart(ordinary), _apart(toxic)]
    rows = [(text, kind * FOLDS + i % FOLDS) for kind, texts in enumerate(kinds) for i, text in enumerate(texts)]
    kept = spark.createDataFrame(pd.DataFrame(rows, columns=["text", "kind"]), "text string, kind int")
    sizes = [[len(texts[f::FOLDS]) for f in range(FOLDS)] for texts in kinds]
    marked = marks(kept.repartition(spark.sparkContext.defaultParallelism), sizes[1], sizes[0])
    ordinary, toxic = kinds
    x, y = [], []
    for fold in range(FOLDS):
        rest = [t for i, t in enumerate(toxic) if i % FOLDS != fold]
        own = [texts[fold::FOLDS] for texts in (toxic, ordinary)]
        x.append(Model(plain, _toxic_part(rest, marked[fold])).features(own[0] + own[1]))
        y.append(np.repeat([1.0, 0.0], [len(own[0]), len(own[1])]))
    model = Model(plain, _toxic_part(toxic, marked[-1]))
    model.weights = _regression(np.concatenate(x), np.concatenate(y))
    return model


def learn(
    docs: DataFrame, labels: DataFrame, toxic_rows: int = 1200, ordinary_rows: int = 2400,
    longest: int = 65536, windows: int = 40_000, most_bytes: int = 48 << 20,
) -> Model:
    """Fit a model on labelled texts that are not held out.

    The sample is the first ``toxic_rows`` and ``ordinary_rows`` documents by a hash of their id,
    less those without text or with more than ``longest`` characters, and of these the first that
    have ``most_bytes`` together; these parameters bound what comes to the driver. ``windows`` bounds
    the ordinary windows trained on, as in ``fit``. A document labelled twice counts once, as toxic
    if either label says so.
    """
    marked = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    order = F.md5(F.col("doc_id").cast("string"))

    def first(value: int, rows: int) -> DataFrame:
        return marked.where(F.col("toxic") == value).orderBy(order, "doc_id").limit(rows)

    chosen = first(1, toxic_rows).unionByName(first(0, ordinary_rows))
    texts = docs.select("doc_id", "text").where(
        F.col("text").isNotNull() & (F.char_length("text") <= longest))
    # The chosen rows are bounded by the two parameters above, and repeated texts are one.
    sample = texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"])
    so_far = Window.orderBy(order, "doc_id", F.md5("text")).rowsBetween(Window.unboundedPreceding, 0)
    sized = sample.withColumn("_bytes", F.sum(F.octet_length("text")).over(so_far))
    sample = sized.where(F.col("_bytes") <= most_bytes).drop("_bytes").toPandas()
    sample["order"] = [hashlib.md5(str(i).encode()).hexdigest() for i in sample["doc_id"]]
    sample = sample.sort_values(["order", "doc_id", "text"]).drop_duplicates("text")
    return fit(docs.sparkSession, *[sample.loc[sample["toxic"] == k, "text"].tolist() for k in (1, 0)], windows)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) to every row.

    Whole texts are scored, from nothing but the text. NULL and empty texts have no window and
    get the score of a text without any sign. Columns of these names are replaced; all others
    stay.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted")])
    sent = docs.sparkSession.sparkContext.broadcast(
        (model.ordinary, model.toxic, model.weights))
    at = docs.columns.index("text")
    schema = T.StructType([
        *docs.schema.fields, T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType()),
    ])

    def run(batches):
        ready = Model(*sent.value)
        for batch in batches:
            texts = batch.column(at).fill_null("").to_pylist()
            found = ready.scores(texts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found), pa.array((found >= threshold).astype(np.int32))],
                names=[*batch.schema.names, "score", "predicted"],
            )

    return docs.mapInArrow(run, schema)
