"""Document fingerprints from closed syncmers.

A k-mer of K characters is a closed syncmer if the smallest hash among its inner S-mers stands at
its first or last place. That depends on the k-mer alone, so equal passages give equal anchors
wherever they stand, and anchors with their places align texts. A fingerprint keeps, for each of
BINS values of a hash of the anchors, the smallest other hash: texts that share a share of their
anchors agree in that share of bins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.words import mixed

K, S = 16, 4
BINS = 128
EMPTY = 0
# Characters hashed at a time; longer texts are cut, with K - 1 characters repeated.
PIECE = 1 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _anchors(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and 64-bit hashes of the closed syncmers among code points."""
    if len(codes) < K:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    wide = codes.astype(np.uint64)
    n = len(wide) - S + 1
    small = wide[:n] * _FACTOR
    for i in range(1, S):
        small += wide[i:n + i]
        small *= _FACTOR
    small = mixed(small)
    # The minimum of all inner S-mers of every k-mer, by doubling.
    width, inner, least = 1, K - S + 1, small
    while 2 * width <= inner:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < inner:
        least = np.minimum(least[:len(least) - (inner - width)], least[inner - width:])
    count = len(codes) - K + 1
    at = np.flatnonzero((small[:count] == least) | (small[inner - 1:inner - 1 + count] == least))
    hashes = small[at]
    for i in range(S, K, S):
        hashes = mixed(hashes * _FACTOR + small[at + min(i, K - S)])
    return at, hashes


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places (in code points) and hashes of a text's closed syncmers."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    parts = [_anchors(codes[i:i + PIECE + K - 1]) for i in range(0, max(1, len(codes)), PIECE)]
    return (
        np.concatenate([at + i * PIECE for i, (at, _) in enumerate(parts)]),
        np.concatenate([hashes for _, hashes in parts]),
    )


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of BINS 16-bit values per text; EMPTY where no anchor falls into the bin.

    A text without a syncmer stands for its only anchor itself; an empty text has none.
    """
    out = np.full(len(texts) * BINS, 0xFFFF + 1, np.uint32)
    for row, text in enumerate(texts):
        hashes = anchors(text)[1]
        if not len(hashes) and text:
            digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()
            hashes = np.frombuffer(digest, np.uint64)
        bins = (hashes & np.uint64(BINS - 1)).view(np.int64) + row * BINS
        np.minimum.at(out, bins, (hashes >> np.uint64(48)).astype(np.uint32) % 0xFFFF + 1)
    out[out > 0xFFFF] = EMPTY
    return out.astype(np.uint16).reshape(len(texts), BINS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of the anchors, row by row; 1 for two empty texts."""
    used = (a != EMPTY) | (b != EMPTY)
    total = used.sum(1)
    same = ((a == b) & used).sum(1)
    return np.where(total == 0, 1.0, same / np.maximum(total, 1))


def written(prints: np.ndarray) -> list[str]:
    """Fingerprints as hexadecimal strings, four digits a bin."""
    data = prints.astype(">u2").tobytes().hex()
    n = 4 * BINS
    return [data[i:i + n] for i in range(0, len(data), n)]


def aligned(text: str, other: str) -> tuple[int, int]:
    """Positional matching: the shift on which most shared anchors lie, and how many lie there.

    An anchor at place p of ``text`` on shift d stands at p + d of ``other``. (0, 0) without any.
    """
    at, hashes = anchors(text)
    other_at, other_hashes = anchors(other)
    order = np.argsort(other_hashes, kind="stable")
    left = np.searchsorted(other_hashes[order], hashes, "left")
    right = np.searchsorted(other_hashes[order], hashes, "right")
    # Repeated anchors do not place a text: only those that are single in ``other`` count.
    single = right - left == 1
    shifts, counts = np.unique(other_at[order][left[single]] - at[single], return_counts=True)
    if not len(shifts):
        return 0, 0
    best = counts.argmax()
    return int(shifts[best]), int(counts[best])


def fingerprint(docs: DataFrame) -> DataFrame:
    """Add ``fingerprint`` to every row; the text's other columns stay.

    NULL texts count as empty. Equal texts have equal fingerprints.
    """

    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(written(fingerprints(part.fillna("").tolist())))

    return docs.withColumn("fingerprint", run("text"))


def _place(doc_id: Column) -> Column:
    """Order of documents: ascending, without an id first."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))


def edited(docs: DataFrame) -> DataFrame:
    """Compare every document with an edited form of itself and with its next document.

    The next document is the one with the next ``doc_id`` (ties by text, NULL ids first, after the
    last the first). In the edited text the last quarter of the characters, rounded down, is
    replaced by as many from the beginning of the next document, or all it has. Returns
    ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited`` and ``near_next``. NULL texts count as empty; a single document is its own
    next one; an empty table gives no rows; other columns are not looked at.

    Whole texts are shuffled once, into ranges of ``doc_id``. The ranges' ends come from one pass
    over the ids; the first document of every range is sent to the range before it as well.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    place = _place(F.col("doc_id"))
    # As many numbers as a shuffle has partitions.
    ends = docs.select(place.alias("p")).agg(
        F.percentile_approx("p", [i / parts for i in range(1, parts)], 10_000).alias("e")
        if parts > 1 else F.array().cast("array<long>").alias("e")
    ).first()[0] or []
    ends = sorted(set(ends))
    bounds = F.array(*[F.lit(e).cast("long") for e in ends]).cast("array<long>")
    # The range of a document is the number of ends below its place, by bisection.
    steps = [1 << k for k in reversed(range(len(ends).bit_length()))]
    part = F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, s: F.when(F.try_element_at(bounds, at + s) < place, at + s).otherwise(at),
    )
    ranged = docs.withColumn("part", part.cast("int")) if ends else docs.withColumn("part", F.lit(0))
    firsts = ranged.groupBy("part").agg(F.min(place).alias("p")).orderBy("part").collect()
    if not firsts:
        firsts = [(0, 0)]
    # Where the first document of a range goes besides.
    before = {p: firsts[i - 1][0] for i, (_, p) in enumerate(firsts)}
    also = F.create_map(*[F.lit(x).cast(t) for p, to in before.items() for x, t in ((p, "long"), (to, "int"))])
    to = F.try_element_at(also, place)
    home = F.struct(F.col("part"), F.lit(0).alias("extra"))
    sent = ranged.select(
        "doc_id", "text",
        F.explode(F.when(to.isNotNull(), F.array(home, F.struct(to.alias("part"), F.lit(1).alias("extra"))))
                  .otherwise(F.array(home))).alias("at"),
    ).select("at.*", "doc_id", "text")
    sorted_parts = sent.repartitionById(parts, F.pmod("part", F.lit(parts)).cast("int")).sortWithinPartitions(
        "part", "extra", _place(F.col("doc_id")), "text")

    def run(batches):
        held = None
        for batch in batches:
            part = batch.column(0).to_pylist()
            extra = batch.column(1).to_pylist()
            ids, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            prints = fingerprints(texts)
            rows = list(zip(part, extra, ids, texts, prints))
            if held:
                rows.insert(0, held)
            out = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1] and a[0] == b[0]]
            held = rows[-1] if rows else held
            if out:
                yield _compared(out)

    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    return sorted_parts.mapInArrow(run, schema)


def _compared(pairs: list) -> pa.RecordBatch:
    texts = [a[3] for a, _ in pairs]
    cuts = [len(t) // 4 for t in texts]
    changed = [t[:len(t) - c] + b[3][:c] for t, c, (_, b) in zip(texts, cuts, pairs)]
    own = np.stack([a[4] for a, _ in pairs])
    following = np.stack([b[4] for _, b in pairs])
    new = fingerprints(changed)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([a[2] for a, _ in pairs], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
            pa.array(written(own)), pa.array(written(new)),
            pa.array(likeness(own, new)), pa.array(likeness(own, following)),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
         "near_next"],
    )
