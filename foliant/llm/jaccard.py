"""Similarity join of texts on word n-grams, and the groups of texts it links.

A text is the set of its n-grams. All sets are ordered rarest first. Two sets whose Jaccard
similarity reaches the threshold then share one of their first n-grams, so only those are joined.
Before a pair is compared in full it must pass three filters on what the join knows: the lengths
differ little enough, the places of the shared n-gram leave enough of both sets, and the sets
differ in few enough of the parts that they are cut into by hash, some hundred or, for large sets,
half as many as n-grams. A part is known by whether it has an odd number of n-grams; each part in
which two sets differ in that holds an n-gram that only one of them has, which bounds their
distance from below as the halves of a suffix filter do.

Rarity is a count per cell of hashed n-grams over the whole table, of a fixed number of cells, so
it can be sent to every task at any size of input. It only orders n-grams; any order gives the same
pairs.

Groups of many near copies would make pairs without end. Equal sets are one node from the start.
Then every n-gram's sets are compared with its shortest and its longest set only, and groups are
formed; after that only pairs are compared whose sets are in different groups. What is left out
could only link what is linked. ``link_counts`` needs every link, so it compares those pairs too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.shared import components, stored
from foliant.llm.words import NON_SPACE, Words, blocks, mixed, sequences

CELL_BITS = 17
# Sets of an n-gram that are compared with each other and not first with the one most like them all.
FEW = 16
# 64-bit words with a bit for each part of a set, at least.
PART_WORDS = 8
# Documents are looked up by so many values of a hash of their id; the list of values is broadcast.
LOOKUP = 1 << 18
_SECOND = np.uint64(0x5851F42D4C957F2D)


def ngram_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct 64-bit n-gram hashes of every text that has words.

    A text of fewer than ``n`` words has one n-gram, the whole sequence.
    """
    for row, end, data, offsets in blocks(texts):
        words = Words(data, offsets, True, NON_SPACE)
        hashes = words.hashes()
        grams = sequences(hashes, n)
        for i in range(end - row):
            first, last = int(words.first[i]), int(words.first[i + 1])
            if last - first >= n:
                yield row + i, np.unique(grams[first:last - n + 1])
            elif last > first:
                yield row + i, sequences(hashes[first:last], last - first)


def _signed(values) -> pa.Array:
    return pa.array(np.ascontiguousarray(values, np.uint64).view(np.int64))


def _oddness(grams: np.ndarray) -> np.ndarray:
    """A bit for each part of a set, as 64-bit words: a power of two of them, by the set's size."""
    words = PART_WORDS
    while 128 * words < len(grams):
        words *= 2
    part = (grams & np.uint64(64 * words - 1)).view(np.int64)
    odd = (np.bincount(part, minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _digest(grams: np.ndarray) -> tuple[int, int]:
    return int(mixed(grams).sum()), int(mixed(grams ^ _SECOND).sum())


def _measured(docs: DataFrame, n: int) -> DataFrame:
    """A row per text: ``doc_id``, ``n``, digest ``g`` and ``g2`` of its set, oddness of
    its ``parts``; and rows with ``cell`` and ``n``: how often a cell's n-grams occur in sets."""

    def measure(batches):
        counts = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            ids = batch.column(0)
            rows = len(ids)
            size, g, g2 = np.zeros(rows, np.int64), np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
            parts = [np.zeros(0, np.int64)] * rows
            for i, grams in ngram_sets(batch.column(1), n):
                size[i] = len(grams)
                g[i], g2[i] = _digest(grams)
                parts[i] = _oddness(grams)
                np.add.at(counts, grams >> np.uint64(64 - CELL_BITS), 1)
            ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(size), _signed(g), _signed(g2), lists,
                 pa.nulls(rows, pa.int32())],
                ["doc_id", "n", "g", "g2", "parts", "cell"],
            )
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(cells), pa.int64()), pa.array(counts[cells])]
            + [pa.nulls(len(cells), pa.int64())] * 2
            + [pa.nulls(len(cells), pa.list_(pa.int64())), pa.array(cells.astype(np.int32))],
            ["doc_id", "n", "g", "g2", "parts", "cell"],
        )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        measure, "doc_id long, n long, g long, g2 long, parts array<long>, cell int"
    )


def _entries(docs: DataFrame, n: int, over: int, under: int, rarity) -> DataFrame:
    """The first n-grams of every set: ``token``, set ``g``, its size ``n``, place ``p`` from 0."""

    def emit(batches):
        counts, seen = rarity.value, set()
        for batch in batches:
            tokens, g, size, place = [], [], [], []
            for _, grams in ngram_sets(batch.column(0), n):
                digest = _digest(grams)
                if digest in seen:
                    continue
                seen.add(digest)
                first = len(grams) - (over * len(grams) + under - 1) // under + 1
                order = np.lexsort((grams, counts[grams >> np.uint64(64 - CELL_BITS)]))[:first]
                tokens.append(grams[order])
                g.append(np.full(first, digest[0], np.uint64))
                size.append(np.full(first, len(grams), np.int32))
                place.append(np.arange(first, dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [_signed(np.concatenate(tokens)), _signed(np.concatenate(g)),
                     pa.array(np.concatenate(size)), pa.array(np.concatenate(place))],
                    ["token", "g", "n", "p"],
                )

    return docs.select("text").mapInArrow(emit, "token long, g long, n int, p int")


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """``g`` and ``grams`` of every text."""

    def emit(batches):
        for batch in batches:
            g, grams = [], []
            for _, one in ngram_sets(batch.column(0), n):
                g.append(_digest(one)[0])
                grams.append(one.view(np.int64))
            if g:
                ends = np.cumsum([0, *map(len, grams)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [_signed(np.array(g, np.uint64)),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(grams)))],
                    ["g", "grams"],
                )

    return texts.select("text").mapInArrow(emit, "g long, grams array<long>")


def _pass(over: int, under: int) -> str:
    """Length and positional filter of a pair with a shared n-gram at places ap and bp."""
    return (
        f"{under} * least(an, bn) >= {over} * greatest(an, bn) AND "
        f"{over + under} * (1 + least(an - ap - 1, bn - bp - 1)) >= {over} * (an + bn)"
    )


def _near(over: int, under: int) -> str:
    """Filter on the parts of a pair: so many n-grams are in one of the sets only, or more.

    Sets that pass the length filter have equally many parts or twice as many, and twice as many
    are folded into one half.
    """
    few = " + ".join(f"bit_count(aparts[{i}] ^ bparts[{i}])" for i in range(PART_WORDS))
    words = "least(size(aparts), size(bparts))"
    a, b = (
        f"if(size({x}) = {words}, {x}[k], {x}[k] ^ {x}[cast(k + {words} as int)])" for x in ("aparts", "bparts")
    )
    many = f"aggregate(sequence(0, {words} - 1), 0, (s, k) -> s + bit_count({a} ^ {b}))"
    most = f"greatest(size(aparts), size(bparts)) = {PART_WORDS}"
    apart = f"if({most}, {few}, {many})"
    return f"{over + under} * (an + bn - ({apart})) >= {2 * over} * (an + bn)"


def _linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, over: int, under: int) -> DataFrame:
    """Those of the ``pairs`` (a, b, an, bn) that reach the threshold."""
    pairs = stored(pairs)
    asked = pairs.select(F.explode(F.array("a", "b")).alias("g")).distinct()
    wanted = stored(nodes.join(asked, "g").select("doc_id", "g"))
    # Most documents are not wanted. They are dropped before the shuffle by a list of hash values
    # with LOOKUP entries at most; it may let others pass.
    value = F.pmod(F.xxhash64("doc_id"), F.lit(LOOKUP)).alias("value")
    values = F.broadcast(wanted.select(value).distinct())
    near = docs.withColumn("value", value).join(values, "value", "left_semi").drop("value")
    sets = stored(_sets(near.join(wanted, "doc_id").select("text"), n))
    both = (
        pairs.join(sets.selectExpr("g b", "grams bgrams"), "b")
        .join(sets.selectExpr("g a", "grams agrams"), "a")
    )
    shared = F.size(F.array_intersect("agrams", "bgrams"))
    total = F.col("an") + F.col("bn") - shared
    return stored(both.where(under * shared >= over * total).select("a", "b"))


def _prepared(docs: DataFrame, n: int, over: int, under: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A row per text, a row per set, the documents that take part, and the sets' first n-grams."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    measured = stored(_measured(docs, n))
    cells = measured.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("n").alias("n"))
    # One number per cell, 2 ** CELL_BITS of them at most.
    table = cells.toPandas()
    counts = np.zeros(1 << CELL_BITS, np.int64)
    counts[table["cell"].to_numpy()] = table["n"].to_numpy()
    rarity = docs.sparkSession.sparkContext.broadcast(counts)

    texts = measured.where("cell IS NULL").drop("cell")
    nodes = (
        texts.where("n > 0 AND doc_id IS NOT NULL").groupBy("g")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("parts").alias("parts"))
    )
    nodes = stored(nodes)
    kept = docs.where("doc_id IS NOT NULL")
    entries = _entries(kept, n, over, under, rarity)
    return texts, nodes, kept, entries


def set_pairs(texts: DataFrame, nodes: DataFrame, kept: DataFrame, entries: DataFrame,
              n: int, over: int, under: int) -> DataFrame:
    """All pairs (a, b), a < b, of distinct sets that reach the threshold, each compared once.

    Takes what ``_prepared`` returns. Pairs inside a group are not left out, so a group of k near
    copies gives up to k * (k - 1) / 2 rows.
    """
    several = entries.groupBy("token").agg(F.min("g").alias("x"), F.max("g").alias("y")).where("x <> y")
    shared = entries.join(several.select("token"), "token").distinct()
    shared = stored(shared.join(nodes.select("g", "parts"), "g"))
    one, two = (
        shared.selectExpr("token", *[f"{c} {x}{c}" for c in ("g", "n", "p", "parts")]) for x in "ab"
    )
    pairs = (
        one.join(two, "token").where(f"ag < bg AND if({_pass(over, under)}, {_near(over, under)}, false)")
        .groupBy(F.col("ag").alias("a"), F.col("bg").alias("b"))
        .agg(F.first("an").alias("an"), F.first("bn").alias("bn"))
    )
    return _linked(pairs, nodes, kept, n, over, under)


def link_counts(docs: DataFrame, n: int = 5, over: int = 80, under: int = 100) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``n_links`` of every row.

    ``n_links`` is the number of other rows with a ``doc_id`` whose text reaches the threshold, equal
    sets among them; that is from all pairs of distinct sets times how many rows have a set. Texts
    without words and rows without a ``doc_id`` have no links. Texts are read as by ``link_groups``.
    """
    texts, nodes, kept, entries = _prepared(docs, n, over, under)
    pairs = set_pairs(texts, nodes, kept, entries, n, over, under)
    rows = texts.where("n > 0 AND doc_id IS NOT NULL").groupBy("g").agg(F.count(F.lit(1)).alias("rows"))
    rows = stored(rows)
    ways = pairs.union(pairs.select("b", "a")).toDF("g", "other")
    linked = (
        ways.join(rows.selectExpr("g other", "rows"), "other").groupBy("g").agg(F.sum("rows").alias("near"))
    )
    counts = rows.join(linked, "g", "left").selectExpr("g", "rows - 1 + coalesce(near, 0) n_links")
    takes_part = texts.where("n > 0 AND doc_id IS NOT NULL").join(counts, "g", "left")
    others = texts.where("NOT (n > 0 AND doc_id IS NOT NULL)").withColumn("n_links", F.lit(0).cast("long"))
    return takes_part.unionByName(others.select(*takes_part.columns)).selectExpr(
        "doc_id", "n n_shingles", "n_links")


def link_groups(docs: DataFrame, n: int = 5, over: int = 80, under: int = 100) -> DataFrame:
    """Group texts linked by a Jaccard similarity of ``over`` / ``under`` or more of word n-grams.

    ``docs`` needs ``doc_id`` and ``text``; A-Z are lower-cased and words end at white space. A row
    comes back for every row: ``doc_id``, ``n_shingles`` (size of its set) and ``component_id``,
    the smallest ``doc_id`` reachable by links. NULL, empty and blank texts have no n-grams, link
    with nothing and are their own group. A text of fewer words than ``n`` has one n-gram, all its
    words. Rows of one ``doc_id`` are one document with several texts. Rows without a ``doc_id``
    take no part and have no group. An empty table gives no rows. Other columns are not looked at.

    Equality of n-grams and of sets is that of 64-bit and 128-bit hashes.
    """
    texts, nodes, kept, entries = _prepared(docs, n, over, under)
    ends = entries.groupBy("token").agg(
        F.min(F.struct("n", "g", "p")).alias("low"), F.max(F.struct("n", "g", "p")).alias("high"),
        F.count(F.lit(1)).alias("sets"),
    ).where("low.g <> high.g")
    shared = stored(entries.join(ends, "token"))

    rule, near = _pass(over, under), _near(over, under)
    # Copies of one text share more with it than with each other, and it has the most in common with all.
    crowd = shared.where(F.col("sets") > FEW)
    standing = crowd.groupBy("g").agg(F.sum("sets").alias("standing"))
    middles = crowd.join(standing, "g").groupBy("token").agg(F.max(F.struct("standing", "n", "g", "p")).alias("_m"))
    middles = middles.select("token", F.struct("_m.n", "_m.g", "_m.p").alias("middle"))
    starred = shared.select("token", "g", "n", "p", F.array("low", "high").alias("o")).unionByName(
        crowd.select("token", "g", "n", "p").join(middles, "token").select("token", "g", "n", "p", F.array("middle").alias("o")))
    tries = starred.selectExpr("g", "n", "p", "explode(o) o").selectExpr(
        "least(g, o.g) a", "greatest(g, o.g) b", "if(g < o.g, n, o.n) an", "if(g < o.g, o.n, n) bn",
        "if(g < o.g, p, o.p) ap", "if(g < o.g, o.p, p) bp",
    )
    first = tries.where(f"a <> b AND {rule}").groupBy("a", "b").agg(
        F.first("an").alias("an"), F.first("bn").alias("bn"))
    first = (
        first.join(nodes.selectExpr("g a", "parts aparts"), "a")
        .join(nodes.selectExpr("g b", "parts bparts"), "b").where(near)
        .select("a", "b", "an", "bn")
    )
    first = stored(first)
    links = _linked(first, nodes, kept, n, over, under)
    roots = stored(components(links))

    placed = (
        shared.select("token", "g", "n", "p")
        .join(roots.withColumnRenamed("node", "g"), "g", "left")
        .withColumn("root", F.coalesce("root", "g"))
    )
    several = placed.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"))
    apart = placed.join(several.where("x <> y").select("token"), "token").distinct()
    apart = stored(apart.join(nodes.select("g", "parts"), "g"))
    one, two = (
        apart.selectExpr("token", *[f"{c} {x}{c}" for c in ("g", "n", "p", "root", "parts")])
        for x in "ab"
    )
    rest = (
        one.join(two, "token").where(f"aroot <> broot AND ag < bg AND if({rule}, {near}, false)")
        .groupBy(F.col("ag").alias("a"), F.col("bg").alias("b"))
        .agg(F.first("an").alias("an"), F.first("bn").alias("bn"))
        .join(first.select("a", "b"), ["a", "b"], "left_anti")
    )
    more = _linked(rest, nodes, kept, n, over, under)
    roots = stored(components(links.union(more)))

    # Rows of one document are linked by it, and a group's name is its smallest document.
    rows = texts.where("doc_id IS NOT NULL").join(
        roots.withColumnRenamed("node", "g"), "g", "left"
    ).withColumn("root", F.coalesce("root", "g"))
    rows = stored(rows.selectExpr("doc_id", "n", "root"))
    twice = (
        rows.where("n > 0").groupBy("doc_id").agg(F.min("root").alias("a"), F.max("root").alias("b"))
        .where("a <> b")
    )
    names = rows.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    grouped = rows.join(names, "root", "left").selectExpr(
        "doc_id", "n n_shingles", "CASE WHEN n > 0 THEN component_id ELSE doc_id END component_id"
    )
    if not twice.isEmpty():
        again = components(
            rows.where("n > 0").join(names, "root").selectExpr("doc_id a", "component_id b")
        )
        grouped = (
            grouped.join(again.selectExpr("node component_id", "root"), "component_id", "left")
            .selectExpr("doc_id", "n_shingles", "coalesce(root, component_id) component_id")
        )
    lost = texts.where("doc_id IS NULL").selectExpr("doc_id", "n n_shingles", "doc_id component_id")
    return grouped.unionByName(lost)
