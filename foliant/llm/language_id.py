"""Language identification with hyperdimensional profiles.

Every letter has a random vector of signs. An n-gram's vector binds those of its letters, each
rotated by its place, by multiplication; a text's vector bundles its n-grams' by summing them as
often as they occur; a language's prototype bundles the unit vectors of its texts. A text has the
language whose prototype is nearest by cosine.

Letters are those of Unicode, in lower case; whatever stands between them counts as one gap. A
letter's signs follow from its code point alone, so every task makes the same ones.

Prototypes are sums, so learning is one pass with a partial sum per language and batch; what reaches
the driver is one vector per language. Prediction is one pass in the tasks, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 1024
NGRAM = 3
SEED = 20
UNKNOWN = "und"
# Code points read at a time, n-grams bound at a time, and texts bundled together.
PIECE, BOUND, TOGETHER = 1 << 20, 2048, 64
# Texts that a language's prototype is made of, about, and how many languages are learnt.
TEXTS, LANGUAGES = 4000, 250
# Bits that hold a code point.
_BITS = 21
_LETTERS: dict[int, np.ndarray] = {}
_ALPHABET: dict[int, bool] = {}


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from; a NULL id is none of them, though it is not learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def letter_vector(code: int) -> np.ndarray:
    """The signs of a letter, or of the gap between words, which is code 0."""
    if code not in _LETTERS:
        if len(_LETTERS) >= 1 << 14:
            _LETTERS.clear()
        signs = np.random.Generator(np.random.PCG64([SEED, code])).integers(0, 2, DIMENSIONS, np.int8)
        _LETTERS[code] = signs * 2 - 1
    return _LETTERS[code]


def _is_letter(codes: np.ndarray) -> np.ndarray:
    """Which of these distinct code points are letters."""
    if len(_ALPHABET) > 1 << 16:
        _ALPHABET.clear()
    found = np.empty(len(codes), bool)
    for i, code in enumerate(codes.tolist()):
        if code not in _ALPHABET:
            _ALPHABET[code] = chr(code).isalpha()
        found[i] = _ALPHABET[code]
    return found


def _symbols(text: str) -> Iterator[np.ndarray]:
    """Letters and gaps of a text that begins and ends with a gap, in pieces that overlap by two."""
    before = np.zeros(1, np.int64)
    for at in range(0, len(text), PIECE):
        raw = np.frombuffer(text[at:at + PIECE].lower().encode("utf-32-le"), np.uint32).astype(np.int64)
        kinds, which = np.unique(raw, return_inverse=True)
        codes = np.where(_is_letter(kinds)[which], raw, 0)
        codes = np.concatenate([before, codes])
        codes = codes[np.concatenate([np.ones(len(before), bool), (codes[len(before):] > 0) | (codes[len(before) - 1:-1] > 0)])]
        yield codes
        before = codes[-(NGRAM - 1):]
    yield np.concatenate([before, np.zeros(1, np.int64)]) if before[-1] else before


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text, each as one number, and how often it has them. No letter, no n-gram."""
    found = []
    for codes in _symbols(text or ""):
        if len(codes) >= NGRAM and codes.any():
            key = np.zeros(len(codes) - NGRAM + 1, np.int64)
            for k in range(NGRAM):
                key = key << _BITS | codes[k:len(codes) - NGRAM + 1 + k]
            # Two numbers at least of three are letters: a gap has letters on both sides.
            found.append(np.unique(key, return_counts=True))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(found) == 1:
        return found[0]
    keys, inverse = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([n for _, n in found])).astype(np.int64)


def bind(keys: np.ndarray) -> np.ndarray:
    """Vectors of n-grams: the product of their letters' vectors, rotated by their place."""
    vectors = np.ones((len(keys), DIMENSIONS), np.int8)
    for k in range(NGRAM):
        codes, which = np.unique(keys >> _BITS * (NGRAM - 1 - k) & (1 << _BITS) - 1, return_inverse=True)
        letters = np.stack([np.roll(letter_vector(c), NGRAM - 1 - k) for c in codes.tolist()])
        vectors *= letters[which]
    return vectors


def bundle(texts: list[str | None]) -> np.ndarray:
    """One unit vector per text; nothing but zeros for a text without letters."""
    grams = [ngrams(text) for text in texts]
    sums = np.zeros((len(texts), DIMENSIONS))
    owners = np.repeat(np.arange(len(texts)), [len(keys) for keys, _ in grams])
    if len(owners):
        counts = np.concatenate([n for _, n in grams])
        distinct, which = np.unique(np.concatenate([keys for keys, _ in grams]), return_inverse=True)
        order = np.argsort(which, kind="stable")
        owners, counts, which = owners[order], counts[order], which[order]
        for at in range(0, len(distinct), BOUND):
            part = slice(*np.searchsorted(which, [at, at + BOUND]))
            have = np.zeros((len(texts), min(BOUND, len(distinct) - at)), np.float32)
            have[owners[part], which[part] - at] = counts[part]
            sums += have @ bind(distinct[at:at + BOUND]).astype(np.float32)
    length = np.sqrt((sums * sums).sum(1, keepdims=True))
    return sums / np.where(length > 0, length, 1)


def prototypes(docs: DataFrame, texts: int = TEXTS, languages: int = LANGUAGES) -> list[tuple[str, list[float]]]:
    """A unit vector for each language in ``lang``, from documents that are not held out.

    Of a language with more than ``texts`` documents, those are bundled whose id's hash falls below
    its share, so that about ``texts`` of them are; of more than ``languages`` languages those with
    the most documents are learnt, ties by name. These parameters bound what is learnt from. NULL texts, NULL
    languages, NULL ids and texts without a letter teach nothing.
    """
    # A NULL id has no hash, and so is not known not to be held out.
    known = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(
        "lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, texts / r["count"]))])
    place = (F.xxhash64("doc_id") % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003
    sample = known.where(place < F.try_element_at(share, F.col("lang"))).select("lang", "text")

    def learn(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, words = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(langs), TOGETHER):
                vectors = bundle(words[at:at + TOGETHER].to_pylist())
                for lang, vector in zip(langs[at:at + TOGETHER], vectors):
                    sums[lang] = sums[lang] + vector if lang in sums else vector
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
            names=["lang", "vector"])

    parts = sample.mapInArrow(learn, "lang string, vector array<double>")
    total = parts.select("lang", F.posexplode("vector").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    found: dict[str, np.ndarray] = {}
    for lang, k, x in total.collect():
        found.setdefault(lang, np.zeros(DIMENSIONS))[k] = x
    lengths = {lang: float(np.sqrt(v @ v)) for lang, v in found.items()}
    return [(lang, (found[lang] / lengths[lang]).tolist()) for lang in sorted(found) if lengths[lang] > 0]


def predict(docs: DataFrame, learnt: list[tuple[str, list[float]]]) -> DataFrame:
    """Add ``lang_pred`` and ``score``, the cosine with that language's prototype, 0 at least.

    Every text is read whole, and nothing but the text. NULL texts and texts without a letter are
    ``und`` with 0, as is every text where no language was learnt; ties go to the language that is
    first by code point. Columns of these names are replaced, all others stay.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score")])
    sent = docs.sparkSession.sparkContext.broadcast(learnt)
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def run(batches):
        names = np.array([lang for lang, _ in sent.value] + [UNKNOWN], object)
        profiles = np.array([v for _, v in sent.value]).reshape(-1, DIMENSIONS).T
        for batch in batches:
            langs, scores = [], []
            for k in range(0, batch.num_rows, TOGETHER):
                vectors = bundle(batch.column(at)[k:k + TOGETHER].to_pylist())
                # Rounded, so that a tie does not hang on the order of sums.
                near = np.column_stack([np.round(vectors @ profiles, 9), np.full(len(vectors), -2.0)])
                best = np.where(vectors.any(1), near.argmax(1), len(names) - 1)
                langs += names[best].tolist()
                scores += np.clip(near[np.arange(len(best)), best], 0, 1).tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)
