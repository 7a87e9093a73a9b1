"""From raw documents to encoded training data, in five stages over the operators of foliant.llm.

Every stage takes all documents that the one before it kept and, but for the last, returns the
columns of ``documents``. What a stage returns is written as Parquet and read again, so a lost
executor repeats part of one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import jaccard, mixing, pieces, secrets, toxicity
from foliant.llm.shared import configure, stored

# Columns that stages read or change.
OWN = ("doc_id", "text", "lang", "source", "n_chars")

# No SQL states a learnt model or a lattice search; tests compare with brute force.
ORACLE_SQL = None


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` with all further columns in one, so that no operator's own columns take their names."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in OWN]
    own = [c for c in docs.columns if c in OWN]
    return docs.select(*own, F.struct(*rest).alias("_extra")) if rest else docs


def unpacked(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from what a stage made of ``packed(docs)``."""
    return df.select(*[F.col(c) if c in OWN else F.col(f"_extra.`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not found toxic. The model is fitted on labelled documents among them."""
    configure(spark)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return unpacked(toxicity.score(packed(docs), model).where("predicted = 0"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group linked by five-word n-grams at 0.8.

    Documents without an id or without words are groups of their own. Rows of one id are one
    document and stay or go together.
    """
    configure(spark)
    groups = jaccard.link_groups(docs, n=5, over=80, under=100)
    copies = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return unpacked(packed(docs).join(copies, "doc_id", "left_anti"), docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and ``n_chars`` counted anew where a text changed."""
    configure(spark)
    found = secrets.scan(packed(docs))
    changed = F.size("spans") > 0
    text = secrets.redacted(F.col("text"), F.col("spans"))
    masked = found.select(*packed(docs).columns, changed.alias("_changed"), text.alias("_text"))
    n_chars = F.when(F.col("_changed"), F.char_length("_text").cast("long")).otherwise(F.col("n_chars"))
    return unpacked(masked.withColumns({"text": F.col("_text"), "n_chars": n_chars}), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix of sources takes them, up to two times."""
    configure(spark)
    return unpacked(mixing.mixed_documents(packed(docs)), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text with the next best segmentations; the text itself is left out."""
    configure(spark)
    return pieces.encode(docs).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
    ("pieces", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
