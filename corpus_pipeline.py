"""A training corpus from raw documents, in five stages of the operators of lodestone.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept;
all but the last return the columns of documents. Nulls, empty tables and repeated rows
are treated as the operators' docstrings say; of rows equal in doc_id and text one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, mixing, near, quality, substring
from lodestone.llm.common import dropped, fold, saved, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = table(spark, sf_dir, "labels").where(fold() % 3 != 1).select("doc_id", F.col("quality").alias("label"))
    return quality.keep(docs, quality.fit(docs, labels))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least doc_id."""
    return near.keep(docs)


def unused(docs: DataFrame, name: str) -> str:
    """A column name like this one that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that repeat are cut out; n_chars follows. Texts without repeats
    stay as they are, and documents of which nothing is left go."""
    words, removed = unused(docs, "n_words"), unused(docs, "n_removed")
    cut = substring.cut(docs, words, removed)
    left = cut.where((F.col(removed) == 0) | (F.col(removed) < F.col(words)))
    if "n_chars" in docs.columns:
        n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
        left = left.withColumn("n_chars", F.when(F.col(removed) > 0, n_chars).otherwise(F.col("n_chars")))
    return left.drop(words, removed)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, and how many of their words, repeats counted."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing sources to target weights", mix_stage),
]

#: The classifier's weights are learned, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet, read again and
    deleted after the next."""
    docs, old = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "pipeline")
        dropped(*old)
        old = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
