"""From raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerleaf.llm import jaccard_join, mixing, packing, pii, quality
from ledgerleaf.llm.common import stored
from ledgerleaf.llm.registry import LIMITS, MASKED, PII_KEY, VOCABULARY
from ledgerleaf.sources.tables import table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list keep."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: five-word shingles, similarity of 0.8 or more."""
    return jaccard_join.one_each(docs, width=5, percent=80)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data as pseudonyms; n_chars, where there is one, follows the text."""
    changed = pii.pseudonymise(docs, PII_KEY)
    if "n_chars" not in docs.columns:
        return changed
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to their targets; a document that is taken twice goes on twice."""
    return mixing.mixed(docs, weights=(5, 2, 1), budget=1.5, max_epochs=2)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens; one row per piece."""
    pieces = packing.cut_documents(docs, VOCABULARY, length=LIMITS["length"], end_id=2, masked=MASKED, loss=LIMITS["loss_tokens"])
    return packing.pack(pieces, LIMITS, size="length")


STAGES = [("quality rules", good), ("jaccard join", distinct), ("pii", private), ("mixing", mix), ("packing", pack)]

#: Decision lists, pseudonyms and token ids are not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each one written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
