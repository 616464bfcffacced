"""One query per training-data operator, with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerleaf.llm import byte_bpe, chat, divergence, html_text, jaccard_join, licenses, mixing, packing, pii, quality, tokens, va_search, whitening
from ledgerleaf.sources.tables import table


VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

#: A sequence holds at most so many ids, pieces of documents and ids that bear loss; the first MASKED ids of a document bear none.
LIMITS = {"length": 4096, "segments": 16, "loss_tokens": 4064}
MASKED = 64

#: For these queries only; a real run brings its own secret key.
PII_KEY = b"test tables only"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_documents(table(spark, sf_dir, "documents"), VOCABULARY, length=LIMITS["length"], end_id=2, masked=MASKED, loss=LIMITS["loss_tokens"])
    return packing.pack(pieces, LIMITS, size="length")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(table(spark, sf_dir, "conversations"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = quality.measures_of(table(spark, sf_dir, "documents"))
    rules = quality.learn(measures, table(spark, sf_dir, "labels"))
    return quality.judged(measures, rules).select("doc_id", *quality.COUNTS, "base_failed", "kept", "rule", *quality.MEASURES)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = mixing.fair_queue(table(spark, sf_dir, "documents"), weights=(5, 2, 1), budget=1.5, max_epochs=2)
    return queue.select("doc_id", "size", "source_size", "target", "taken", "finish", "epochs")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("places")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), VOCABULARY, limit=2048, tables=False)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents"), width=3, percent=90)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY, count_col="n_changed")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = byte_bpe.encode(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    return byte_bpe.digests(byte_bpe.decode(ids, RANKS))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), scale=1024, shift=100_000, components=8)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=3, top=200)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_chat": op2_chat,
    "op3_quality_rules": op3_quality_rules,
    "op4_mixing": op4_mixing,
    "op5_licenses": op5_licenses,
    "op6_token_counts": op6_token_counts,
    "op7_html_text": op7_html_text,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_pii": op9_pii,
    "op10_topk": op10_topk,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_whitening": op12_whitening,
    "op13_divergence": op13_divergence,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op2_chat": chat.ORACLE,
    "op13_divergence": divergence.ORACLE,
    "op10_topk": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS ints FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.ints AS DOUBLE[]), CAST(c.ints AS DOUBLE[])) AS BIGINT) AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.ints) = len(q.ints) WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""",
}
