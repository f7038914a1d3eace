"""The registered queries of the ten operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import language_id, packing, pii, quality_rules, sentencepiece_bpe, simhash, token_counts, token_files, topk, toxicity
from cellweave.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(parts: int) -> Column:
    """crc32 of doc_id as text, mod parts; -1 for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % parts, F.lit(-1).cast("long"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, read(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.digests(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), window=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    counts = [pii.count_of(kind).alias(f"n_{kind}") for kind in pii.KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(pii.all_spans()).alias("spans"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    profiles = language_id.fit(docs.where(fold(4) != 2))
    return language_id.predict(docs, profiles).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(read(spark, sf_dir, "documents"), ngram=4, limit=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)
    return token_files.read_digests(files)


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), k=10, every=100)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").where(fold(3) != 1))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_quality_rules, op2_sentencepiece, op3_packing, op4_pii, op5_language_id, op6_simhash, op7_token_counts, op8_token_files, op9_top_k, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    """Learned, tokenizing, hashing and iterative operators have no SQL: tests hold them against brute force."""
    return {
        "op9_top_k": """
            WITH v AS (
                SELECT row_number() OVER () AS uid, vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS e
                FROM embeddings
                WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
            ),
            s AS (
                SELECT q.uid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
                FROM v q JOIN v c ON q.uid <> c.uid
                WHERE q.vec_id % 100 = 0
            ),
            r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS rank FROM s)
            SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
        """,
    }
