"""The registered queries of the operators for training data, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, html, jaccard, langid, media, mixing, packing, quality, sharding, suffix_dedup
from .common import held_out, tuned

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    langs, probs = langid.train(docs.where(~held_out(F.col("doc_id"))), "doc_id", "text", "lang", PIECES)
    found = langid.identify(docs, "doc_id", "text", langs, probs, PIECES)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), "doc_id", "text", WORD_BPE, 2048, 0)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(_table(spark, sf_dir, "documents"), "doc_id", "text", 200, with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    known = labels.where("quality is not null").where(~held_out(F.col("doc_id"))).select("doc_id", "quality")
    seen = quality.described(docs, "doc_id", "text")
    scored = quality.score(seen, "doc_id", quality.fit(seen.join(known, "doc_id"), "quality"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), "doc_id", "text", "source", max_repeats=4.0)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"), "page_id", "url", "html")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"), "doc_id", "text", width=4, share=(85, 100))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(_table(spark, sf_dir, "documents"), "doc_id", "text")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign_shards(_table(spark, sf_dir, "documents"), "doc_id", 16, "text")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ann.build(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = index.rows.where("id % 100 = 0").select("id", "v")
    return ann.search(index, queries, 10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_best_fit_packing, op3_suffix_dedup, op4_quality, op5_mixing, op6_html_extraction, op7_ngram_jaccard, op8_media, op9_sharding, op10_nearest)
}
#: None of these can be told in DuckDB's SQL (CRC-32, tokenizers, fitted models, files); tests/llm/test_queries.py holds
#: the rows of each against brute force.
ORACLES: dict[str, str] = {}
