"""The corpus pipeline: language ID, near duplicates, repeated passages, source mixture, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; all but the last
return the columns of documents. run() writes each stage's result in the shared folder and reads it again. For all
stages: an empty table gives no rows; extra columns, whatever their names, are not carried on; texts of any length are
taken whole; nulls may stand in any column, as the stages say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import jaccard, langid, mixing, packing, suffix_dedup
from marlstone.llm.common import stored, tuned
from marlstone.llm.queries import PIECES, WORD_BPE

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Set lang to the predicted language; documents without a language go: null texts and texts without a letter.

    Any text with a letter is in some language and stays, whatever its score. A null lang only keeps a row out of the
    fit; without any known lang nothing can be predicted and all rows go. Ties go to the language that sorts first.
    Repeated rows and null ids stay as they are.
    """
    tuned(spark)
    langs, probs = langid.train(docs, "doc_id", "text", "lang", PIECES)
    found = langid.identify(docs, "doc_id", "text", langs, probs, PIECES, keep=("text", "source", "n_chars"))
    return found.where("lang_pred <> 'und'").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 0.8 Jaccard similarity of five-word shingles, the one with the smallest id stays.

    Of rows that are equal in all columns one stays. Rows with one id but different values stay or go together: they stay
    if one of them stands for its group. Rows with a null id have no group and all stay; null and empty texts are linked
    with nothing and stay.
    """
    tuned(spark)
    groups = jaccard.near_duplicates(docs, "doc_id", "text", width=5, share=(80, 100))
    stay = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.select(*COLUMNS).join(stay, "doc_id", "left_semi").withColumn("_row", F.xxhash64(*COLUMNS)).dropDuplicates(["doc_id", "_row"])
    return kept.select(*COLUMNS).union(docs.select(*COLUMNS).where("doc_id is null"))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out every 200-byte string that occurs again, every occurrence; what is left of a cut text stays unless blank.

    Texts that were not cut stay, blank ones too; a null text becomes empty. n_chars is counted anew. Repeated rows repeat
    each other and are cut whole; a null id is allowed. Where a string ends inside a character, that character stays.
    """
    tuned(spark)
    spans = suffix_dedup.repeated_spans(suffix_dedup.keyed(docs, "doc_id", "text"))
    clean = suffix_dedup.apply_spans(docs, "doc_id", "text", spans, keep=("lang", "source"))
    clean = clean.where((F.col("n_removed") == 0) | (F.trim("kept_text") != ""))
    return clean.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("bigint").alias("n_chars"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and those of small sources up to four times, in a temperature mixture.

    Null sources form one source; null and empty texts have no tokens and stay once, or as often as their source is used
    whole. Repeated rows are used each.
    """
    tuned(spark)
    return mixing.mix(docs, "doc_id", "text", "source", max_repeats=4.0, keep=("text", "lang", "n_chars")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row per piece of a document, with the document's id.

    A null or empty text is its end token alone. Repeated rows and null ids are packed like any others; pieces of equal
    length may change places.
    """
    tuned(spark)
    return packing.pack(docs, "doc_id", "text", WORD_BPE, 2048, 0)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_array_dedup", suffix_array_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Fitted models, suffix arrays and tokenizers can't be told in SQL; tests/llm/test_pipeline.py holds each stage's rows
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
