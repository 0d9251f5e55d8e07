"""The corpus pipeline: quality rules, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of `documents`, whatever their names. What holds for every stage: rows without a doc_id can't be told
apart by any stage and leave with the first; rows that repeat a doc_id are judged and cut each by its
own text, except that the near-duplicate join takes them for one document; texts of any length are
read whole; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import ngram_join, packing, quality_rules, substring_dedup
from lumenfold.llm.base import fresh, written
from lumenfold.llm.numbering import keyed


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in the one column of ids."""
    key = fresh("__id", *docs.columns)
    return docs.join(ids.toDF(key).distinct(), F.col("doc_id").cast("long") == F.col(key), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their language's fertility bands reject go; null and empty texts are
    among them. Rows that repeat an id are judged each by its own text. Equal texts of a language are judged alike."""
    key = fresh("__key", *docs.columns)
    own = keyed(docs, key)
    named = own.rows.select(F.col(key).alias("doc_id"), "text", *(["lang"] if "lang" in docs.columns else []))
    kept = quality_rules.judged(named).where("kept").select(F.col("doc_id").alias(key)).distinct()
    return own.rows.join(kept, key, "left_semi").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles at Jaccard 0.8: of documents that links connect, the smallest doc_id stays. Texts
    without words link with nothing and stay. Rows that repeat an id are one document here, of their different
    texts with a line break between them, so that shingles also run from one to the next; they stay or go together."""
    return _only(docs, ngram_join.joined(docs).where("component_id = doc_id").select("doc_id"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 13 words that a smaller doc_id also has are cut from `text`; n_chars follows. Null texts and
    those of fewer words stay as they are. Rows that repeat an id never count as each other's copies, and each is
    cut by its own text's repeats."""
    cut = substring_dedup.rewritten(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(cut.schema["n_chars"].dataType)) if "n_chars" in cut.columns else cut


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents left, in sequences of at most 2048 tokens. A null or empty text is its end id alone;
    rows that repeat an id are packed each on its own; pieces of equal length take places by id."""
    return packing.packed(docs)


STAGES = [("quality_rules", quality), ("ngram_join", near_duplicates), ("substring_dedup", repeated_passages), ("packing", packed)]

#: Neither token ids nor the packing plan can be had in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
