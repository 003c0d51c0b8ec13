"""A corpus pipeline: reject poor texts, keep one of each group of near copies, drop benchmark leaks,
replace personal data, pack token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents; the last one returns the packed pieces. An empty table gives an empty
one. Rows without an id, and texts that are null, empty or blank, pass all stages. Rows that repeat are
judged each, but of equal rows with one id, near_duplicates keeps one. Other columns are left aside.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocarium.llm import decontam, ngram_join, packing, pii, quality, queries, shared

#: Ids that a broadcast may have, 8 bytes each.
SENT_IDS = 1_000_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine gives 0.7 or more, and those without any word (null, empty, blank)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels.where(quality.fold(F.col("doc_id"), 4) != 2))
    return quality.with_score(docs, model).where(F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]") | (F.col("score") >= 0.7)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group linked by five-word shingles at 0.8 or more, and of rows with that id and one
    text only one; null ids stay."""
    groups = ngram_join.ngram_jaccard_join(docs, n=5, percent=80)
    gone = shared.saved(groups.where("component_id <> doc_id").select("doc_id").distinct())
    left = docs.join(sent(gone), "doc_id", "left_anti").select(*COLUMNS)
    again = shared.saved(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null").select("doc_id"))
    if again.isEmpty():
        return left
    twice = left.join(sent(again), "doc_id", "left_semi").withColumn("k", F.xxhash64("text")).dropDuplicates(["doc_id", "k"]).drop("k")
    return left.join(sent(again), "doc_id", "left_anti").unionByName(twice.select(*COLUMNS))


def sent(ids: DataFrame) -> DataFrame:
    """Ids for a join with texts: to every worker up to SENT_IDS of them, so that texts stay where they are; else a merge join."""
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids.hint("merge")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates; n_chars follows the new text."""
    out = pii.replace_pii(docs, queries.PII_KEY)
    return out.withColumn("n_chars", F.when(F.col("pii_count") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    return packing.pack(docs, public_tokenizers.path(queries.VOCABULARY), end_id=1).drop("ids")


STAGES = [
    ("quality_filter", quality_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: Models, near copies by components and token ids are not SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.saved(docs)
    return docs
