"""The registered queries of the subpackage; each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

VOCABULARY = "byte_bpe_50k.json"


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_join

    return ngram_join.ngram_jaccard_join(shared.documents(spark, sf_dir), n=4, percent=85).drop("class_id")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    out = decontam.decontaminate(shared.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.drop("spans", "items")


def op3_media_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ogg

    return ogg.media_features(ogg.media_column(shared.documents(spark, sf_dir)))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the pages that no rule settles, labelled by words in their host names."""
    from . import url_filter

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host, path = url_filter.host_and_path(F.col("url"))
    free = pages.select("url", host.alias("host"), path.alias("path")).where(url_filter.rule_of(F.col("host"), F.col("path"))[0].isNull())
    model = url_filter.train(free.select("url", url_filter.seed_label(F.col("host")).alias("label")))
    return url_filter.judge(pages, model).drop("block_score")


#: Stands for the secret key that a deployment passes to the operator.
PII_KEY = b"a key for tests only"


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.replace_pii(shared.documents(spark, sf_dir), PII_KEY).select("doc_id", "text", "pii_types", "pii_count")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_output

    docs = shared.documents(spark, sf_dir)
    written = token_output.write_tokens(docs, shared.shared_dir(spark), public_tokenizers.path(VOCABULARY), end_id=2)
    return token_output.read_tokens(spark, written).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = shared.documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels.where(quality.fold(F.col("doc_id"), 4) != 2))
    out = quality.score(docs, model)
    return out.select("doc_id", (quality.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    out = packing.pack(shared.documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), end_id=1)
    return out.drop("ids")


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm

    return lm.lm_scores(shared.documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_count

    out = token_count.token_counts(shared.documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))
    return out.withColumn("over_limit", F.col("n_tokens") > 512)


def queries() -> dict:
    return {f.__name__: f for f in (op1_ngram_jaccard, op2_decontaminate, op3_media_ogg, op4_url_filter, op5_pii, op6_token_output, op7_quality, op8_packing, op9_lm_scores, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {}
