"""Vocabularies, and token streams as ids at dense positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents whose counts are added up in one window of the running offset.
DOC_BLOCK = 100_000


def build_vocab(tokens: DataFrame, max_size: int = 4000, min_count: int = 5) -> DataFrame:
    """(id, word, n): the commonest words, ties in code point order; id 0 is the commonest."""
    return commonest(tokens.groupBy(F.col("token").alias("word")).agg(F.count(F.lit(1)).alias("n")), max_size, min_count)


def commonest(counted: DataFrame, max_size: int, min_count: int) -> DataFrame:
    top = counted.where(F.col("n") >= min_count).orderBy(F.desc("n"), "word").limit(max_size)
    # at most max_size rows reach this one-partition window
    return top.select((F.row_number().over(Window.orderBy(F.desc("n"), "word")) - 1).alias("id"), "word", "n")


def narrowed(vocab: DataFrame, size: int) -> DataFrame:
    """A smaller vocabulary of the same corpus is a prefix."""
    return vocab.where(F.col("id") < size)


def encode(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """(gpos, doc_ord, dpos, id): tokens outside the vocabulary go, gaps close, documents follow each other.

    The vocabulary's size is bounded by its limit, so it is broadcast. Positions are a row number in
    the document plus an offset, a running total of the documents' counts in blocks of documents.
    """
    kept = tokens.join(F.broadcast(vocab.select(F.col("word").alias("token"), "id")), "token")
    placed = kept.withColumn("dpos", F.row_number().over(Window.partitionBy("doc_ord").orderBy("pos")).cast("long") - 1)
    return placed.join(doc_offsets(kept), "doc_ord").select((F.col("before") + F.col("dpos")).alias("gpos"), "doc_ord", "dpos", "id")


def doc_offsets(kept: DataFrame) -> DataFrame:
    """(doc_ord, before): tokens in all documents before this one."""
    per = kept.groupBy("doc_ord").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.floor(F.col("doc_ord") / DOC_BLOCK))
    base = per.groupBy("block").agg(F.sum("n").alias("t"))
    base = base.select("block", F.coalesce(F.sum("t").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = Window.partitionBy("block").orderBy("doc_ord").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("inner", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(base, "block").select("doc_ord", (F.col("base") + F.col("inner")).alias("before"))


def coverage(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """(kept, total, share) of tokens inside the vocabulary."""
    marked = tokens.join(F.broadcast(vocab.select(F.col("word").alias("token"), F.lit(1).alias("known"))), "token", "left")
    return marked.agg(F.count("known").alias("kept"), F.count(F.lit(1)).alias("total")).withColumn("share", F.col("kept") / F.greatest("total", F.lit(1)))
