"""Counts of a growing corpus: a stream of documents adds to tables keyed by word.

Ids are ranks and change as text arrives, so running counts are kept by word, as whole numbers that
can be added. Windows stay inside documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import token_array
from ..operators.counts import unit_weight


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) of a streaming or static table."""
    return docs.select(F.explode(token_array(F.col(text_col))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def pair_counts(docs: DataFrame, window: int = 4, text_col: str = "text") -> DataFrame:
    """(a, b, wl) of unordered word pairs by whole-number harmonic weights; narrow up to the sum."""
    unit = unit_weight(window)
    t = docs.select(token_array(F.col(text_col)).alias("t"))
    near = F.flatten(F.transform("t", lambda w, k: F.transform(F.slice(F.col("t"), F.greatest(k + 1 - window, F.lit(1)), F.least(k, F.lit(window))), lambda x, m: F.struct(F.least(w, x).alias("a"), F.greatest(w, x).alias("b"), (F.lit(unit) / (F.least(k, F.lit(window)) - m)).cast("long").alias("wl")))))
    return t.select(F.explode(near).alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.wl").alias("wl"))


def accumulate(stream: DataFrame, table: str, checkpoint: str, text_col: str = "text", **trigger):
    """Start a query that keeps word counts as one Parquet part a batch; ``current`` adds them up.

    A batch that is tried again writes its own part again, so each batch counts once.
    """

    def batch(df: DataFrame, number: int) -> None:
        word_counts(df, text_col).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(table).groupBy("word").agg(F.sum("n").alias("n"))
