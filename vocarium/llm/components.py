"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import shared


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(a, b) to (id, component): the smallest id reachable, for every id with a link.

    Every step is a grouped minimum, which combines before the shuffle, and a join back. Each round
    is written to the shared folder, so lineage stays short and lost executors cost one round; the
    count and sum that tell whether it changed anything are taken while it is written.
    """

    def marked(e: DataFrame) -> tuple[DataFrame, dict]:
        mark = Observation()
        return shared.saved(e.observe(mark, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))), mark.get

    now, seen = marked(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        if not seen["n"]:
            break
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        last = seen
        now, seen = marked(small.where("a <> b").distinct())
        if last == seen:
            break
    else:
        raise RuntimeError("components still change")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
