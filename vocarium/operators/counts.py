"""Windowed co-occurrence as whole numbers: a neighbour at distance d weighs L / d, with L = lcm(1..window)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions in one block; a block also gets the window before it, so blocks are counted apart.
BLOCK = 1 << 15


def unit_weight(window: int) -> int:
    return math.lcm(*range(1, window + 1))


def cooccurrence(ids: DataFrame, window: int = 4, harmonic: bool = True, min_weight: float = 0.0, per_document: bool = False) -> DataFrame:
    """(i, j, wl, w): symmetric cells; w = wl / L. Windows cross documents unless ``per_document``.

    One shuffle brings a block's positions together, one adds up unordered pairs; the mirror image
    is made from the sums, and equal ids count twice on the diagonal.
    """
    return mirrored(unordered(ids, window, harmonic, per_document).groupBy("a", "b").agg(F.sum("wl").alias("wl")), unit_weight(window), min_weight)


def unordered(ids: DataFrame, window: int, harmonic: bool, per_document: bool = False, across: bool = False) -> DataFrame:
    """(a, b, wl), a <= b, of every two tokens in a window; with ``across``, of two documents only."""
    unit = unit_weight(window)
    pos, group = ("dpos", ["doc_ord"]) if per_document else ("gpos", [])
    block = F.floor(F.col(pos) / BLOCK)
    base = ids.select("doc_ord", F.col(pos).alias("p"), "id", block.alias("block"))
    halo = base.where(F.col("p") % BLOCK >= BLOCK - window).withColumn("block", F.col("block") + 1)
    both = base.withColumn("own", F.lit(True)).unionByName(halo.withColumn("own", F.lit(False)))
    w = Window.partitionBy(*group, "block").orderBy("p")
    left = lambda d: F.when(F.lag("doc_ord", d).over(w) != F.col("doc_ord"), F.lag("id", d).over(w)) if across else F.lag("id", d).over(w)
    near = F.array(*[F.struct(F.lit(unit // d if harmonic else unit).cast("long").alias("wl"), left(d).alias("left")) for d in range(1, window + 1)])
    pairs = both.select("id", "own", near.alias("near")).where("own").select("id", F.explode("near").alias("x")).where("x.left is not null")
    return pairs.select(F.least("id", "x.left").alias("a"), F.greatest("id", "x.left").alias("b"), "x.wl")


def mirrored(sums: DataFrame, unit: int, min_weight: float) -> DataFrame:
    """Both cells of each unordered pair's sum."""
    sums = sums.withColumn("wl", F.when(F.col("a") == F.col("b"), 2 * F.col("wl")).otherwise(F.col("wl")))
    if min_weight > 0:
        sums = sums.where(F.col("wl") >= F.lit(unit * min_weight))
    ends = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")))).otherwise(F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")), F.struct(F.col("b").alias("i"), F.col("a").alias("j"))))
    return sums.select("wl", F.explode(ends).alias("c")).select("c.i", "c.j", "wl", (F.col("wl") / F.lit(float(unit))).alias("w"))


def density(cells: DataFrame, size: int) -> DataFrame:
    return cells.agg(F.count(F.lit(1)).alias("nnz")).withColumn("density", F.col("nnz") / F.lit(max(1, size * size)))
