"""Weightings of count cells (i, j, w) to (i, j, v)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pmi(cells: DataFrame, alpha: float = 1.0, shift: float = 1.0, clip: bool = False) -> DataFrame:
    """Pointwise mutual information with context smoothing; marginals are those of the cells given.

    Marginals have one row a word, a vocabulary's worth; the total is one row.
    """
    cells = cells.where("w > 0")
    m = cells.groupBy("i").agg(F.sum("w").alias("m"))
    s = m.agg(F.sum(F.pow("m", F.lit(float(alpha)))).alias("s"))
    right = m.crossJoin(F.broadcast(s)).select(F.col("i").alias("j"), (F.lit(float(alpha)) * F.log("m") - F.log("s")).alias("context"))
    left = m.select("i", F.log("m").alias("own"))
    move = F.log(F.lit(float(shift))) if shift > 0 else F.lit(0.0)
    out = cells.join(left, "i").join(right, "j").select("i", "j", (F.log("w") - F.col("own") - move - F.col("context")).alias("v"))
    return out.where("v > 0") if clip else out


def ppmi(cells: DataFrame, alpha: float = 1.0, shift: float = 1.0) -> DataFrame:
    return pmi(cells, alpha, shift, clip=True)


def log_counts(cells: DataFrame, alpha: float = 1.0, shift: float = 1.0) -> DataFrame:
    return cells.where("w > 0").select("i", "j", F.log1p("w").alias("v"))


def raw(cells: DataFrame, alpha: float = 1.0, shift: float = 1.0) -> DataFrame:
    return cells.select("i", "j", F.col("w").alias("v"))


WEIGHTINGS: dict[str, Callable[..., DataFrame]] = {"ppmi": ppmi, "pmi": pmi, "log": log_counts, "raw": raw}
