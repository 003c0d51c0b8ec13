"""Ranks, correlation, paired tests and spreads."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_ranks(df: DataFrame, col: str, out: str) -> DataFrame:
    """Ranks from 1; equal values share their mean rank.

    Values are counted first, so the running total is over distinct values within ranges of them;
    only the ranges' totals meet in one task.
    """
    counts = df.groupBy(F.col(col).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    ranked = running_total(counts, "__v", "__n", "__before").select("__v", (F.col("__before") + (F.col("__n") + 1) / 2.0).alias(out))
    return df.join(ranked, F.col(col).eqNullSafe(F.col("__v"))).drop("__v")


def running_total(df: DataFrame, key: str, n: str, out: str, ranges: int = 64) -> DataFrame:
    """Sum of n over all rows with a smaller key; keys are distinct and can be ordered."""
    cuts = df.agg(F.percentile_approx(F.col(key).cast("double"), [k / ranges for k in range(1, ranges)], 10_000).alias("q")).select(F.array_distinct("q").alias("q"))
    part = df.crossJoin(F.broadcast(cuts)).withColumn("__r", F.coalesce(F.size(F.filter("q", lambda x: x < F.col(key).cast("double"))), F.lit(0))).drop("q")
    totals = part.groupBy("__r").agg(F.sum(n).alias("__t"))
    base = totals.select("__r", F.coalesce(F.sum("__t").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    inner = Window.partitionBy("__r").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return part.withColumn(out, F.coalesce(F.sum(n).over(inner), F.lit(0))).join(F.broadcast(base), "__r").withColumn(out, F.col(out) + F.col("__base")).drop("__r", "__base")


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """(rho, n); 0.0 for fewer than two rows or a constant side."""
    mean = df.agg(F.avg(x).alias("__mx"), F.avg(y).alias("__my"))
    c = df.crossJoin(F.broadcast(mean)).select((F.col(x) - F.col("__mx")).alias("a"), (F.col(y) - F.col("__my")).alias("b"))
    sums = c.agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"), F.count(F.lit(1)).alias("n"))
    return sums.select(F.coalesce(F.try_divide(F.col("ab"), F.sqrt("aa") * F.sqrt("bb")), F.lit(0.0)).alias("rho"), "n")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson of average ranks."""
    both = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return pearson(average_ranks(average_ranks(both, "x", "rx"), "y", "ry"), "rx", "ry")


def chi_squared(only_a: Column, only_b: Column) -> Column:
    """McNemar's statistic with continuity correction; 0 without disagreement."""
    return F.coalesce(F.try_divide(F.pow(F.abs(only_a - only_b) - 1, F.lit(2.0)), only_a + only_b), F.lit(0.0))


def mcnemar(only_a: int, only_b: int) -> float:
    """p-value of equal discordant counts."""
    n = only_a + only_b
    return math.erfc(math.sqrt((abs(only_a - only_b) - 1) ** 2 / n / 2)) if n else 1.0


def mcnemar_p(only_a: Column, only_b: Column) -> Column:
    @F.pandas_udf("double")
    def p(chi: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([math.erfc(math.sqrt(c / 2)) if k else 1.0 for c, k in zip(chi, n, strict=True)])

    return p(chi_squared(only_a, only_b), only_a + only_b)


def sample_sd(col: str) -> Column:
    """Standard deviation with n - 1; 0 for fewer than two rows."""
    return F.coalesce(F.stddev_samp(col), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))
