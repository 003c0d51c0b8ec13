"""Splits, word pairs, and rank correlation against counts of text that a space has not seen."""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import sparse_space


def half(pos: Column, block: int = 4000, offset: int = 0) -> Column:
    """'train' or 'test': the first ``offset`` tokens train, then blocks alternate, train first."""
    return F.when((pos < offset) | (F.floor((pos - offset) / block) % 2 == 0), "train").otherwise("test")


def in_train(pos: Column, block: int = 4000) -> Column:
    """How many of the positions before this one are in the train half."""
    return F.floor(pos / (2 * block)) * block + F.least(pos % (2 * block), F.lit(block))


def split_documents(tokens: DataFrame, block: int = 4000, offset: int = 0) -> DataFrame:
    """tokens(doc_ord, pos, token) with ``half``; each document starts anew."""
    return tokens.withColumn("half", half(F.col("pos"), block, offset))


def split_lists(lists: DataFrame, block: int = 4000, offset: int = 0) -> DataFrame:
    """(doc_ord, train, test) of lists(doc_ord, t), as ``split_documents``."""
    n = F.size("t")

    def blocks(first: int) -> Column:
        """Every second block from a position on, as slices: no call a token."""
        parts = F.transform(F.sequence(F.lit(first), n - 1, F.lit(2 * block)), lambda s: F.slice("t", s + 1, block))
        return F.when(n > first, F.flatten(parts)).otherwise(F.array().cast("array<string>"))

    return lists.select("doc_ord", F.concat(F.slice("t", 1, offset), blocks(offset)).alias("train"), blocks(offset + block).alias("test"))


def sample_pairs(ceiling: int, count: int, filled: Callable[[int], bool], seed: int, attempts: int) -> list[tuple[int, int]]:
    """Distinct pairs of ids below the ceiling whose rows are filled, ascending; ``attempts`` draws a pair wanted, at most."""
    rng, out, tries = random.Random(seed), set(), 0
    while ceiling > 0 and len(out) < count and tries < count * attempts:
        tries += 1
        i, j = rng.randrange(ceiling), rng.randrange(ceiling)
        key = (min(i, j), max(i, j))
        if i != j and key not in out and filled(key[0]) and filled(key[1]):
            out.add(key)
    return sorted(out)


def truth_cosines(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """(i, j, actual) of the pairs that share something; computed once for all candidates."""
    return sparse_space.cosines(truth, pairs).where("cosine <> 0").select("i", "j", F.col("cosine").alias("actual"))


def predicted(space: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(i, j, ...) with the cosine of the words' vectors."""
    u = space.select("id", "unit")
    a = pairs.join(u.select(F.col("id").alias("i"), F.col("unit").alias("ui")), "i")
    return a.join(u.select(F.col("id").alias("j"), F.col("unit").alias("uj")), "j").withColumn("predicted", V.dot(F.col("ui"), F.col("uj"))).drop("ui", "uj")


def correlation(space: DataFrame, actual: DataFrame) -> tuple[float, int]:
    """Spearman of predicted and actual similarity, and how many pairs it rests on.

    The pairs are a sample that the driver drew (``sample_pairs``), so it can hold their two numbers.
    """
    both = predicted(space, actual).select("predicted", "actual").toArrow()
    return rank_correlation(both["predicted"].to_numpy(), both["actual"].to_numpy()), both.num_rows


def rank_correlation(x: np.ndarray, y: np.ndarray) -> float:
    """Pearson of average ranks; 0 for fewer than two pairs or a constant side."""

    def centred(v: np.ndarray) -> np.ndarray:
        _, at, n = np.unique(v, return_inverse=True, return_counts=True)
        r = (np.cumsum(n) - (n - 1) / 2.0)[at]
        return r - r.mean()

    if len(x) < 2:
        return 0.0
    a, b = centred(x), centred(y)
    scale = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
    return float((a * b).sum() / scale) if scale else 0.0
