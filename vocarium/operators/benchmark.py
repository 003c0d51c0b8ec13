"""A morphology benchmark made from a vocabulary: rules, word pairs, questions, scores."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio

#: Fixed values: (name, prefix, suffix, shortest stem).
RULES = (("plural", "", "s", 4), ("past", "", "ed", 4), ("progressive", "", "ing", 4), ("adverb", "", "ly", 4), ("apostrophe-s", "", "'s", 4), ("er-form", "", "er", 4), ("negation", "un", "", 4))
LIMIT, SEED = 120, 20260811
METHODS = ("3cosadd", "3cosmul")


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rules)], "rule int, category string, prefix string, suffix string, min_stem int")


def find_pairs(vocab: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, category, stem_id, stem, derived): derived forms that are words themselves; an equi-join on the made form."""
    stem = vocab.select(F.col("id").alias("stem_id"), F.col("word").alias("stem")).crossJoin(F.broadcast(rules))
    fits = (F.length("stem") >= F.col("min_stem")) & ((F.col("suffix") == "") | ~F.col("stem").endswith(F.col("suffix"))) & ((F.col("prefix") == "") | ~F.col("stem").startswith(F.col("prefix")))
    made = stem.where(fits).withColumn("derived", F.concat("prefix", "stem", "suffix"))
    return made.join(vocab.select(F.col("word").alias("derived")), "derived").select("rule", "category", "stem_id", "stem", "derived")


def build_benchmark(vocab: DataFrame, rules: DataFrame, min_pairs: int = 4) -> DataFrame:
    """The pairs of categories that have enough of them."""
    pairs = find_pairs(vocab, rules)
    full = pairs.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pairs)
    return pairs.join(F.broadcast(full.select("rule")), "rule")


def quadruples(pairs: list[tuple[str, str]], limit: int = LIMIT, seed: int = SEED) -> list[tuple[str, str, str, str]]:
    """Questions (a, b, c, d) of all ordered pairs of distinct pairs, or a sample of ``limit`` by index, never listing them all."""
    pairs = sorted(pairs)
    p = len(pairs)
    total = p * (p - 1)
    picked = random.Random(seed).sample(range(total), limit) if total > limit else range(total)
    out = []
    for x in picked:
        q, r = divmod(x, p - 1)
        out.append((*pairs[q], *pairs[r + (r >= q)]))
    return out


def questions(benchmark: DataFrame, limit: int = LIMIT, seed: int = SEED) -> DataFrame:
    """(qid, category, a, b, c, d); a bounded number a category."""
    by: dict[tuple[int, str], list[tuple[str, str]]] = {}
    for r in benchmark.select("rule", "category", "stem", "derived").collect():
        by.setdefault((r["rule"], r["category"]), []).append((r["stem"], r["derived"]))
    rows = [(cat, *q) for (_, cat), pairs in sorted(by.items()) for q in quadruples(pairs, limit, seed)]
    return benchmark.sparkSession.createDataFrame([(k, *r) for k, r in enumerate(rows)], "qid long, category string, a string, b string, c string, d string")


def outcomes(asked: DataFrame, answers: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(qid, category, top1, top5, form, given) of each question from answers(qid, rnk, word)."""
    best = answers.groupBy("qid").agg(F.max(F.when(F.col("rnk") == 1, F.col("word"))).alias("given"), F.collect_set("word").alias("five"))
    shapes = benchmark.select("category", F.col("derived").alias("given"), F.lit(True).alias("shape")).distinct()
    out = asked.join(best, "qid", "left").join(shapes, ["category", "given"], "left")
    hit = lambda c: F.coalesce(c, F.lit(False))
    return out.select("qid", "category", hit(F.col("given") == F.col("d")).alias("top1"), hit(F.array_contains("five", F.col("d"))).alias("top5"), hit(F.col("shape")).alias("form"), "given", "a", "b", "c", "d")


def tally(results: DataFrame, *keys: str) -> DataFrame:
    """Counts a category and, as category ALL, over all of them, in one pass."""
    sums = [F.count(F.lit(1)).alias("asked"), *[F.count_if(F.col(c)).alias(c) for c in ("top1", "top5", "form")]]
    levels = results.rollup(*keys, "category").agg(*sums, F.grouping_id().alias("level"))
    return levels.where(F.col("level") <= 1).withColumn("category", F.coalesce("category", F.lit("ALL"))).drop("level")


def rates(scores: DataFrame) -> DataFrame:
    return scores.select("*", *[ratio(F.col(c), F.col("asked")).alias(n) for c, n in (("top1", "accuracy"), ("top5", "recall5"), ("form", "form_rate"))])


def discordance(sparse: DataFrame, dense: DataFrame) -> DataFrame:
    """(metric, sparse_only, dense_only) of two systems' outcomes on the same questions."""
    both = sparse.select("qid", *[F.col(c).alias(f"s_{c}") for c in ("top1", "top5", "form")]).join(dense, "qid")
    long = both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"s_{c}").alias("s"), F.col(c).alias("d")) for c in ("top1", "top5", "form")])).alias("x")).select("x.*")
    return long.groupBy("metric").agg(F.count_if(F.col("s") & ~F.col("d")).alias("sparse_only"), F.count_if(F.col("d") & ~F.col("s")).alias("dense_only"))


def with_rank(scores: DataFrame, keys: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("id"))
    return scores.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= n)
