"""A space of sparse rows: normalised cells (i, j, v), queried by joins on j."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linalg import CellMatrix


def normalised(cells: DataFrame) -> DataFrame:
    """Unit rows; rows of zeros vanish."""
    norms = cells.groupBy("i").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm")).where("norm > 0")
    return cells.join(norms, "i").select("i", "j", (F.col("v") / F.col("norm")).alias("v"))


def cosines(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(i, j) with ``cosine`` of their rows; 0 where a row is empty or nothing is shared."""
    n = normalised(cells)
    a = pairs.select("i", "j").distinct().join(n.select("i", F.col("j").alias("k"), F.col("v").alias("x")), "i")
    b = n.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("y"))
    dots = a.join(b, ["j", "k"]).groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("cosine"))
    return pairs.join(dots, ["i", "j"], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))


def all_cosines(cells: DataFrame, block: int = 256) -> DataFrame:
    """(i, j, cosine), i < j, of every two rows that share a column, for cells above 0.

    Rows are taken in blocks; each pair of blocks is one matrix product, so a row goes out once a block.
    """
    n = normalised(cells)
    blocks = n.agg(F.coalesce(F.floor(F.max("i") / block) + 1, F.lit(0))).first()[0]
    own = F.floor(F.col("i") / block).cast("int")
    met = n.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(int(blocks) - 1)))) if blocks else n.withColumn("other", F.lit(0))
    met = met.select(F.least(own, "other").alias("lo"), F.greatest(own, "other").alias("hi"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "v")

    def product(key: tuple, table: pa.Table) -> pa.Table:
        lo, hi = (k.as_py() for k in key)
        i, j, v = (table[c].to_numpy() for c in ("i", "j", "v"))
        places, at = np.unique(j, return_inverse=True)
        sides = []
        for b in (lo, hi):
            mine = i // block == b
            dense = np.zeros((block, len(places)))
            dense[i[mine] - b * block, at[mine]] = v[mine]
            sides.append(dense)
        dots = sides[0] @ sides[1].T
        a, b = np.nonzero(dots)
        x, y = a + lo * block, b + hi * block
        keep = x < y
        return pa.table({"i": x[keep], "j": y[keep], "cosine": dots[a, b][keep]})

    return met.groupBy("lo", "hi").applyInArrow(product, "i long, j long, cosine double")


def answers(units: DataFrame, questions: DataFrame, n: int = 5, block: int = 256) -> DataFrame:
    """(qid, rnk, id, score) for questions(qid, a, b, c) in ids: the n rows nearest to b - a + c.

    Questions are a bounded set. Blocks of their targets go through the distributed product; what
    comes back is a number a word and question. Rows that share nothing score 0; inputs and empty
    rows never answer.
    """
    rows = questions.orderBy("qid").collect()
    schema = "qid long, rnk int, id long, score double"
    size = (units.agg(F.max(F.greatest("i", "j"))).first()[0] or 0) + 1
    m = CellMatrix(units, int(size))
    filled = np.zeros(size, bool)
    filled[[r["i"] for r in m.cells.select("i").distinct().collect()]] = True
    out = []
    for lo in range(0, len(rows), block):
        part = rows[lo : lo + block]
        asked = {r[w] for r in part for w in "abc"}
        cells = m.cells.where(F.col("i").isin(list(asked))).toArrow()
        vec = {k: np.zeros(size) for k in asked}
        for i, j, v in zip(*(cells[c].to_pylist() for c in ("i", "j", "v")), strict=True):
            vec[i][j] = v
        scores = m.times(np.array([vec[r["b"]] - vec[r["a"]] + vec[r["c"]] for r in part]).T).T
        scores[:, ~filled] = -np.inf
        for r, s in zip(part, scores, strict=True):
            s[[r["a"], r["b"], r["c"]]] = -np.inf
            top = np.lexsort((-np.arange(size), -s))[:n]
            out += [(r["qid"], k, int(i), float(s[i])) for k, i in enumerate(top, 1) if np.isfinite(s[i])]
    m.close()
    return units.sparkSession.createDataFrame(out, schema)


def similarity(units: DataFrame, a: int, b: int) -> float:
    x, y = (units.where(F.col("i") == k).select("j", F.col("v").alias(n)) for k, n in ((a, "x"), (b, "y")))
    return float(x.join(y, "j").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0.0))).first()[0])
