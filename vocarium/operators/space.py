"""A vector space as a table (id, word, vec, unit), and exact queries on it.

Equal scores come with the higher id first.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.kept import kept

METRICS = ("cosine", "dot", "euclidean")


def scored(metric: str, vec: Column, unit: Column, query: Column, query_unit: Column) -> Column:
    """Higher is nearer; Euclidean distance is negated."""
    if metric == "cosine":
        return V.dot(unit, query_unit)
    if metric == "dot":
        return V.dot(vec, query)
    if metric == "euclidean":
        return -V.distance(vec, query)
    raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")


class Space:
    """Words with vectors. ``table`` has id and word unique; ``meta`` holds settings and eigenvalues."""

    def __init__(self, table: DataFrame, meta: dict | None = None):
        t = table.select("id", "word", F.col("vec").cast("array<double>").alias("vec"))
        self.table = t.withColumn("unit", V.unit(F.col("vec")))
        self.meta = dict(meta or {})
        self._dim: int | None = None

    @classmethod
    def of(cls, spark: SparkSession, words: Sequence[str], vectors, meta: dict | None = None) -> Space:
        rows = [(k, w, [float(x) for x in v]) for k, (w, v) in enumerate(zip(words, vectors, strict=True))]
        return cls(spark.createDataFrame(rows, "id long, word string, vec array<double>"), meta)

    @property
    def dim(self) -> int:
        if self._dim is None:
            first = self.table.select(F.size("vec").alias("n")).first()
            self._dim = first["n"] if first else 0
        return self._dim

    def __len__(self) -> int:
        return self.table.count()

    def __contains__(self, word: str) -> bool:
        return not self.table.where(F.col("word") == word).isEmpty()

    def rows(self, *words: str) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """(vector, direction) of each word, in one job; a missing word is a KeyError."""
        got = {r["word"]: (np.array(r["vec"]), np.array(r["unit"])) for r in self.table.where(F.col("word").isin(list(set(words)))).select("word", "vec", "unit").collect()}
        for w in words:
            if w not in got:
                raise KeyError(f"{w!r} is not in the vocabulary")
        return got

    def vector(self, word: str) -> np.ndarray:
        return self.rows(word)[word][0]

    def direction(self, word: str) -> np.ndarray:
        return self.rows(word)[word][1]

    def similarity(self, a: str, b: str, metric: str = "cosine") -> float:
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")
        got = self.rows(a, b)
        (va, ua), (vb, ub) = got[a], got[b]
        return float(ua @ ub if metric == "cosine" else va @ vb if metric == "dot" else -np.linalg.norm(va - vb))

    def similarities(self, words: Sequence[str], metric: str = "cosine") -> DataFrame:
        """(a, b, score) of every unordered pair of the words given, in their order."""
        asked = self.table.sparkSession.createDataFrame(list(enumerate(words)), "at int, word string")
        side = self.table.join(F.broadcast(asked), "word")
        x, y = (side.select(*[F.col(c).alias(c + s) for c in ("at", "word", "vec", "unit")]) for s in ("1", "2"))
        pairs = x.join(F.broadcast(y), F.col("at1") < F.col("at2"))
        return pairs.select(F.col("word1").alias("a"), F.col("word2").alias("b"), scored(metric, F.col("vec1"), F.col("unit1"), F.col("vec2"), F.col("unit2")).alias("score"), "at1", "at2").orderBy("at1", "at2").drop("at1", "at2")

    def rank(self, query: Iterable[float], n: int = 10, exclude: Iterable[str] = (), metric: str = "cosine") -> DataFrame:
        """The n best words for a vector: one scan, per-partition top n, merged on the driver."""
        q = np.array(list(query), float)
        size = float(np.linalg.norm(q))
        score = scored(metric, F.col("vec"), F.col("unit"), V.literal(q), V.literal(q / size if size else q))
        left = self.table.where(~F.col("word").isin(list(exclude))) if exclude else self.table
        return left.select("id", "word", score.alias("score")).orderBy(F.desc("score"), F.desc("id")).limit(n)

    def neighbors(self, word: str, n: int = 10, metric: str = "cosine") -> DataFrame:
        return self.rank(self.vector(word), n, [word], metric)

    def analogy(self, a: str, b: str, c: str, n: int = 5, metric: str = "cosine") -> DataFrame:
        """a is to b as c is to ...: the target b - a + c in directions for cosine, else in raw vectors."""
        got, k = self.rows(a, b, c), 1 if metric == "cosine" else 0
        return self.rank(got[b][k] - got[a][k] + got[c][k], n, [a, b, c], metric)

    def analogy_mul(self, a: str, b: str, c: str, n: int = 5, epsilon: float = 1e-3) -> DataFrame:
        """Products of cosines moved to [0, 1]."""
        got = self.rows(a, b, c)
        pa_, pb, pc = ((V.dot(F.col("unit"), V.literal(got[w][1])) + 1) / 2 for w in (a, b, c))
        left = self.table.where(~F.col("word").isin(a, b, c))
        return left.select("id", "word", (pb * pc / (pa_ + epsilon)).alias("score")).orderBy(F.desc("score"), F.desc("id")).limit(n)

    def axis(self, negative: str, positive: str, words: Sequence[str]) -> DataFrame:
        """(word, score) along the direction from negative to positive, ascending; unknown words are skipped, repeats kept."""
        got = self.rows(negative, positive)
        d = got[positive][1] - got[negative][1]
        size = float(np.linalg.norm(d))
        asked = self.table.sparkSession.createDataFrame(list(enumerate(words)), "at int, word string")
        line = self.table.join(F.broadcast(asked), "word").select("at", "word", V.dot(F.col("unit"), V.literal(d / size if size else d)).alias("score"))
        return line.orderBy("score", "at").drop("at")

    def eigenvalues(self) -> list[float]:
        values = self.meta.get("eigenvalues")
        if not values:
            raise ValueError("this space was saved without eigenvalues")
        return [float(x) for x in values]

    def _columns(self, factors: Iterable[float], **meta) -> Space:
        return Space(self.table.select("id", "word", V.scaled(F.col("vec"), factors).alias("vec")), self.meta | meta)

    def rescaled(self, power: float) -> Space:
        """The same directions under another exponent of |eigenvalue|; an unrecorded present one counts as 0.5."""
        now = float(self.meta.get("eigenvalue_power", 0.5))
        return self._columns([abs(x) ** (power - now) if x else 0.0 for x in self.eigenvalues()], eigenvalue_power=power)

    def shrunk(self, threshold: float) -> Space:
        """Eigenvalues moved towards zero by the threshold; an unrecorded exponent counts as 1.0."""
        power = float(self.meta.get("eigenvalue_power", 1.0))
        return self._columns([(max(0.0, abs(x) - threshold) / abs(x)) ** power if x else 0.0 for x in self.eigenvalues()], shrinkage=threshold)

    def subspace(self, keep: Sequence[int]) -> Space:
        """The columns named, in the order given."""
        cols = F.transform(F.array(*[F.lit(int(k)) for k in keep]), lambda k: F.element_at("vec", k + 1))
        meta = dict(self.meta)
        if meta.get("eigenvalues"):
            meta["eigenvalues"] = [meta["eigenvalues"][k] for k in keep]
        return Space(self.table.select("id", "word", cols.alias("vec")), meta)

    def positive_dimensions(self) -> list[int]:
        return [k for k, x in enumerate(self.eigenvalues()) if x > 0]

    def negative_dimensions(self) -> list[int]:
        return [k for k, x in enumerate(self.eigenvalues()) if x < 0]

    def write(self, path: str) -> None:
        """Parquet of (id, word, vec), the settings beside it as JSON text."""
        self.table.select("id", "word", "vec").write.mode("overwrite").parquet(f"{path}/vectors")
        self.table.sparkSession.createDataFrame([(json.dumps(self.meta, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Space:
        return cls(spark.read.parquet(f"{path}/vectors"), json.loads(spark.read.text(f"{path}/meta").first()["value"]))

    def matrix(self) -> tuple[list[str], np.ndarray]:
        """Words and vectors on the driver, in id order: vocabulary-sized only."""
        rows = self.table.select("id", "word", "vec").orderBy("id").collect()
        return [r["word"] for r in rows], np.array([r["vec"] for r in rows]).reshape(len(rows), -1)


#: Questions sent out at once, and the words that one product holds beside a part of them.
ASKED, PART, WORDS = 1 << 14, 1 << 11, 1 << 11


def top_answers(space: DataFrame, questions: DataFrame, n: int = 5, method: str = "3cosadd", metric: str = "cosine", epsilon: float = 1e-3) -> DataFrame:
    """(qid, rnk, id, word, score): the n best for every question(qid, a, b, c).

    Questions are resolved by joins, and go out in chunks of about ``ASKED``. A task meets a chunk with
    its words in blocks of ``PART`` by ``WORDS`` and keeps its own n best a question, so its memory
    depends on neither table's size, and the shuffle carries n rows a question and task. A product only
    tells who may be among the best; those are scored again term by term, so that equal vectors score equal.
    """
    spark, kind = space.sparkSession, "unit" if metric == "cosine" else "vec"
    v = space.select("id", "word", kind)
    asked = questions.select("qid", *"abc")
    for w in "abc":
        asked = asked.join(v.select(F.col("word").alias(w), F.col("id").cast("long").alias(f"{w}_id"), F.col(kind).alias(f"{w}_vec")), w)
    asked = kept(asked.select("qid", *[f"{w}_{c}" for c in ("id", "vec") for w in "abc"]))
    many = asked.count()
    out_type = "qid long, id long, word string, score double"
    if not many:
        return spark.createDataFrame([], out_type.replace("id long, word", "rnk int, id long, word"))
    chunks = -(-many // ASKED)
    words = space.select(F.col("id").cast("long").alias("id"), "word", kind)
    if many > PART:
        words = kept(words.repartition(2 * spark.sparkContext.defaultParallelism, "id"))
    found = None
    for chunk in range(chunks):
        t = asked.where(F.pmod(F.xxhash64("qid"), F.lit(chunks)) == chunk).toArrow() if chunks > 1 else asked.toArrow()
        if t.num_rows:
            a, b, c = (np.concatenate([x.flatten().to_numpy() for x in t[f"{w}_vec"].chunks]).reshape(t.num_rows, -1) for w in "abc")
            skip = np.stack([t[f"{w}_id"].to_numpy() for w in "abc"], 1)
            vecs = (a, b, c) if method == "3cosmul" else (b - a + c,)
            sent = spark.sparkContext.broadcast((t["qid"].to_numpy(), skip, vecs))
            part = words.mapInArrow(_best(sent, n, method, metric, epsilon), out_type)
            found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("id"))
    return found.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= n).select("qid", "rnk", "id", "word", "score")


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows, each added up from the first term to the last, as a database does."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out += x[:, k] * y[:, k]
    return out


def _best(sent, n: int, method: str, metric: str, epsilon: float):
    def scores(x: np.ndarray, t: list[np.ndarray]) -> np.ndarray:
        if method == "3cosmul":
            a, b, c = ((_dots(x, y) + 1) / 2 for y in t)
            return b * c / (a + epsilon)
        if metric == "euclidean":
            return -np.sqrt(_dots(d := t[0] - x, d))
        if metric == "dot":
            return _dots(x, t[0])
        size = np.sqrt(_dots(x, x) * _dots(t[0], t[0]))
        return _dots(x, t[0]) / np.where(size == 0, 1.0, size)

    def rough(x: np.ndarray, t: list[np.ndarray]) -> tuple[np.ndarray, float]:
        """Scores to within the second figure, the squares of distances."""
        if method == "3cosmul":
            a, b, c = ((y @ x.T + 1) / 2 for y in t)
            out = b * c / (a + epsilon)
            return out, 1e-6 * max(1.0, float(np.abs(out).max()))
        xx, tt = (x * x).sum(1), (t[0] * t[0]).sum(1)
        if metric == "euclidean":
            return 2 * (t[0] @ x.T) - xx - tt[:, None], 1e-9 * float(xx.max() + tt.max())
        if metric == "dot":
            return t[0] @ x.T, 1e-9 * float(np.sqrt(xx.max() * tt.max()))
        length = lambda s: np.where(s == 0, 1.0, np.sqrt(s))
        return (t[0] / length(tt)[:, None]) @ (x / length(xx)[:, None]).T, 1e-9

    def few(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Places of the words that can answer: of equal vectors, only those of the highest ids do."""
        order = np.argsort(-ids, kind="stable")
        rows = np.ascontiguousarray(x[order]).view(np.dtype((np.void, x.shape[1] * 8))).ravel()
        _, kind = np.unique(rows, return_inverse=True)
        by = np.argsort(kind, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], kind[by][1:] != kind[by][:-1])))
        rank = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by))))
        return order[by[rank < n + 3]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, skip, vecs = sent.value
        best = np.full((len(qids), n), -np.inf)
        best_id, best_at = np.full((len(qids), n), -1), np.full((len(qids), n), -1)
        names, seen = [], 0

        def meet(lo: int, hi: int, ids: np.ndarray, x: np.ndarray, at: np.ndarray) -> None:
            t = [y[lo:hi] for y in vecs]
            s, margin = rough(x, t)
            least = best[lo:hi, -1]
            least = -(least**2) if metric == "euclidean" and method != "3cosmul" else least
            if len(ids) > n + 3:  # n words beside the three asked are at least as good as this
                least = np.maximum(least, np.partition(s, -(n + 3), axis=1)[:, -(n + 3)]) if np.isneginf(least).any() else least
            q, k = np.nonzero(s >= (least - margin)[:, None])
            ok = (ids[k, None] != skip[lo + q]).all(1)
            q, k = q[ok], k[ok]
            if not len(q):
                return
            exact = np.concatenate([scores(x[k[p : p + 65536]], [y[q[p : p + 65536]] for y in t]) for p in range(0, len(q), 65536)])
            q, k, exact = (y[np.isfinite(exact)] for y in (q, k, exact))
            hit = np.unique(q)
            all_q = np.concatenate([np.repeat(hit, n), q])
            all_s = np.concatenate([best[lo + hit].ravel(), exact])
            all_id = np.concatenate([best_id[lo + hit].ravel(), ids[k]])
            all_at = np.concatenate([best_at[lo + hit].ravel(), at[k]])
            order = np.lexsort((-all_id, -all_s, all_q))
            starts = np.searchsorted(all_q[order], hit)
            top = order[starts[:, None] + np.arange(n)]
            best[lo + hit], best_id[lo + hit], best_at[lo + hit] = all_s[top], all_id[top], all_at[top]

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            x = batch.column(2).flatten().to_numpy().reshape(len(ids), -1)
            names.append(batch.column(1))
            able = few(ids, x)
            for k in range(0, len(able), WORDS):
                p = able[k : k + WORDS]
                for lo in range(0, len(qids), PART):
                    meet(lo, min(lo + PART, len(qids)), ids[p], x[p], seen + p)
            seen += len(ids)
        q, r = np.nonzero(best_at >= 0)
        if len(q):
            words = pa.chunked_array(names).take(pa.array(best_at[q, r])).combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array(qids[q]), pa.array(best_id[q, r]), words, pa.array(best[q, r])], ["qid", "id", "word", "score"])

    return run
