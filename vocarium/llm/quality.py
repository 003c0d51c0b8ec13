"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): all pairwise
interactions of a document in time linear in its features.

Inputs are the whole text and, where the column exists, ``n_chars``; a null there counts as the length
of the text. Labels, language, source and ids are never inputs. Training takes at most
``TRAIN_ROWS`` labelled rows, those with the lowest hash of their id; everything is scored.
Null and empty texts get the score of a document without words. Null labels are not learnt from.
Repeated rows are scored each. Without labels of both kinds the score is the share of label 1 (0.5 if none).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .wordhash import BLANK_WORDS, span_hashes, words

#: Labelled rows that are learnt from, at most.
TRAIN_ROWS = 4000
WORD_BITS, RANK, STATS = 14, 8, 18
#: Byte kinds for the structure statistics.
KINDS = np.full(256, 7, np.uint8)
KINDS[97:123] = 0
KINDS[65:91] = 1
KINDS[48:58] = 2
KINDS[[9, 11, 12, 13, 32]] = 3
KINDS[10] = 4
KINDS[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 5
KINDS[128:] = 6
KINDS[124] = 8


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def features(arr: pa.Array, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse hashed words (rows, buckets, values) and a matrix of raw statistics."""
    rows, cols, vals, stats = [], [], [], []
    for lo, hi, buf, offs in shared.chunks(arr):
        n = hi - lo
        size = np.diff(offs)
        owner = np.repeat(np.arange(n, dtype=np.int64), size)
        kinds = np.bincount(owner * 16 + KINDS[buf], minlength=n * 16).reshape(n, 16).astype(np.float64)
        low, s, e, first = words(buf, offs, BLANK_WORDS)
        h = span_hashes(low, s, e)
        count = np.diff(first)
        whose = np.repeat(np.arange(n, dtype=np.int64), count)
        bucket = (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        key, times = np.unique(whose << WORD_BITS | bucket, return_counts=True)
        r, c = key >> WORD_BITS, key & ((1 << WORD_BITS) - 1)
        x = np.log1p(times)
        length = np.sqrt(np.bincount(r, weights=x * x, minlength=n))
        rows.append(r + lo)
        cols.append(c)
        vals.append(x / length[r])
        distinct = np.bincount(r, minlength=n)
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (whose[1:] == whose[:-1])
        repeats = np.bincount(whose[again], minlength=n)
        width = (e - s).astype(np.float64)
        head = np.zeros(len(h), np.float64)
        if len(h):
            head = (KINDS[buf[s]] == 1).astype(np.float64)
            odd_end = np.isin(KINDS[buf[e - 1]], (7, 8)).astype(np.float64)
        else:
            odd_end = head
        per = lambda v: np.bincount(whose, weights=v, minlength=n)
        w, b = np.maximum(count, 1), np.maximum(size, 1)
        top = np.zeros(n)
        np.maximum.at(top, r, times / w[r])
        bang = np.zeros(len(buf), bool)
        if len(buf) > 1:
            bang[1:] = (buf[1:] == 33) & (buf[:-1] == 33)
        stats.append(
            np.column_stack(
                (
                    *(kinds[:, k] / b for k in range(9)),
                    np.log1p(count), np.log1p(size), distinct / w, repeats / w, per(width) / w, per(head) / w, per(odd_end) / w, top,
                    np.bincount(owner[bang], minlength=n) / w,
                )
            )
        )
    if not stats:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, STATS + 1))
    stat = np.vstack(stats)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(vals), np.column_stack((stat, np.log1p(np.where(meta >= 0, meta, np.expm1(stat[:, 10])))))


class FactorisationMachine:
    """Weights for (hashed words, statistics); numpy only."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, rank: int = RANK, seed: int = 7):
        n = (1 << WORD_BITS) + len(mean)
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, std
        self.w0, self.w = 0.0, np.zeros(n)
        self.v = rng.normal(0, 0.02, (n, rank))

    def entries(self, r, c, x, stat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((stat - self.mean) / self.std, -4, 4) / 4
        n, k = z.shape
        rows = np.concatenate((r, np.repeat(np.arange(n), k)))
        order = np.argsort(rows, kind="stable")
        cols = np.concatenate((c, np.tile((1 << WORD_BITS) + np.arange(k), n)))
        return rows[order], cols[order], np.concatenate((x, z.ravel()))[order]

    def raw(self, rows, cols, vals, n):
        """Scores before the sigmoid, and the sums per factor; every row has entries."""
        starts = np.searchsorted(rows, np.arange(n))
        vx = self.v[cols] * vals[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(vx * vx, starts, axis=0)
        return self.w0 + np.add.reduceat(self.w[cols] * vals, starts) + 0.5 * (sums * sums - squares).sum(1), sums

    def train(self, rows, cols, vals, y, epochs: int = 8, rate: float = 0.1, decay: float = 1e-4, batch: int = 64, seed: int = 11) -> None:
        rng, n = np.random.default_rng(seed), len(y)
        starts = np.searchsorted(rows, np.arange(n + 1))
        gw, gv, g0 = np.full(len(self.w), 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        for _ in range(epochs):
            order = rng.permutation(n)
            for lo in range(0, n, batch):
                pick = order[lo : lo + batch]
                lens = starts[pick + 1] - starts[pick]
                at = shared.ragged(starts[pick], lens)
                r, c, x = np.repeat(np.arange(len(pick)), lens), cols[at], vals[at]
                out, sums = self.raw(r, c, x, len(pick))
                err = (1 / (1 + np.exp(-out)) - y[pick]) / len(pick)
                g0 += err.sum() ** 2
                self.w0 -= rate * err.sum() / np.sqrt(g0)
                used, back = np.unique(c, return_inverse=True)
                ex = err[r] * x
                dw = np.bincount(back, weights=ex) + decay * self.w[used]
                grad = ex[:, None] * (sums[r] - self.v[c] * x[:, None])
                dv = np.zeros((len(used), grad.shape[1]))
                np.add.at(dv, back, grad)
                dv += decay * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= rate * dv / np.sqrt(gv[used])


def _meta(df: DataFrame) -> Column:
    meta = df["n_chars"].cast("double") if "n_chars" in df.columns else F.lit(None).cast("double")
    return F.coalesce(meta, F.lit(-1.0)).alias("meta")


def _slim(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(df[id_col].alias("id"), df[text_col].alias("text"), _meta(df))


def train(df: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_ROWS) -> FactorisationMachine | float:
    """Fit on a bounded sample of labels(id, label); only features of those rows come to the driver."""
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most)
    slim = _slim(df, id_col, text_col).join(F.broadcast(known), "id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r, c, x, s = features(shared.plain(b.column("text")), b.column("meta").to_numpy())
            cut = np.searchsorted(r, np.arange(len(s) + 1))
            cols = [c[cut[k] : cut[k + 1]].tolist() for k in range(len(s))]
            vals = [x[cut[k] : cut[k + 1]].tolist() for k in range(len(s))]
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.string()), b.column("y"), pa.array(cols, pa.list_(pa.int32())), pa.array(vals, pa.list_(pa.float32())), pa.array(s.tolist(), pa.list_(pa.float64()))], ["id", "y", "cols", "vals", "stat"])

    got = slim.mapInArrow(run, "id string, y int, cols array<int>, vals array<float>, stat array<double>").toArrow()
    got = got.sort_by([("id", "ascending")]).combine_chunks()
    y = got["y"].to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    flat = lambda name: np.concatenate([np.asarray(x.values) for x in got[name]])
    lens = np.array([len(x.values) for x in got["cols"]])
    stat = flat("stat").reshape(len(y), -1)
    fm = FactorisationMachine(stat.mean(0), stat.std(0) + 1e-6)
    rows, cols, vals = fm.entries(np.repeat(np.arange(len(y)), lens), flat("cols").astype(np.int64), flat("vals").astype(np.float64), stat)
    fm.train(rows, cols, vals, y)
    return fm


def score(df: DataFrame, model: FactorisationMachine | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every document. Narrow: no shuffle."""
    shared.short_batches(df.sparkSession)
    slim = _slim(df, id_col, text_col)
    kind = slim.schema["id"].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = sent.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(fm, shared.plain(b.column(1)), b.column(2).to_numpy()), pa.float64())], ["id", "score"])

    return slim.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def with_score(df: DataFrame, model: FactorisationMachine | float, text_col: str = "text") -> DataFrame:
    """The table's rows as they are, with a column ``score``. Narrow: no shuffle."""
    shared.short_batches(df.sparkSession)
    names = [c for c in df.columns if c != "score"]
    packed = df.select(F.struct(*[df[f"`{c}`"] for c in names]).alias("row"), df[text_col].alias("text"), _meta(df))
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(sent.value, shared.plain(b.column(1)), b.column(2).to_numpy()), pa.float64())], ["row", "score"])

    out = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, score double")
    return out.select(*[F.col("row").getField(c).alias(c) for c in names], "score")


def scores(fm: FactorisationMachine | float, arr: pa.Array, meta: np.ndarray) -> np.ndarray:
    if isinstance(fm, float):
        return np.full(len(arr), fm)
    if not len(arr):
        return np.zeros(0)
    out, _ = fm.raw(*fm.entries(*features(arr, meta)), len(arr))
    return 1 / (1 + np.exp(-np.clip(out, -40, 40)))
