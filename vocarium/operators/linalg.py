"""Sparse times dense on the cluster, small dense algebra on the driver.

Only n x p blocks (words by at most some hundred columns) are on the driver; cells stay distributed.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CellMatrix:
    """A square sparse matrix: cells (i, j, v) of size n, so that empty rows count.

    Rows are partitioned once and kept, and every product reuses them.
    """

    def __init__(self, cells: DataFrame, n: int):
        self.n = n
        self.cells = cells.select("i", "j", F.col("v").cast("double")).repartition("i").sortWithinPartitions("i", "j").persist(StorageLevel.MEMORY_AND_DISK)

    def close(self) -> None:
        self.cells.unpersist()

    def nnz(self) -> int:
        return self.cells.count()

    def dense(self) -> np.ndarray:
        out = np.zeros((self.n, self.n))
        t = self.cells.toArrow()
        out[t["i"].to_numpy(), t["j"].to_numpy()] = t["v"].to_numpy()
        return out

    def times(self, x: np.ndarray) -> np.ndarray:
        """A @ x. The block x goes to every worker; each row of the product is made in one task."""
        k = x.shape[1]
        sent = self.cells.sparkSession.sparkContext.broadcast(np.ascontiguousarray(x, np.float64))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for b in batches:
                i, j, v = (b.column(c).to_numpy() for c in range(3))
                if not len(i):
                    continue
                starts = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
                if len(starts) * len(sent.value) <= 16 * len(v):  # full enough for a dense product
                    block = np.zeros((len(starts), len(sent.value)))
                    block[np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(i)))), j] = v
                    sums = block @ sent.value
                else:
                    sums = np.add.reduceat(v[:, None] * sent.value[j], starts, axis=0)
                for r, s in zip(i[starts].tolist(), sums, strict=True):
                    held[r] = held[r] + s if r in held else s
                if len(held) > 4096:
                    last = int(i[-1])
                    yield from rows({r: s for r, s in held.items() if r != last})
                    held = {last: held[last]}
            if held:
                yield from rows(held)

        def rows(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
            flat = pa.array(np.concatenate(list(held.values())))
            offsets = pa.array(np.arange(len(held) + 1) * k, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.ListArray.from_arrays(offsets, flat)], ["i", "y"])

        out = np.zeros((self.n, k))
        got = self.cells.mapInArrow(run, "i long, y array<double>").toArrow()
        if got.num_rows:
            out[got["i"].to_numpy()] = np.concatenate([np.asarray(y.values) for y in got["y"]]).reshape(-1, k)
        sent.unpersist()
        return out


def gaussian(n: int, k: int, rng: random.Random) -> np.ndarray:
    """Row by row from Python's generator, so that a seed gives the same block everywhere."""
    return np.array([rng.gauss(0.0, 1.0) for _ in range(n * k)]).reshape(n, k)


def gram(x: np.ndarray) -> np.ndarray:
    return x.T @ x


def cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.T @ b


def cholesky(a: np.ndarray, floor: float = 1e-12) -> np.ndarray:
    """Lower factor; pivots at or below the floor are lifted to it, so that nothing raises."""
    n = len(a)
    out = np.zeros((n, n))
    for c in range(n):
        out[c, c] = np.sqrt(max(a[c, c] - out[c, :c] @ out[c, :c], floor))
        out[c + 1 :, c] = (a[c + 1 :, c] - out[c + 1 :, :c] @ out[c, :c]) / out[c, c]
    return out


def invert_lower(low: np.ndarray) -> np.ndarray:
    out = np.zeros_like(low)
    for r in range(len(low)):
        out[r, r] = 1 / low[r, r]
        out[r, :r] = -(low[r, :r] @ out[:r, :r]) / low[r, r]
    return out


def orthonormalise(x: np.ndarray) -> np.ndarray:
    """Same span with orthonormal columns: a Gram factor, twice."""
    for _ in range(2):
        x = x @ invert_lower(cholesky(gram(x))).T
    return x


def symmetric_eigh(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues descending by sign, vectors as columns."""
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    return values[::-1], vectors[:, ::-1]


def _ritz(a: CellMatrix, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = symmetric_eigh(cross(q, a.times(q)))
    keep = np.argsort(-np.abs(values), kind="stable")[:k]
    return values[keep], q @ vectors[:, keep]


def randomised_eigh(a: CellMatrix, k: int, oversample: int = 16, power_iterations: int = 3, rng: random.Random | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Subspace iteration and Rayleigh-Ritz; the k pairs of largest absolute value."""
    p = min(a.n, k + oversample)
    q = orthonormalise(a.times(gaussian(a.n, p, rng or random.Random(0))))
    for _ in range(power_iterations):
        q = orthonormalise(a.times(q))
    return _ritz(a, q, k)


def block_krylov_eigh(a: CellMatrix, k: int, block: int = 24, depth: int = 4, rng: random.Random | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All iterates span the basis; at most block * depth pairs."""
    block = min(block, a.n)
    w, kept = gaussian(a.n, block, rng or random.Random(0)), []
    for _ in range(depth):
        w = orthonormalise(a.times(w))
        kept.append(w)
    return _ritz(a, orthonormalise(np.hstack(kept)), min(k, block * depth))


def principal_angles(a: np.ndarray, b: np.ndarray) -> list[float]:
    """Cosines of the angles between two column spaces, descending, in [0, 1]."""
    s = np.linalg.svd(orthonormalise(a).T @ orthonormalise(b), compute_uv=False)
    return np.clip(s, 0, 1).tolist()


FACTORISERS = ("subspace", "krylov")
