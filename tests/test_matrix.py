import math
import random

import numpy as np
import pytest

from vocarium.operators import counts, linalg, sparse_space, weight


def ids_of(spark, ids, docs=None):
    docs = docs or [0] * len(ids)
    seen, rows = {}, []
    for k, (d, i) in enumerate(zip(docs, ids, strict=True)):
        seen[d] = seen.get(d, -1) + 1
        rows.append((k, d, seen[d], i))
    return spark.createDataFrame(rows, "gpos long, doc_ord long, dpos long, id int")


def dense(df, v="w"):
    return {(r["i"], r["j"]): r[v] for r in df.collect()}


def brute(ids, window, harmonic=True):
    out = {}
    for p, i in enumerate(ids):
        for d in range(1, min(window, p) + 1):
            w = 1 / d if harmonic else 1.0
            for a, b in ((i, ids[p - d]), (ids[p - d], i)):
                out[a, b] = out.get((a, b), 0) + w
    return out


def test_cooccurrence(spark):
    assert dense(counts.cooccurrence(ids_of(spark, [0, 1]), 4)) == {(0, 1): 1.0, (1, 0): 1.0}
    assert dense(counts.cooccurrence(ids_of(spark, [0, 0]), 4)) == {(0, 0): 2.0}
    assert counts.cooccurrence(ids_of(spark, []), 4).count() == 0
    got = dense(counts.cooccurrence(ids_of(spark, [0, 1], [0, 1]), 4, per_document=True))
    assert got == {}


@pytest.mark.parametrize("harmonic", [True, False])
def test_cooccurrence_against_brute_force_across_blocks(spark, monkeypatch, harmonic):
    monkeypatch.setattr(counts, "BLOCK", 16)
    rng = random.Random(1)
    ids = [rng.randrange(7) for _ in range(200)]
    got, want = dense(counts.cooccurrence(ids_of(spark, ids), 5, harmonic)), brute(ids, 5, harmonic)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    pruned = dense(counts.cooccurrence(ids_of(spark, ids), 5, harmonic, 25.0))
    assert all((j, i) in pruned for i, j in pruned) and len(pruned) < len(got)


def cells(spark, m, v="w"):
    return spark.createDataFrame([(i, j, float(x)) for i, r in enumerate(m) for j, x in enumerate(r) if x], f"i int, j int, {v} double")


def test_weights(spark):
    c = cells(spark, [[4, 1], [1, 4]])
    assert dense(weight.ppmi(c), "v")[0, 0] == pytest.approx(math.log(1.6))
    assert dense(weight.pmi(c), "v")[0, 1] == pytest.approx(math.log(0.4))
    assert dense(weight.ppmi(c, shift=1.5), "v")[0, 0] == pytest.approx(math.log(1.6 / 1.5))
    flat = dense(weight.pmi(cells(spark, np.outer([1, 2, 3], [1, 2, 3]))), "v")
    assert all(abs(x) < 1e-12 for x in flat.values())
    rare = cells(spark, [[10, 10, 1], [10, 10, 0], [1, 0, 0]])
    assert dense(weight.pmi(rare, 0.75), "v")[0, 2] < dense(weight.pmi(rare), "v")[0, 2]
    assert dense(weight.log_counts(c), "v")[0, 0] == pytest.approx(math.log1p(4))
    assert weight.ppmi(c.where("w > 9")).count() == 0


def planted(n, values, seed=3):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))
    return q[:, : len(values)] @ np.diag(values) @ q[:, : len(values)].T


@pytest.mark.parametrize("kind", ["subspace", "krylov"])
def test_factorisation_recovers_a_planted_spectrum(spark, kind):
    m = planted(24, [15, -11, 6, 0.1])
    a = linalg.CellMatrix(cells(spark, m, "v"), 24)
    values, vectors = linalg.randomised_eigh(a, 3, 8, 4) if kind == "subspace" else linalg.block_krylov_eigh(a, 3, 6, 3)
    assert np.allclose(values, [15, -11, 6], atol=1e-5)
    assert np.allclose(vectors.T @ vectors, np.eye(3), atol=1e-6)
    assert np.allclose(a.times(np.eye(24)), m)
    assert np.allclose(a.dense(), m)
    a.close()


def test_small_algebra():
    assert np.isfinite(linalg.invert_lower(linalg.cholesky(np.array([[1.0, 2], [2, 4]])))).all()
    x = np.random.default_rng(1).normal(size=(9, 3))
    q = linalg.orthonormalise(x)
    assert np.allclose(q.T @ q, np.eye(3))
    e = np.eye(3)
    assert linalg.principal_angles(e[:, :1], e[:, 1:2]) == pytest.approx([0])
    assert linalg.principal_angles(e[:, :2], e[:, [0, 2]]) == pytest.approx([1, 0])
    assert linalg.principal_angles(e[:, :1], np.array([[0.5], [math.sqrt(0.75)], [0]])) == pytest.approx([0.5])


def test_sparse_rows(spark):
    c = cells(spark, [[3, 4, 0, 0], [6, 8, 0, 0], [0, 0, 1, 1], [0, 0, 0, 0]], "v")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "i int, j int")
    got = {(r["i"], r["j"]): r["cosine"] for r in sparse_space.cosines(c, pairs).collect()}
    assert got[0, 1] == pytest.approx(1) and got[0, 2] == 0 and got[0, 3] == 0
    q = spark.createDataFrame([(7, 0, 1, 2)], "qid long, a int, b int, c int")
    units = sparse_space.normalised(cells(spark, [[1, 0, 0], [0, 1, 0], [0, 0, 1], [-1, 1, 1], [0, 0, 0]], "v"))
    assert [r["id"] for r in sparse_space.answers(units, q).collect()] == [3]
    assert sparse_space.similarity(sparse_space.normalised(c), 0, 1) == pytest.approx(1)
