import math

import numpy as np
import pytest

from vocarium.operators import benchmark
from vocarium.operators import space
from vocarium.operators.space import Space, top_answers
from vocarium.plans import laboratory as lab
from vocarium.sources import codec

H = math.sqrt(3) / 2


@pytest.fixture(scope="module")
def square(spark):
    return Space.of(spark, ["king", "queen", "man", "woman"], [(1, 1), (1, 2), (3, 1), (3, 2)])


def words(df):
    return [r["word"] for r in df.collect()]


def test_lookup(square):
    assert square.vector("queen").tolist() == [1, 2] and "king" in square and "x" not in square and len(square) == 4 and square.dim == 2
    with pytest.raises(KeyError, match="nobody"):
        square.vector("nobody")
    with pytest.raises(ValueError, match="metric"):
        square.similarity("king", "man", "taxi")


def test_analogies(square):
    for metric in ("dot", "euclidean"):
        assert words(square.analogy("king", "queen", "man", 1, metric)) == ["woman"]
    assert words(square.analogy_mul("king", "queen", "man", 1)) == ["woman"]


def test_metrics_and_ties(spark):
    s = Space.of(spark, ["query", "long", "short", "sideways", "zero"], [(1, 0), (10, 0), (0.1, 0), (0, 1), (0, 0)])
    assert words(s.neighbors("query", 1, "dot")) == ["long"]
    assert words(s.neighbors("query", 1, "euclidean")) == ["short"]
    assert words(s.neighbors("query", 2)) == ["short", "long"]  # equal scores: the higher id first
    assert s.similarity("query", "zero") == 0


def test_axis(spark):
    s = Space.of(spark, ["cold", "cool", "warm", "hot"], [(0, 1), (0.5, H), (H, 0.5), (1, 0)])
    assert words(s.axis("cold", "hot", ["hot", "warm", "none", "cool", "cold"])) == ["cold", "cool", "warm", "hot"]


def test_columns(spark):
    s = Space.of(spark, ["a", "b"], [(1, 2, 3), (4, 5, 6)], {"eigenvalues": [4, -2, 0], "eigenvalue_power": 1.0})
    assert np.allclose(s.rescaled(1.5).vector("a"), [2, 2 * math.sqrt(2), 0])
    assert np.allclose(s.shrunk(1).vector("a"), [0.75, 1, 0])
    t = s.subspace([2, 0])
    assert t.vector("b").tolist() == [6, 4] and t.eigenvalues() == [0, 4]
    assert s.positive_dimensions() == [0] and s.negative_dimensions() == [1]
    with pytest.raises(ValueError, match="eigenvalues"):
        Space.of(spark, ["a"], [(1,)]).rescaled(1)


def test_files(spark, tmp_path):
    s = Space.of(spark, ["café", "b"], [(1.5, -2), (0, 3)], {"dim": 2})
    codec.save(s, f"{tmp_path}/s.bin")
    back = codec.load(spark, f"{tmp_path}/s.bin")
    assert back.vector("café").tolist() == [1.5, -2] and back.meta == {"dim": 2}
    with pytest.raises(ValueError, match="not a saved space"):
        codec.loads(b"nonsense")
    s.write(f"{tmp_path}/p")
    assert Space.read(spark, f"{tmp_path}/p").meta == {"dim": 2}


def test_benchmark(spark):
    stems = ["ship", "boat", "tree", "bird"]
    base = np.eye(5)
    s = Space.of(spark, [*stems, *(w + "s" for w in stems)], [*(base[k] for k in range(4)), *(base[k] + base[4] for k in range(4))])
    got = {r["category"]: r for r in lab.evaluate(s, ("3cosadd",)).collect()}
    assert got["plural"]["asked"] == 12 == got["plural"]["top1"] == got["ALL"]["form"]


def test_batch_answers_equal_single_ones(spark):
    rng = np.random.default_rng(2)
    s = Space.of(spark, [f"w{k}" for k in range(40)], rng.normal(size=(40, 6)))
    asked = spark.createDataFrame([(k, f"w{k}", f"w{k + 1}", f"w{k + 2}") for k in range(5)], "qid long, a string, b string, c string")
    for metric in ("cosine", "dot", "euclidean"):
        got = {}
        for r in top_answers(s.table, asked, 5, metric=metric).orderBy("qid", "rnk").collect():
            got.setdefault(r["qid"], []).append(r["word"])
        assert got[3] == words(s.analogy("w3", "w4", "w5", 5, metric))


@pytest.mark.parametrize("method", ["3cosadd", "3cosmul"])
def test_answers_in_chunks_and_blocks_equal_one_sort(spark, monkeypatch, method):
    for name, size in (("ASKED", 16), ("PART", 4), ("WORDS", 8)):
        monkeypatch.setattr(space, name, size)
    rng = np.random.default_rng(4)
    vecs = np.concatenate([rng.normal(size=(30, 6))] * 3)  # equal vectors: the higher id first
    s = Space.of(spark, [f"w{k}" for k in range(90)], vecs)
    asked = [(k, (k * 7) % 90, (k * 11 + 1) % 90, (k * 13 + 5) % 90) for k in range(50)]
    held = []
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x, f=type(spark.sparkContext).broadcast: held.append(len(x[0])) or f(self, x))
    out = top_answers(s.table, spark.createDataFrame([(k, *(f"w{x}" for x in q)) for k, *q in asked], "qid long, a string, b string, c string"), method=method)
    got = {}
    for r in out.orderBy("qid", "rnk").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    for k, a, b, c in asked:
        cos = lambda x: (unit @ unit[x] + 1) / 2
        score = np.round(unit @ (unit[b] - unit[a] + unit[c]) if method == "3cosadd" else cos(b) * cos(c) / (cos(a) + 1e-3), 9)
        assert got[k] == [x for x in sorted(range(90), key=lambda x: (-score[x], -x)) if x not in (a, b, c)][:5]
    assert sum(held) == 50 and max(held) < 50  # no broadcast holds all questions


def test_pairs_and_questions(spark):
    names = ["ship", "ships", "hi", "his", "glass", "glasses", "glasss", "under", "ununder", "tree", "trees"]
    v = spark.createDataFrame(list(enumerate(names)), "id int, word string")
    pairs = {(r["category"], r["stem"], r["derived"]) for r in benchmark.find_pairs(v, benchmark.rules_table(spark)).collect()}
    assert pairs == {("plural", "ship", "ships"), ("plural", "tree", "trees")}  # stems that begin or end like the affix are none
    four = [(c, c + "s") for c in "dbca"]
    assert len(benchmark.quadruples(four)) == 12 and len(benchmark.quadruples(four, 5)) == 5
    assert benchmark.quadruples(four, 5) == benchmark.quadruples(four[::-1], 5)
