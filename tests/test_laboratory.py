import math

import pytest

from vocarium.config import Config
from vocarium.functions import stats
from vocarium.operators import heldout
from vocarium.plans import claims
from vocarium.plans import laboratory as lab
from vocarium.plans.build import build


def test_ranks_and_correlation(spark):
    ranks = lambda xs: sorted(r["r"] for r in stats.average_ranks(spark.createDataFrame([(float(x),) for x in xs], "x double"), "x", "r").collect())
    assert ranks([1, 5, 5, 9]) == [1, 2.5, 2.5, 4]
    assert ranks([7, 7, 7]) == [2, 2, 2]
    rho = lambda ps: stats.spearman(spark.createDataFrame([(float(a), float(b)) for a, b in ps], "x double, y double"), "x", "y").first()["rho"]
    assert rho([(1, 1), (2, 4), (3, 9)]) == pytest.approx(1)
    assert rho([(1, 3), (2, 2), (3, 1)]) == pytest.approx(-1)
    assert rho([(1, 5), (2, 5)]) == 0 and rho([(1, 1)]) == 0


def test_mcnemar():
    assert [round(stats.mcnemar(a, b), 4) for a, b in ((57, 34), (66, 105), (0, 0))] == [0.0211, 0.0037, 1.0]
    assert stats.mcnemar(30, 2) < 0.001


def test_split(spark):
    t = spark.createDataFrame([(0, k) for k in range(10)], "doc_ord long, pos int")
    got = {r["pos"] for r in heldout.split_documents(t, 2).where("half = 'train'").collect()}
    assert got == {0, 1, 4, 5, 8, 9}
    assert heldout.sample_pairs(5, 100, lambda k: k != 2, 1, 20) == sorted({(i, j) for i in (0, 1, 3, 4) for j in (0, 1, 3, 4) if i < j})


def test_spreads():
    s = lab.Spread("x", [-1, 0, 1])
    assert s.sd == 1 and s.floor == 2 and lab.Spread("x", [3]).sd == 0
    assert [lab.verdict(s, d) for d in (1, 2.5, 4)] == ["noise", "marginal", "solid"]
    assert [lab.reverses(dict(zip("ab", e, strict=True)), 0.0152) for e in ((0.05, -0.05), (0.0042, -0.0026), (0.35, 0.02), (0.05, 0))] == [True, False, False, False]
    assert lab.reverses({"a": 0.05, "b": -0.05}) and not lab.reverses({"a": 0.01, "b": -0.01}) and lab.reverses({"a": 0.01, "b": -0.01}, 0.0)
    assert lab.combined([lab.Spread("a", [0, 2]), lab.Spread("b", [0, 2])]) == pytest.approx(2)
    assert lab.confounded("alpha", {"alpha": 0.5})


def test_register(spark):
    reg = claims.register(spark)
    assert reg.count() == 21 == reg.select("id").distinct().count()
    assert claims.unentitled(reg).count() == 0
    assert claims.sigma_violations(reg).count() == 0
    assert claims.by_status(reg, "open").count() == 1
    assert claims.Result("x", "spearman", 0.1, 0.11, 0.0).agrees and not claims.Result("x", "spearman", 0.1, 0.2, 0.0).agrees


SENTENCES = ["the sea was calm and the whale swam deep", "the ocean was calm and the whale swam deep", "the forest was dark and the wolf ran far", "the grove was dark and the wolf ran far"]


def test_build_finds_words_in_like_contexts(spark):
    docs = spark.createDataFrame([(k, " ".join([s] * 50)) for k, s in enumerate(SENTENCES)], "doc_id long, text string")
    config = Config(vocab_size=50, min_count=1, dim=8, oversample=8, min_pair_weight=0.0)
    space, report = build(docs, config)
    assert [s[0] for s in report.stages] == ["read", "vocabulary", "co-occurrence", "ppmi", "factorise"]
    assert space.similarity("sea", "ocean") > 0.9
    assert space.neighbors("sea", 1).first()["word"] == "ocean"
    assert math.isclose(build(docs, config.with_(seed=5))[0].similarity("sea", "wolf"), space.similarity("sea", "wolf"), abs_tol=1e-3)
    with pytest.raises(ValueError, match="no token"):
        build(docs.limit(0), config)


def test_config_keys():
    a, b = Config(), Config(eigenvalue_power=0.5)
    assert a.key("factors") == b.key("factors") and a.key("space") != b.key("space")
    assert a.key("counts") != Config(window=2).key("counts") and a.key("vocab") == Config(window=2).key("vocab")


def test_probe_scores_one_build_on_every_axis(spark):
    docs = spark.createDataFrame([(k, " ".join([s] * 50)) for k, s in enumerate(SENTENCES)], "doc_id long, text string")
    base = Config(vocab_size=50, min_count=1, dim=4, oversample=4, min_pair_weight=0.0)
    few = dict(block=40, pair_vocab=12, pair_count=30)
    tried = {"factorisation": (base.seed,), "pair sample": (20260811, 7), "block size": (40,), "block phase": (0,), "pair ceiling": (12,)}
    ruler = lab.build_ruler(docs, base, **few)
    assert ruler.drawn == 30 and ruler.coverage == pytest.approx(30 / ruler.words.count())
    again = ruler.redrawn(12, 30).actual
    assert sorted(again.collect()) == sorted(ruler.actual.collect())
    got = lab.probe(docs, base, tried, **few)
    assert [a.name for a in got] == list(lab.PROBE)
    assert all(a.values[0] == pytest.approx(ruler.score(base), abs=1e-6) for a in got) and len(got[1].values) == 2
