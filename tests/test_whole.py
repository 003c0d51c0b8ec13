"""The registered queries do the whole job; those without SQL are held against brute force."""

import inspect
import math
from collections import defaultdict

from vocarium import queries
from vocarium.config import Config
from vocarium.operators import sparse_space
from vocarium.plans import claims, laboratory


def test_engine_queries_take_the_operators_own_settings(monkeypatch, spark):
    assert queries.WHOLE == Config()
    seen = {}

    def keep(name, module, result):
        f = getattr(module, name)

        def run(*args, **options):
            bound = inspect.signature(f).bind(*args, **options)
            bound.apply_defaults()
            seen[name] = bound.arguments
            return result

        monkeypatch.setattr(module, name, run)

    class Stub:
        table = type("T", (), {"persist": lambda self: self})()

    class Stages:
        space = lambda self, config: seen.setdefault("space", config) and Stub()

    ruler = type("R", (), {"stages": Stages()})()
    monkeypatch.setattr(queries, "_table", lambda *a: None)
    monkeypatch.setattr(queries, "_stages", lambda *a: Stages())
    rows = [("x", 0, dict(asked=1, top1=1, top5=1, form=1))]
    for name, module, result in (
        ("build_ruler", laboratory, ruler), ("dimension_curve", laboratory, [(4, 0.5, rows[0][2])]), ("sweep_power", laboratory, [(1.0, rows[0][2])]), ("ablate_signs", laboratory, rows),
        ("audit", laboratory, [laboratory.Finding("window", 4)]), ("audit_tokenisation", laboratory, [("x", 0.5, 1.0)]), ("ruler_sweep", claims, {"c": {"r": 0.1}}), ("compare_subspaces", laboratory, [laboratory.Overlap("x", [1.0])]),
    ):
        keep(name, module, result)
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *a, **b: a[0])
    for name in ("dimension_curve", "power_sweep", "sign_ablation", "audit_window", "audit_tokenisation", "ruler_sweep", "principal_angles"):
        queries.QUERIES[name](spark, "")
    assert (seen["build_ruler"]["pair_vocab"], seen["build_ruler"]["pair_count"]) == (1200, 4000) == (seen["audit_tokenisation"]["pair_vocab"], seen["audit_tokenisation"]["pair_count"])
    assert seen["audit"]["grid"] in (None, laboratory.GRID) and seen["audit_tokenisation"]["variants"] == laboratory.TOKENISATIONS
    assert seen["dimension_curve"]["dims"] == laboratory.DIMENSIONS and seen["space"].dim == max(laboratory.DIMENSIONS)
    assert seen["ruler_sweep"]["rulers"] == laboratory.RULERS and seen["ruler_sweep"]["only"] == () and not seen["ruler_sweep"]["options"].keys() & {"pair_vocab", "pair_count"}
    assert seen["ablate_signs"]["random_draws"] == 8 and seen["sweep_power"]["limit"] == seen["ablate_signs"]["limit"] == seen["dimension_curve"]["limit"] == 60
    assert seen["compare_subspaces"]["slices"] == laboratory.SLICES


def test_all_cosines_against_brute_force(spark):
    cells = [(i, (i * k * k + 3 * k) % 40, 0.5 + (i + k) % 5) for i in range(0, 30) for k in range(1, 4)]
    rows = defaultdict(dict)
    for i, j, v in cells:
        rows[i][j] = v
    cells = [(i, j, float(v)) for i, r in rows.items() for j, v in r.items()]
    norm = {i: math.sqrt(sum(v * v for v in r.values())) for i, r in rows.items()}
    want = {(a, b): sum(v * rows[b][j] for j, v in rows[a].items() if j in rows[b]) / norm[a] / norm[b] for a in rows for b in rows if a < b and rows[a].keys() & rows[b].keys()}
    df = spark.createDataFrame(cells, "i int, j int, v double")
    for block in (7, 256):
        got = {(r["i"], r["j"]): r["cosine"] for r in sparse_space.all_cosines(df, block).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert sparse_space.all_cosines(df.limit(0)).count() == 0


def test_every_word_has_its_top_contexts(spark):
    w = spark.createDataFrame([(i, j, float((i * 7 + j * 3) % 11)) for i in range(25) for j in range(14)], "i int, j int, v double")
    names = spark.createDataFrame([(k, f"w{k}") for k in range(25)], "id int, word string")
    got = defaultdict(dict)
    for r in queries.top_contexts(w, names).collect():
        got[r["word"]][r["rnk"]] = r["context"]
    assert len(got) == 25
    for i in range(25):
        best = sorted(range(14), key=lambda j: (-((i * 7 + j * 3) % 11), -j))[:10]
        assert got[f"w{i}"] == {k: f"w{j}" for k, j in enumerate(best, 1)}
