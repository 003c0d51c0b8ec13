"""Command line: ``python -m vocarium COMMAND``; each command is a table and its rendering."""

from __future__ import annotations

import argparse
import sys

from .config import Config
from .functions.render import table
from .session import session
from .sources.kept import kept


def _docs(spark, args):
    from .sources import corpus

    if args.documents:
        return spark.read.parquet(args.documents)
    return corpus.read_texts(spark, f"{args.corpus}/*.txt")


def _space(spark, args):
    from .operators.space import Space
    from .sources import codec

    return codec.load(spark, args.space) if args.space.endswith(".bin") else Space.read(spark, args.space)


def _config(args) -> Config:
    names = {"vocab": "vocab_size", "dim": "dim", "window": "window", "min_pair_weight": "min_pair_weight", "power_iterations": "power_iterations", "min_count": "min_count"}
    return Config(**{field: getattr(args, a) for a, field in names.items() if getattr(args, a, None) is not None})


def fetch(spark, args):
    from .sources import corpus

    print("\n".join(corpus.fetch(spark, args.corpus, args.collection)) or "nothing is missing")


def build(spark, args):
    from .plans.build import build as make
    from .sources import codec

    space, report = make(_docs(spark, args), _config(args))
    if args.space.endswith(".bin"):
        codec.save(space, args.space)
    else:
        space.write(args.space)
    print(report.render())


def neighbors(spark, args):
    print(table(("word", "score"), [(r["word"], r["score"]) for r in _space(spark, args).neighbors(args.word, args.n, args.metric).collect()]))


def analogy(spark, args):
    s = _space(spark, args)
    got = s.analogy_mul(args.a, args.b, args.c, args.n) if args.method == "3cosmul" else s.analogy(args.a, args.b, args.c, args.n, args.metric)
    print(table(("word", "score"), [(r["word"], r["score"]) for r in got.collect()]))


def similarity(spark, args):
    print(table(("a", "b", "score"), _space(spark, args).similarities(args.words, args.metric).collect()))


def axis(spark, args):
    s = _space(spark, args)
    words = args.words or [r["word"] for r in s.table.orderBy("id").limit(args.n).collect()]
    print(table(("word", "score"), s.axis(args.negative, args.positive, words).collect()))


def evaluate(spark, args):
    from .plans import laboratory as lab

    s = _space(spark, args)
    print(table(("method", "category", "asked", "top1", "top5", "form"), lab.evaluate(s, limit=args.limit, seed=args.seed).orderBy("method", "category").select("method", "category", "asked", "top1", "top5", "form").collect()))
    if args.misses:
        print(table(("category", "a", "b", "c", "d", "given"), lab.misses(s, limit=args.limit, seed=args.seed).limit(args.misses).collect()))


def sweep(spark, args):
    from .plans import laboratory as lab

    print(table(("power", "asked", "top1", "top5", "form"), [(p, *t.values()) for p, t in lab.sweep_power(_space(spark, args), method=args.method, limit=args.limit)]))


def heldout(spark, args):
    from .plans import laboratory as lab

    config = _config(args)
    ruler = lab.build_ruler(_docs(spark, args), config, args.block, pair_count=args.pairs, attempts=20)
    rows = lab.sweep_heldout(ruler, ruler.stages.space(config), args.powers)
    best = max(r[1] for r in rows)
    print(table(("power", "rho", "pairs", ""), [(*r, "best" if r[1] == best else "") for r in rows]))


def baseline(spark, args):
    from .plans import laboratory as lab

    config = _config(args)
    # both systems come from the same half of the text
    ruler = lab.build_ruler(_docs(spark, args), config)
    c = lab.compare(ruler.stages.space(config), ruler.stages.weighted(config), ruler.stages.vocab(config), args.limit)
    rows = []
    for m, (s, d) in c.discordant.items():
        p = c.significance(m)
        rows.append((m, c.sparse[m], c.dense[m], s, d, p, ("sparse" if s > d else "dense") if p < 0.05 else "neither"))
    print(table(("metric", "sparse", "dense", "sparse only", "dense only", "p", "winner"), rows))


def audit(spark, args):
    from .plans import laboratory as lab

    found = lab.audit(lab.build_ruler(_docs(spark, args), _config(args)), base=_config(args), progress=lambda p, v: print(p, v, file=sys.stderr))
    print(table(("parameter", "value", "rho", ""), [(f.parameter, v, s, "default" if v == f.default else "") for f in found for v, s in f.scores]))
    print("defaults that lose:", ", ".join(f.parameter for f in found if not f.default_wins) or "none")


def dimensions(spark, args):
    from .plans import laboratory as lab

    config = _config(args).with_(dim=max(args.dims))
    ruler = lab.build_ruler(_docs(spark, args), config)
    print(table(("dims", "rho", "asked", "top1", "top5", "form"), [(d, rho, *t.values()) for d, rho, t in lab.dimension_curve(ruler, ruler.stages.space(config), args.dims)]))


def subspaces(spark, args):
    from .plans import laboratory as lab
    from .plans.build import Stages, lists_of

    config = _config(args)
    stages = Stages(kept(lists_of(_docs(spark, args), config)))
    print(table(("slice", "mean", "aligned", "least"), [(o.label, o.mean, o.aligned, o.least) for o in lab.compare_subspaces(stages.space(config), stages.space(config.with_(factoriser="krylov")))]))


def noise(spark, args):
    from .plans import laboratory as lab

    print(table(("measure", "mean", "sd", "floor"), [(s.name, s.mean, s.sd, s.floor) for s in lab.measure(lab.build_ruler(_docs(spark, args), _config(args)), range(args.seeds), _config(args))]))


def claims(spark, args):
    from .plans import claims as c

    reg = c.register(spark)
    print(table(("claim", "status", "sigma", "unit"), (c.by_status(reg, args.status) if args.status else reg).select("id", "status", "sigma", "unit").collect(), 1))
    print("without the controls their status needs:", ", ".join(r["id"] for r in c.unentitled(reg).collect()) or "none")
    print(table(("control", "claims"), c.control_usage(reg).orderBy("control").collect()))


def verify(spark, args):
    from .plans import claims as c

    got = c.verify(_docs(spark, args), tuple(args.only), _config(args), args.collection)
    print(table(("claim", "recorded", "observed", "drift", "agrees"), [(r.id, r.recorded, r.observed, r.drift, r.agrees) for r in got]))
    print(c.summarise(got))
    return int(any(not r.agrees for r in got))


def robustness(spark, args):
    from .plans import claims as c
    from .plans import laboratory as lab

    docs = _docs(spark, args)
    if args.rulers:
        for claim, effects in c.ruler_sweep(docs, _config(args)).items():
            print(claim, effects, "reverses" if lab.reverses(effects, c.EFFECT_SD) else "")
        return
    axes = lab.probe(docs, _config(args))
    print(table(("axis", "mean", "sd", "range"), [(a.name, a.mean, a.sd, a.range) for a in axes]))
    print(lab.robustness_verdict([a for a in axes if a.name != "pair ceiling"], args.seed_floor))


def demo(spark, args):
    s = _space(spark, args)
    for r in s.table.orderBy("id").limit(args.n).collect():
        print(r["word"], "->", ", ".join(x["word"] for x in s.neighbors(r["word"], 5).collect()))


def info(spark, args):
    s = _space(spark, args)
    print(table(("setting", "value"), [("words", len(s)), ("dim", s.dim), *((k, str(v)[:60]) for k, v in sorted(s.meta.items()))]))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vocarium")
    subs = top.add_subparsers(dest="command", required=True)

    def add(run, *options):
        p = subs.add_parser(run.__name__)
        p.set_defaults(run=run)
        p.add_argument("--master")
        p.add_argument("--space", default="space.parquet")
        p.add_argument("--corpus", default="corpus")
        p.add_argument("--documents", help="a Parquet table (doc_id, text) in place of text files")
        p.add_argument("--collection", default="novels")
        for names, kw in options:
            p.add_argument(*names, **kw)

    o = lambda *names, **kw: (names, kw)
    made = [o("--vocab", type=int), o("--window", type=int), o("--dim", type=int), o("--min-pair-weight", type=float), o("--power-iterations", type=int), o("--min-count", type=int)]
    metric, method = o("--metric", default="cosine"), o("--method", default="3cosadd", choices=("3cosadd", "3cosmul"))
    add(fetch)
    add(build, *made)
    add(neighbors, o("word"), o("-n", type=int, default=10), metric)
    add(analogy, o("a"), o("b"), o("c"), o("-n", type=int, default=5), metric, method)
    add(similarity, o("words", nargs="+"), metric)
    add(axis, o("negative"), o("positive"), o("words", nargs="*"), o("-n", type=int, default=20))
    add(evaluate, o("--limit", type=int, default=120), o("--seed", type=int, default=20260811), o("--misses", type=int, default=0))
    add(sweep, method, o("--limit", type=int, default=60))
    add(heldout, *made, o("--block", type=int, default=4000), o("--pairs", type=int, default=4000), o("--powers", type=float, nargs="+", default=[0, 0.25, 0.5, 0.75, 1, 1.25, 1.5]))
    add(baseline, *made, o("--limit", type=int, default=120))
    add(audit, *made)
    add(dimensions, *made, o("--dims", type=int, nargs="+", default=[16, 32, 48, 64, 96, 128, 160]))
    add(subspaces, *made)
    add(noise, *made, o("--seeds", type=int, default=6))
    add(claims, o("--status"))
    add(verify, *made, o("only", nargs="*"))
    add(robustness, *made, o("--seed-floor", type=float, default=0.0047), o("--rulers", action="store_true"))
    add(demo, o("-n", type=int, default=10))
    add(info)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(session(args.master), args) or 0


if __name__ == "__main__":
    sys.exit(main())
