"""A register of claims as a table, and the questions it answers: who says more than its evidence allows?"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from . import laboratory

#: Spreads of a held-out effect and of a form rate, of a rebuild, and the tolerance in rebuild spreads.
EFFECT_SD, FORM_SD, REBUILD_SD, TOLERANCE = 0.0152, 0.0170, 0.0047, 4
#: The controls there are, in our words.
CONTROLS = {
    "noise-floor": "compared with what chance moves",
    "second-corpus": "run again on other books",
    "held-out": "scored on text not used for building",
    "ruler-invariant": "sign kept under rebuilt truths",
    "unbiased-metric": "the metric does not reward the fit itself",
    "paired-test": "both sides answered the same questions",
    "shared-questions": "questions that all candidates can answer",
    "dimension-matched": "as many dimensions on both sides",
    "random-baseline": "compared with random choices",
    "intervention": "the supposed cause was changed on purpose",
}
#: Controls that a status requires.
REQUIRED = {
    "holds": ("noise-floor", "second-corpus"),
    "single-corpus": ("noise-floor",),
    "backwards": ("noise-floor", "second-corpus"),
    "refuted": ("noise-floor", "second-corpus", "paired-test"),
    "marginal": ("noise-floor",),
    "no-effect": ("noise-floor",),
    "instrument-dependent": ("noise-floor", "ruler-invariant"),
    "open": (),
}
_N, _S, _H, _R, _P, _Q = "noise-floor", "second-corpus", "held-out", "ruler-invariant", "paired-test", "shared-questions"
#: Fixed values: (id, in short, status, effect, effect on the second corpus, sigma, unit, controls, (parameter, against)).
REGISTER = (
    ("ppmi-vs-raw", "ppmi over raw counts", "holds", 0.3531, 0.4787, 23.2, "spearman", (_N, _S, _H, _R), ("weighting", "raw")),
    ("ppmi-vs-log", "ppmi over logged counts", "holds", 0.2669, 0.2802, 17.6, "spearman", (_N, _S, _H, _R), ("weighting", "log")),
    ("cosine-vs-dot", "directions over raw products", "holds", None, None, 11.9, "form", (_N, _S), None),
    ("harmonic-window", "1/d over a flat window", "instrument-dependent", 0.0858, 0.1179, 5.6, "spearman", (_N, _S, _H, _R), ("harmonic", False)),
    ("eigenvalue-exponent", "exponent 1 over 0.5", "holds", 0.1083, 0.1283, 7.1, "spearman", (_N, _S, _H, "unbiased-metric", _R), ("eigenvalue_power", 0.5)),
    ("clipping", "clipped over signed pmi", "holds", 0.0822, 0.0837, 5.4, "spearman", (_N, _S, _H, _R), ("weighting", "pmi")),
    ("pair-pruning", "rare pairs dropped", "instrument-dependent", 0.0533, 0.0832, 3.5, "spearman", (_N, _S, _H, _R), ("min_pair_weight", 0.0)),
    ("no-shift", "no shift over shift 2", "instrument-dependent", 0.0426, 0.0408, 2.8, "spearman", (_N, _S, _H, _R), ("shift", 2.0)),
    ("cosine-vs-euclidean", "cosine over distance", "holds", None, None, 3.4, "form", (_N, _S, _P), None),
    ("lowercasing", "case folded", "holds", None, None, 3.4, "", (_N, _S, _Q, _H), None),
    ("magnitude-ranking", "directions by size, not sign", "holds", None, None, None, "form", (_N, _S, "dimension-matched", "random-baseline"), None),
    ("alpha-smoothing-off", "alpha 1 over 0.75", "no-effect", 0.0042, None, 0.3, "spearman", (_N, _S, _H), ("alpha", 0.75)),
    ("vocabulary-size", "8000 words over 4000", "marginal", None, None, 2.1, "", (_N, _Q, _H), None),
    ("window-size", "window 4 over 2", "no-effect", 0.0219, None, 1.4, "spearman", (_N, _H, _R), ("window", 2)),
    ("window-4-vs-6", "window 4 over 6", "no-effect", -0.0039, None, 0.3, "spearman", (_N, _H, _R), ("window", 6)),
    ("min-count", "the count cutoff", "no-effect", None, None, 0.5, "", (_N, _Q, _H), None),
    ("3cosmul", "products over offsets", "no-effect", None, None, 0.4, "form", (_N,), None),
    ("accurate-factorisation", "accuracy hurts", "refuted", None, None, None, "form", (_N, _S, _P, "unbiased-metric"), None),
    ("compression-trades-identity", "compression gives category for identity", "refuted", None, None, None, "form", (_N, _S, _P), None),
    ("dimension-sweet-spot", "64 dimensions over 160", "refuted", None, None, None, "form", (_N, _S, _P), None),
    ("past-tense-deficit", "sparse rows and -ed in fiction", "open", None, None, None, "", (_S, _Q, "intervention"), None),
)
SCHEMA = "id string, what string, status string, effect double, effect_expository double, sigma double, unit string, controls array<string>, check struct<parameter: string, against: string>"


def register(spark: SparkSession) -> DataFrame:
    for r in REGISTER:
        for c in r[7]:
            if c not in CONTROLS:
                raise KeyError(f"unknown control {c!r}")
    return spark.createDataFrame([(*r[:7], list(r[7]), (r[8][0], json.dumps(r[8][1])) if r[8] else None) for r in REGISTER], SCHEMA)


def required(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, list(c)) for s, c in REQUIRED.items()], "status string, needs array<string>")


def by_status(claims: DataFrame, status: str) -> DataFrame:
    return claims.where(F.col("status") == status)


def missing(claims: DataFrame) -> DataFrame:
    """Every claim with the controls its status needs and it lacks."""
    return claims.join(F.broadcast(required(claims.sparkSession)), "status").withColumn("missing", F.array_sort(F.array_except("needs", "controls"))).drop("needs")


def unentitled(claims: DataFrame) -> DataFrame:
    return missing(claims).where(F.size("missing") > 0)


def unreplicated(claims: DataFrame) -> DataFrame:
    return claims.where(~F.array_contains("controls", _S))


def unchecked_against_the_ruler(claims: DataFrame) -> DataFrame:
    return claims.where((F.col("unit") == "spearman") & ~F.array_contains("controls", _R))


def paired(claims: DataFrame) -> DataFrame:
    return claims.where(F.array_contains("controls", _P))


def recorded(collection: str):
    return F.col("effect_expository" if collection == "expository" else "effect")


def checkable(claims: DataFrame, collection: str = "novels") -> DataFrame:
    return claims.where(F.col("check").isNotNull() & recorded(collection).isNotNull())


def control_usage(claims: DataFrame) -> DataFrame:
    """How many claims lean on each control; unused ones stay with 0."""
    every = claims.sparkSession.createDataFrame([(c,) for c in CONTROLS], "control string")
    used = claims.select(F.explode("controls").alias("control")).groupBy("control").agg(F.count(F.lit(1)).alias("n"))
    return every.join(used, "control", "left").select("control", F.coalesce("n", F.lit(0)).alias("n"))


def sigma_violations(claims: DataFrame) -> DataFrame:
    """Held-out claims whose sigma is not their effect in spreads."""
    return claims.where((F.col("unit") == "spearman") & F.col("effect").isNotNull() & (F.abs(F.col("sigma") - F.abs("effect") / EFFECT_SD) > 0.15))


@dataclass
class Result:
    """A claim measured again."""

    id: str
    unit: str
    recorded: float
    observed: float
    seconds: float

    @property
    def drift(self) -> float:
        return self.observed - self.recorded

    @property
    def tolerance(self) -> float:
        return TOLERANCE * REBUILD_SD if self.unit == "spearman" else float("inf")

    @property
    def agrees(self) -> bool:
        return abs(self.drift) <= self.tolerance


def config_delta(ruler: laboratory.Ruler, check: tuple[str, object], base: Config) -> float:
    return ruler.score(base) - ruler.score(base.with_(**{check[0]: check[1]}))


def verify(docs: DataFrame, only: tuple[str, ...] = (), base: Config | None = None, collection: str = "novels", progress=None, ruler: laboratory.Ruler | None = None) -> list[Result]:
    """Build with the claim's setting changed and compare with what is recorded; the default is built once."""
    base, at = base or Config(), 4 if collection == "expository" else 3
    wanted = [r for r in REGISTER if r[8] and r[at] is not None and (not only or r[0] in only)]
    if not wanted:
        return []
    ruler = ruler or laboratory.build_ruler(docs, base)
    own, out = ruler.score(base), []
    for r in wanted:
        if progress:
            progress(r[0])
        began = time.time()
        out.append(Result(r[0], r[6], r[at], own - ruler.score(base.with_(**{r[8][0]: r[8][1]})), time.time() - began))
    return out


def summarise(results: list[Result]) -> str:
    off = [r.id for r in results if not r.agrees]
    if not results:
        return "no claim to verify"
    return f"{len(results) - len(off)} of {len(results)} within tolerance" + (": not " + ", ".join(off) if off else "")


def ruler_sweep(docs: DataFrame, base: Config | None = None, rulers=laboratory.RULERS, only: tuple[str, ...] = (), **options) -> dict[str, dict[str, float]]:
    """{claim: {ruler: effect}} of every checkable claim, leaving out rulers that vary its own parameter."""
    base = base or Config()
    claims = [r for r in REGISTER if r[8] and r[3] is not None and (not only or r[0] in only)]
    out: dict[str, dict[str, float]] = {r[0]: {} for r in claims}
    first = None
    for label, overrides in rulers:
        # only the truth changes: halves, vocabulary and spaces are the first ruler's
        if first is None:
            first = ruler = laboratory.build_ruler(docs, base, overrides=overrides, **options)
        else:
            ruler = first.judged(overrides, *(options[k] if k in options else d for k, d in (("pair_vocab", 1200), ("pair_count", 4000), ("seed", 20260811), ("attempts", 50))))
        own = ruler.score(base)
        for r in claims:
            if not laboratory.confounded(r[8][0], overrides):
                out[r[0]][label] = own - ruler.score(base.with_(**{r[8][0]: r[8][1]}))
    return out
