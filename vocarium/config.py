"""Settings of one build. Frozen; stages are cached by the settings that they depend on."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class Config:
    """The defaults."""

    lowercase: bool = True
    fold_accents: bool = True
    split_clitics: bool = False
    vocab_size: int = 4000
    min_count: int = 10
    window: int = 4
    harmonic: bool = True
    min_pair_weight: float = 1.0
    weighting: str = "ppmi"
    alpha: float = 1.0
    shift: float = 1.0
    dim: int = 64
    factoriser: str = "subspace"
    krylov_block: int = 24
    krylov_depth: int = 4
    oversample: int = 16
    power_iterations: int = 3
    eigenvalue_power: float = 1.0
    shrinkage: float = 0.0
    seed: int = 20260811

    def as_dict(self) -> dict:
        return asdict(self)

    def with_(self, **changes) -> Config:
        return replace(self, **changes)

    def key(self, stage: str) -> str:
        """What a stage's result depends on: its own settings and those of the stages before it."""
        names = [n for s in list(SETTINGS)[: list(SETTINGS).index(stage) + 1] for n in SETTINGS[s]]
        return json.dumps([(n, getattr(self, n)) for n in names])


#: The settings that each stage reads, in the order of the stages.
SETTINGS = {
    "tokens": ("lowercase", "fold_accents", "split_clitics"),
    "vocab": ("vocab_size", "min_count"),
    "counts": ("window", "harmonic", "min_pair_weight"),
    "weighted": ("weighting", "alpha", "shift"),
    "factors": ("dim", "factoriser", "krylov_block", "krylov_depth", "oversample", "power_iterations", "seed"),
    "space": ("eigenvalue_power", "shrinkage"),
}

#: The yardstick for held-out truth; it must not follow Config.
RULER = {"window": 4, "harmonic": True, "min_pair_weight": 1.0, "alpha": 0.75, "shift": 1.0}
