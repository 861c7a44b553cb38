"""Imputers by key."""

from __future__ import annotations

from collections.abc import Sequence

from .dae import DenoisingImputer
from .forest import MissForest
from .mice import Mice
from .simple import MeanMode, MedianMode

IMPUTERS = {
    "meanmode": MeanMode,
    "medianmode": MedianMode,
    "mice": Mice,
    "missforest": MissForest,
    "dae": DenoisingImputer,
}
SEEDED = ("mice", "missforest", "dae")


def build_imputer(key: str, seed: int = 42, keys: Sequence[str] = (), **options):
    """Imputer with `fit(df)` to a model with `transform(df)`, and `fit_transform(df)`."""
    if key not in IMPUTERS:
        raise ValueError(f"Unknown imputer '{key}'.")
    if key in SEEDED:
        options["seed"] = seed
    return IMPUTERS[key](keys=keys, **options)
