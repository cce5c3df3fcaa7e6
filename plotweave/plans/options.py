"""Parameters of the workflows, and their named faults."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace


# The defaults of the workflows.
@dataclass(frozen=True)
class Options:
    """Defaults of every entry point; ``for_entry`` has those that differ."""

    window: int = 10
    n_clusters: int = 50
    n_iter: int = 10
    alpha_metrics: tuple[str, ...] = ("shannon",)
    hill_order: float = 1
    beta_metrics: bool = True
    fd_metrics: tuple[str, ...] = ()
    pcelim: float = 0.02
    min_sun: float = 0.25
    alpha_sample: int = 100_000
    beta_sample: int = 2_000
    dimensions: int = 3
    neighbours: int = 3
    moving_window: bool = False
    iqr_weight: float = 3.0
    starts: int = 10
    seed: int = 0
    algorithm: str = "hartigan-wong"


# Where an entry point's defaults differ.
DEFAULTS = {
    "full": Options(),
    "tiles": Options(iqr_weight=4.0),
    "species_map": Options(n_iter=1, beta_metrics=False),
    "classes": Options(n_iter=1, alpha_metrics=("richness", "shannon", "simpson", "hill"), beta_sample=1_000),
    "abundance": Options(n_iter=1, pcelim=0.0, beta_sample=1_000),
    "plots": Options(alpha_metrics=("richness", "shannon", "simpson", "hill", "fisher")),
}


def for_entry(entry: str, **changes) -> Options:
    return replace(DEFAULTS[entry], **changes)


FATAL = {"no_stored_model": "no stored model to apply: fit one first", "no_pca": "no principal components: fit them first", "pca_choice": "no component was chosen"}
NOTES = {"no_model": "no stored model: it will be fitted", "few_pixels": "fewer pixels than wanted: all are used"}


class WorkflowError(RuntimeError):
    """A workflow can't go on."""


def report(name: str) -> None:
    """Raise a fatal fault by name, warn of another."""
    if name in FATAL:
        raise WorkflowError(FATAL[name])
    warnings.warn(NOTES[name], stacklevel=2)
