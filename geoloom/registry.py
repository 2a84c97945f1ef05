"""The operator registry: kind, least observations, outputs and how each runs; extension is by registering here."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from geoloom.operators import descriptors, grouped, pairs, rolling

KINDS = ("series", "pair", "cohort", "window")


@dataclass(frozen=True)
class Operator:
    """``build`` takes a panel (series), pairs (pair) or an edge list (cohort) and returns a DataFrame."""

    name: str
    kind: str
    build: Callable[..., DataFrame]
    native: bool
    min_obs: int = 0
    phase: str = "derived"
    normalisation: str = "none"
    priority: int = 2
    params: dict = field(default_factory=dict)

    def __call__(self, df: DataFrame, **params) -> DataFrame:
        return self.build(df, **{**self.params, **params})


REGISTRY: dict[str, Operator] = {}


def register(op: Operator) -> Operator:
    if op.kind not in KINDS:
        raise ValueError(f"{op.kind} is none of {KINDS}")
    if op.name in REGISTRY:
        raise ValueError(f"{op.name} is registered already")
    REGISTRY[op.name] = op
    return op


def get(name: str) -> Operator:
    if name not in REGISTRY:
        raise KeyError(f"no operator {name}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


def select(kind: str | None = None, phase: str | None = None, priority: int | None = None) -> list[Operator]:
    return [o for o in REGISTRY.values() if (kind is None or o.kind == kind) and (phase is None or o.phase == phase) and (priority is None or o.priority <= priority)]


def execute(name: str, panel: DataFrame, normalisation: str | None = None, **params) -> DataFrame:
    """Normalise as the operator asks (or as told), then run it."""
    from geoloom.operators.joins import pairs_on_date
    from geoloom.operators.panel import normalise

    op = get(name)
    ready = normalise(panel, normalisation or op.normalisation)
    return op(pairs_on_date(ready) if op.kind == "pair" and not op.native else ready, **params)


for _name, _build, _min, _norm in (
    ("basic_stats", descriptors.basic_stats, 10, "none"), ("self_beta", descriptors.rolling_self_beta, 63, "none"), ("autocorrelation", descriptors.autocorrelation, 50, "none"), ("trend", descriptors.trend, 30, "none"),
    ("mann_kendall", descriptors.mann_kendall, 30, "none"), ("volatility", descriptors.volatility, 63, "none"), ("parkinson", descriptors.parkinson, 63, "none"), ("variance_ratio", descriptors.variance_ratio, 16, "none"),
    ("half_life", descriptors.half_life, 50, "none"), ("window_stability", descriptors.window_stability, 50, "none"), ("hurst_rs", descriptors.hurst_rs, 20, "none"), ("dfa", descriptors.dfa, 100, "none"),
    ("permutation_entropy", descriptors.permutation_entropy, 50, "none"), ("sample_entropy", descriptors.sample_entropy, 50, "none"), ("garch", descriptors.garch_heuristic, 50, "none"), ("signature_diagnostics", descriptors.signature_diagnostics, 30, "none"),
    ("rolling", rolling.rolling, 0, "none"),
):
    register(Operator(_name, "series", _build, True, _min, normalisation=_norm))
for _name, _build, _norm in (
    ("correlation", pairs.correlation_pairs, "returns"), ("cross_correlation", pairs.cross_correlation, "zscore"), ("mutual_information", pairs.mutual_information, "none"), ("transfer_entropy", pairs.transfer_entropy, "none"),
    ("rank_dependence", pairs.rank_dependence, "none"), ("kendall", pairs.kendall, "none"), ("distances", pairs.distances, "zscore"), ("spread", pairs.spread, "none"),
):
    register(Operator(_name, "pair", _build, True, 30, normalisation=_norm))
for _name, (_min, _) in grouped.SERIES.items():
    register(Operator(f"kernel_{_name}", "series", grouped.series_descriptors, False, _min, params={"names": [_name]}))
for _name, (_min, _) in grouped.PAIRS.items():
    register(Operator(f"kernel_{_name}", "pair", grouped.pair_descriptors, False, _min, params={"names": [_name]}))
for _name, _build in (("eigen_structure", grouped.eigen_structure), ("clusters", grouped.clusters), ("decontamination", grouped.decontamination), ("mahalanobis", grouped.mahalanobis)):
    register(Operator(_name, "cohort", _build, False, 30))
