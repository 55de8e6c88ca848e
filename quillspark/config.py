"""Parameters: lists, registries, experiment configuration."""

from __future__ import annotations

from dataclasses import dataclass, field

from .functions.labels import Ranges, check_ranges, check_transforms
from .operators.learn import GRIDS, LEARNERS
from .schema import LABELS, label_group

# Objective names.
OBJECTIVES = {
    "pearson_r": "pearson_r_rounded",
    "spearman": "spearman_rounded",
    "kendall_tau": "kendall_tau_rounded",
    "precision_macro": "precision_macro",
    "precision_weighted": "precision_weighted",
    "recall": "recall_macro",
    "f1_macro": "f1_macro",
    "f1_weighted": "f1_weighted",
    "f1_score_least_frequent": "f1_score_least_frequent",
    "accuracy": "accuracy",
    "uwk": "uwk",
    "uwk_off_by_one": "uwk_off_by_one",
    "qwk": "qwk",
    "qwk_off_by_one": "qwk_off_by_one",
    "lwk": "lwk",
    "lwk_off_by_one": "lwk_off_by_one",
}


def _names(s: str) -> list[str]:
    return [x.strip() for x in s.split(",")]


def parse_games(s: str, known: list[str]) -> set[str]:
    """Empty, ``all``, or a comma list of known games."""
    if not s.strip():
        return set()
    if s.strip() == "all":
        return set(known)
    got = set(_names(s))
    if not got <= set(known):
        raise ValueError(f"unknown games: {sorted(got - set(known))}")
    return got


def parse_learners(s: str) -> set[str]:
    """P9."""
    got = set(_names(s))
    if not got <= set(LEARNERS):
        raise ValueError(f"unknown learners: {sorted(got - set(LEARNERS))}")
    return got


def parse_attributes(s: str, label: str) -> set[str]:
    """P10: ``all`` is everything outside the target's group, ``none`` nothing; a list must keep out of it."""
    if label not in LABELS:
        raise ValueError(f"unknown label: {label!r}")
    if s.strip() == "none":
        return set()
    group = set(label_group(label))
    if s.strip() == "all":
        return set(LABELS) - group
    got = set(_names(s))
    if not got <= set(LABELS):
        raise ValueError(f"unknown attributes: {sorted(got - set(LABELS))}")
    if got & group and len(group) > 1:
        raise ValueError(f"attributes of the target's own group: {sorted(got & group)}")
    return got


@dataclass(frozen=True)
class Experiment:
    """A validated experiment."""

    games: set[str]
    learners: list[str]
    training_rounds: int
    training_samples_per_round: int
    grid_search_samples_per_fold: int
    prediction_label: str
    non_nlp_features: set[str] = field(default_factory=set)
    param_grids: list | None = None
    objective: str | None = None
    data_sampling: str = "even"
    grid_search_folds: int = 5
    hashed_features: int | None = None
    nlp_features: bool = True
    bin_ranges: Ranges | None = None
    lognormal: bool = False
    power_transform: float | None = None
    majority_baseline: bool = True
    rescale: bool = True
    feature_selection_percentile: float = 1.0
    n_jobs: int = 1

    def __post_init__(self):
        def need(ok, what):
            if not ok:
                raise ValueError(what)

        whole = lambda x, least: isinstance(x, int) and not isinstance(x, bool) and x >= least
        need(self.games, "no games")
        need(self.learners and set(self.learners) <= set(LEARNERS), "unknown learner")
        need(whole(self.training_rounds, 2), "training_rounds must be above 1")
        need(whole(self.training_samples_per_round, 1), "training_samples_per_round must be positive")
        need(whole(self.grid_search_samples_per_fold, 2), "grid_search_samples_per_fold must be above 1")
        need(whole(self.grid_search_folds, 2), "grid_search_folds must be above 1")
        need(self.prediction_label in LABELS and self.prediction_label not in self.non_nlp_features, "prediction label")
        need(set(self.non_nlp_features) <= set(LABELS), "unknown attribute")
        need(self.objective is None or self.objective in OBJECTIVES, "unknown objective")
        need(self.data_sampling in ("even", "stratified"), "unknown sampling")
        need(self.hashed_features is None or whole(self.hashed_features, 0), "hashed_features")
        need(self.power_transform is None or (isinstance(self.power_transform, float) and self.power_transform != 0), "power")
        need(isinstance(self.feature_selection_percentile, float) and 0 < self.feature_selection_percentile <= 1, "percentile")
        need(whole(self.n_jobs, 1), "n_jobs")
        for name in ("nlp_features", "lognormal", "majority_baseline", "rescale"):
            need(isinstance(getattr(self, name), bool), name)
        check_transforms(self.lognormal, self.power_transform)
        if self.bin_ranges is not None:
            check_ranges(self.bin_ranges)

    def grids(self) -> list[dict]:
        return self.param_grids or [GRIDS[x] for x in self.learners]
