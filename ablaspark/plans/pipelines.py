"""Pipelines that can be taken apart: named steps, a registry of builders, ablation rules."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml.feature import PCA
from pyspark.ml.tuning import CrossValidator

from ..operators.configs import AblationConfig
from ..operators.learners import Ensemble
from ..operators.steps import HINTS, SYNONYMS


@dataclass(frozen=True)
class Step:
    """One step: a stage, or an ordered group of named inner stages.

    ``without`` replaces the step when it is switched off (for example a column rename
    that keeps the vector flowing when PCA goes away).
    """

    name: str
    stage: object = None
    inner: Sequence[tuple[str, object]] = field(default_factory=tuple)
    without: object = None


Builder = Callable[[AblationConfig], Sequence[Step]]
_BUILDERS: dict[str, Builder] = {}


def register_pipeline(name: str, fn: Builder) -> None:
    """Make ``fn(config) -> steps`` available under a name."""
    if not callable(fn):
        raise TypeError("a pipeline builder must be callable")
    _BUILDERS[name] = fn


def registered(name: str) -> Builder:
    if name not in _BUILDERS:
        raise KeyError(f"pipeline '{name}' is not registered; available: {sorted(_BUILDERS)}")
    return _BUILDERS[name]


def as_steps(built) -> list[Step]:
    """Accept steps, a single estimator, (name, estimator) pairs, or a dict holding one of these."""
    if isinstance(built, dict):
        values = [v for v in built.values() if isinstance(v, (list, tuple)) or hasattr(v, "fit")]
        if not values:
            raise TypeError("the builder's dict holds no pipeline")
        return as_steps(values[0])
    if hasattr(built, "fit") or isinstance(built, Ensemble):
        return [Step("model", built)]
    steps = [s if isinstance(s, Step) else Step(s[0], s[1]) for s in built]
    for s in steps:
        for x in [s.stage, *[i for _, i in s.inner]]:
            if x is not None and not (hasattr(x, "fit") or isinstance(x, (Transformer, Ensemble))):
                raise TypeError(f"step '{s.name}' is neither an estimator nor a transformer")
    return steps


def canonical_name(step: Step) -> str:
    """The canonical name that a step's name stands for, else the one of its PCA, else of a hint in its name; else its own name."""
    low = step.name.lower()
    for canonical, names in SYNONYMS.items():
        if low in names:
            return canonical
    if _reduces(step):
        return "feature_engineering"
    for canonical, parts, start in HINTS:
        if any(p in low for p in parts) or (start and low.startswith(start)):
            return canonical
    return step.name


def _reduces(step: Step) -> bool:
    return any(isinstance(x, PCA) for x in [step.stage, *[x for _, x in step.inner]])


def canonical_steps(steps: Sequence[Step]) -> list[Step]:
    """Steps under canonical names; a name that comes again gets a number."""
    out, seen = [], set()
    for s in steps:
        name = base = canonical_name(s)
        number = 0
        while name in seen:
            number += 1
            name = f"{base}_{number}"
        seen.add(name)
        out.append(replace(s, name=name))
    return out


def untuned(stage):
    """A search gives way to the estimator it would tune."""
    return stage.getEstimator() if isinstance(stage, CrossValidator) else stage


def single(stage):
    """An ensemble gives way to one estimator: a vote to its first member, a stack to its final learner, bags to their base."""
    return stage.single() if isinstance(stage, Ensemble) else stage


def plain(stage, config: AblationConfig):
    """The model without what the configuration switches off; searches and ensembles may hold each other."""
    while True:
        inner = stage
        if not config.use_hyperparam_tuning:
            inner = untuned(inner)
        if not config.use_ensembling:
            inner = single(inner)
        if inner is stage:
            return stage
        stage = inner


def ablate_stages(steps: Sequence[Step], config: AblationConfig) -> list[Step]:
    """Switch components off: scaling keeps the imputer, feature engineering drops the reducer,
    tuning unwraps a search, ensembling falls back to one estimator (see ``single``)."""
    out = []
    for s in steps:
        if s.name == "preprocessor" and not config.use_scaling:
            kept = tuple((n, x) for n, x in s.inner if "scale" not in n.lower())
            if kept:
                out.append(replace(s, inner=kept))
            elif s.without is not None:
                out.append(Step(s.name, s.without))
        elif s.name == "feature_engineering" and not config.use_feature_engineering:
            if s.without is not None:
                out.append(Step(s.name, s.without))
        elif s.name == "model":
            out.append(replace(s, stage=plain(s.stage, config)))
        else:
            out.append(s)
    return out


def to_pipeline(steps: Sequence[Step]) -> Pipeline:
    stages: list[Estimator | Transformer] = []
    for s in steps:
        for x in [x for _, x in s.inner] or [s.stage]:
            if x is not None:
                stages.append(x.stage() if isinstance(x, Ensemble) else x)
    return Pipeline(stages=stages)


def build(builder: str | Builder, config: AblationConfig) -> Pipeline:
    fn = registered(builder) if isinstance(builder, str) else builder
    return to_pipeline(ablate_stages(canonical_steps(as_steps(fn(config))), config))
