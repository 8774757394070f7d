"""Pipelines as data: step rows (pipeline, pos, name, class, parent) are named and inspected."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .configs import TOGGLES, AblationConfig
from .ordering import ordered_rank

# Step-name synonyms of the three canonical steps.
SYNONYMS = {
    "preprocessor": ["preprocessor", "scaler", "imputer", "preproc", "pre_processing"],
    "feature_engineering": ["feature_engineering", "fe", "pca", "feature_eng", "feature_engineer"],
    "model": ["model", "estimator", "clf", "regressor", "modeling"],
}
# Parts (and a start) of names that hint at a canonical step, tried in this order.
HINTS = (("feature_engineering", ("pca", "feature"), ""), ("preprocessor", ("scale", "imputer"), "pre"), ("model", ("model", "clf", "reg"), ""))
SCALER_CLASSES = ["StandardScaler"]
TUNER_CLASSES = ["GridSearchCV", "RandomizedSearchCV"]
VOTING_CLASSES = ["VotingClassifier", "VotingRegressor"]
STACKING_CLASSES = ["StackingClassifier", "StackingRegressor"]
BAGGING_CLASSES = ["BaggingClassifier", "BaggingRegressor"]
ENSEMBLE_CLASSES = [*VOTING_CLASSES, *STACKING_CLASSES, *BAGGING_CLASSES]


def _in(column: str, names: Sequence[str]) -> str:
    return f"{column} in ({', '.join(repr(n) for n in names)})"


def canonical_steps(steps: DataFrame) -> DataFrame:
    """Add step: preprocessor / feature_engineering / model, duplicates numbered _1, _2, ...

    Synonyms first, then the class (PCA, also one level down in ``nested``), then parts of
    the name. Duplicate names are numbered in position order.
    """
    low = "lower(name)"
    synonyms = " ".join(f"when {_in(low, names)} then '{c}'" for c, names in SYNONYMS.items())
    nested = "or array_contains(nested, 'PCA')" if "nested" in steps.columns else ""
    rule = (
        f"case {synonyms} when class = 'PCA' {nested} then 'feature_engineering'"
        + "".join(f" when {' or '.join([f'contains({low}, {p!r})' for p in parts] + ([f'startswith({low}, {start!r})'] if start else []))}"
                  f" then '{canonical}'" for canonical, parts, start in HINTS)
        + " else name end"
    )
    named = steps.withColumn("__canon", F.expr(rule))
    numbered = ordered_rank(named, ["pos"], "__nth", by=["pipeline", "__canon"])
    return numbered.withColumn("step", F.expr(
        "case when __nth = 1 then __canon else concat(__canon, '_', __nth - 1) end")).drop("__canon", "__nth")


def inspect_steps(steps: DataFrame, step: str = "step") -> DataFrame:
    """Per pipeline: component flags, type of the last step, number of steps.

    ``nested`` (array of class names, optional) is searched as well.
    """
    has_nested = "nested" in steps.columns

    def seen(names: Sequence[str]) -> str:
        inner = f" or arrays_overlap(coalesce(nested, array()), array({', '.join(repr(n) for n in names)}))"
        return f"bool_or({_in('class', names)}{inner if has_nested else ''})"

    return steps.groupBy("pipeline").agg(
        F.expr(seen(SCALER_CLASSES)).alias("has_scaler"),
        F.expr(f"bool_or({step} = 'feature_engineering')").alias("has_feature_engineering"),
        F.expr(f"bool_or({step} = 'feature_selection')").alias("has_feature_selection"),
        F.expr(seen(TUNER_CLASSES)).alias("has_tuning"),
        F.expr(seen(ENSEMBLE_CLASSES)).alias("has_ensembling"),
        F.expr("max_by(class, pos)").alias("model_type"),
        F.expr("count(1)").alias("n_steps"))


def ablation_meaningful(inspected: DataFrame, required: int = 2) -> DataFrame:
    """Add n_components and meaningful: at least ``required`` of four components present."""
    flags = ["has_scaler", "has_feature_engineering", "has_tuning", "has_ensembling"]
    total = " + ".join(f"cast({f} as int)" for f in flags)
    return inspected.withColumn("n_components", F.expr(total)).withColumn(
        "meaningful", F.expr(f"n_components >= {int(required)}"))


# Words that mark a step as removed under each variant.
VARIANT_WORDS = {
    "full": [],
    "no_scaling": ["scaler", "standard", "minmax", "robust", "scaling"],
    "no_feature_engineering": ["pca", "feature", "select", "poly", "transform", "fe_"],
    "no_tuning": ["gridsearch", "bayessearch", "randomsearch", "optuna", "tuner"],
    "no_ensemble": ["voting", "stacking", "bagging", "ensemble"],
    "minimal": ["pca", "feature", "select", "poly", "gridsearch", "voting", "stacking", "bagging"],
}


def simulate_ablation(steps: DataFrame, text: str = "description",
                      variants: Mapping[str, Sequence[str]] = VARIANT_WORDS) -> DataFrame:
    """(pipeline, variant, pos, text): the steps that survive each variant.

    If a variant removes every step of a pipeline, its last step stays. Survivors are
    found row by row; only the per-pipeline emptiness takes one aggregate for all variants.
    """
    gone = {v: " or ".join(f"contains(__low, '{w}')" for w in words) or "false" for v, words in variants.items()}
    low = steps.selectExpr("pipeline", "pos", text, f"lower({text}) as __low")
    marked = low.selectExpr("pipeline", "pos", text, *[f"{g} as __g{i}" for i, g in enumerate(gone.values())])

    def rows(test: str) -> str:
        picks = ", ".join(f"case when {test.format(g=f'__g{i}')} then '{v}' end" for i, v in enumerate(gone))
        return f"explode(filter(array({picks}), v -> v is not null)) as variant"

    last = marked.groupBy("pipeline").agg(
        F.max("pos").alias("pos"), F.expr(f"max_by({text}, pos)").alias(text),
        *[F.expr(f"bool_and(__g{i})").alias(f"__g{i}") for i in range(len(gone))])
    return marked.selectExpr("pipeline", rows("not {g}"), "pos", text).unionByName(
        last.selectExpr("pipeline", rows("{g}"), "pos", text))


#: Searches and ensembles may hold each other; a tree that goes deeper than this has a node among its own descendants.
MOST_NESTING = 64


def ablate_pipelines(nodes: DataFrame, configs: Sequence[AblationConfig]) -> DataFrame:
    """(pipeline, configuration, pos, step, class, inner): the steps of each pipeline that are left under each configuration.

    ``nodes`` are pipelines as trees: pipeline, node, parent (null for a step), pos, role, name, class. Roles below a step are
    'inner' (a part of a nested pipeline), 'estimator' (what a search tunes), 'member', 'final' and 'base' (of an ensemble).
    Steps get canonical names first. Without scaling the preprocessor loses the parts whose name has 'scale', or goes; without
    feature engineering that step goes. Without tuning a search in the model gives way to its estimator; without ensembling a vote
    gives way to its first member, a stack to its final learner (first member, if there is none), bags to their base - again and
    again, as searches and ensembles may hold each other. What has no such child stays. ``inner`` has the names of the parts left.
    """
    def pick(value: str, role: str) -> str:
        return f"min_by({value}, pos) filter (where role = '{role}')"

    kids = nodes.where("parent is not null").groupBy("pipeline", F.col("parent").alias("node")).agg(
        *[F.expr(pick("node", r)).alias(f"__{r}") for r in ("estimator", "member", "final", "base")],
        F.expr("array_sort(collect_list(struct(pos, name, class)) filter (where role = 'inner'))").alias("__parts"))
    tree = nodes.join(kids, ["pipeline", "node"], "left").withColumns({
        "__tuned": F.expr(f"case when {_in('class', TUNER_CLASSES)} then __estimator end"),
        "__single": F.expr(f"case when {_in('class', VOTING_CLASSES)} then __member when {_in('class', STACKING_CLASSES)}"
                           f" then coalesce(__final, __member) when {_in('class', BAGGING_CLASSES)} then __base end"),
        "__parts": F.expr("coalesce(__parts, array())")})
    tree = cut_lineage(tree.select("pipeline", "node", "parent", "pos", "name", "class", "__tuned", "__single", "__parts"))

    toggles = ", ".join(f"struct('{c.name}' as configuration, " + ", ".join(
        f"{str(getattr(c, t)).lower()} as {t}" for t in TOGGLES) + ")" for c in configs)
    steps = canonical_steps(tree.where("parent is null").withColumn("nested", F.expr("transform(__parts, p -> p.class)")))
    grid = cut_lineage(steps.selectExpr("*", f"inline(array({toggles}))").selectExpr(
        "pipeline", "configuration", "pos", "step", "node", "class", "use_scaling", "use_feature_engineering", "use_hyperparam_tuning",
        "use_ensembling", "__tuned", "__single", "__parts",
        "case when step = 'preprocessor' and not use_scaling then filter(__parts, p -> not contains(lower(p.name), 'scale')) else __parts end as __left"))
    gone = ("step = 'preprocessor' and not use_scaling and size(__left) = 0"
            " or step = 'feature_engineering' and not use_feature_engineering")
    out = ["pipeline", "configuration", "pos", "step", "class", "transform(__left, p -> p.name) as inner"]
    done = grid.where(f"step != 'model' and not ({gone})").selectExpr(*out)

    # the model goes down its tree while its class is switched off
    below = "coalesce(if(use_hyperparam_tuning, null, __tuned), if(use_ensembling, null, __single))"
    inside = tree.selectExpr("pipeline", "node", "class", "__tuned", "__single", "__parts as __left")
    now = grid.where("step = 'model'").drop("__parts").withColumn("__next", F.expr(below))
    for _ in range(MOST_NESTING):
        done = done.unionByName(now.where("__next is null").selectExpr(*out))
        moving = now.where("__next is not null").selectExpr(
            "pipeline", "configuration", "pos", "step", "use_hyperparam_tuning", "use_ensembling", "__next as node")
        now = cut_lineage(moving.join(inside, ["pipeline", "node"]).withColumn("__next", F.expr(below)))
        if now.isEmpty():
            return done
    raise ValueError(f"a model is nested deeper than {MOST_NESTING}")
