"""Ablation configurations, as Python values and as table columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.safe import q

SCALER_TYPES = ("standard", "minmax", "robust", "none")
TOGGLES = ("use_scaling", "use_feature_engineering", "use_hyperparam_tuning", "use_ensembling")
CONFIG_SCHEMA = (
    "name string, use_scaling boolean, use_feature_engineering boolean, use_hyperparam_tuning boolean,"
    " use_ensembling boolean, model_type string, scaler_type string, description string, extra map<string,string>"
)

# Fixed description texts (Ukrainian, as users of the result tables know them).
_PART_TEXT = {
    "use_feature_engineering": "інженерія ознак",
    "use_hyperparam_tuning": "тюнінг гіперпараметрів",
    "use_ensembling": "ансамблювання",
}
_MINIMAL_TEXT = "Мінімальний pipeline (тільки базова модель)"


@dataclass(frozen=True)
class AblationConfig:
    """Which components of a pipeline are on."""

    name: str
    use_scaling: bool = True
    use_feature_engineering: bool = True
    use_hyperparam_tuning: bool = True
    use_ensembling: bool = True
    model_type: str = "default"
    scaler_type: str = "standard"
    description: str | None = None
    extra: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.scaler_type not in SCALER_TYPES:
            raise ValueError(f"scaler_type '{self.scaler_type}' must be one of {SCALER_TYPES}")
        if self.description is None:
            object.__setattr__(self, "description", self._text())
        if not self.use_scaling:
            object.__setattr__(self, "scaler_type", "none")

    def _text(self) -> str:
        parts = [f"масштабування ({self.scaler_type})"] if self.use_scaling else []
        parts += [text for toggle, text in _PART_TEXT.items() if getattr(self, toggle)]
        return f"Pipeline з: {', '.join(parts)}" if parts else _MINIMAL_TEXT

    @property
    def active_components(self) -> int:
        return sum(getattr(self, t) for t in TOGGLES)

    @property
    def is_full(self) -> bool:
        return self.active_components == len(TOGGLES)


def _off(*names: str) -> dict:
    return {f"use_{n}": False for n in names}


def standard_configs() -> list[AblationConfig]:
    """full, each component off in turn, and minimal."""
    every = ("scaling", "feature_engineering", "hyperparam_tuning", "ensembling")
    return [
        AblationConfig("full", description="Повний pipeline з усіма компонентами (baseline)"),
        AblationConfig("no_scaling", description="Pipeline без масштабування ознак", **_off("scaling")),
        AblationConfig("no_feature_engineering", description="Pipeline без інженерії ознак",
                       **_off("feature_engineering")),
        AblationConfig("no_tuning", description="Pipeline без підбору гіперпараметрів", **_off("hyperparam_tuning")),
        AblationConfig("no_ensemble", description="Pipeline без ансамблювання моделей", **_off("ensembling")),
        AblationConfig("minimal", description=_MINIMAL_TEXT, **_off(*every)),
    ]


def cumulative_configs() -> list[AblationConfig]:
    """Five stages, one component more at each."""
    names = ("stage_0_model_only", "stage_1_with_scaling", "stage_2_with_features", "stage_3_with_tuning",
             "stage_4_full")
    return [AblationConfig(n, **{t: i < on for i, t in enumerate(TOGGLES)}) for on, n in enumerate(names)]


def custom_config(name: str, **options) -> AblationConfig:
    return AblationConfig(name=name, **options)


def variant_grid(scalers: Sequence[str], models: Sequence[str], **options) -> list[AblationConfig]:
    """One configuration per scaler and model; 'none' turns scaling off."""
    return [
        AblationConfig(f"{m}_{s}", use_scaling=s != "none", scaler_type=s, model_type=m, **options)
        for m in models for s in scalers
    ]


def config_table(spark: SparkSession, configs: Sequence[AblationConfig]) -> DataFrame:
    """The configurations as a table, with ``cfg_ord``, active_components and is_full."""
    rows = [(c.name, *[getattr(c, t) for t in TOGGLES], c.model_type, c.scaler_type, c.description,
             {k: str(v) for k, v in c.extra.items()}, i) for i, c in enumerate(configs)]
    return normalize_configs(spark.createDataFrame(rows, CONFIG_SCHEMA + ", cfg_ord int"))


def normalize_configs(configs: DataFrame) -> DataFrame:
    """Apply the configuration rules to a table of any size.

    Scaling off forces scaler 'none', an unknown scaler raises, a missing description is
    written from the parts, and the component count and full flag are added.
    """
    known = ", ".join(f"'{s}'" for s in SCALER_TYPES)
    on = [f"cast({t} as int)" for t in TOGGLES]
    parts = ["case when use_scaling then concat('масштабування (', scaler_type, ')') end"] + [
        f"case when {t} then '{text}' end" for t, text in _PART_TEXT.items()]
    text = (f"case when {' + '.join(on)} = 0 then '{_MINIMAL_TEXT}'"
            f" else concat('Pipeline з: ', concat_ws(', ', {', '.join(parts)})) end")
    described = configs.withColumns({
        "description": F.expr(f"coalesce(description, {text})"),
        "scaler_type": F.expr(
            f"case when scaler_type not in ({known}) then raise_error(concat('unknown scaler_type ', scaler_type))"
            " when not use_scaling then 'none' else scaler_type end"),
        "active_components": F.expr(" + ".join(on)),
    })
    return described.withColumn("is_full", F.expr(f"active_components = {len(TOGGLES)}"))


def read_configs(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """Configurations from JSON objects, one per row, checked against the schema: (good, rejects).

    ``good`` has the configuration's columns, with the rules of ``normalize_configs`` applied; ``rejects`` has the line and all
    reasons against it: no JSON object, no name, fields that a configuration does not have, a switch that is neither true nor
    false, an unknown scaler, an ``extra`` that is no object. Missing fields take their defaults. Other columns go along in both;
    rows are judged one by one, so the table may be of any size.
    """
    fields = [c.split(" ")[0] for c in CONFIG_SCHEMA.split(", ")]
    known = ", ".join(f"'{f}'" for f in fields)
    scalers = ", ".join(f"'{s}'" for s in SCALER_TYPES)
    parsed = lines.withColumn("__m", F.expr(f"from_json({q(line)}, 'map<string,string>')")).withColumn(
        "__extra", F.expr("from_json(__m['extra'], 'map<string,string>')"))
    reasons = ["case when __m is null then 'not a JSON object' end", "case when __m is not null and coalesce(trim(__m['name']), '') = '' then 'no name' end"]
    switches = [f"case when __m['{t}'] is not null and lower(__m['{t}']) not in ('true', 'false') then '{t} is neither true nor false' end"
                for t in TOGGLES]
    switches += [f"case when __m['scaler_type'] not in ({scalers}) then concat('unknown scaler_type ', __m['scaler_type']) end",
                 "case when __m['extra'] is not null and __extra is null then 'extra is not an object' end"]
    strange = f"transform(array_sort(array_except(coalesce(map_keys(__m), array()), array({known}))), f -> concat('unknown field ', f))"
    judged = parsed.withColumn("reasons", F.expr(
        f"filter(concat(array({', '.join(reasons)}), {strange}, array({', '.join(switches)})), r -> r is not null)"))
    kept = [c for c in lines.columns if c != line]
    good = judged.where("size(reasons) = 0").selectExpr(
        *[q(c) for c in kept if c not in fields], "__m['name'] as name", *[f"coalesce(lower(__m['{t}']) = 'true', true) as {t}" for t in TOGGLES],
        "coalesce(__m['model_type'], 'default') as model_type", "coalesce(__m['scaler_type'], 'standard') as scaler_type",
        "__m['description'] as description", "coalesce(__extra, map()) as extra")
    return normalize_configs(good), judged.where("size(reasons) > 0").selectExpr(*map(q, lines.columns), "reasons")


def cross_grid(datasets: DataFrame, **axes: Sequence) -> DataFrame:
    """Every dataset row with every combination of the literal axes (configs, seeds, models).

    The axes are small constants, so the grid is a chain of explodes over the input
    partitions; there is no join and no shuffle.
    """
    out = datasets
    for name, values in axes.items():
        literals = ", ".join("'" + v.replace("'", "\\'") + "'" if isinstance(v, str) else repr(v) for v in values)
        out = out.selectExpr("*", f"explode(array({literals})) as {q(name)}")
    return out
