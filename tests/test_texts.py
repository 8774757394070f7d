"""Text mining, step rows and configurations."""

import pytest

from ablaspark.operators import configs, relational, steps, texts


def docs(spark, *items):
    return spark.createDataFrame(list(enumerate(items)), "id int, text string")


def found(df, **kw):
    return [(r["metric"], r["value"]) for r in texts.extract_metrics(df, "text", ["id"], **kw).orderBy("id", "line_no").collect()]


def test_published_metric_lines(spark):
    df = docs(spark, "[LightGBM] [Info] Start training from score 206171.291667\nok",
              "Final Validation Performance: 0.9583333333333334", "RMSE = -1.5e3\r\nnothing 3", "accuracy unknown")
    assert found(df) == [
        ("generic", 206171.291667), ("final validation performance", .9583333333333334), ("generic", 1.5)]


def test_unanchored_and_corrected_names(spark):
    df = docs(spark, "rmse: 2.5", "rmse = -1e-3", "test score: 7")
    assert found(df)[0] == ("mse", 2.5)
    assert found(df, compat=False) == [("rmse", 2.5), ("rmse", -0.001), ("score", 7.0)]


def test_quality_and_keywords(spark):
    df = docs(spark, "# head\nfrom x import y\n  # more\nmodel = RandomForestClassifier(SVC)", "")
    a, b = texts.text_quality(df, "text").orderBy("id").collect()
    assert (a["lines_of_code"], a["comment_lines"], a["comment_ratio"]) == (4, 2, .5) and a["has_imports"] and a["has_model"]
    assert b["lines_of_code"] == 1 and not b["has_comments"]
    k = texts.keyword_detect(df, "text").orderBy("id").collect()
    assert k[0]["detected_models"] == ["Random Forest", "Support Vector Machine"] and k[0]["complexity"] == "complex"
    assert k[1]["detected_models"] == [] and k[1]["complexity"] == "simple"


def test_secrets_are_found_and_hidden(spark):
    key = "AKIA" + "ABCDEFGHIJKLMNOP"
    text = "x" * 100 + "\n" + key + " and " + key + "\n" + "y" * 300
    rows = texts.secret_scan(docs(spark, text, "clean"), "text", ["id"]).orderBy("position").collect()
    assert [(r["position"], r["match"]) for r in rows] == [(102, "AKIA" + "*" * 16), (127, "AKIA" + "*" * 16)]
    assert all("ABCD" not in r["context"] and "\n" not in r["context"] for r in rows)
    assert all(len(r["context"]) <= 200 for r in rows)
    open_rows = texts.secret_scan(docs(spark, text), "text", ["id"], redact=False).collect()
    assert {r["match"] for r in open_rows} == {key}
    other = texts.secret_scan(docs(spark, "SK-" + "a" * 40, 'token = "' + "f" * 40 + '"'), "text", ["id"]).collect()
    assert {r["pattern"] for r in other} == {"OpenAI Key (sk-)", "Generic token"}


def test_fenced(spark):
    df = docs(spark, "a\n```python\nx = 1\n```\n```\nlonger = 22\n```", "see\nimport os\nos.x()", "def main():\n  pass", "none")
    first = [r["code"] for r in texts.extract_fenced(df, "text").orderBy("id").collect()]
    assert first == ["x = 1", "import os\nos.x()", "def main():\n  pass", None]
    assert texts.extract_fenced(df, "text", "longest").orderBy("id").first()["code"] == "longer = 22"


def test_tokens_and_tails(spark):
    counts = texts.token_count(docs(spark, "  a b\n c ", "", "   "), "text").orderBy("id").collect()
    assert [r["estimated_tokens"] for r in counts] == [3, 0, 0]
    logs = spark.createDataFrame([("t", "t_1.log", "old"), ("t", "t_2.log", "a\nb\nc\n")], "task string, file string, text string")
    assert relational.log_tail(logs, "task", "file", "text", 2).first()["tail"] == "b\nc"
    assert relational.log_tail(logs, "task", "file", "text", 9).first()["tail"] == "a\nb\nc"


def test_names_and_paths(spark):
    df = docs(spark, "breast_cancer_x_y", "wine", "reg_synth", "plain")
    got = [(r["dataset"], r["variant"]) for r in texts.split_dataset_variant(df, "text").orderBy("id").collect()]
    assert got == [("breast_cancer", "x_y"), ("wine", ""), ("reg", "synth"), ("plain", "")]
    paths = docs(spark, "a/results/iris_1/s.csv", "results/variants_n5/wine/s.csv", "old/digits_2/s.csv", "x/y")
    got = [r["dataset_variant"] for r in texts.dataset_from_path(paths, "text").orderBy("id").collect()]
    assert got == ["iris_1", "wine", "digits_2", "unknown"]
    kinds = texts.classify_artifact(docs(spark, "init_code_1.py", "train0.py", "zzz.py"), "text").orderBy("id").collect()
    assert [r["artifact_type"] for r in kinds] == ["initialization", "train", "other"]


def test_step_names(spark):
    rows = [("p", 1, "imputer", "SimpleImputer"), ("p", 2, "Scaler", "StandardScaler"), ("p", 3, "reduce", "PCA"),
            ("p", 4, "my_clf", "SVC"), ("p", 5, "other", "X"), ("q", 1, "est", "VotingClassifier")]
    df = spark.createDataFrame(rows, "pipeline string, pos int, name string, class string")
    named = steps.canonical_steps(df)
    assert [r["step"] for r in named.where("pipeline = 'p'").orderBy("pos").collect()] == [
        "preprocessor", "preprocessor_1", "feature_engineering", "model", "other"]
    info = {r["pipeline"]: r for r in steps.ablation_meaningful(steps.inspect_steps(named)).collect()}
    assert info["p"]["has_scaler"] and info["p"]["has_feature_engineering"] and info["p"]["meaningful"]
    assert info["q"]["has_ensembling"] and not info["q"]["meaningful"] and info["q"]["model_type"] == "VotingClassifier"


def test_simulated_variants_keep_the_last_step(spark):
    df = spark.createDataFrame([("p", 1, "scaler->StandardScaler"), ("p", 2, "pca->PCA")], "pipeline string, pos int, description string")
    got = {}
    for r in steps.simulate_ablation(df).collect():
        got.setdefault(r["variant"], []).append(r["pos"])
    assert sorted(got["full"]) == [1, 2] and got["no_scaling"] == [2] and got["no_feature_engineering"] == [1]
    only = df.where("pos = 2")
    assert [r["pos"] for r in steps.simulate_ablation(only).where("variant = 'minimal'").collect()] == [2]


def test_configs(spark):
    table = configs.config_table(spark, configs.standard_configs()).collect()
    assert [(r["name"], r["active_components"], r["scaler_type"]) for r in table] == [
        ("full", 4, "standard"), ("no_scaling", 3, "none"), ("no_feature_engineering", 3, "standard"),
        ("no_tuning", 3, "standard"), ("no_ensemble", 3, "standard"), ("minimal", 0, "none")]
    assert [c.active_components for c in configs.cumulative_configs()] == [0, 1, 2, 3, 4]
    assert [c.is_full for c in configs.cumulative_configs()] == [False] * 4 + [True]
    with pytest.raises(ValueError):
        configs.custom_config("x", scaler_type="other")
    custom = configs.custom_config("x", use_scaling=False, use_ensembling=False, extra={"k": "1"})
    assert custom.scaler_type == "none" and custom.description.startswith("Pipeline")
    assert len(configs.variant_grid(["standard", "none"], ["rf", "lr"])) == 4
    bad = spark.createDataFrame([("x", True, True, True, True, "d", "weird", None, {})], configs.CONFIG_SCHEMA)
    with pytest.raises(Exception, match="weird"):
        configs.normalize_configs(bad).collect()


def test_manifest_filters(spark):
    text = ('{"total_entries": 3, "entries": [{"task": "a", "run_id": "1", "source": "s", "destination": "d", "artifact_type": "train"},'
            '{"task": "b", "run_id": "2", "source": "s", "destination": "d", "artifact_type": "other"},'
            '{"task": "a", "run_id": "2", "source": "s", "destination": "d", "artifact_type": "ensemble"}]}')
    df = docs(spark, text)
    assert texts.explode_manifest(df, "text").count() == 2
    assert texts.explode_manifest(df, "text", types=None).count() == 3
    assert texts.explode_manifest(df, "text", tasks=["a"], runs=["2"]).count() == 1
