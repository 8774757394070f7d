"""Ablation studies, refinement, sources, sinks and streams on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learners, stages
from ..operators.configs import standard_configs
from ..operators.splitting import head_cap, split_holdout
from ..plans import ablation, linear_grid, refinement
from ..plans.pipelines import Step
from ..session import scratch_path
from ..sources import readers, sinks
from ..streaming import files as stream_files
from ..streaming import runs as stream_runs
from . import sqltext as S
from .aggregates import CV_WIDE, cv_wide
from .inputs import runs
from .models import DOC_FEATURES, doc_split, labelled_docs
from .registry import query

# --- ablation ---------------------------------------------------------------------------------------


def doc_builder(config):
    """Impute and scale, reduce by PCA, then a vote of two small models."""
    cols = DOC_FEATURES
    return [
        Step("preprocessor", inner=[("imputer", stages.impute(cols)), ("scaler", stages.scale(cols, "standard"))]),
        Step("assembler", stages.assemble(cols, "raw")),
        Step("feature_engineering", stages.variance_pca("raw", "features"),
             without=stages.ApplyStage(lambda d: d.withColumn("features", F.col("raw")), "keep", ("raw",))),
        Step("model", learners.Voting([("rf", learners.forest(trees=10, depth=4)), ("lr", learners.logistic(1.0, 50))],
                                      kind="soft")),
    ]


query("run_ablation_holdout", "configuration cfg_ord:i run:i random_state:i metric value:f")(
    lambda t: ablation.run_holdout(labelled_docs(t).drop("lang", "source"), ["doc_id"], "label", doc_builder)
    .where("metric != 'train_time'"))

query("run_ablation_cv",
      "config_name repeat:i random_seed:i status n_folds:i mean_accuracy:f std_accuracy:f mean_f1_macro:f std_f1_macro:f use_scaling")(
    lambda t: ablation.run_cv(labelled_docs(t).drop("lang", "source"), ["doc_id"], "label", doc_builder))

_SINGLE = ["l_quantity", "l_discount", "l_tax"]


def _grid_sql(c: str) -> str:
    return f"""SELECT '{c}' AS configuration, f.fold, count(*) AS n, avg((y - b0 - b1 * {c}) * (y - b0 - b1 * {c})) AS mse,
    1 - avg((y - b0 - b1 * {c}) * (y - b0 - b1 * {c})) / var_pop(y) AS r2_score
  FROM b JOIN (SELECT k.fold, regr_slope(b.y, b.{c}) AS b1, regr_intercept(b.y, b.{c}) AS b0 FROM b, (SELECT DISTINCT fold FROM b) k
    WHERE b.fold != k.fold GROUP BY 1) f ON f.fold = b.fold GROUP BY 1, 2"""


query("ablate_linear_grid", "configuration fold:i n:i mse:f rmse:f r2_score:f", f"""
WITH b AS (SELECT CAST(l_orderkey % 5 AS INTEGER) AS fold, l_extendedprice / 1000.0e0 AS y, l_quantity, l_discount, l_tax FROM lineitem),
r AS ({' UNION ALL '.join(_grid_sql(c) for c in _SINGLE)} UNION ALL
  SELECT 'none' AS configuration, b.fold, count(*), avg((y - m) * (y - m)), 1 - avg((y - m) * (y - m)) / var_pop(y)
  FROM b JOIN (SELECT k.fold, avg(b.y) AS m FROM b, (SELECT DISTINCT fold FROM b) k WHERE b.fold != k.fold GROUP BY 1) f ON f.fold = b.fold GROUP BY 1, 2)
SELECT *, sqrt(mse) AS rmse FROM r""")(
    lambda t: linear_grid.linear_grid(
        t.lineitem.selectExpr("cast(l_orderkey % 5 as int) as fold", "l_extendedprice / 1000.0D as y", *_SINGLE), "y",
        {**{c: [c] for c in _SINGLE}, "none": []}))

query("feature_ablation", "removed importance:f score:f drop:f")(
    lambda t: refinement.feature_ablation(*doc_parts(t), DOC_FEATURES))


def doc_parts(t):
    return tuple(p.drop("features") for p in doc_split(t))


query("refine_component", "component alternative score:f best")(
    lambda t: refinement.refine_component(*doc_parts(t), DOC_FEATURES))


def _searches(train):
    """The five families on small grids; the operator's own grids are those of ``default_searches``."""
    small = {"forest": ({"numTrees": [5, 10], "maxDepth": [2, 4]}, 3), "boosting": ({"maxIter": [5], "maxDepth": [2, 3]}, None),
             "stochastic": ({"maxIter": [5], "subsamplingRate": [0.7, 0.9]}, 2), "deep": ({"maxIter": [5], "maxDepth": [4]}, None)}
    return refinement.default_searches(train, "label", None, 3, small)


def _candidates(t):
    train, test = doc_split(t)
    return train, test, *refinement.candidate_models(train, test, searches=_searches(train))


query("candidate_models", "name score:f")(lambda t: _candidates(t)[3])


def _vote_of_candidates(t):
    _, test, fitted, table = _candidates(t)
    return refinement.ensemble_scores(fitted, table, test)


query("candidate_ensembles", "voting_score:f weighted_score:f best_ensemble best_score:f")(_vote_of_candidates)


def _sanity(t):
    train, test = (head_cap(d, 200, ["doc_id"]) for d in doc_parts(t))

    def broken(config):
        raise ValueError("no such builder")

    return ablation.sanity_matrix(t.spark, {"docs": doc_builder, "broken": broken}, train, test)


query("sanity_matrix", "builder configuration status")(_sanity)

# --- sources and sinks: written by Spark from the tables, then read back -----------------------------


def _csv(t):
    path = scratch_path(t.spark, "csv")
    t.customer.selectExpr("c_custkey", "c_acctbal", "c_mktsegment as label").write.option("header", True).csv(path)
    df, target = readers.scan_csv_labeled(t.spark, path, schema="c_custkey bigint, c_acctbal double, label string")
    return df.withColumnRenamed(target, "target")


query("scan_csv_labeled", "c_custkey:i c_acctbal:f target", "SELECT c_custkey, c_acctbal, c_mktsegment AS target FROM customer")(_csv)


def _named(t):
    named = readers.NamedSources()
    for n in ("supplier", "customer"):
        named.register_parquet(n, f"{t.folder}/{n}.parquet")
    return named.load(t.spark, "supplier")


query("scan_named", "s_suppkey:i s_name s_acctbal:f", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")(_named)


def _tree(t):
    root = scratch_path(t.spark, "tree")
    table = runs(t).groupBy("experiment", "configuration").agg(F.expr("avg(value)").alias("mean"), F.expr("count(1)").alias("n_runs"))
    for e in range(2):
        table.where(f"experiment % 2 = {e}").selectExpr(
            "configuration", "mean", "0.0D as std", "0.0D as min", "0.0D as max", "cast(null as double) as ci_lower",
            "cast(null as double) as ci_upper", "n_runs + 100 * experiment as n_runs").write.option("header", True).csv(f"{root}/exp{e}/w")
    return readers.scan_result_tree(t.spark, root, pattern="*.csv")


query("scan_result_tree", "experiment configuration mean:f n_runs:i", f"""
WITH {S.RUNS} SELECT concat('exp', CAST(experiment % 2 AS VARCHAR), '/w') AS experiment, configuration, avg(value) AS mean,
  count(*) + 100 * experiment AS n_runs FROM runs GROUP BY experiment, configuration""")(_tree)


def _json(t):
    root = scratch_path(t.spark, "json")
    files = t.part.count() // 1000 + 1  # about a thousand records per array file, at any scale
    arrays = t.part.groupBy(F.expr(f"pmod(xxhash64(p_partkey), {files})")).agg(F.expr(
        "to_json(collect_list(struct(p_name as model, p_type as dataset, p_retailprice as accuracy_mean)))").alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(f"{root}/good")
    t.spark.range(1).selectExpr("'[{\"model\": ' as value").write.text(f"{root}/bad")
    good, _ = readers.scan_json_records(t.spark, f"{root}/*", "model string, dataset string, accuracy_mean double")
    return good


query("scan_json_records", "model dataset accuracy_mean:f",
      "SELECT p_name AS model, p_type AS dataset, p_retailprice AS accuracy_mean FROM part")(_json)


def _results(t):
    paths = sinks.write_results(cv_wide(t).withColumn("config_name", F.expr("if(config_name = 'click', 'full', config_name)")),
                                scratch_path(t.spark, "results"))
    return t.spark.read.parquet(paths["comparison"])


query("write_results", "configuration mean:f count:i delta:f", f"""
WITH {CV_WIDE}, m AS (SELECT CASE WHEN config_name = 'click' THEN 'full' ELSE config_name END AS configuration, avg(mean_accuracy) AS mean,
  count(*) AS count FROM cv WHERE status = 'success' GROUP BY 1)
SELECT configuration, mean, count, mean - (SELECT mean FROM m WHERE configuration = 'full') AS delta FROM m""")(_results)


def _task(t):
    split = split_holdout(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), ["o_orderkey"])
    paths = sinks.write_task_split(split, "o_orderstatus", ["o_orderkey"], scratch_path(t.spark, "task"))
    train, test, truth = (t.spark.read.parquet(paths[k]) for k in ("train", "test", "test_labels"))
    return test.join(truth, "o_orderkey").selectExpr("'test' as part", "*").unionByName(
        train.selectExpr("'train' as part", "*"))


query("write_task_split", "part o_orderkey:i o_totalprice:f o_orderstatus", """
WITH k AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', o_orderkey, '42'))) AS rn, count(*) OVER () AS n FROM orders)
SELECT CASE WHEN rn <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS part, o_orderkey, o_totalprice, o_orderstatus FROM k""")(_task)


def _history(t):
    path = scratch_path(t.spark, "history")
    rows = runs(t).groupBy("experiment").agg(F.expr("avg(value)").alias("f1_score")).selectExpr(
        "'20250101_000000' as timestamp", "concat('set_', experiment) as dataset_name", "f1_score", "f1_score as accuracy",
        "f1_score as precision", "f1_score as recall", "'rf' as final_model", "'standard' as best_scaler",
        "cast(null as string) as best_feature_selector", "experiment")
    for half in (0, 1):
        sinks.append_history(rows.where(f"experiment % 2 = {half}"), path)
    return t.spark.read.parquet(path)


query("append_history", "dataset_name f1_score:f final_model", f"""
WITH {S.RUNS} SELECT concat('set_', CAST(experiment AS VARCHAR)) AS dataset_name, avg(value) AS f1_score, 'rf' AS final_model FROM runs GROUP BY experiment""")(_history)

query("head_cap", "o_orderkey:i o_totalprice:f", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500")(
    lambda t: head_cap(t.orders, 500, ["o_orderkey"]))

# --- streams: the table file is the stream, drained once ------------------------------------------------


def _stream(t, table):
    """A file stream over one table of the data folder."""
    batch = getattr(t, table)
    return t.spark.readStream.schema(batch.schema).parquet(f"{t.folder}/{table}*.parquet")


def _drain(t, frame, keys, name):
    out, check = scratch_path(t.spark, name), scratch_path(t.spark, f"{name}-checkpoint")
    stream_runs.keep_versions(frame, keys, out, check).awaitTermination()
    return stream_runs.read_version(t.spark, out)


query("stream_runs_summary", "l_returnflag l_linestatus mean:f std:f min:f max:f ci_lower:f ci_upper:f n_runs:i", """
WITH RECURSIVE m AS (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS std, min(l_quantity) AS min,
  max(l_quantity) AS max, count(*) AS n_runs FROM lineitem GROUP BY 1, 2), """ + S.t_quantiles("SELECT n_runs - 1 AS nu FROM m")
      + " SELECT *, mean - q * std / sqrt(n_runs) AS ci_lower, mean + q * std / sqrt(n_runs) AS ci_upper FROM m JOIN tq ON nu = n_runs - 1")(
    lambda t: _drain(t, stream_runs.stream_runs_summary(_stream(t, "lineitem"), "l_quantity", ["l_returnflag", "l_linestatus"]),
                     ["l_returnflag", "l_linestatus"], "summary"))

query("stream_largest_file", "dataset path size:i", """
SELECT source AS dataset, arg_max(CAST(doc_id AS VARCHAR), (n_chars, CAST(doc_id AS VARCHAR))) AS path, max(n_chars) AS size FROM documents GROUP BY 1""")(
    lambda t: _drain(t, stream_files.stream_largest_file(
        _stream(t, "documents").selectExpr("source as dataset", "cast(doc_id as string) as path", "n_chars as size")), ["dataset"], "largest"))


def _progress(t):
    log, check = scratch_path(t.spark, "log"), scratch_path(t.spark, "log-checkpoint")
    states = _stream(t, "events").selectExpr("cast(user_id as string) as dataset", "event_type as state", "ts", "props as details")
    stream_files.append_states(states, log, check).awaitTermination()
    return stream_files.last_states(t.spark.read.parquet(log))


query("stream_progress_log", "dataset state", """
SELECT CAST(user_id AS VARCHAR) AS dataset, arg_max(event_type, (ts, event_type)) AS state FROM events GROUP BY 1""")(_progress)


def _new_files(t):
    seen = _stream(t, "events").selectExpr(
        "cast(user_id as string) as path", "cast(0 as bigint) as mtime", "event_type as hash", "cast(ts as timestamp) as seen_at")
    fresh = stream_files.stream_new_files(seen)
    out, check = scratch_path(t.spark, "fresh"), scratch_path(t.spark, "fresh-checkpoint")
    fresh.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(
        availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(out).selectExpr("path", "hash", "cast(unix_micros(seen_at) as bigint) as seen_us")


query("stream_new_files", "path hash seen_us", """
WITH RECURSIVE seen AS (
    SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) AS n FROM events),
steps AS (
    SELECT user_id, event_type, ts, n, true AS processed, event_type AS last_type, ts AS last_ts FROM seen WHERE n = 1
    UNION ALL
    SELECT user_id, event_type, ts, n, due, CASE WHEN due THEN event_type ELSE last_type END, CASE WHEN due THEN ts ELSE last_ts END
    FROM (SELECT s.*, p.last_type, p.last_ts, s.event_type != p.last_type OR s.ts >= p.last_ts + INTERVAL 60 SECOND AS due
          FROM steps p JOIN seen s ON s.user_id = p.user_id AND s.n = p.n + 1) AS x)
SELECT CAST(user_id AS VARCHAR) AS path, event_type AS hash, epoch_us(CAST(ts AS TIMESTAMP)) AS seen_us FROM steps WHERE processed
""")(_new_files)


#: Events are dealt to blocks of BLOCK seconds, each up to SHIFT seconds early or in place. A block is a micro-batch of as many files
#: as the largest block has parts of FILE_ROWS rows, so that larger tables make larger micro-batches and not more of them.
BLOCK, SHIFT, LATENESS, FILE_ROWS = 4 * 86400, 6 * 3600, 5 * 86400, 500_000


def _deal(spark, dealt, folder):
    """Write the blocks in order, each in the same number of files, and return that number."""
    if dealt.isEmpty():
        dealt.drop("block").write.parquet(folder)
        return 1
    staged = scratch_path(spark, "blocks")
    dealt.write.partitionBy("block").parquet(staged)
    blocks = spark.read.schema(dealt.schema).parquet(staged)
    sizes = {r["block"]: r["count"] for r in blocks.groupBy("block").count().collect()}
    files = -(-max(sizes.values()) // FILE_ROWS)
    for block in sorted(sizes):
        blocks.where(F.col("block") == block).drop("block").repartition(files).write.mode("append").parquet(folder)
    return files


def _ordered_files(t):
    folder, out, check = (scratch_path(t.spark, n) for n in ("sightings", "ordered", "ordered-checkpoint"))
    seen = t.events.selectExpr(
        "cast(user_id as string) as path", "cast(0 as bigint) as mtime", "event_type as hash", "cast(ts as timestamp) as seen_at")
    dealt = seen.withColumn("block", F.expr(f"(unix_seconds(seen_at) + pmod(xxhash64(path, seen_at), {SHIFT})) div {BLOCK}")).where(
        "block is not null")
    files = _deal(t.spark, dealt, folder)
    stream = t.spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", files).parquet(folder)
    fresh = stream_files.stream_ordered_files(stream, f"{LATENESS} seconds", cooldown=6 * 3600.0)
    fresh.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(
        availableNow=True).start().awaitTermination()
    return t.spark.read.schema(fresh.schema).parquet(out).selectExpr("path", "hash", "cast(unix_micros(seen_at) as bigint) as seen_us")


query("stream_ordered_files", "path hash seen_us", f"""
WITH RECURSIVE seen AS (
    SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) AS n FROM events
    WHERE epoch_ms(CAST(ts AS TIMESTAMP)) < (SELECT epoch_ms(CAST(max(ts) AS TIMESTAMP)) FROM events) - {LATENESS} * 1000),
steps AS (
    SELECT user_id, event_type, ts, n, true AS processed, event_type AS last_type, ts AS last_ts FROM seen WHERE n = 1
    UNION ALL
    SELECT user_id, event_type, ts, n, due, CASE WHEN due THEN event_type ELSE last_type END, CASE WHEN due THEN ts ELSE last_ts END
    FROM (SELECT s.*, p.last_type, p.last_ts, s.event_type != p.last_type OR s.ts >= p.last_ts + INTERVAL 6 HOUR AS due
          FROM steps p JOIN seen s ON s.user_id = p.user_id AND s.n = p.n + 1) AS x)
SELECT CAST(user_id AS VARCHAR) AS path, event_type AS hash, epoch_us(CAST(ts AS TIMESTAMP)) AS seen_us FROM steps WHERE processed
""")(_ordered_files)
