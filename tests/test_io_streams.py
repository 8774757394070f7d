"""Sources, sinks, generators and streams."""

import json
import time

import pytest
from pyspark.sql import functions as F

from ablaspark.operators.summaries import summarize_statistics
from ablaspark.sources import generators, readers, sinks
from ablaspark.streaming import files, runs


def test_labelled_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,y\n1,2.5,x\n3,,z\n")
    df, target = readers.scan_csv_labeled(spark, str(tmp_path / "t.csv"))
    assert target == "y" and dict(df.dtypes) == {"a": "int", "b": "double", "y": "string"}
    assert readers.scan_csv_labeled(spark, str(tmp_path / "t.csv"), "a")[1] == "a"
    with pytest.raises(ValueError, match="available"):
        readers.scan_csv_labeled(spark, str(tmp_path / "t.csv"), "q")


def test_named_sources(spark, folder):
    named = readers.NamedSources()
    named.register_parquet("part", f"{folder}/part.parquet")
    assert named.names() == ["part"] and named.load(spark, "part").count() > 0
    with pytest.raises(ValueError, match="part"):
        named.load(spark, "iris")


def test_json_records_split_off_broken_files(spark, tmp_path):
    (tmp_path / "comparison_full_1.json").write_text(json.dumps([{"model": "a", "success": True}, {"model": "b"}]))
    (tmp_path / "comparison_full_2.json").write_text("[{\"model\": ")
    good, bad = readers.scan_json_records(spark, f"{tmp_path}/comparison_full_*.json", "model string, success boolean")
    assert sorted((r["model"], r["success"]) for r in good.collect()) == [("a", True), ("b", None)]
    assert [r["file"].rsplit("/", 1)[1] for r in bad.collect()] == ["comparison_full_2.json"]


def test_result_tree(spark, tmp_path):
    head = "configuration,mean,std,min,max,ci_lower,ci_upper,n_runs\n"
    for place, row in (("e1/w", "full,0.5,0.1,0,1,0.4,0.6,20"), ("e2", "minimal,0.7,,0,1,,,1")):
        (tmp_path / place).mkdir(parents=True)
        (tmp_path / place / "summary_statistics_20250101_000000.csv").write_text(head + row + "\n")
        (tmp_path / place / "other.csv").write_text("x\n1\n")
    (tmp_path / "summary_statistics_1.csv").write_text(head + "full,1,0,1,1,,,2\n")
    rows = {r["experiment"]: r for r in readers.scan_result_tree(spark, str(tmp_path)).collect()}
    assert set(rows) == {"e1/w", "e2", ""} and rows["e2"]["std"] is None and rows["e1/w"]["n_runs"] == 20
    assert rows["e1/w"]["summary_file"].endswith("summary_statistics_20250101_000000.csv")


def test_generators(spark):
    df = generators.gen_preset(spark, "synthetic_regression_easy")
    assert df.count() == 1500 and len(df.columns) == 22
    w = generators.regression_weights(10, 101)
    signal = " + ".join(f"{v}D * x{i}" for i, v in enumerate(w))
    row = df.selectExpr(f"label - ({signal}) as e").agg(F.avg("e"), F.stddev("e")).first()
    assert row[0] == pytest.approx(0, abs=0.5) and row[1] == pytest.approx(5, rel=0.1)
    f1 = generators.gen_friedman1(spark, 1000, 6, 0.0)
    y = "10 * sin(pi() * x0 * x1) + 20 * power(x2 - 0.5, 2) + 10 * x3 + 5 * x4"
    assert f1.where(f"abs(label - ({y})) > 1e-9").count() == 0
    cls = generators.gen_classification(spark)
    assert cls.count() == 1200 and cls.select("label").distinct().count() == 4 and len(cls.columns) == 27
    assert cls.collect() == generators.gen_classification(spark).collect()
    with pytest.raises(ValueError):
        generators.gen_preset(spark, "nope")


def test_result_files(spark, tmp_path):
    rows = [("full", "success", .9, 1.0), ("full", "success", .8, 2.0), ("minimal", "success", .7, 1.0), ("minimal", "failed", None, 1.0)]
    df = spark.createDataFrame(rows, "config_name string, status string, mean_accuracy double, time_sec double")
    paths = sinks.write_results(df, str(tmp_path / "a"))
    assert set(paths) == {"full", "summary", "comparison"}
    assert spark.read.parquet(paths["summary"]).where("config_name = 'minimal'").first()["n_experiments"] == 1
    assert set(sinks.write_results(df.where("config_name != 'full'"), str(tmp_path / "b"), fmt="csv")) == {"full", "summary"}


def test_task_split_hides_the_label(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i), i % 2, "test" if i < 3 else "train") for i in range(10)], "id int, x double, y int, split string")
    paths = sinks.write_task_split(df, "y", ["id"], str(tmp_path))
    assert "y" not in spark.read.parquet(paths["test"]).columns and spark.read.parquet(paths["test"]).count() == 3
    assert spark.read.parquet(paths["test_labels"]).columns == ["id", "y"] and spark.read.parquet(paths["train"]).count() == 7


def test_history_appends(spark, tmp_path):
    row = spark.createDataFrame([("t", "d", .1, .2, .3, .4, "m", "s", "f")], ", ".join(
        f"{c} {'double' if i in (2, 3, 4, 5) else 'string'}" for i, c in enumerate(sinks.HISTORY_COLUMNS)))
    for _ in range(2):
        sinks.append_history(row.select(*reversed(row.columns)), str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).columns == sinks.HISTORY_COLUMNS
    assert spark.read.parquet(str(tmp_path / "h")).count() == 2


def test_stream_summary_equals_batch(spark, tmp_path, folder):
    events = spark.read.parquet(f"{folder}/events.parquet").select("event_type", "value")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    frame = runs.stream_runs_summary(stream, "value", ["event_type"])
    runs.keep_versions(frame, ["event_type"], str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {r["event_type"]: r for r in runs.read_version(spark, str(tmp_path / "out")).collect()}
    want = {r["event_type"]: r for r in summarize_statistics(events, "value", ["event_type"]).collect()}
    assert set(got) == set(want)
    for k, r in want.items():
        assert got[k]["n_runs"] == r["n_runs"] and got[k]["ci_upper"] == pytest.approx(r["ci_upper"], rel=1e-9)


def test_watching_files(spark, tmp_path):
    root = tmp_path / "w"
    for name, text in (("iris_1/a.py", "x" * 10), ("iris_1/deep/b.py", "y" * 30), ("wine/c.py", "z"), ("other/d.py", "q"), ("iris_2/n.txt", "t")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    found = files.with_dataset(files.file_stream(spark, str(root)), ["iris", "wine"])
    frame = files.stream_largest_file(found)
    runs.keep_versions(frame, ["dataset"], str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    rows = {r["dataset"]: r for r in runs.read_version(spark, str(tmp_path / "out")).collect()}
    assert set(rows) == {"iris", "wine"} and rows["iris"]["path"].endswith("deep/b.py") and rows["iris"]["size"] == 30


def test_repeats_inside_the_cooldown_are_dropped(spark, tmp_path):
    schema = "path string, mtime bigint, hash string, seen_at timestamp"
    stamp = "timestamp'2025-01-01 00:00:{:02d}'"

    def drop(n, rows):
        df = spark.sql(" union all ".join(f"select '{p}' as path, {m}L as mtime, '{h}' as hash, {t} as seen_at" for p, m, h, t in rows))
        df.coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))

    query_args = dict(out=str(tmp_path / "out"), check=str(tmp_path / "check"))

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        files.stream_new_files(stream).writeStream.format("parquet").option("path", query_args["out"]).option(
            "checkpointLocation", query_args["check"]).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["path"], r["hash"]) for r in spark.read.schema(schema).parquet(query_args["out"]).collect())

    drop(1, [("a", 1, "h", stamp.format(0)), ("a", 1, "h", stamp.format(5)), ("b", 1, "h", stamp.format(1))])
    assert run() == [("a", "h"), ("b", "h")]
    drop(2, [("a", 1, "h", stamp.format(20)), ("a", 2, "k", stamp.format(21))])  # a repeat and a new version
    assert run() == [("a", "h"), ("a", "k"), ("b", "h")]


def test_one_file_at_a_time_gives_the_same_answer(spark, tmp_path):
    schema = "path string, mtime bigint, hash string, seen_at timestamp"
    for n in range(6):
        spark.sql(f"select 'a' as path, 1L as mtime, 'h' as hash, timestamp_seconds({n * 25}) as seen_at").coalesce(1).write.parquet(
            str(tmp_path / "in" / str(n)))
    got = []
    for n, limit in enumerate((1, 100)):
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", limit).parquet(
            str(tmp_path / "in"))
        files.stream_new_files(stream).writeStream.format("parquet").option("path", str(tmp_path / f"o{n}")).option(
            "checkpointLocation", str(tmp_path / f"c{n}")).trigger(availableNow=True).start().awaitTermination()
        got.append(sorted(r[0] for r in spark.read.parquet(str(tmp_path / f"o{n}")).selectExpr("unix_seconds(seen_at)").collect()))
    assert got == [[0, 75], [0, 75]]


@pytest.mark.parametrize("dealt", [[[0, 1, 2], [3, 4, 5, 6, 7, 8]], [[2, 0, 4], [1, 3], [6, 5], [8, 7]], [[4], [3], [2], [1], [0], [5], [7], [6], [8]]])
def test_order_of_batches_does_not_matter_in_event_time(spark, tmp_path, dealt):
    """Sightings every 25 s of a, every 50 s a changed version of b, one of no path; the last one only moves the watermark."""
    schema = "path string, mtime timestamp, hash string, seen_at timestamp"
    for n, moments in enumerate(dealt):
        rows = []
        for m in moments:
            when = f"timestamp_seconds({5000 + m * 25 + (1000 if m == 8 else 0)})"
            rows += [f"select 'a' as path, timestamp_seconds(1) as mtime, 'h' as hash, {when} as seen_at",
                     f"select 'b', timestamp_seconds(1), 'h{m // 2}', {when}", f"select null, null, null, {when}"]
        spark.sql(" union all ".join(rows)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    files.stream_ordered_files(stream, "200 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(schema).parquet(str(tmp_path / "out"))
    assert got.where("path is not null and mtime != timestamp_seconds(1)").isEmpty()
    found = {p: sorted(r[0] for r in got.where(f"path <=> {p}").selectExpr("unix_seconds(seen_at) - 5000").collect())
             for p in ("'a'", "'b'", "null")}
    assert found == {"'a'": [0, 75, 150], "'b'": [0, 50, 100, 150], "null": [0, 75, 150]}


def test_polling_finds_rewritten_files(spark, tmp_path):
    root, log = tmp_path / "w", str(tmp_path / "log")
    root.mkdir()
    (root / "a.py").write_text("one")

    def look(at):
        return files.poll_files(spark, str(root), log, f"2025-01-01 00:00:{at:02d}").count()

    assert [look(0), look(5)] == [1, 0]
    (root / "a.py").write_text("two, longer")
    (root / "b.py").write_text("new")
    assert [look(10), look(20)] == [2, 0]
    assert files.poll_files(spark, str(root), log, "2025-01-01 00:02:00").count() == 2


def test_state_log_last_write_wins(spark, tmp_path):
    rows = [("d", "started", 1), ("d", "copy_done", 3), ("d", "detected", 2), ("e", "error", 1)]
    df = spark.createDataFrame(rows, "dataset string, state string, s int").selectExpr(
        "dataset", "state", "timestamp_seconds(s) as ts", "'x' as details")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a restart appends nothing twice
        files.append_states(stream, str(tmp_path / "log"), str(tmp_path / "check")).awaitTermination()
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 4
    assert {r["dataset"]: r["state"] for r in files.last_states(log).collect()} == {"d": "copy_done", "e": "error"}


def test_repeated_and_killed_batches_leave_the_same_table(spark, tmp_path):
    path = str(tmp_path / "t")
    store = runs.version_writer(path, ["k"], keep=2)
    batch = lambda *rows: spark.createDataFrame(rows, "k string, v int")
    table = lambda v=None: sorted(map(tuple, runs.read_version(spark, path, v).collect()), key=str)
    with pytest.raises(FileNotFoundError):
        runs.read_version(spark, path)
    store(batch(("a", 1), (None, 2)), 0)
    store(batch((None, 3), ("b", 4)), 1)
    want = [("a", 1), ("b", 4), (None, 3)]
    assert table() == want and table(0) == [("a", 1), (None, 2)]
    # batch 2 was killed before its commit: readers don't see it, and the repeated batch replaces it
    batch(("half", 9)).write.parquet(f"{path}/v2")
    assert table() == want
    store(batch(("a", 7)), 2)
    store(batch(("a", 8)), 2)  # repeated after the commit
    assert table() == [("a", 7), ("b", 4), (None, 3)] and runs.versions(spark, path) == [1, 2]
    store(batch(), 3)
    assert table() == [("a", 7), ("b", 4), (None, 3)] and not (tmp_path / "t" / "v1").exists()


def test_larger_tables_make_larger_micro_batches_and_not_more(spark, tmp_path, monkeypatch):
    """A block was a micro-batch for each file that its tasks wrote, and every path had a state call of its own."""
    from ablaspark.workload import studies

    rows = [(f"p{n % 300}", 1, f"h{n % 3}", 3 * studies.BLOCK + n * 600) for n in range(3000)]
    table = spark.createDataFrame(rows, "path string, mtime bigint, hash string, s bigint").repartition(6).selectExpr(
        "path", "mtime", "hash", "timestamp_seconds(s) as seen_at")
    monkeypatch.setattr(studies, "FILE_ROWS", 200)
    found = []
    for name, some in (("all", table), ("none", table.where("false"))):
        folder = str(tmp_path / name)
        files_of_block = studies._deal(spark, some.withColumn("block", F.expr(f"unix_seconds(seen_at) div {studies.BLOCK}")), folder)
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_of_block).parquet(folder)
        query = files.stream_ordered_files(stream, f"{studies.LATENESS} seconds", cooldown=86400.0, buckets=8).writeStream.format("parquet").option(
            "path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-check")).trigger(availableNow=True).start()
        query.awaitTermination()
        found.append((files_of_block, query.recentProgress))
    (number, progress), (empty, _) = found
    assert empty == 1 and number == 3  # 576 rows at most in parts of 200
    assert sum(p["numInputRows"] > 0 for p in progress) == 6  # six blocks of four days
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) <= 8
    kept = spark.read.schema(table.schema).parquet(str(tmp_path / "all-out")).selectExpr("path", "hash", "unix_seconds(seen_at) as s")
    want, last = set(), {}
    for path, _, digest, at in rows:
        if at < rows[-1][3] - studies.LATENESS and (path not in last or last[path][0] != digest or at - last[path][1] >= 86400):
            want.add((path, digest, at))
            last[path] = (digest, at)
    assert set(map(tuple, kept.collect())) == want and kept.count() == len(want)
