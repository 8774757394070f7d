"""Splits and folds: exact sizes, independence of partitioning, deep cuts, odd classes."""

import hashlib
import math
from collections import Counter

import pytest

from ablaspark.operators import splitting


@pytest.fixture(scope="module")
def rows():
    return [(i, ["a", "a", "a", "b", None][i % 5] if i % 50 else "rare") for i in range(2003)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id bigint, y string").cache()


def key(i, seed):
    return hashlib.md5(f"{i}|{seed}".encode()).hexdigest()


def collect(d, c):
    return {r["id"]: r[c] for r in d.collect()}


def test_holdout_is_the_hash_order(df, rows):
    got = collect(splitting.split_holdout(df, ["id"], 0.2, 9), "split")
    order = sorted((i for i, _ in rows), key=lambda i: key(i, 9))
    n = math.ceil(len(rows) * 0.2)
    assert {i for i, s in got.items() if s == "test"} == set(order[:n]) and len(got) == len(rows)


@pytest.mark.parametrize("parts", [1, 8, 200])
def test_split_does_not_depend_on_partitions(df, parts):
    assert collect(splitting.split_holdout(df.repartition(parts), ["id"]), "split") == collect(
        splitting.split_holdout(df, ["id"]), "split")


def test_deep_cuts_give_the_same_split(df, monkeypatch):
    plain = collect(splitting.split_stratified(df, ["id"], "y"), "split")
    monkeypatch.setattr(splitting, "_ONE_TASK", 0)
    monkeypatch.setattr(splitting, "_DIGITS", 1)
    real, rounds = splitting._keyed, []

    def counted(frame, ids, seed, label, digits):
        rounds.append(digits)
        if digits >= 4:
            monkeypatch.setattr(splitting, "_ONE_TASK", 10**9)
        return real(frame, ids, seed, label, digits)

    monkeypatch.setattr(splitting, "_keyed", counted)
    assert collect(splitting.split_stratified(df, ["id"], "y"), "split") == plain
    assert max(rounds) >= 4


def test_stratified_quota(df, rows):
    got = collect(splitting.split_stratified(df, ["id"], "y", 0.25), "split")
    total = Counter(y for _, y in rows)
    test = Counter(y for i, y in rows if got[i] == "test")
    assert sum(test.values()) == math.ceil(len(rows) * 0.25)
    assert all(abs(test[y] - total[y] * 0.25) <= 1 for y in total)


def test_kfold_sizes(df, rows):
    got = Counter(collect(splitting.kfold(df, ["id"], 7), "fold").values())
    assert set(got) == set(range(7)) and sum(got.values()) == len(rows)
    assert got == {f: len(rows) // 7 + (f < len(rows) % 7) for f in range(7)}


def test_stratified_kfold_mix(df, rows):
    got = collect(splitting.stratified_kfold(df, ["id"], "y", 5), "fold")
    sizes = Counter(got.values())
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(5))
    for y in {y for _, y in rows}:
        per = Counter(got[i] for i, c in rows if c == y)
        assert max(per.values()) - min(per[f] for f in range(5)) <= 1


def test_class_smaller_than_fold_count(spark):
    df = spark.createDataFrame([(i, "x" if i < 2 else "y") for i in range(23)], "id int, y string")
    got = collect(splitting.stratified_kfold(df, ["id"], "y", 5), "fold")
    assert len(got) == 23 and Counter(got.values()) == {0: 5, 1: 5, 2: 5, 3: 4, 4: 4}


def test_seeds_change_the_split(df):
    a, b = (collect(splitting.split_holdout(df, ["id"], 0.5, s), "split") for s in (1, 2))
    assert a != b


def test_bad_arguments(df):
    with pytest.raises(ValueError):
        splitting.split_holdout(df, ["id"], 1.5)
    with pytest.raises(ValueError):
        splitting.kfold(df, ["id"], 1)
    with pytest.raises(ValueError):
        splitting.head_cap(df.where("false"), 3, ["id"])


def test_seed_schedule(df):
    runs = splitting.seed_schedule(df.limit(1), 3, 42, first_run=0).collect()
    assert [(r["run"], r["random_state"]) for r in runs] == [(0, 42), (1, 43), (2, 44)]
