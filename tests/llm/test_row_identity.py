"""Deduplication decides about rows, also where ids are null or repeated."""

import pytest

from ablaspark.llm import exact_dedup, mixing, packing, secrets, simhash, tokenizers

PASSAGE = " ".join(f"word{i}" for i in range(60))
COPIES = [(None, PASSAGE), (None, PASSAGE), (None, "stands alone, far from the passage"), (7, "one two"), (7, "three four five")]


@pytest.mark.parametrize("operator", [simhash.deduplicated, exact_dedup.deduplicated])
def test_null_ids_and_repeated_ids(spark, operator):
    rows = operator(spark.createDataFrame(COPIES, "doc_id bigint, text string").repartition(3)).collect()
    assert sorted(r["text"] for r in rows) == sorted({t for _, t in COPIES})


def test_longest_row_of_an_id_stays(spark):
    for order in (1, -1):
        rows = [(1, "a b c"), (1, "abc"), (1, " a  b  c ")][::order]
        got = exact_dedup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).collect()
        assert [r["text"] for r in got] == [" a  b  c "]


def test_of_equal_rows_one_is_taken_in_part(spark):
    text = " ".join(f"w{i}" for i in range(16))
    rows = [(1, text, "a")] * 2 + [(None, text, "a")] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "'x' as taken", "1 as row_no")
    for n in (2, 4):
        some = df.filter("doc_id = 1") if n == 2 else df
        got = mixing.mixed_rows(some).collect()
        sizes = [len(r["text"].split()) for r in got]
        assert sum(sizes) == 16 * n * 3 // 2 and max(sizes) <= 16 and all(r["taken"] == "x" for r in got)


def test_equal_rows_are_scanned_once(spark):
    rows = [(1, "token = abcdefabcdef0123")] * 3 + [(None, "secret = abcdefghijklmnop")] * 2 + [(2, "token = abcdefabcdef0123"), (None, None)]
    ledger = secrets.Ledger(spark)
    got = secrets.scan_versions(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), ledger).collect()
    assert sorted(len(r["findings"]) for r in got) == [0, 1, 1, 2, 2, 2, 2] and ledger.rows().count() == 3


def test_other_tokenizers_are_refused(spark):
    df = spark.createDataFrame([(1, "a text")], "doc_id bigint, text string")
    with pytest.raises(ValueError, match="normalizer"):
        packing.pack(df, tokenizers.path("byte_bpe_50k.json"))
