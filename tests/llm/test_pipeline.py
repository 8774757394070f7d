"""Each stage of the corpus pipeline against a plain version on its own input."""

import re

import brute

import corpus_pipeline
from ablaspark.llm import packing, tokenizers
from ablaspark.llm.common import stored


def test_stages(spark, folder, documents):
    columns, docs, out = documents.columns, documents, {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = (docs.collect(), stage(spark, docs, folder))
        docs = stored(out[name][1], "stage")
        out[name] = (out[name][0], docs.collect())
        if name != "packing":
            assert docs.columns == columns

    given, got = out["language ID"]
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in given if r["text"] and any(c.isalpha() for c in r["text"])}

    given, got = out["exact dedup"]
    best = {}
    for r in given:
        key = re.sub(r"[\x20\x09-\x0D]+", "", r["text"])
        best[key] = min(best.get(key, (1, 0)), (-len(r["text"]), r["doc_id"]))
    assert {r["doc_id"] for r in got} == {i for _, i in best.values()} and len(got) == len(best)

    given, got = out["near-dedup"]
    roots = brute.components([brute.simhash(r["text"]) for r in given], [r["doc_id"] for r in given])
    assert sorted(r["doc_id"] for r in got) == sorted(set(roots))

    given, got = out["mixing"]
    count = lambda rows: sum(len(r["text"].encode().split()) for r in rows)
    assert count(got) == int(1.5 * count(given)) and {r["doc_id"] for r in got} <= {r["doc_id"] for r in given}

    given, got = out["packing"]
    words = packing.WordIds(tokenizers.path())
    assert sum(r["length"] for r in got) == sum(len(words.document(r["text"])) // 4 for r in given)
    assert sorted({(r["sequence_id"], r["offset"]) for r in got}) == sorted((r["sequence_id"], r["offset"]) for r in got)


def through(spark, docs, folder):
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), "stage")
        rows[name] = docs.collect()
    return rows


def test_odd_rows_go_through_all_stages(spark, folder, odd):
    rows = through(spark, odd, folder)
    for name in ("language ID", "exact dedup", "near-dedup", "mixing"):
        assert rows[name] and set(odd.columns) == set(rows[name][0].asDict())
        assert all(r["text"] and any(c.isalpha() for c in r["text"]) and r["key"] == "x" for r in rows[name])
    for name in ("exact dedup", "near-dedup"):
        assert len({re.sub(r"\s", "", r["text"]) for r in rows[name]}) == len(rows[name])
    assert {r["doc_id"] for r in rows["packing"]} == {r["doc_id"] for r in rows["mixing"]}


def test_an_empty_table_goes_through_all_stages(spark, folder, nothing):
    assert not any(through(spark, nothing, folder).values())
