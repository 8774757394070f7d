"""The judging tasks of op7: what they sort and merge, and what they answer."""

import numpy as np
import pandas as pd
import pytest

from ablaspark.llm import bwt, suffix_dedup
from ablaspark.llm.exchange import bits_of

LENGTH = 50


def _text(rng, n, letters=26):
    return bytes((97 + rng.integers(0, letters, n)).astype(np.uint8))


def _part(strings):
    """The rows of one part: two chunks, each with half of the strings (document, text)."""
    blobs = []
    for chunk in (0, 1):
        own = strings[chunk::2]
        blobs.append((chunk, 3, np.int64(len(own)).tobytes() + np.array([k for k, _ in own], np.int64).tobytes()
                      + np.array([len(t) for _, t in own], np.int64).tobytes() + b"".join(t for _, t in own)))
    return pd.DataFrame(blobs, columns=["chunk", "part", "data"])


def _expected(strings):
    least = {}
    for key, text in strings:
        for i in range(len(text) - LENGTH + 1):
            w = text[i:i + LENGTH]
            least[w] = min(least.get(w, key), key)
    return [[least[t[i:i + LENGTH]] < key for key, t in strings[c::2] for i in range(len(t) - LENGTH + 1)] for c in (0, 1)]


def _strings(rng):
    passage = _text(rng, 90)
    strings = [(int(key), _text(rng, 30) + passage[a:a + 60] + _text(rng, 30)) for key, a in zip(rng.permutation(40), rng.integers(0, 30, 40))]
    strings += [(50 + i, _text(rng, 70)) for i in range(60)]  # nowhere else
    strings += [(200, passage), (200, passage), (7, b"a" * 130), (8, b"a" * 61), (9, b"ab" * 60), (9, b"ab" * 40), (10, b"a" * 50), (11, b"ab" * 30)]
    return strings


@pytest.mark.parametrize("shard_bytes", [1 << 21, 1000, 150])
def test_judged_strings_match_brute_force(monkeypatch, shard_bytes):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard_bytes)
    for seed in range(3):
        strings = _strings(np.random.default_rng(seed))
        rows = _part(strings)
        got = suffix_dedup._judge_regions(LENGTH)(rows)
        assert list(got["chunk"]) == [0, 1] and list(got["part"]) == [3, 3]
        assert [bits_of(got[got["chunk"] == c])[0].tolist() for c in (0, 1)] == _expected(strings)


def test_strings_of_one_document_are_not_merged(monkeypatch):
    """All strings of a part were sorted and merged, most of them without an equal anywhere; that was most of the time."""
    merged = []
    kept = suffix_dedup._least_documents
    monkeypatch.setattr(suffix_dedup, "_least_documents", lambda s, length: merged.append(len(s.symbols)) or kept(s, length))
    rng = np.random.default_rng(1)
    single = [(i, _text(rng, 300)) for i in range(50)]
    shared = _text(rng, 70)
    suffix_dedup._judge_regions(LENGTH)(_part(single + [(3, single[3][1])]))
    assert merged == []
    strings = single + [(90, shared), (91, _text(rng, 20) + shared)]
    got = suffix_dedup._judge_regions(LENGTH)(_part(strings))
    assert merged == [2 * 71]
    assert [bits_of(got[got["chunk"] == c])[0].tolist() for c in (0, 1)] == _expected(strings)


def test_rows_are_sorted_as_deep_as_they_are_merged(monkeypatch):
    """They were sorted to the end of the longest string, by a comparison sort of 64-bit numbers."""
    rng = np.random.default_rng(2)
    passage = _text(rng, 3000)
    symbols = np.frombuffer((passage + b"\0") * 2, np.uint8)
    begin, size = np.array([0, 3001]), np.array([3001, 3001])
    sorts = []
    kept = bwt.stable_order
    monkeypatch.setattr(bwt, "stable_order", lambda *a: sorts.append(1) or kept(*a))
    whole, few = bwt.circular_ranks(symbols, begin, size), len(sorts)
    deep = bwt.circular_ranks(symbols, begin, size, LENGTH)
    assert len(sorts) - few < few
    first = [bytes(np.roll(symbols[b:b + n], -(r - b))[:LENGTH]) for r in deep.tolist() for b, n in ((r // 3001 * 3001, 3001),)]
    assert first == sorted(first) and sorted(deep.tolist()) == sorted(whole.tolist())


def test_stable_order_with_and_without_room_in_a_word():
    key = np.random.default_rng(3).integers(0, 50, 500).astype(np.uint64)
    for width in (6, 60):
        order, value = bwt.stable_order(key, width)
        assert order.tolist() == np.argsort(key, kind="stable").tolist() and value.tolist() == sorted(key.tolist())
