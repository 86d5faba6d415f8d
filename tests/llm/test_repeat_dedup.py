"""Removed passages against a comparison of all passages."""

import random

import numpy as np
import pytest
from llm_frames import MESSY, documents, prose, repeats

from ferrybook.llm import repeat_dedup
from ferrybook.llm.repeat_dedup import (
    nearest_smaller,
    previous_factors,
    remove_repeats,
    suffix_levels,
    suffix_ranks,
    without_repeats,
)


def corpus():
    rng = random.Random(5)
    rows = []
    passages = [prose(70 + i, 60) for i in range(3)]
    for i in range(40):
        text = prose(i, 60 + i, words=5000)
        if i % 2:
            at = rng.randrange(len(text))
            text = text[:at] + passages[i % 3][i % 5 :] + text[at:]
        rows.append((i, text))
    rows += [(50, prose(1, 80)), (51, prose(1, 80)), (52, "ab" * 400), (53, "x" * 199), (54, "y" * 200)]
    rows += [(55, "z" * 201), (56, "é" * 150 + prose(3, 50)), (57, prose(3, 50) + "é" * 150), (58, "é" * 99)]
    return rows


def check(spark, rows, keep_first, length=200):
    got = remove_repeats(documents(spark, rows), length=length, keep_first=keep_first).collect()
    expected = repeats([r for r in rows if r[0] is not None], length, keep_first)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) == expected[r.doc_id]
            assert sum(s.bytes for s in r.spans) == r.n_removed


@pytest.mark.parametrize("keep_first", [True, False])
def test_equals_all_passages(spark, keep_first):
    check(spark, corpus(), keep_first)


@pytest.mark.parametrize("keep_first", [True, False])
def test_anchors_with_many_spans(spark, monkeypatch, keep_first):
    monkeypatch.setattr(repeat_dedup, "LARGEST_GROUP", 2)
    check(spark, corpus(), keep_first, length=150)


def test_small_batches_of_suffixes(spark, monkeypatch):
    monkeypatch.setattr(repeat_dedup, "SORT_BYTES", 2000)
    check(spark, corpus(), True)


def test_messy_rows(spark):
    rows = [r for r in MESSY if r[0] not in (8, None)]
    check(spark, rows, False)
    twice = [(8, prose(1, 300))] * 2
    gone = remove_repeats(documents(spark, twice), keep_first=False).collect()
    assert [r.n_removed for r in gone] == [len(prose(1, 300))] * 2
    stays = remove_repeats(documents(spark, twice), keep_first=True).collect()
    assert [r.n_removed for r in stays] == [0, 0]
    nameless = remove_repeats(documents(spark, [(None, prose(2, 200))] * 2), keep_first=False).collect()
    assert [r.n_removed for r in nameless] == [0, 0]
    assert remove_repeats(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(documents(spark, []), length=40)


def shared(a, b, depth):
    return next((j for j in range(min(depth, len(a), len(b))) if a[j] != b[j]), min(depth, len(a), len(b)))


@pytest.mark.parametrize("text", [b"banana bandana banana", b"a" * 30, b"abaab" * 9 + b"abaaa" * 5])
def test_suffix_ranks_and_previous_factors(text):
    data = np.frombuffer(text, dtype=np.uint8)
    for depth in (1, 3, 7, 8, 13, 40):
        prefixes = [bytes(data[i : i + depth]) for i in range(len(data))]
        order = sorted(set(prefixes))
        assert [order.index(p) + 1 for p in prefixes] == suffix_ranks(data, depth).tolist()
        for places in (np.arange(len(data)), np.arange(1, len(data), 3)):
            size, source = previous_factors(suffix_levels(data, depth), data, places)
            for k, i in enumerate(places):
                longest = max((shared(text[j:], text[i:], depth) for j in places[:k]), default=0)
                if i + depth > len(text):  # what lies after the end counts as equal only if both end there
                    longest = min(longest, len(text) - i)
                assert size[k] == longest
                if longest:
                    assert source[k] < i and shared(text[source[k] :], text[i:], depth) == longest


def test_nearest_smaller():
    rng = random.Random(2)
    for n in (0, 1, 2, 500):
        values = rng.sample(range(10 * n + 1), n)
        expected = [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(n)]
        assert nearest_smaller(np.array(values, dtype=np.int64)).tolist() == expected
    assert nearest_smaller(np.arange(1000)[::-1]).tolist() == [-1] * 1000


def test_odd_column_names_stay(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string").selectExpr(
        "*", "1 as `a.b`", "'x' as `my col`", "named_struct('p:q', 1, 'r s', array(2)) as `a:b`", "3 as `t``k`"
    )
    cleaned = without_repeats(df)
    assert cleaned.columns == df.columns
    assert sorted(map(str, cleaned.drop("text").collect())) == sorted(map(str, df.drop("text").collect()))


def test_all_columns_stay_and_text_is_valid(spark):
    df = documents(spark, corpus())
    cleaned = without_repeats(df)
    assert cleaned.columns == df.columns
    expected = repeats(corpus(), 200, True)
    for r in cleaned.collect():
        assert r.text == expected[r.doc_id][3].decode("utf-8", "ignore")
