"""Components against all pairs; estimates; large groups; odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from llm_frames import MESSY, documents, edited, near_components, prose
from pyspark.sql import functions as F

from ferrybook.llm import near_dedup
from ferrybook.llm.near_dedup import components, estimated_similarity, keep_one, near_duplicates


def corpus():
    rows = []
    for group in range(6):
        base = prose(group, 200)
        rows += [(group * 100 + j, edited(base, j, 1 + j % 7)) for j in range(25)]
        rows += [(group * 100 + 50 + j, base) for j in range(5)]
    # A chain: each is close to the next, the ends are far apart.
    text = prose(99, 150)
    for j in range(12):
        rows.append((1000 - j, text))
        text = edited(text, 500 + j, 2)
    rows += [(2000, "a b c d"), (2001, "A B C D"), (2002, "a b c"), (2003, "A b\tC d e"), (2004, "a b c d E")]
    return rows


def check(spark, rows, percent):
    got = near_duplicates(documents(spark, rows), percent=percent).collect()
    expected = near_components([r for r in rows if r[0] is not None], percent)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


@pytest.mark.parametrize("percent", [80, 85])
def test_equals_all_pairs(spark, percent):
    check(spark, corpus(), percent)


@pytest.mark.parametrize("weight", [3000, 9000])
def test_blocks_of_large_buckets_find_the_same(spark, monkeypatch, weight):
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 2)
    monkeypatch.setattr(near_dedup, "NEAREST", 1)
    monkeypatch.setattr(near_dedup, "BLOCK", weight)
    check(spark, corpus(), 85)


@pytest.mark.parametrize("percent", [80, 85])
def test_large_buckets_thinned_by_rare_shingles_find_the_same(spark, monkeypatch, percent):
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 3)
    monkeypatch.setattr(near_dedup, "LARGE_BUCKET", 3)
    monkeypatch.setattr(near_dedup, "NEAREST", 1)
    # Repeated rows, and pages of a template that differ more or less than the threshold.
    rows = corpus() + [r for r in corpus() if r[0] % 7 == 0]
    template = prose(50, 120)
    rows += [(3000 + j, f"{template} {prose(3000 + j, 3 + j % 14, 10**6)}") for j in range(120)]
    check(spark, rows, percent)


def test_members_below_the_threshold_leave_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LARGE_BUCKET", 40)
    left = []
    plain = near_dedup._links_in_buckets

    def watched(named, *rest):
        left.append(named.select("rep").distinct().count())
        return plain(named, *rest)

    monkeypatch.setattr(near_dedup, "_links_in_buckets", watched)
    template = prose(51, 150)
    rows = [(j, f"{template} {prose(4000 + j, 20, 10**6)}") for j in range(300)]
    rows += [(1000, rows[17][1] + " more"), (1001, "other " + rows[200][1])]
    check(spark, rows, 85)
    assert left and left[0] < 30


def test_shared_counts():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 9000, n)).astype(np.uint64) for n in (1, 0, 3000, 9000, 40)]
    expected = [[len(np.intersect1d(x, y)) for y in sets] for x in sets]
    got = near_dedup._shared(sets)
    np.fill_diagonal(got, 0)  # a set's own shingles that no other has are not counted
    assert got.tolist() == [[0 if i == j else v for j, v in enumerate(r)] for i, r in enumerate(expected)]


def test_messy_rows_and_empty_table(spark):
    check(spark, MESSY, 85)
    assert near_duplicates(documents(spark, [])).count() == 0


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    hub = [(1, i) for i in range(200, 400)]
    edges = spark.createDataFrame(path + hub + [(399, 500)], "a long, b long")
    got = {r.id: r.label for r in components(edges).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 1: 1, **{i: 1 for i in range(200, 400)}, 500: 1}


def test_estimate_is_near_the_similarity(spark):
    rng = np.random.default_rng(3)
    whole = rng.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = np.unique(whole[:3000]), np.unique(whole[1000:])
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    found = near_dedup._signatures(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
    one, two = near_dedup._lists(found["packed"]).to_pylist()
    df = spark.createDataFrame([(one, two)], "x array<long>, y array<long>")
    estimate, same = df.select(estimated_similarity("x", "y"), estimated_similarity("x", "x")).first()
    assert abs(estimate - true) < 0.15 and same == 1


def test_short_texts_have_one_shingle():
    _, members, offsets = next(near_dedup.shingle_sets(pa.array(["a b", "A  B", None, "a b c d e f"])))
    assert np.diff(offsets).tolist() == [1, 1, 0, 2] and members[0] == members[1]


def test_one_of_each_group_stays(spark):
    rows = corpus() + [(i if i is None else i + 5000, t) for i, t in MESSY]
    df = documents(spark, rows)
    kept = keep_one(df, percent=85)
    assert kept.columns == df.columns
    expected = near_components([r for r in rows if r[0] is not None], 85)
    ids = [r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None]
    assert sorted(ids) == sorted(i for i, (_, c) in expected.items() if i == c)
    assert kept.filter(F.col("doc_id").isNull()).count() == 2


def test_columns_with_any_name_stay(spark):
    rows = [(1, prose(1, 60)), (2, prose(1, 60)), (2, prose(1, 60)), (3, prose(3, 60)), (3, prose(3, 60)), (None, "x")]
    for some in (rows, rows[:2]):
        df = documents(spark, some).selectExpr("*", "1 as `a.b`", "2 as `my col`", "3 as `t``k`")
        kept = keep_one(df)
        assert kept.columns == df.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == (["1", "3", "None"] if some is rows else ["1"])
