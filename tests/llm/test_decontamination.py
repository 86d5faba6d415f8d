"""Spaced seeds: what they must hit, and planted passages with substitutions."""

import itertools
import random
import re

import numpy as np
import pytest
from llm_frames import MESSY, documents, prose

from ferrybook.llm import decontamination
from ferrybook.llm.decontamination import MASKS, best_overlap, contaminated, without_contaminated

ITEMS = {i: prose(900 + i, 15 + i, words=3000) for i in range(30)}


def items(spark, rows=None):
    df = spark.createDataFrame(list((rows or ITEMS).items()), "item_id long, text string")
    return df.selectExpr("*", "'x' as id", "1 as item", "2 as seed", "3 as tokens")


def test_masks_hit_all_overlaps_of_15_with_3_substitutions():
    placed = [
        sum(1 << (at + i) for i, c in enumerate(mask) if c == "1")
        for mask in MASKS
        for at in range(15 - len(mask) + 1)
    ]
    for wrong in itertools.combinations(range(15), 3):
        bits = sum(1 << i for i in wrong)
        assert any(not marks & bits for marks in placed)


def substituted(text, n, seed):
    words = text.split()
    for i in random.Random(seed).sample(range(len(words)), n):
        words[i] = f"other{i}"
    return " ".join(words)


def test_planted_passages_are_found_and_clean_documents_are_not(spark):
    rows, planted = [], set()
    for i in range(120):
        text = prose(i, 120, words=3000)
        if i % 2:
            item = i % 30
            passage = substituted(ITEMS[item], i % 4, i).upper().replace(" ", ", ")
            text = f"{text} {passage}. {prose(i + 5000, 50)}"
            planted.add((i, item))
        rows.append((i, text))
    found = contaminated(documents(spark, rows), items(spark)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == planted and len(found) == len(planted)
    assert all(r.n_equal >= 0.75 * r.n_tokens for r in found)
    for r in found:
        assert 120 <= r.start <= 123 and r.n_equal >= len(ITEMS[r.item_id].split()) - 3
    left = without_contaminated(documents(spark, rows), items(spark))
    assert left.columns == documents(spark, rows).columns
    assert {r.doc_id for r in left.collect()} == {i for i in range(120) if not i % 2}


def test_messy_rows_and_empty_tables(spark):
    rows = MESSY + [(30, ITEMS[3]), (30, ITEMS[3]), (None, ITEMS[4])]
    odd = {**ITEMS, 70: None, 71: "", 72: "too few words"}
    found = contaminated(documents(spark, rows), items(spark, odd)).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in found) == [(0, 4), (30, 3)]
    left = without_contaminated(documents(spark, rows), items(spark, odd))
    assert left.count() == len(MESSY)
    assert contaminated(documents(spark, []), items(spark)).count() == 0
    assert contaminated(documents(spark, rows), items(spark).limit(0)).count() == 0


@pytest.mark.parametrize("offset", [-3, 0, 4])
def test_best_overlap(offset):
    item = np.arange(100, 120)
    document = np.arange(50)
    for i, t in enumerate(item):
        if 0 <= i + offset < 50:
            document[i + offset] = t
    document[offset + 10] = 7
    start, tokens, equal = best_overlap(document, item, offset)
    assert (start, tokens, equal) == (max(0, offset), 20 + min(0, offset), 19 + min(0, offset))


@pytest.mark.parametrize("share", [0.1, 0.2, 0.25, 0.3])
def test_best_overlap_is_the_longest_good_run(share):
    rng = np.random.default_rng(int(share * 100))
    for n in [*range(13, 60), 300]:
        item = np.arange(n)
        document = np.where(rng.random(n) < share, -1, item)
        ok = document == item
        runs = [
            (b - a, ok[a:b].sum(), -a)
            for a in range(n)
            for b in range(a + 1, n + 1)
            if ok[a] and ok[b - 1] and ok[a:b].sum() >= 0.75 * (b - a)
        ]
        tokens, equal, start = max(runs)
        assert best_overlap(document, item, 0) == (-start, tokens, equal)


@pytest.mark.parametrize("copies", [4, 5])
def test_good_runs_with_wide_gaps_between_them_are_found(spark, copies):
    item = prose(77, 29 * copies - 9, words=3000).split()
    text = " ".join(f"gap{i}" if i % 29 >= 20 else w for i, w in enumerate(item))
    (row,) = contaminated(documents(spark, [(1, text)]), items(spark, {5: " ".join(item)})).collect()
    assert (row.doc_id, row.item_id) == (1, 5) and row.n_tokens >= 20
    assert row.n_equal >= 0.75 * row.n_tokens


@pytest.mark.parametrize("n", range(13, 22))
def test_masks_hit_all_runs_of_three_quarters_equal_tokens(n):
    wrong = np.array([sum(1 << i for i in c) for c in itertools.combinations(range(n), n // 4)])
    for mask in MASKS:
        for at in range(n - len(mask) + 1):
            wrong = wrong[wrong & sum(1 << (at + i) for i, c in enumerate(mask) if c == "1") != 0]
    assert not len(wrong)


def test_short_items_and_sparse_overlaps_are_found(spark):
    bare = {80: "alpha beta gamma", 81: "only", 82: "six of these tokens are here"}
    long = prose(990, 13, words=3000).split()
    changed = " ".join("xx" if i in (1, 3, 5) else w for i, w in enumerate(long))
    rows = [(i, f"before {text} after") for i, text in bare.items()] + [(83, changed), (84, "beta gamma alpha")]
    found = contaminated(documents(spark, rows), items(spark, {**bare, 83: " ".join(long)})).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(80, 80), (81, 81), (82, 82), (83, 83)]


def plain_overlaps(rows, items):
    """Best overlap of each document and item, by trying all alignments and runs."""
    found = {}
    for doc, text in rows:
        tokens = re.findall(r"[0-9a-z]+", text.lower())
        for item, item_text in items.items():
            own = item_text.split()
            runs = []
            for offset in range(1 - len(own), len(tokens)):
                places = [
                    i for i in range(max(0, offset), min(len(tokens), offset + len(own))) if tokens[i] == own[i - offset]
                ]
                good = [
                    (b - a + 1, n, -a)
                    for k, a in enumerate(places)
                    for n, b in enumerate(places[k:], 1)
                    if n >= 0.75 * (b - a + 1)
                ]
                runs += [max(good)] if good else []
            runs = [(n, -size, at) for size, n, at in runs if size >= 13]
            if runs:
                n, size, at = max(runs)
                found[doc, item] = (-at, -size, n)
    return found


def test_equals_all_alignments(spark):
    rng = random.Random(8)
    own = {i: prose(300 + i, rng.randrange(13, 40), words=40) for i in range(8)}
    rows = []
    for i in range(60):
        words = prose(i, 40, words=40).split()
        part = own[i % 8].split()
        first = rng.randrange(len(part) - 11)
        part = [w if rng.random() > 0.15 * (i % 4) else "zz" for w in part[first : first + rng.randrange(11, 30)]]
        at = rng.randrange(len(words))
        rows.append((i, " ".join(words[:at] + part + words[at:])))
    found = contaminated(documents(spark, rows), items(spark, own)).collect()
    got = {(r.doc_id, r.item_id): (r.start, r.n_tokens, r.n_equal) for r in found}
    expected = plain_overlaps(rows, own)
    assert got == expected and 20 < len(got) < 60


def test_repetitive_texts_meet_once(spark):
    own = {1: "buy now " * 40, 2: "a " * 60, 3: prose(5, 30)}
    rows = [(i, "buy now " * 3000 + "a " * 5000) for i in range(3)] + [(9, prose(6, 50))]
    found = contaminated(documents(spark, rows), items(spark, own)).collect()
    got = {(r.doc_id, r.item_id): (r.n_tokens, r.n_equal) for r in found}
    assert got == {(i, j): (n, n) for i in range(3) for j, n in ((1, 80), (2, 60))}


def test_full_filter_only_costs_work(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "LEAST_BITS", 6)
    monkeypatch.setattr(decontamination, "MOST_BITS", 6)
    rows = [(i, f"{prose(i, 60)} {ITEMS[i] if i % 3 else ''}") for i in range(30)]
    found = contaminated(documents(spark, rows), items(spark)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i) for i in range(30) if i % 3}


def test_columns_with_any_name_stay(spark):
    rows = [(1, ITEMS[3]), (2, prose(1, 40)), (None, None)]
    df = documents(spark, rows).selectExpr(
        "*", "1 as text_hash", "2 as _found", "3 as found", "4 as hash", "5 as `a.b`", "6 as `my col`"
    )
    left = without_contaminated(df, items(spark))
    assert left.columns == df.columns
    assert sorted(map(str, left.collect())) == sorted(map(str, df.filter("doc_id is null or doc_id = 2").collect()))
