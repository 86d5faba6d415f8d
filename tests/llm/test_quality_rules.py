"""Quality counts and likelihood ratios against plain Python."""

import collections
import math
import re

import pytest
import xxhash
from llm_frames import MESSY, documents, edited, prose, space_words

from ferrybook.llm.quality_rules import BUCKETS, THRESHOLD, bucket_ratios, keep_good, rate_quality


def h(*values, seed=42):
    for v in values:
        data = v.encode() if isinstance(v, str) else v.to_bytes(8, "little")
        seed = xxhash.xxh64(data, seed=seed).intdigest()
    return seed


def buckets(text):
    hashes = [h(w) for w in space_words(text)]
    return [x % BUCKETS for x in hashes] + [h(a, b) % BUCKETS for a, b in zip(hashes, hashes[1:])]


def counts(text):
    text = text or ""
    w = space_words(text)
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if space_words(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def ratios(rows, trusted):
    passages = {}
    for i, text in rows:
        for p in re.split(r"(?<=[dl048йхν])[\x20\x09-\x0D]+|\n", text or ""):
            passages[p] = passages.get(p, 0) | (i in trusted)
    n, t = collections.Counter(), collections.Counter()
    for p, good in passages.items():
        for b in buckets(p):
            n[b] += 1
            t[b] += good
    whole_n, whole_t = sum(n.values()) + BUCKETS, sum(t.values()) + BUCKETS
    return lambda b: math.log((t[b] + 1) / whole_t) - math.log((n[b] + 1) / whole_n) if n[b] else 0.0


@pytest.fixture(scope="module")
def rows():
    junk = [" ".join(f"{w}$$ |" for w in prose(i, 80).split()) for i in range(20)]
    lines = "\n".join(["the same line here"] * 5 + ["", " ", "another line of it"])
    texts = [prose(i, 120) for i in range(60)] + junk + [lines, "x y z " * 30, "# * $ % & | < >"]
    return [(100 + i, t) for i, t in enumerate(texts)] + MESSY


def test_equals_plain_version(spark, rows):
    trusted = {100 + i for i in range(50)}
    labels = spark.createDataFrame([(i,) for i in trusted] + [(None,)], "doc_id long")
    got = rate_quality(documents(spark, rows), labels).collect()
    ratio = ratios(rows, trusted)
    expected = []
    for i, text in rows:
        c, b = counts(text), buckets(text)
        score = sum(map(ratio, b)) / len(b) if b else 0.0
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        expected.append((i, *c, failed, score, not failed and score >= THRESHOLD))
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(expected, key=order), strict=True):
        assert a[:7] + a[8:] == b[:7] + b[8:]
        assert a[7] == pytest.approx(b[7], abs=2e-6)
    kept = {r.doc_id for r in got if r.kept}
    assert {100 + i for i in range(60)} <= kept and not kept & {160 + i for i in range(20)}


def test_no_trusted_rows_and_empty_table(spark, rows):
    none = spark.createDataFrame([], "doc_id long")
    assert {r.score for r in rate_quality(documents(spark, rows), none).collect()} == {0.0}
    assert rate_quality(documents(spark, []), none).count() == 0


@pytest.mark.parametrize("copies", [3, 100])
def test_copies_push_no_good_text_out(spark, copies):
    rows = [(i, prose(i, 150, words=800)) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(copies)]
    rows += [(1000 + i, edited(rows[1][1], i, 2)) for i in range(min(copies, 10))]
    labels = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    got = rate_quality(documents(spark, rows), labels).collect()
    assert all(r.kept for r in got if r.doc_id < 50 or 100 <= r.doc_id < 1000)
    assert all(r.kept for r in got if r.doc_id >= 1000)


def test_only_near_copies_of_trusted_texts_teach_the_trusted_side(spark):
    rows = [(i, prose(i, 150, words=800)) for i in range(60)]
    rows += [(1000 + i, edited(rows[1][1], i, 2)) for i in range(200)]
    half = rows[2][1].split()[:75] + rows[55][1].split()[:75]
    rows += [(2000, " ".join(half)), (2001, rows[3][1] + " \n"), (2002, "")]
    labels = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    got = {r.doc_id: r for r in rate_quality(documents(spark, rows), labels).collect()}
    assert all(got[i].kept for i in [*range(50), *range(1000, 1200), 2001])
    # Neither texts of their own nor a text that is half a copy count as trusted.
    assert not any(got[i].kept for i in [*range(50, 60), 2000, 2002])


def test_kept_rows_have_all_columns(spark, rows):
    df = documents(spark, rows)
    none = spark.createDataFrame([], "doc_id long")
    kept = keep_good(df, none)
    assert kept.columns == df.columns
    assert kept.count() == sum(r.kept for r in rate_quality(df, none).collect())


def test_rated_without_shuffle_or_python(spark, rows):
    plan = rate_quality(documents(spark, rows), spark.createDataFrame([(100,)], "doc_id long"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text


def test_filter_is_in_no_plan_description_and_in_no_row(spark, rows):
    """The driver keeps and logs a description of the plan at every step of a query."""
    labels = spark.createDataFrame([(100 + i,) for i in range(50)], "doc_id long")
    ratios = bucket_ratios(documents(spark, rows), labels)
    text = ratios._jdf.queryExecution().executedPlan().toString()
    assert len(text) < 100_000
    assert "AS filter" not in text


def test_characters_are_counted_by_patterns(spark):
    """Odd white space, symbols side by side, letters beyond 16 bits; no table lookups."""
    texts = [
        "\x0b\n\t\n \x0c\r\n", "a\u00a0b\n\u2003\n\u2003\n",
        "##$$ %&|<>*\n\n#", "\U0001f600 x\r\nx\r\n\U0001f600", "^[]-\\", None,
    ]
    none = spark.createDataFrame([], "doc_id long")
    rated = rate_quality(documents(spark, list(enumerate(texts))), none)
    assert "translate(" not in rated._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: tuple(r[1:6]) for r in rated.collect()} == {i: counts(t) for i, t in enumerate(texts)}
