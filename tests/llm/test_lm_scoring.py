"""Base scores against plain Python; the model's probabilities sum to one and beat them."""

import collections
import math
import zlib

import numpy as np
import pytest
from llm_frames import MESSY, documents, lower, prose, space_words

from ferrybook.llm import lm_scoring
from ferrybook.llm.lm_scoring import CLASSES, FIRST_ENDING, fit, score_texts, train


def tokens(text):
    return [*space_words(lower(text)), None]


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 5 == 1


def language(i, name, words):
    text = prose(i, 150).split()
    return " ".join(words[int(w[1:]) % len(words)] if j % 2 else f"{w}{name}" for j, w in enumerate(text))


@pytest.fixture(scope="module")
def rows():
    kinds = [("xa", ["the", "of", "and"]), ("yo", ["der", "die", "das"]), ("zu", ["le", "la", "de"])]
    return [(100 + i, language(i, *kinds[i % 3])) for i in range(150)] + MESSY


@pytest.mark.parametrize("at_hand", [1 << 18, 5])
def test_base_equals_plain_version(spark, rows, monkeypatch, at_hand):
    monkeypatch.setattr(lm_scoring, "AT_HAND", at_hand)  # 5: nearly all counts are joined
    monkeypatch.setattr(lm_scoring, "STEPS", 20)
    count = collections.Counter(t for i, text in rows if not held(i) for t in tokens(text))
    total, size = sum(count.values()), sum(count.values()) + 0.5 * (len(count) + 1)
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    expected = []
    for i, text in rows:
        t = tokens(text)
        base = sum(math.log10((count[w] + 0.5) / size) for w in t)
        expected.append((i, held(i), len(t), sum(count[w] > 0 for w in t), total, base))
    got = sorted((tuple(r) for r in score_texts(documents(spark, rows)).collect()), key=order)
    for a, b in zip(got, sorted(expected, key=order), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5])
        assert a[6] < 0


def test_model_beats_the_base_on_held_out_texts(spark, rows):
    out = [r for r in score_texts(documents(spark, rows)).collect() if r.held_out and r.n_tokens > 50]
    assert len(out) > 10
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.1 * sum(r.n_tokens for r in out)


def test_probabilities_sum_to_one(spark, rows):
    docs = documents(spark, rows).filter("doc_id is not null").select("text")
    model, counts = fit(docs)
    table = 10.0**model.log_table
    assert np.allclose(table.sum(axis=1), 1, atol=1e-4)
    # Within an open class: all its words, and one unknown word.
    left = {r.word: r for r in counts.collect() if r.word != 0}
    single = set(model.classes.words.view(np.int64).tolist())
    mass = np.full(CLASSES, 0.5)
    for word, r in left.items():
        if word not in single:
            mass[model.classes.ending_class[r.ending]] += r.n + 0.5
    assert np.allclose(np.log10(mass[FIRST_ENDING:]), model.log_class_mass[FIRST_ENDING:])


def test_training_learns_the_context():
    counts = np.zeros((CLASSES, CLASSES, CLASSES), dtype=np.int64)
    for a in range(10):
        for b in range(10):
            counts[a, b, 20 + b] = 90
            counts[a, b, 30] = 10
    table = 10.0 ** train(counts.ravel(), np.ones(CLASSES, dtype=bool))
    assert all(table[a * CLASSES + b, 20 + b] > 0.7 for a in range(10) for b in range(10))


def test_empty_table_and_no_training_rows(spark):
    assert score_texts(documents(spark, [])).count() == 0
    only = next(i for i in range(100) if held(i))
    (row,) = score_texts(documents(spark, [(only, "a b")])).collect()
    assert (row.train_tokens, row.n_known, row.base_score) == (0, 0, 0.0) and row.score < 0


def test_sixty_words_of_one_ending_are_told_apart_by_context(spark):
    ring = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}ing" for i in range(60)]
    rows = [(i, " ".join(ring[(i + j) % 60] for j in range(240))) for i in range(60)]
    out = [r for r in score_texts(documents(spark, rows)).collect() if r.held_out]
    assert out and all(r.score > -0.3 * r.n_tokens for r in out)
