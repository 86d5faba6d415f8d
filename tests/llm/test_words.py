"""Hashes of words tell apart what sums modulo a power of two do not."""

import pyarrow as pa

from ferrybook.llm.words import LONG_WORD, chunks, space_table, split_words


def hashes(*texts):
    return [split_words(c, space_table()).hashes.tolist() for c in chunks(pa.array(texts))][0]


def test_patterns_made_for_sum_hashes_differ():
    pattern = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = pattern.translate(str.maketrans("ab", "ba"))
    one, two, again = hashes(pattern, other, f"  {pattern.upper()}\n")
    assert one == again != two


def test_words_around_the_bound():
    words = ["x" * n for n in range(LONG_WORD - 2, LONG_WORD + 3)]
    found = hashes(" ".join(words), *words)
    assert found[:5] == found[5:] and len(set(found)) == 5
