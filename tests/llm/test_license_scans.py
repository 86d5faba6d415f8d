"""License phrases against plain Python, and automata against all readings of a template."""

import itertools
import re

import pytest
from llm_frames import MESSY, documents, lower

from ferrybook.llm.license_scans import PERMISSION, PHRASES, Automaton, scan_licenses, word_hashes


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def test_automaton_accepts_exactly_the_readings():
    automaton = Automaton("a b [[c d]] e {{2}} f [[g]]")
    readings = set()
    for optional, any_, last in itertools.product(["", "c d"], ["", "x", "x f", "f"], ["", "g"]):
        readings.add(" ".join(f"a b {optional} e {any_} f {last}".split()))
    for reading in readings:
        assert automaton.match(word_hashes(reading)) == len(reading.split())
    for wrong in ("a b c e f", "a b e x y z f", "a b d e f", "a e f", "b e f", "a b e"):
        assert automaton.match(word_hashes(wrong)) == 0
    assert automaton.match(word_hashes("a b e f then more")) == 4
    for bad in ("[[a b]] c", "a b [[c", "a b ]]", "a b [[c [[d]] ]]", "a"):
        with pytest.raises(ValueError):
            Automaton(bad)


def test_base_counts_equal_plain_version(spark):
    rows = MESSY + [
        (20, "The MIT License. mit-license; Apache\nLicense, GENERAL public  license! mit license"),
        (21, "mit" * 3 + " license mit x license"),
        (22, "mit license " * 500),
        (23, "ümit license"),
    ]
    for row in scan_licenses(documents(spark, rows)).collect():
        text = next(t for i, t in rows if i == row.doc_id and len(words(t)) == row.n_words)
        w, starts, labels = words(text), [], set()
        for phrase, label in PHRASES.items():
            p = phrase.split()
            for i in range(len(w)):
                if w[i : i + len(p)] == p:
                    starts.append(i)
                    labels.add(label)
        assert (row.n_base, row.base_labels) == (len(starts), ",".join(sorted(labels)))
        assert (row.first_word, row.last_word) == (min(starts, default=None), max(starts, default=None))
        assert labels <= set(row.labels.split(",")) and 0 <= row.score <= 1


def test_templates(spark):
    mit = PERMISSION.replace("[[", "").replace("]]", "").replace("{{12}}", "the authors")
    rows = [
        (1, f"Copyright 2020 x\n{mit}\nend"),
        (2, mit.replace("sublicense", "sell")),
        (3, "It is licensed under the GNU General Public License, either version 3 or later."),
        (4, "Licensed under CC BY-NC 4.0."),
        (5, "licensed under the Apache License. Version 1.1"),
        (6, "Licensed under CC BY-NC"),
    ]
    got = {r.doc_id: r for r in scan_licenses(documents(spark, rows)).collect()}
    assert [got[i].labels for i in range(1, 7)] == ["mit-text", "", "gpl,gpl-3.0", "cc-by-nc-4.0", "apache", ""]
    assert got[1].matches[0].start == 3 and got[1].matches[0].words == len(words(mit))
    assert got[1].score == pytest.approx(len(words(mit)) / (len(words(mit)) + 4))
    assert scan_licenses(documents(spark, [])).count() == 0
