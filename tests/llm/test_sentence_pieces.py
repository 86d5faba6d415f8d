"""Ids against the SentencePiece library, and exact round trips."""

import pandas as pd
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_frames import MESSY, documents

from ferrybook.llm.sentence_pieces import (
    MODEL,
    Encoder,
    decode_ids,
    encode_texts,
    load_pieces,
    merge,
    sort_suffixes,
)

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
PIECES = load_pieces()
ENCODER = Encoder(**PIECES)
TEXTS = [
    "Hello  world", " a", "a ", "a\n b\t c", "", "é漢 🤗x", "▁a", "a\r\nb\x00c", None, "   ",
    "supercalifragilistic" * 50, "漢字仮名 交じり文 😀😀", "x" * 300 + " " * 40, "  lead and trail  ", "\U0010ffff",
]


def ids(texts):
    return [x for part in ENCODER.encode(pa.array(texts, pa.string())) for x in part.to_pylist()]


def test_equals_the_library():
    assert ids(TEXTS) == [LIBRARY.encode(t or "") for t in TEXTS]
    assert ids([]) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab eitnr  éß漢🤗\n") | st.characters(codec="utf-8")), max_size=4))
def test_any_text_equals_the_library(texts):
    assert ids(texts) == [LIBRARY.encode(t) for t in texts]


def test_given_documents(sf_dir):
    texts = pd.read_parquet(f"{sf_dir}/documents.parquet").text.tolist()
    assert ids(texts) == LIBRARY.encode(texts)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr("ferrybook.llm.sentence_pieces.KNOWN_WORDS", 3)
    monkeypatch.setattr("ferrybook.llm.sentence_pieces.BATCH_BYTES", 40)
    monkeypatch.setattr("ferrybook.llm.sentence_pieces.KNOWN_PAIRS", 3)
    assert ids(TEXTS) == [LIBRARY.encode(t or "") for t in TEXTS]


def test_suffixes_are_sorted():
    data = pa.array([b"the then this the\xffthe thenceforth"])[0].as_py()
    import numpy as np

    order, _ = sort_suffixes(np.frombuffer(data, dtype=np.uint8), 24)
    cut = [data[i : i + 24].ljust(24, b"\0") for i in order]
    assert cut == sorted(cut) and sorted(order) == list(range(len(data)))


@pytest.mark.parametrize("word", ["hello", "aaaaaaa", "international", "zzqj"])
def test_merge_equals_the_library(word):
    assert merge(" " + word, ENCODER.rank) == [p.replace("▁", " ") for p in LIBRARY.encode(word, out_type=str)]


def test_operators(spark):
    rows = MESSY + list(enumerate(TEXTS, 100))
    coded = decode_ids(encode_texts(documents(spark, rows)))
    got = coded.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == LIBRARY.encode(r.text or "")
        assert r.decoded == (r.text or "").replace("▁", " ")
    for r in encode_texts(documents(spark, rows), verify=True).collect():
        assert r.ids == LIBRARY.encode(r.text or "")
        assert r.round_trip == ("▁" not in (r.text or ""))
    bare = encode_texts(documents(spark, rows), with_text=False)
    assert bare.columns == ["doc_id", "ids"] and bare.count() == len(rows)
    assert decode_ids(encode_texts(documents(spark, []))).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert decode_ids(nothing).first().decoded == ""
