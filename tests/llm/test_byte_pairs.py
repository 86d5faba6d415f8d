"""Byte-level ids against the tiktoken library, and round trips."""

import hashlib
import random
from array import array

import pytest
import regex
import tiktoken
from llm_frames import MESSY, documents

from ferrybook.llm import byte_pairs
from ferrybook.llm.byte_pairs import BytePairs, PartIds, decode_bytes, encode_bytes, ids_of, load_pattern, load_ranks


@pytest.fixture(scope="module")
def ranks():
    return load_ranks()


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=load_pattern(), mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def pairs(ranks):
    return BytePairs(ranks)


def test_each_token_has_its_merge(ranks, pairs):
    assert set(pairs.halves) == {r for t, r in ranks.items() if len(t) > 1}
    token = {r: t for t, r in ranks.items()}
    assert all(token[a] + token[b] == token[r] for r, (a, b) in pairs.halves.items())


@pytest.mark.parametrize("seed", range(8))
def test_random_parts(library, pairs, ranks, seed):
    rng = random.Random(seed)
    tokens = list(ranks)
    letters = ["ab", "aehinrst", "0123456789", "äöüßéèñ漢字かな🤗", " \n\t", "=-*_#"][seed % 6]
    for _ in range(300):
        kind = rng.randrange(3)
        if kind == 0:
            part = "".join(rng.choices(letters, k=rng.randrange(1, 60))).encode()
        elif kind == 1:
            part = b"".join(rng.choices(tokens, k=rng.randrange(1, 8)))
        else:
            part = rng.choice(tokens) * rng.randrange(1, 12)
        assert pairs.encode(part) == library._encode_single_piece(part), part


def test_long_parts_take_linear_work(library, pairs):
    for part in ("a" * 50_000, "ab" * 30_000, "aab" * 20_000, "the" * 20_000):
        assert pairs.encode(part.encode()) == library._encode_single_piece(part.encode())


def test_long_texts_and_small_memory(library, pairs, monkeypatch):
    text = "Some words, numbers 12345 and   blanks\n\n\tfür 漢字. " * 400 + "x" * 3000
    compiled = regex.compile(load_pattern())
    expected = array("i", library.encode_ordinary(text)).tobytes()
    assert ids_of(text, compiled, PartIds(pairs)) == expected
    monkeypatch.setattr(byte_pairs, "SPLIT_LETTERS", 100)
    monkeypatch.setattr(byte_pairs, "KNOWN_PARTS", 3)
    monkeypatch.setattr(byte_pairs, "KNOWN_PAIRS", 3)
    assert ids_of(text, compiled, PartIds(pairs)) == expected


def test_operator_equals_library(spark, library):
    rows = [*MESSY, (20, "<|endoftext|> it's We'LL 'd"), (21, "    ﻿ end  "), (22, " " * 5000)]
    df = documents(spark, rows)
    coded = decode_bytes(encode_bytes(df))
    assert coded.columns == ["doc_id", "ids", "decoded"]
    got = sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in coded.collect()), key=str)
    expected = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows]
    assert got == sorted(expected, key=str)
    assert encode_bytes(df.limit(0)).count() == 0 and decode_bytes(encode_bytes(df.limit(0))).count() == 0


def test_small_batches(spark, library, monkeypatch):
    monkeypatch.setattr(byte_pairs, "BATCH_IDS", 5)
    rows = [(i, " ".join(["word"] * (i % 7))) for i in range(50)]
    got = {r.doc_id: (list(r.ids), bytes(r.decoded)) for r in decode_bytes(encode_bytes(documents(spark, rows))).collect()}
    assert got == {i: (library.encode_ordinary(t), t.encode()) for i, t in rows}


def test_null_ids_have_no_bytes(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in decode_bytes(df).collect()] == [b"", b""]


def test_query_on_given_documents(spark, sf_dir, library):
    from ferrybook.llm.queries import queries

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries()["op12_byte_pairs"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        joined = ",".join(map(str, ids)).encode()
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(joined).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
