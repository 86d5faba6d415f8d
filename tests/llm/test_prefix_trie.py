"""Prefix tries against a plain walk over all conversations."""

import collections
import hashlib
import random
import zlib

import pytest
import xxhash

from ferrybook.llm import prefix_trie as module
from ferrybook.llm.prefix_trie import centroid_sums, ordered_turns, plain_steps, prefix_trie, rebuilt_steps

SCHEMA = "conv_id long, turn long, role string, text string"


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", *(f"'x' as `{c}`" for c in ("place", "a", "k1", "slice", "level", "part", "a.b")))


def hashes(role, text):
    a = xxhash.xxh64(text.encode(), seed=xxhash.xxh64(role.encode(), seed=42).intdigest()).intdigest()
    one = xxhash.xxh64((1).to_bytes(4, "little"), seed=42).intdigest()
    b = xxhash.xxh64(role.encode(), seed=xxhash.xxh64(text.encode(), seed=one).intdigest()).intdigest()
    return [x - (1 << 64) if x >> 63 else x for x in (a, b)]


def in_order(rows):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, *hashes(role, text), role, text))
    return {c: [t[4:] for t in sorted(found)] for c, found in turns.items()}


def rebuilt(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - c % 100, [])[:h] + own[h:]
    return out


def expected(conversations):
    members = collections.defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[x] for x in below) if below else 1
        own = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        saved[node] = own + sum(saved[x] for x in below)
    rows = []
    for node, found in members.items():
        ends = ",".join(str(c) for c in sorted(found) if len(conversations[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        rows.append((min(found), len(node), parent, len(found), len(children[node]), leaves[node], saved[node], digest))
    return sorted(rows, key=str)


def check(spark, rows, width=module.WIDTH):
    turns = ordered_turns(frame(spark, rows))
    got = sorted(map(tuple, prefix_trie(rebuilt_steps(turns), width).collect()), key=str)
    assert got == expected(rebuilt(in_order(rows)))
    return turns


def conversations(seed, n, longest=6, letters="abc"):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(rng.randrange(longest + 1)):
            rows.append((c, turn, rng.choice(["user", "bot"]), rng.choice(letters) * rng.randrange(4)))
    rng.shuffle(rows)
    return rows


def plain_sums(parents, own):
    sums = [list(v) for v in own]
    for v in range(len(own) - 1, 0, -1):
        sums[parents[v]] = [a + b for a, b in zip(sums[parents[v]], sums[v])]
    return sums


@pytest.mark.parametrize("seed", range(12))
def test_centroid_sums(seed):
    rng = random.Random(seed)
    n = rng.choice([1, 2, 7, 300])
    shape = [lambda v: v - 1, lambda v: 0, lambda v: rng.randrange(v), lambda v: max(0, v - rng.randrange(1, 4))][seed % 4]
    parents = [-1] + [shape(v) for v in range(1, n)]
    own = [(rng.randrange(100), -v) for v in range(n)]
    assert centroid_sums(parents, own) == plain_sums(parents, own)


@pytest.mark.parametrize("width", [2, 5, 4096])
def test_small_tries(spark, width):
    check(spark, conversations(width, 230), width)


def test_long_conversations_are_sliced(spark, monkeypatch):
    monkeypatch.setattr(module, "SLICE", 4)
    monkeypatch.setattr(module, "ENDS", 3)
    rows = conversations(1, 40, longest=30, letters="a")
    rows += [(500 + c, t, "user", "same") for c in range(9) for t in range(25 + c % 3)]
    check(spark, rows, 3)


def test_one_conversation_with_a_third_of_the_rows(spark):
    rows = conversations(2, 150)
    rows += [(7, t % 40, "user", f"turn {t % 90}") for t in range(len(rows) // 2)]  # ties and repeated rows
    turns = check(spark, rows, 50)
    places = sorted(r.place for r in turns.filter("conv_id = 7").collect())
    assert places == list(range(1, len(places) + 1))


def test_one_beginning_and_one_conversation_of_many(spark):
    rows = [(c, t, "user", "the same first turns") for c in range(300) for t in range(3)]
    rows += [(c, 3, "bot", f"answer {c}") for c in range(0, 300, 3)]
    check(spark, rows, 20)


def test_messy_rows(spark):
    rows = [(None, 1, "user", "no id"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, "", "")]
    rows += [(-205, 1, "user", "x" * 100_000), (-205, 2, "bot", "ünï 🤗"), (100, 5, "user", "first")]
    turns = in_order(rows)
    assert turns[1][0] == ("user", "first")
    got = prefix_trie(plain_steps(ordered_turns(frame(spark, rows)))).collect()
    assert sorted(map(tuple, got), key=str) == expected(turns)
    for none in ([], [(None, 1, "user", "text")]):
        assert prefix_trie(plain_steps(ordered_turns(frame(spark, none)))).count() == 0
        assert prefix_trie(rebuilt_steps(ordered_turns(frame(spark, none)))).count() == 0


def test_query_on_given_conversations(spark, sf_dir):
    from ferrybook.llm.queries import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries()["op11_conversation_trie"](spark, sf_dir)
    assert dict(got.dtypes)["n_leaves"] == dict(got.dtypes)["depth"] == "bigint"
    assert sorted(map(tuple, got.collect()), key=str) == expected(rebuilt(in_order(rows)))
