"""Shards against a search over all group sizes in plain Python."""

import random
import zlib

import pytest
from llm_frames import MESSY, documents, prose
from pyspark.sql import functions as F

from ferrybook.llm import sharding
from ferrybook.llm.sharding import shard_documents


def smallest_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, used, load = (low + high) // 2, 1, 0
        for s in sizes:
            used, load = (used + 1, s) if load + s > middle else (used, load + s)
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


def check(spark, rows, shards):
    df = documents(spark, rows)
    keys = df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k")).distinct().collect()
    key = {r.text or "": r.k for r in keys}
    out = shard_documents(df, shards).collect()
    text_of = {}
    for i, t in rows:
        text_of.setdefault(i, t)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in out) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    sizes = {}
    for _, t in rows:
        sizes[key[t or ""]] = sizes.get(key[t or ""], 0) + len((t or "").encode()) + 1
    ordered = [sizes[k] for k in sorted(sizes)]
    loads, slots, groups = {}, {}, {}
    for r in out:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads.values()) == smallest_capacity(ordered, shards)
    named = {r.doc_id: r.shard for r in out if r.doc_id is not None}
    for i, t in rows:
        if i is not None:
            groups.setdefault(t or "", set()).add(named[i])
    assert all(len(s) == 1 for s in groups.values())
    # Contiguous in key order.
    order = [min(groups[t]) for t in sorted(groups, key=key.get)]
    assert order == sorted(order)
    return loads


class ListCuts(sharding.Cuts):
    """The search over (key, bytes) pairs in memory."""

    def __init__(self, groups, shards):
        self.groups, self.shards, self.looks = groups, shards, 0
        self.spans = [(-(1 << 63), (1 << 63) - 1)]
        self.ranges = self._histogram(None, sharding.KEY_BITS - sharding.HISTOGRAM_BITS)
        self._index()
        self.largest = max(size for _, size in groups)

    def _where(self, spans):
        self.spans = spans

    def _histogram(self, where, bits):
        self.looks += 1
        assert self.looks < 500
        found = {}
        for key, size in self.groups:
            if any(a <= key <= b for a, b in self.spans):
                found.setdefault(key >> bits, []).append(size)
        return sorted(
            (sharding.Range(k << bits, bits, sum(v), len(v)) for k, v in found.items()), key=lambda r: r.low
        )


@pytest.mark.parametrize("bits", [2, 5])
@pytest.mark.parametrize("seed", range(25))
def test_search_looks_closer_until_it_is_exact(monkeypatch, bits, seed):
    monkeypatch.setattr(sharding, "HISTOGRAM_BITS", bits)
    rng = random.Random(seed)
    n = rng.choice([1, 5, 40, 300])
    keys = sorted({rng.randrange(-(1 << 63), 1 << 63) >> rng.choice([0, 0, 40]) for _ in range(n)})
    groups = [(k, rng.choice([1, 50, rng.randrange(1, 3000), 100_000 if seed % 3 == 0 else 7])) for k in keys]
    shards = rng.choice([1, 2, 16])
    cuts = ListCuts(groups, shards)
    first = cuts.keys()
    sizes = [s for _, s in groups]
    assert cuts.capacity() == smallest_capacity(sizes, shards)
    assert first == sorted(set(first)) and len(first) < shards
    loads = [0] * shards
    for k, s in groups:
        loads[sum(k >= f for f in first)] += s
    assert max(loads) == smallest_capacity(sizes, shards)


def test_smallest_largest_shard(spark):
    rows = [(i, prose(i, 1 + i * 7 % 50)) for i in range(150)]
    loads = check(spark, rows, 16)
    assert len(loads) == 16 and min(loads.values()) > 0.5 * max(loads.values())


def test_one_group_with_a_third_of_the_rows(spark):
    rows = [(i, prose(0, 30) if i % 3 == 0 else prose(i, 30)) for i in range(300)]
    assert len(check(spark, rows, 8)) == 8  # and none is empty


@pytest.mark.parametrize("percent", [5, 30, 90])
def test_many_equal_texts(spark, percent):
    texts = (f"text {i} " + "x" * (i % 37) for i in range(50_000))
    rows = [(i, "the same text" if i % 100 < percent else t) for i, t in enumerate(texts)]
    assert len(check(spark, rows, 16)) == 16


def test_messy_rows_and_few_groups(spark):
    check(spark, MESSY, 16)
    assert shard_documents(documents(spark, []), 16).count() == 0
    assert {r.shard for r in shard_documents(documents(spark, [(1, "a"), (2, "a")]), 4).collect()} == {0}
