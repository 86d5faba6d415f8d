"""Repeated passages, found by suffix order and longest-previous-factor arrays.

A passage of ``LENGTH`` bytes that starts at two places is a repeat. To bring equal
passages together without sorting the whole corpus, each passage names an anchor: its
run of ``ANCHOR`` bytes with the smallest hash. Equal passages have equal anchors at
the same place inside them. The passages of one anchor occurrence form a span. Only
spans whose anchor occurs more than once can hold a repeat.

Spans equal as a whole (by a 64-bit hash) are one class, and are counted without a look
at their bytes. One span of each class is sent to the task of its anchor. There the
suffixes of all spans are sorted by their first ``LENGTH`` bytes, ties in text order. The
nearest smaller positions on either side in that order give each passage its longest
previous factor and where that lies; a passage that is one as a whole is a later copy.
Anchors with very many classes are not sorted but resolved by hashes of passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrybook.llm.common import write_stage
from ferrybook.llm.words import (
    BYTE_VALUES,
    Chunk,
    as_long,
    chunks,
    mix,
    powers,
    prefix_sums,
    segment_of,
)

LENGTH = 200
ANCHOR = 32
#: An anchor with more classes of spans than this is not sorted in one task: its
#: passages are counted by their hashes instead, which spreads over all tasks.
LARGEST_GROUP = 2000
#: Suffixes that are sorted at a time, unless one anchor alone has more.
SORT_BYTES = 1 << 21


class Spans:
    """Anchors of the passages of a chunk, and the run of passages that each has."""

    def __init__(self, chunk: Chunk, length: int):
        data, size = chunk.data, len(chunk.data)
        none = np.zeros(0, dtype=np.int64)
        self.row = self.low = self.count = self.at = none
        self.anchor = self.whole = none.astype(np.uint64)
        if size < length:
            return
        sums = prefix_sums(data, BYTE_VALUES)
        _, down = powers(size)
        grams = size - ANCHOR + 1
        hashes = mix((sums[ANCHOR:] - sums[:grams]) * down[:grams])
        # The smallest hash of each run of `width`, with its place in the low bits.
        bits = np.uint64(max(21, int(size).bit_length()))
        best = (hashes >> bits << bits) | np.arange(grams, dtype=np.uint64)
        width, step = length - ANCHOR + 1, 1
        while 2 * step <= width:
            best = np.minimum(best[: len(best) - step], best[step:])
            step *= 2
        if step < width:
            best = np.minimum(best[: len(best) - (width - step)], best[width - step :])
        place = (best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        # Passages may not cross texts.
        starts = np.zeros(len(place), dtype=bool)
        rooms = np.diff(chunk.offsets) - length + 1
        edges = np.zeros(len(place) + 1, dtype=np.int64)
        roomy = rooms > 0
        np.add.at(edges, chunk.offsets[:-1][roomy], 1)
        np.add.at(edges, np.minimum(chunk.offsets[:-1][roomy] + rooms[roomy], len(place)), -1)
        starts = np.cumsum(edges[:-1]) > 0
        first = starts.copy()
        first[1:] &= ~starts[:-1] | (place[1:] != place[:-1])
        first[np.minimum(chunk.offsets[:-1][roomy], len(place) - 1)] = True
        low = np.flatnonzero(first & starts)
        if not len(low):
            return
        total = np.cumsum(starts)
        after = np.append(low[1:], len(place))
        self.count = total[after - 1] - total[low] + 1
        self.at = place[low]
        self.row = np.searchsorted(chunk.offsets, low, side="right") - 1
        self.low = low - chunk.offsets[self.row]
        self.anchor = hashes[self.at]
        until = low + self.count + length - 1
        span = mix((sums[until] - sums[low]) * down[low])
        self.whole = mix(span + (self.at - low).astype(np.uint64) * np.uint64(256) + self.count.astype(np.uint64))


def _anchors(length: int):
    """Rows (anchor, whole, id, at, more): a document's spans.

    ``at`` holds a span's start and, in its low 16 bits, its number of passages. Equal
    spans of one document are one row; ``more`` has the starts of the others, if any.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                s = Spans(chunk, length)
                order = np.lexsort((s.low, s.whole, s.anchor, s.row))
                row, whole, anchor = s.row[order], s.whole[order], s.anchor[order]
                low, count = s.low[order], s.count[order]
                new = np.ones(len(order), dtype=bool)
                new[1:] = (row[1:] != row[:-1]) | (whole[1:] != whole[:-1]) | (anchor[1:] != anchor[:-1])
                heads = np.flatnonzero(new)
                others = np.diff(np.append(heads, len(order))) - 1
                more = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(others)), pa.int32()),
                    pa.array(low[~new], pa.int64()),
                    mask=pa.array(others == 0),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(as_long(anchor[heads]), pa.int64()),
                        pa.array(as_long(whole[heads]), pa.int64()),
                        batch.column(0).take(pa.array(row[heads] + chunk.first)),
                        pa.array(low[heads] << 16 | count[heads], pa.int64()),
                        more,
                    ],
                    names=["anchor", "whole", "id", "at", "more"],
                )

    return run


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edges[::2], edges[1::2] - edges[::2]


def _cut_spans(length: int):
    """Bytes of the spans that a document was asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(2).to_pylist()
            rows, anchor, low, count, seen, body, classes = [], [], [], [], [], [], []
            for chunk in chunks(batch.column(1)):
                for i in range(len(chunk)):
                    text = chunk.data[chunk.offsets[i] : chunk.offsets[i + 1]]
                    for x in asked[chunk.first + i]:
                        rows.append(chunk.first + i)
                        anchor.append(x["anchor"])
                        low.append(x["low"])
                        count.append(x["count"])
                        seen.append(x["seen"])
                        classes.append(x["classes"])
                        body.append(text[x["low"] : x["low"] + x["count"] + length - 1].tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor, pa.int64()),
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(low, pa.int64()),
                    pa.array(count, pa.int64()),
                    pa.array(seen, pa.int64()),
                    pa.array(body, pa.binary()),
                    pa.array(classes, pa.int64()),
                ],
                names=["anchor", "id", "low", "count", "seen", "body", "classes"],
            )

    return run


def suffix_levels(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """Ranks of the suffixes by their first bytes, at depths that double up to ``length``.

    Bytes after the end count as smallest; equal prefixes have equal ranks.
    """
    n = len(data)
    padded = np.concatenate((data.astype(np.uint64) + np.uint64(1), np.zeros(length + 8, np.uint64)))
    # Seven bytes of up to 256 and the mark for "after the end" fit a 64-bit key.
    key = np.zeros(n, dtype=np.uint64)
    have = min(7, length)
    for j in range(have):
        key = key * np.uint64(257) + padded[j : j + n]
    levels = []
    while True:
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, dtype=np.int32)
        new[1:] = np.cumsum(key[order][1:] != key[order][:-1])
        rank = np.empty(n, dtype=np.int32)
        rank[order] = new + 1
        levels.append((have, rank))
        if have >= length:
            return levels
        shift = min(have, length - have)
        key = rank.astype(np.uint64) << np.uint64(32)
        if shift < n:
            key[: n - shift] |= rank[shift:].astype(np.uint64)
        have += shift


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of each suffix by its first ``length`` bytes."""
    return suffix_levels(data, length)[-1][1]


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each value the index of the nearest smaller one before it, or -1.

    What lies between a value and where it points is larger than it, so a value that
    points to a larger one may point where that points. All do so at once.
    """
    to = np.arange(-1, len(values) - 1)
    moving = np.flatnonzero(to >= 0)
    moving = moving[values[to[moving]] > values[moving]]
    while len(moving):
        to[moving] = to[to[moving]]
        moving = moving[to[moving] >= 0]
        moving = moving[values[to[moving]] > values[moving]]
    return to


def common_bytes(
    levels: list[tuple[int, np.ndarray]], data: np.ndarray, a: np.ndarray, b: np.ndarray
) -> np.ndarray:
    """How many first bytes the suffixes at two places share, up to the deepest level."""
    length, last = levels[-1]
    got = np.zeros(len(a), dtype=np.int64)
    whole = last[a] == last[b]
    left = np.flatnonzero(~whole)

    def grow(values: np.ndarray, step: int) -> np.ndarray:
        x, y = a[left] + got[left], b[left] + got[left]
        same = (x < len(data)) & (y < len(data))
        same[same] = values[x[same]] == values[y[same]]
        got[left[same]] += step
        return left[same]

    for have, rank in reversed(levels[:-1]):  # each is at most twice the next
        grow(rank, have)
    for _ in range(levels[0][0] - 1):
        left = grow(data, 1)
    got[whole] = length
    return got


def previous_factors(
    levels: list[tuple[int, np.ndarray]], data: np.ndarray, places: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Longest-previous-factor array of the suffixes at some places, in text order.

    For each, how many first bytes it shares with an earlier one at most (up to the
    deepest level), and the place of that one, or -1. In suffix order, with ties in
    text order, it is the nearest smaller position on one of the two sides.
    """
    by_rank = np.argsort(levels[-1][1][places], kind="stable")
    order = places[by_rank]
    n = len(order)
    size, source = np.zeros(n, dtype=np.int64), np.full(n, -1)
    before = nearest_smaller(order)
    after = n - 1 - nearest_smaller(order[::-1])[::-1]
    for near in (before, after):
        has = np.flatnonzero((near >= 0) & (near < n))
        common = common_bytes(levels, data, order[has], order[near[has]])
        better = common > size[has]
        has, common = has[better], common[better]
        size[has], source[has] = common, order[near[has]]
    in_text = np.empty(n, dtype=np.int64)
    in_text[by_rank] = np.arange(n)
    return size[in_text], source[in_text]


def _match_spans(length: int, keep_first: bool):
    """Repeats among the spans of each anchor; rows come sorted by anchor and place."""

    def work(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        body = part.column(5)
        sizes = np.array([len(x) for x in body.to_pylist()], dtype=np.int64)
        data = np.frombuffer(b"".join(body.to_pylist()), dtype=np.uint8)
        offsets = np.append(0, np.cumsum(sizes))
        count = part.column(3).to_numpy()
        # Only the passages of the spans themselves, still in text order.
        inside = np.arange(len(data)) - offsets[segment_of(offsets)] < np.repeat(count, sizes)
        begins = np.flatnonzero(inside)
        factor, source = previous_factors(suffix_levels(data, length), data, begins)
        flags = factor >= length  # the whole passage came before
        if not keep_first:
            flags[np.searchsorted(begins, source[flags])] = True
            # Spans seen twice are known to be repeats as a whole.
            flags &= np.repeat(part.column(4).to_numpy() == 1, count)
        places = np.append(0, np.cumsum(count))
        # A run may not go on into the next span.
        spread = np.zeros(len(flags) + len(count), dtype=bool)
        spread[np.arange(len(flags)) + segment_of(places)] = flags
        begin, run_length = _runs(spread)
        owner = np.searchsorted(places + np.arange(len(places)), begin, side="right") - 1
        start = begin - owner - places[owner] + part.column(2).to_numpy()[owner]
        return pa.RecordBatch.from_arrays(
            [
                part.column(1).take(pa.array(owner)),
                pa.array(start, pa.int64()),
                pa.array(run_length, pa.int64()),
            ],
            names=["id", "start", "run"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            anchor = batch.column(0).to_numpy()
            body = np.array([len(x) for x in batch.column(5).to_pylist()], dtype=np.int64)
            limits = np.append(np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])), len(anchor))
            for i, (a, b) in enumerate(zip(limits[:-1], limits[1:])):
                goes_on = i == 0 and held and held[-1].column(0)[-1].as_py() == anchor[a]
                if size >= SORT_BYTES and not goes_on:
                    yield work(held)
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size += int(body[a:b].sum())
        if held:
            yield work(held)

    return run


def _hash_passages(length: int):
    """A hash of each passage of a span, for anchors with very many spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column(5)[i].as_py(), dtype=np.uint8)
                count = batch.column(3)[i].as_py()
                sums = prefix_sums(data, BYTE_VALUES)
                _, down = powers(len(data))
                plain = (sums[length : length + count] - sums[:count]) * down[:count]
                low = batch.column(2)[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(as_long(mix(plain)), pa.int64()),
                        batch.column(0).take(pa.array(np.full(count, i))),
                        batch.column(1).take(pa.array(np.full(count, i))),
                        pa.array(low + np.arange(count), pa.int64()),
                        batch.column(4).take(pa.array(np.full(count, i))),
                    ],
                    names=["passage", "anchor", "id", "start", "seen"],
                )

    return run


def _with_texts(docs: DataFrame, lists: DataFrame, of: str, how: str) -> DataFrame:
    """Documents with the list made for them. The null-safe join adds no filter of its
    own to ``docs``, so Spark can use one shuffle of the texts for both joins. The lists
    grow with the documents, so the plan is the same at every size: no broadcast."""
    joined = docs.join(lists.hint("merge"), F.col("id").eqNullSafe(F.col(of)), how)
    return joined.select(*docs.columns, *(c for c in lists.columns if c != of))


def repeat_starts(docs: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Runs of places where a repeated passage starts: ``id``, ``start``, ``run``."""
    kind = docs.schema["id"].dataType.simpleString()
    spans = write_stage(
        docs.filter("id is not null").mapInArrow(
            _anchors(length), f"anchor long, whole long, id {kind}, at long, more array<long>"
        )
    )
    low, count = F.shiftright("at", 16), F.col("at").bitwiseAND(F.lit(0xFFFF))
    # A document's equal spans are one row, so a row with more of them counts at once.
    often = spans.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("rows"), F.count("more").alias("rows_with_more")
    )
    often = often.filter("rows > 1 or rows_with_more > 0").select("anchor")
    spans = write_stage(spans.join(often, "anchor"))
    classes = spans.groupBy("anchor", "whole").agg(
        F.sum(F.when(F.col("more").isNull(), 1).otherwise(F.size("more") + 1)).alias("seen"),
        F.min(F.struct("id", "at")).alias("rep"),
    )
    classes = write_stage(classes)
    twice = classes.filter("seen > 1").select("anchor", "whole", "rep")
    more = F.coalesce("more", F.array().cast("array<bigint>"))
    starts = F.concat(F.array(low), more)
    if keep_first:
        starts = F.when(F.struct("id", "at") == F.col("rep"), more).otherwise(starts)
    whole = spans.join(twice, ["anchor", "whole"]).select(
        "id", F.explode(starts).alias("start"), count.alias("run")
    )

    groups = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("classes"))
    groups = groups.filter("classes > 1")
    asked = classes.join(groups, "anchor").select("anchor", "seen", "classes", "rep.*")
    ask = F.struct("anchor", low.alias("low"), count.alias("count"), "seen", "classes")
    spans_of = f"anchor long, id {kind}, low long, count long, seen long, body binary, classes long"

    lists = asked.groupBy(F.col("id").alias("asking")).agg(F.collect_list(ask).alias("asked"))
    with_texts = _with_texts(docs, lists, "asking", "inner")
    bodies = write_stage(with_texts.mapInArrow(_cut_spans(length), spans_of))
    large = bodies.filter(F.col("classes") > LARGEST_GROUP).drop("classes")
    usual = bodies.filter(F.col("classes") <= LARGEST_GROUP).drop("classes")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    matched = (
        usual.repartition(tasks, "anchor")
        .sortWithinPartitions("anchor", "id", "low")
        .mapInArrow(_match_spans(length, keep_first), f"id {kind}, start long, run long")
    )
    found = whole.unionByName(matched)
    if not large.isEmpty():
        passages = large.mapInArrow(
            _hash_passages(length), f"passage long, anchor long, id {kind}, start long, seen long"
        )
        passages = write_stage(passages)
        repeated = passages.groupBy("anchor", "passage").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "start")).alias("first")
        )
        again = passages.join(repeated.filter("n > 1"), ["anchor", "passage"])
        if keep_first:
            again = again.filter(F.struct("id", "start") != F.col("first"))
        found = found.unionByName(again.select("id", "start", F.lit(1).cast("long").alias("run")))
    return found


def _remove(length: int, text_at: int, found_at: int):
    """Columns of each row but the last, then n_bytes, n_removed, spans and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(found_at).to_pylist()
            others = [i for i in range(batch.num_columns) if i not in (text_at, found_at)]
            for chunk in chunks(batch.column(text_at)):
                removed, spans, kept = [], [], []
                for i in range(len(chunk)):
                    text = chunk.data[chunk.offsets[i] : chunk.offsets[i + 1]]
                    edges = np.zeros(len(text) + 1, dtype=np.int64)
                    for x in found[chunk.first + i] or ():
                        edges[x["start"]] += 1
                        edges[x["start"] + x["run"] + length - 1] -= 1
                    covered = np.cumsum(edges[:-1]) > 0
                    removed.append(int(covered.sum()))
                    spans.append([{"start": int(a), "bytes": int(b)} for a, b in zip(*_runs(covered))])
                    kept.append(text[~covered].tobytes())
                span = pa.list_(pa.struct([("start", pa.int64()), ("bytes", pa.int64())]))
                rows = batch.slice(chunk.first, len(chunk))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(rows.column(i) for i in others),
                        pa.array(np.diff(chunk.offsets), pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array(spans, span),
                        pa.array(kept, pa.binary()),
                        pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()),
                    ],
                    names=[
                        *(batch.schema.names[i] for i in others),
                        *("n_bytes", "n_removed", "spans", "kept", "kept_text"),
                    ],
                )

    return run


def _cleaned(docs: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """``docs`` (id, text and others) with what is removed and what is left."""
    if not 2 * ANCHOR <= length < 1 << 16:
        raise ValueError(f"length must be at least {2 * ANCHOR} and below {1 << 16}")
    starts = repeat_starts(docs.select("id", "text"), length, keep_first)
    lists = starts.groupBy("id").agg(F.collect_set(F.struct("start", "run")).alias("found"))
    lists = lists.withColumnRenamed("id", "found_for")
    joined = _with_texts(docs, lists, "found_for", "left")
    others = [f for f in docs.schema if f.name != "text"]
    added = T._parse_datatype_string(
        "n_bytes long, n_removed long, spans array<struct<start:long,bytes:long>>, kept binary,"
        " kept_text string"
    )
    run = _remove(length, docs.columns.index("text"), len(docs.columns))
    return joined.mapInArrow(run, T.StructType([*others, *added]))


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    keep_first: bool = True,
) -> DataFrame:
    """Texts without repeated passages: ``id_col``, n_bytes, n_removed, spans, kept.

    A byte goes if a string of ``length`` bytes that covers it also starts elsewhere,
    in the same document or another; matches never cross documents, and overlapping
    occurrences count. With ``keep_first`` the first occurrence (by id, then place)
    stays. Strings are judged on the input, not on what is left. ``spans`` are the
    removed runs, ``kept`` the other bytes (binary, as a cut may fall inside a
    character).

    A null text is empty. Ids name documents: repeated rows of one id are repeats of
    each other when all occurrences go, and one document when the first stays. Rows
    without an id are returned as they are. An empty table gives an empty result;
    other columns are not read.

    Passages are routed by their anchors, equal spans are counted before they meet,
    and an anchor shared by very many different spans is resolved by passage hashes,
    counted in parallel. Equal spans and anchors are told by 64-bit hashes of both.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _cleaned(docs, length, keep_first).drop("kept_text").withColumnRenamed("id", id_col)


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH
) -> DataFrame:
    """All rows and columns of ``docs``; later copies of passages are cut from the text.

    A character of which a cut leaves only a part goes as a whole.
    """
    row = docs.select(
        F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")
    )
    cleaned = _cleaned(row, length, keep_first=True)
    columns = [
        F.col("kept_text").alias(c) if c == text_col else F.col("row").getField(c).alias(c)
        for c in docs.columns
    ]
    return cleaned.select(*columns)
