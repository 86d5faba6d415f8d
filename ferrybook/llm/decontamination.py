"""Benchmark decontamination with spaced seeds.

A mask is laid over each run of tokens and only its marked places are hashed, so two
runs that differ at unmarked places have the same hash. Hashes of the test items are
joined with those of the training documents; every hit gives an alignment of item and
document, along which equal and substituted tokens are then counted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrybook.llm.common import cut_lineage
from ferrybook.llm.words import as_long, chunks, mix, powers, punctuation_table, split_words

#: Masks of six tokens each. At least one of them hits any run of 13 to 25 tokens of which
#: three quarters are equal, wherever these are (tests/llm checks all cases); a longer run
#: has such a one in it.
MASKS = (
    "1111010001", "11101011", "11001000111", "110010111",
    "101000011011", "1100001000111", "111111", "1110111",
)
#: A reported overlap has this many tokens at least (or the whole of a shorter item),
#: of which this share is equal.
LEAST_TOKENS, LEAST_EQUAL = 13, 0.75
#: The filter of test hashes has three parts. Each has eight bits for every seed, within
#: 2**22 and 2**26 bits; a fuller filter lets more documents pass, and loses none.
FILTER_PARTS, LEAST_BITS, MOST_BITS = 3, 22, 26


def seed_hashes(tokens: np.ndarray, masks: Sequence[str] = MASKS) -> Iterator[np.ndarray]:
    """For each mask, the hash of the marked tokens at every place it fits."""
    up, _ = powers(64)
    for number, mask in enumerate(masks):
        n = len(tokens) - len(mask) + 1
        if n <= 0:
            yield np.zeros(0, dtype=np.uint64)
            continue
        out = np.full(n, number + 1, dtype=np.uint64)
        for place, mark in enumerate(mask):
            if mark == "1":
                out += tokens[place : place + n] * up[place + 1]
        yield mix(out)


def _filter_slots(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return [(hashes >> np.uint64(21 * i)) & mask for i in range(FILTER_PARTS)]


def _item_seeds(masks: Sequence[str], whole: Sequence[str]):
    """Masks of ``whole`` are laid over items of their own length only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        separators = punctuation_table()
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                words = split_words(chunk, separators)
                rows, hashes = [], []
                for i in range(len(chunk)):
                    tokens = words.hashes[words.offsets[i] : words.offsets[i + 1]]
                    for mask, found in zip((*masks, *whole), seed_hashes(tokens, (*masks, *whole))):
                        if mask in whole and len(tokens) != len(mask):
                            continue
                        found = np.unique(found)
                        rows.append(np.full(len(found), chunk.first + i))
                        hashes.append(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.concatenate(rows))),
                        pa.array(as_long(np.concatenate(hashes)), pa.int64()),
                    ],
                    names=["item", "seed"],
                )

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    separators = punctuation_table()
    for batch in batches:
        for chunk in chunks(batch.column(1)):
            words = split_words(chunk, separators)
            lists = pa.ListArray.from_arrays(
                pa.array(words.offsets, pa.int32()), pa.array(as_long(words.hashes), pa.int64())
            )
            ids = batch.column(0).slice(chunk.first, len(chunk))
            yield pa.RecordBatch.from_arrays([ids, lists], names=["item", "item_tokens"])


def _document_hits(masks: Sequence[str], shared, bits: int):
    """Documents with a hash that passes the filter: their tokens and those hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        separators, filled = punctuation_table(), shared.value
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                words = split_words(chunk, separators)
                place, seed = [], []
                for mask, found in zip(masks, seed_hashes(words.hashes, masks)):
                    ok = np.ones(len(found), dtype=bool)
                    for part, slot in enumerate(_filter_slots(found, bits)):
                        byte = filled[part][slot >> np.uint64(3)]
                        ok &= (byte >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    at = np.flatnonzero(ok)
                    row = np.searchsorted(words.offsets, at, side="right") - 1
                    at = at[at + len(mask) <= words.offsets[row + 1]]  # within one text
                    place.append(at)
                    seed.append(found[at])
                place, seed = np.concatenate(place), np.concatenate(seed)
                row = np.searchsorted(words.offsets, place, side="right") - 1
                order = np.argsort(row, kind="stable")
                row, place, seed = row[order], place[order], seed[order]
                rows, first = np.unique(row, return_index=True)
                limits = np.append(first, len(row))
                tokens = [as_long(words.hashes[words.offsets[r] : words.offsets[r + 1]]) for r in rows]
                hits = [
                    [
                        {"seed": int(s), "at": int(p)}
                        for s, p in zip(as_long(seed[a:b]), place[a:b] - words.offsets[r])
                    ]
                    for r, a, b in zip(rows, limits[:-1], limits[1:])
                ]
                where = pa.array(rows + chunk.first, pa.int64())
                hit = pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(where),
                        batch.column(1).take(where),
                        pa.array(tokens, pa.list_(pa.int64())),
                        pa.array(hits, hit),
                    ],
                    names=["id", "text_hash", "tokens", "hits"],
                )

    return run


def best_overlap(document: np.ndarray, item: np.ndarray, offset: int) -> tuple[int, int, int]:
    """The longest run along an alignment: start in the document, tokens, equal tokens.

    It begins and ends with an equal token, and at least ``LEAST_EQUAL`` of its tokens
    are equal; of equally long ones that with most equal tokens, then the first. An item
    below ``LEAST_TOKENS`` that lies in the document as a whole may end in substitutions.
    """
    start, end = max(0, offset), min(len(document), offset + len(item))
    equal = document[start:end] == item[start - offset : end - offset]
    places = np.flatnonzero(equal)
    if not len(places):
        return start, 0, 0
    if end - start == len(item) < LEAST_TOKENS and len(places) >= LEAST_EQUAL * len(item):
        return start, len(item), len(places)
    # From the a-th to the b-th equal token there are b - a + 1 equal ones, so the run is
    # good if its low[a] is at most its high[b].
    at = np.arange(len(places))
    low, high = at - LEAST_EQUAL * places, at + 1 - LEAST_EQUAL * (places + 1)
    first = np.searchsorted(-np.minimum.accumulate(low), -high)
    tokens, n_equal = places - places[first] + 1, at - first + 1
    best = np.lexsort((at, -n_equal, -tokens))[0]
    return start + int(places[first[best]]), int(tokens[best]), int(n_equal[best])


def alignments(
    seeds: np.ndarray, places: np.ndarray, item: np.ndarray, masks: Sequence[str]
) -> np.ndarray:
    """Offsets of an item at which a document's hits (seeds, sorted, and places) meet its own.

    Places of the item are gone through one by one, so repetitive texts, of which each
    place meets many, need memory for the distinct offsets only.
    """
    found = [np.zeros(0, dtype=np.int64)]
    for own in seed_hashes(item, masks):
        own = as_long(own)
        low, high = np.searchsorted(seeds, own, "left"), np.searchsorted(seeds, own, "right")
        for at in np.flatnonzero(high > low):
            found.append(places[low[at] : high[at]] - at)
            if len(found) > 256:
                found = [np.unique(np.concatenate(found))]
    return np.unique(np.concatenate(found))


def _verify(masks: Sequence[str]):
    """The best overlap of each pair of a document and an item, if it is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "text_hash", "item", "start", "n_tokens", "n_equal"]
        for batch in batches:
            keep, found = [], []
            for i in range(batch.num_rows):
                document = np.asarray(batch.column(3)[i].values, dtype=np.int64)
                item = np.asarray(batch.column(4)[i].values, dtype=np.int64)
                hits = batch.column(5)[i].values
                seeds, places = (np.asarray(hits.field(c), dtype=np.int64) for c in (0, 1))
                order = np.argsort(seeds, kind="stable")
                offsets = alignments(seeds[order], places[order], item.view(np.uint64), masks)
                runs = [best_overlap(document, item, int(o)) for o in offsets]
                runs = [x for x in runs if x[1] >= min(LEAST_TOKENS, len(item))]
                if runs:
                    keep.append(i)
                    found.append(max(runs, key=lambda x: (x[2], -x[1], -x[0])))
            where = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(where) for c in range(3)]
                + [pa.array([f[c] for f in found], pa.int64()) for c in range(3)],
                names=names,
            )

    return run


def _test_filter(seeds: DataFrame, bits: int) -> np.ndarray:
    """Bit map of the test hashes, eight to a byte."""
    parts = []
    for part in range(FILTER_PARTS):
        slot = F.shiftrightunsigned("seed", 21 * part).bitwiseAND(F.lit((1 << bits) - 1))
        parts.append(F.struct(F.lit(part).alias("part"), slot.alias("slot")))
    words = (
        seeds.select(F.inline(F.array(*parts)))
        .groupBy("part", F.shiftright("slot", 5).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 as int))")).alias("bits"))
    )
    filled = np.zeros((FILTER_PARTS, 1 << (bits - 5)), dtype="<u4")
    found = words.toArrow()  # at most three times 2**21 rows
    part, word, value = (found.column(c).to_numpy() for c in range(3))
    filled[part, word] = value.astype(np.uint32)
    return filled.view(np.uint8)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    masks: Sequence[str] = MASKS,
) -> DataFrame:
    """Overlaps of documents with test items, one row per document and item.

    Returns ``id_col``, text_hash (of the document), ``item_col``, start (token in the
    document), n_tokens and n_equal of the overlap with most equal tokens. Tokens are runs of digits,
    letters and non-ASCII characters with A-Z lower-cased, so case and punctuation do
    not matter. An overlap may hold substituted tokens but no inserted ones; beyond an
    insertion it is two overlaps.

    Null and empty texts overlap with nothing. Items with fewer tokens than the shortest
    mask are looked up as a whole, so they are found verbatim only; other items below
    ``LEAST_TOKENS`` are found with substitutions where a mask fits between these. Repeated
    rows give one row. Documents without an id are told apart by their texts. Empty tables
    give an empty result; other columns are not read.

    Documents go through a filter of bounded size before anything is shuffled: only
    documents with a hash that may be one of the test hashes are sent on, with their
    tokens once. The join on hashes decides; the filter only saves work. A document and
    an item meet once, however often they share a seed; their alignments are found where
    both are.
    """
    docs = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")
    )
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    id_kind, item_kind = (
        docs.schema["id"].dataType.simpleString(),
        items.schema["item"].dataType.simpleString(),
    )
    item_tokens = items.mapInArrow(_tokens, f"item {item_kind}, item_tokens array<long>")
    short = item_tokens.select(F.size("item_tokens").alias("n")).distinct()
    short = short.filter(F.col("n").between(1, min(map(len, masks)) - 1)).collect()  # five lengths at most
    whole = tuple("1" * n for n in sorted(r.n for r in short))
    seeds = items.mapInArrow(_item_seeds(masks, whole), f"item {item_kind}, seed long")
    seeds = cut_lineage(seeds.distinct())
    bits = min(MOST_BITS, max(LEAST_BITS, (8 * seeds.count()).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(_test_filter(seeds, bits))
    hits = docs.mapInArrow(
        _document_hits((*masks, *whole), shared, bits),
        f"id {id_kind}, text_hash long, tokens array<long>, hits array<struct<seed:long,at:long>>",
    )
    hits = cut_lineage(hits)
    meeting = (
        hits.select("id", "text_hash", F.explode(F.array_distinct("hits.seed")).alias("seed"))
        .join(seeds, "seed")
        .select("id", "text_hash", "item")
        .distinct()
    )
    documents = hits.select(
        F.col("id").alias("doc"), F.col("text_hash").alias("doc_hash"), "tokens", "hits"
    )
    same = F.col("id").eqNullSafe(F.col("doc")) & (F.col("text_hash") == F.col("doc_hash"))
    pairs = (
        meeting.join(documents, same)
        .withColumnRenamed("item", "of_item")
        .join(item_tokens, F.col("of_item").eqNullSafe(F.col("item")))
        .select("id", "text_hash", "item", "tokens", "item_tokens", "hits")
    )
    verified = pairs.mapInArrow(
        _verify((*masks, *whole)),
        f"id {id_kind}, text_hash long, item {item_kind}, start long, n_tokens long, n_equal long",
    )
    best = F.max_by(F.struct("start", "n_tokens", "n_equal"), F.struct("n_equal", -F.col("start")))
    return (
        verified.groupBy("id", "text_hash", "item")
        .agg(best.alias("best"))
        .select(F.col("id").alias(id_col), "text_hash", F.col("item").alias(item_col), "best.*")
    )


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names: str
) -> DataFrame:
    """The rows of ``docs`` that overlap with no test item; all columns are kept."""
    found = contaminated(docs, benchmark, id_col, text_col, **names)
    found = found.select(F.col(id_col).alias("found"), F.col("text_hash").alias("found_hash")).distinct()
    # The columns travel as one, so that none of them can clash with a name used here.
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    same = F.col("id").eqNullSafe(F.col("found")) & (F.col("hash") == F.col("found_hash"))
    return rows.join(found, same, "left_anti").select("row.*")
